import pytest


@pytest.fixture
def frame(spark):
    """Documents from texts: ids count from 0, or (id, text) pairs are given; two extra columns with clashing names."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, spans string, block string, score string").repartition(3)

    return make

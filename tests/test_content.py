"""The cache by content: what is scored, kept and removed."""

import pytest
from pyspark.sql import functions as F

from sievelight.streaming import content


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def test_refresh(spark, tmp_path):
    path, seen = f"file://{tmp_path}/cache", []

    def score(df):
        seen.append(sorted(r["id"] for r in df.collect()))
        return df.select("id", F.length(F.coalesce("text", F.lit(""))).alias("score"))

    assert content.cached(spark, path).count() == 0
    first = [(i, "x" * i) for i in range(6)] + [(6, None), (None, "lost"), (5, "xxxxx")]
    assert content.refresh(docs(spark, first), path, score) == {"kept": 0, "scored": 7, "removed": 0}
    assert content.refresh(docs(spark, first), path, score) == {"kept": 7, "scored": 0, "removed": 0}
    changed = [(0, ""), (1, "longer"), (2, "xx"), (6, "no longer null"), (9, "new")]
    assert content.refresh(docs(spark, changed), path, score) == {"kept": 2, "scored": 3, "removed": 5}
    assert seen == [[0, 1, 2, 3, 4, 5, 6], [], [1, 6, 9]]
    assert {r["id"]: r["score"] for r in content.cached(spark, path).collect()} == {0: 0.0, 1: 6.0, 2: 2.0, 6: 14.0, 9: 3.0}
    assert content.refresh(docs(spark, [(2, "yy"), (20, "z")]), path, score, whole=False) == {"kept": 4, "scored": 2, "removed": 1}
    assert len([p for p in (tmp_path / "cache").iterdir() if p.name.startswith("scores-")]) == 1
    assert content.refresh(docs(spark, []), path, score) == {"kept": 0, "scored": 0, "removed": 6}


def test_a_failed_refresh_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    content.refresh(docs(spark, [(1, "a")]), path, lambda df: df.select("id", F.lit(0.5).alias("score")))
    for broken in (lambda df: df.select("id", F.lit(float("nan")).alias("score")), lambda df: df.where("id < 0").select("id", F.lit(1.0).alias("score"))):
        with pytest.raises(Exception, match="no finite score"):
            content.refresh(docs(spark, [(1, "b")]), path, broken)
        assert [tuple(r)[::2] for r in content.cached(spark, path).collect()] == [(1, 0.5)]


def test_stream(spark, tmp_path):
    path, source = f"file://{tmp_path}/cache", f"file://{tmp_path}/in"
    score = lambda df: df.select("id", F.length("text").alias("score"))
    for part in ([(1, "a"), (2, "bb")], [(2, "ccc"), (3, "d")]):
        docs(spark, part).coalesce(1).write.mode("append").json(source)
        content.refresh_stream(spark.readStream.schema("id long, text string").json(source), path, f"file://{tmp_path}/ck", score).awaitTermination()
    assert {r["id"]: r["score"] for r in content.cached(spark, path).collect()} == {1: 1.0, 2: 3.0, 3: 1.0}

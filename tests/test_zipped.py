"""The zip source: limits, broken lines, splits, and the commit in two steps."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievelight.sources import zipped


@pytest.fixture
def read(spark):
    zipped.register(spark)
    return lambda path, **o: spark.read.format("zip_jsonl").options(path=f"file://{path}", member="m.jsonl", **o).load()


def test_limits_and_broken_lines(read, tmp_path):
    lines = [json.dumps({"text": "short"}), "", "not json", json.dumps({"other": 1}), json.dumps({"text": "  long enough é "}), json.dumps({"text": None}), json.dumps({"text": "long enough too"}), json.dumps({"text": "and this one too"})]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.jsonl", "\n".join(lines) + '\n{"text": "half a li')
    at = lambda **o: [r["nth"] for r in read(tmp_path / "a.zip", **o).orderBy("nth").collect()]
    assert at() == [0, 4, 6, 7] and at(low=8) == [4, 6, 7] and at(low=8, high=15) == [4, 6] and at(low=8, want=2) == [4, 6] and at(most=7) == [0, 4, 6] and at(want=0) == []


def test_round_trip_in_splits(spark, read, tmp_path):
    df = spark.range(0, 1000, 1, 5).select(F.col("id"), F.concat(F.lit("text é\n"), "id").alias("text"))
    for _ in range(2):
        df.write.format("zip_jsonl").mode("append").option("path", f"file://{tmp_path}/out").option("member", "m.jsonl").save()
    back = read(tmp_path / "out")
    assert back.rdd.getNumPartitions() == 10 and back.count() == 2000
    assert {r["text"] for r in back.collect()} == {f"text é\n{i}" for i in range(1000)}


def test_a_failed_write_leaves_nothing(spark, read, tmp_path):
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("zip_jsonl").mode("append").option("path", f"file://{tmp_path}/out").option("member", "m.jsonl").save()
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_staged")] == []
    assert read(tmp_path / "out").count() == 0
    with pytest.raises(Exception, match="only appends"):
        bad.write.format("zip_jsonl").mode("overwrite").option("path", f"file://{tmp_path}/out").option("member", "m.jsonl").save()


def test_tasks_hold_few_rows(spark, read, tmp_path, monkeypatch):
    """Rows are read and written in batches of bounded size, however many Spark hands over."""
    reader = zipped.ZipReader({"path": f"file://{tmp_path}/out", "member": "m.jsonl"})
    df = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("é"), "id")).alias("text"), F.array("id").alias("more"))
    df.write.format("zip_jsonl").mode("append").option("path", f"file://{tmp_path}/out").option("member", "m.jsonl").save()
    (file,) = reader.partitions()
    assert [b.num_rows for b in reader.read(file)] == [256, 244]
    monkeypatch.setattr(zipped, "CHARS", 40)
    assert max(b.num_rows for b in reader.read(file)) == 15 and sum(b.num_rows for b in reader.read(file)) == 500
    with zipfile.ZipFile(file.path.removeprefix("file://")) as z:
        assert [json.loads(line) for line in z.read("m.jsonl").splitlines()] == [{"id": i, "text": None if i % 2 else f"é{i}", "more": [i]} for i in range(1000)]
    assert {(r["nth"], r["text"]) for r in read(tmp_path / "out").collect()} == {(i, f"é{i}") for i in range(0, 1000, 2)}

"""A cache of scores by content: a row counts as long as its document has the text that it was made of.

The key is the id with the SHA-256 of the text. A refresh scores what is new or changed, keeps what is the same, leaves out what is gone, writes
the table anew and then moves one small file that names it, in one step, over the old one; readers see the old table or the new one,
and a refresh that fails changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, digest string, score double"
Scorer = Callable[[DataFrame], DataFrame]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _named(spark: SparkSession, path: str) -> str | None:
    """The folder of the table that counts now."""
    fs, p = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(p):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def _swap(spark: SparkSession, path: str, name: str) -> None:
    fs, staged = _fs(spark, f"{path}/_{name}")
    out = fs.create(staged, False)
    out.write(bytearray(name.encode()))
    out.close()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    _, to = _fs(spark, f"{path}/CURRENT")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(to), options)


def cached(spark: SparkSession, path: str) -> DataFrame:
    """(id, digest, score); empty before the first refresh."""
    name = _named(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/{name}") if name else spark.createDataFrame([], SCHEMA)


def refresh(docs: DataFrame, path: str, score: Scorer, whole: bool = True) -> dict[str, int]:
    """Brings the cache at ``path`` up to date with ``docs`` (id, text): how many rows were kept, scored and removed.

    ``score`` takes (id, text) and returns (id, score); a document without a score, or with one that isn't finite, is an error. With ``whole``
    ``docs`` are all documents, and ids that aren't among them go; without it, as in a stream, they stay. Of rows that repeat an id one counts,
    that with the smallest digest; null ids are left out, and a null text is one of its own kind.
    """
    spark = docs.sparkSession
    was, old = cached(spark, path), _named(spark, path)
    digest = F.coalesce(F.sha2("text", 256), F.lit("-"))
    now = docs.select(F.col("id").cast("long").alias("id"), "text", digest.alias("digest")).where("id is not null")
    first = now.groupBy("id").agg(F.min("digest").alias("digest"))
    same = was.join(first, ["id", "digest"], "left_semi")
    todo = first.join(was.select("id", "digest"), ["id", "digest"], "left_anti")
    texts = now.join(todo, ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "text")
    scored = todo.join(score(texts).select("id", F.col("score").cast("double").alias("score")), "id", "left")
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    fine = F.when(bad, F.raise_error(F.concat(F.lit("no finite score: "), F.col("id").cast("string")))).otherwise(F.col("score"))
    fresh = scored.select("id", "digest", fine.alias("score"), F.lit(1).alias("new"))
    rest = same if whole else was.join(first, "id", "left_anti").unionByName(same)
    name = f"scores-{uuid.uuid4().hex}"
    made = rest.withColumn("new", F.lit(0)).unionByName(fresh)
    made.write.parquet(f"{path}/{name}")
    n, new = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)), F.coalesce(F.sum("new"), F.lit(0))).first()
    before = was.count()
    _swap(spark, path, name)
    if old:
        fs, p = _fs(spark, f"{path}/{old}")
        fs.delete(p, True)
    return {"kept": n - new, "scored": new, "removed": before - (n - new)}


def refresh_stream(docs: DataFrame, path: str, checkpoint: str, score: Scorer):
    """The same for a stream of documents: each micro-batch brings its ids up to date, so a replay scores nothing."""
    return docs.writeStream.foreachBatch(lambda batch, _: refresh(batch, path, score, whole=False)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

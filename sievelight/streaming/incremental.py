"""Scores only documents that a cache lacks, as a batch and as a stream with the same function."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_ROLES = ("baseline", "train", "val")


def check_role(role: str, final: bool = False) -> None:
    """The held-out role needs ``final``; names are letters, digits, dots, dashes and underscores."""
    if role not in (*OPEN_ROLES, "test"):
        raise ValueError(f"unknown role {role!r}")
    if role == "test" and not final:
        raise PermissionError("the held-out role is read only in a final run")


def check_name(name: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9_.\-]+", name):
        raise ValueError(f"bad signal name {name!r}")


def missing(docs: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    return docs.join(cache.select(key), key, "left_anti")


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row that changes whenever an id or text does."""
    part = F.conv(F.substring(F.sha1(F.concat_ws("|", F.col("id").cast("string"), "text")), 1, 15), 16, 10).cast("decimal(38,0)")
    return docs.agg(F.sha1(F.concat_ws("|", F.sum(part).cast("string"), F.count(F.lit(1)).cast("string"))).alias("fingerprint"))


def _cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "id long, score double")


def score_missing(docs: DataFrame, path: str, score) -> int:
    """Appends (id, score) of documents that the table at ``path`` lacks; a score that isn't finite is an error. Idempotent."""
    spark = docs.sparkSession
    todo = score(missing(docs, _cache(spark, path)).dropDuplicates(["id"])).select("id", "score")
    checked = todo.withColumn("score", F.when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), F.raise_error(F.concat(F.lit("score is not finite: "), F.col("id").cast("string")))).otherwise(F.col("score")))
    before = _cache(spark, path).count()
    checked.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def stream_scores(docs: DataFrame, path: str, checkpoint: str, score):
    """The streaming form: each micro-batch goes through ``score_missing``, so replays add nothing."""
    return docs.writeStream.foreachBatch(lambda batch, _: score_missing(batch, path, score)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Score and embedding caches keyed by seed and split, evaluation-set checks, exclusive result sinks and the one-shot lock."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.streaming.incremental import check_name, missing


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def create_exclusively(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that must not exist yet; FileExistsError if it does, whoever came first."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if exists(spark, path):
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def write_once(results: dict[str, DataFrame], folder: str, name: str, facts: dict | None = None) -> None:
    """Result tables under ``folder``, each as Parquet, after a lock of that name was taken: a second run is refused.

    Every table is computed before the lock is, so that a failing query doesn't use up the only run.
    """
    check_name(name)
    some = next(iter(results.values())).sparkSession
    staged = {k: f"{folder}/_staged-{uuid.uuid4().hex}-{k}" for k in results}
    for k, df in results.items():
        check_name(k)
        df.write.parquet(staged[k])
    fs, _ = _fs(some, folder)
    path = some.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        create_exclusively(some, f"{folder}/{name}.lock", json.dumps(facts or {}, sort_keys=True))
    except FileExistsError:
        for s in staged.values():
            fs.delete(path(s), True)
        raise
    for k, s in staged.items():
        fs.rename(path(s), path(f"{folder}/{name}-{k}"))


def score_path(folder: str, seed: int, split_hash: str, signal: str) -> str:
    """The cache of a signal for one split: a partition by seed and split hash."""
    check_name(signal)
    return f"{folder}/seed={seed}/split_hash={split_hash}/{signal}"


def find_scores(spark: SparkSession, folder: str, seed: int, split_hash: str, signal: str, override: str | None = None) -> DataFrame:
    """The cached scores of a split; ``override`` names another table. FileNotFoundError says what is there instead."""
    path = override or score_path(folder, seed, split_hash, signal)
    if not exists(spark, path):
        raise FileNotFoundError(f"no scores of {signal!r} for seed {seed} and split {split_hash} under {folder}")
    return spark.read.parquet(path)


def checked_evalset(rows: DataFrame, prefix: str = "ext_") -> DataFrame:
    """(problem, n) of an external evaluation set: repeated ids, null ids, sources without the prefix; no rows if it's fit."""
    repeated = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit("repeated id").alias("problem"), F.count(F.lit(1)).alias("n"))
    none = rows.where("id is null").agg(F.lit("null id").alias("problem"), F.count(F.lit(1)).alias("n"))
    named = rows.where(~F.coalesce(F.col("source").startswith(prefix), F.lit(False))).agg(F.lit(f"source without {prefix}").alias("problem"), F.count(F.lit(1)).alias("n"))
    return repeated.unionAll(none).unionAll(named).where("n > 0")


def extend_embeddings(docs: DataFrame, path: str, encoder) -> int:
    """Appends (id, embedding) of documents that the table at ``path`` lacks, and says how many (S16). Idempotent."""
    spark = docs.sparkSession
    known = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], "id long, embedding array<double>")
    before = known.count()
    todo = missing(docs, known).dropDuplicates(["id"])
    encoder(todo).select("id", "embedding").write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def append_signal_csv(scores: DataFrame, path: str) -> int:
    """Appends (id, score, ms) of ids that the CSV table at ``path`` lacks, in files that appear whole or not at all.

    A half-written last line, as an interrupted writer of another kind may leave, is dropped by the reader and scored again.
    """
    from sievelight.sources.readers import read_signal_csv

    spark = scores.sparkSession
    known = read_signal_csv(spark, path) if exists(spark, path) else spark.createDataFrame([], "id string, score double, ms double")
    before = known.count()
    todo = missing(scores.select(F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"), F.col("ms").cast("double").alias("ms")), known).dropDuplicates(["id"])
    todo.write.mode("append").csv(path, header=True)
    return read_signal_csv(spark, path).count() - before

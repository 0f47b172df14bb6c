"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Toxic documents go; of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the one with the smallest id
stays; word spans of 50 words or more that a document shares with one of smaller id are removed from its text; documents with a
benchmark item go; what is left is encoded and decoded by the byte-pair transducer. All stages but the last return the
columns of their input. Null and empty texts pass through every filter: they are not toxic, have no shingles and no spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import bpe, decontaminate, near_dedup, substring_dedup, toxicity
from sievelight.llm.common import save


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled ones, scores under 0.5."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents linked at a similarity of 0.8."""
    return near_dedup.keep_first(docs)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the spans that start in a smaller one."""
    return substring_dedup.without_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_spans),
    ("decontamination", drop_benchmark),
    ("bpe", encode_texts),
]
#: SQL can't express the learned, hashed and automaton stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; the tables between them are written in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Deduplication with label conflicts, id guards, length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import strip
from sievelight.operators.ordered import at_rank, counted, quantiles
from sievelight.shared import saved


def _key() -> Column:
    return F.sha2(strip(F.col("text")), 256).alias("_key")


def _judged(keyed: DataFrame, order: str) -> DataFrame:
    per = keyed.groupBy("_key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.min(order).alias("_first"))
    fate = F.when(F.col("_lo") < F.col("_hi"), "conflict").when(F.col(order) == F.col("_first"), "kept").otherwise("dup")
    return keyed.join(per, "_key").withColumn("fate", fate).drop("_key", "_lo", "_hi", "_first")


def dedupe(rows: DataFrame, order: str = "id") -> DataFrame:
    """Adds ``fate``: ``conflict`` if the stripped text has two labels, else ``kept`` for the first of (text, label), else ``dup``.

    Texts are compared by the SHA-256 of the stripped text, so groups are made of digests. The first row and the labels of a
    text are aggregates, combined before the shuffle; a text that a third of all rows share is one group of them.
    """
    return _judged(rows.select("*", _key()), order)


def fates(rows: DataFrame, order: str = "id") -> DataFrame:
    """(order, label, fate) of each row, as ``dedupe`` has it: texts are read once for their digests, which are written, and no text moves."""
    return _judged(saved(rows.select(order, "label", _key()), "digests"), order)


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "attack_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("n_clean"), F.count_if(F.col("label") == 1).alias("n_poisoned"))


def length_summary(rows: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """n, median, p25, p75 by the exclusive quantile rule ((n + 1) p, clamped), truncated to integers; from running counts of lengths."""
    n = F.col("k_all")
    out = [F.max(n).alias("n")]
    for name, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75)):
        # position j is clamped to 1 .. n - 1 and the value interpolates between ranks j and j + 1
        place = F.lit(p) * (n + 1)
        j = F.least(F.greatest(F.floor(place), F.lit(1)), F.greatest(n - 1, F.lit(1)))
        here, nxt = at_rank("v", j - 1), at_rank("v", j)
        out.append(F.floor(F.coalesce(here + F.max(place - j) * (nxt - here), here)).cast("long").alias(name))
    return counted(rows.withColumn("v", F.col(length).cast("double")), by, "v").groupBy(*by).agg(*out)


def pool_stats(rows: DataFrame) -> DataFrame:
    """Per source: median lengths of both labels, their ratio, and whether it is outside 0.5 to 2."""
    each = quantiles(rows, ["source", "label"], "length", [0.5])
    med = each.groupBy("source").agg(*(F.max(F.when(F.col("label") == k, F.col("q")[0])).alias(c) for k, c in enumerate(("clean_median", "poisoned_median"))))
    ratio = F.try_divide("poisoned_median", "clean_median")
    return med.withColumn("ratio", F.round(ratio, 6)).withColumn("outside", ((ratio < 0.5) | (ratio > 2)).cast("int"))

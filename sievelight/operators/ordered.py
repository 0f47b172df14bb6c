"""Running sums and exact quantiles of a distributed column.

Rows are first counted by distinct value, combined before the shuffle. The counts are range-partitioned by group and value
and written with the number of their range; one small row per range and group, summed over the ranges before it, tells each range where it
begins. So a running sum is a window within a range, a quantile is a look-up of two ranks by aggregates, and no task ever holds
all values of a group: ranges are as even as Spark's sample makes them, whatever the values and however few the groups are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.shared import saved


def ranges(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts`` in the order of (by, value), written in as many ranges as there are shuffle partitions, with the range's number."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = counts.select(*by, value, *(F.coalesce(c, F.lit(0)).alias(c) for c in sums))
    return saved(keep.repartitionByRange(n, *by, value).withColumn("_range", F.spark_partition_id()), "ranges")


def running(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts`` (one row per ``by`` and ``value``) with, for each c of ``sums``, ``c_upto``: its sum over the rows of the group
    up to this value, and ``c_all``; and with ``previous``, the next smaller value of the group.

    A null value stands before all others and a null group is a group; sums of nothing are 0. An empty table gives no rows.
    """
    ranged = ranges(counts, by, value, sums)
    per = ranged.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in sums), F.max(value).alias("_last"))  # a row per range and group
    order = Window.partitionBy(*by).orderBy("_range")
    begins = per.select(
        *by, "_range", F.lag("_last").over(order).alias("_last"),
        *(x for c in sums for x in ((F.sum(f"_{c}").over(order) - F.col(f"_{c}")).alias(f"_{c}"), F.sum(f"_{c}").over(Window.partitionBy(*by)).alias(f"{c}_all"))),
    )
    within = Window.partitionBy(*by, "_range").orderBy(value)
    local = ranged.select("*", F.lag(value).over(within).alias("_lag"), F.row_number().over(within).alias("_nth"), *(F.sum(c).over(within).alias(f"{c}_upto") for c in sums))
    same = F.lit(True)
    for c in [*by, "_range"]:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = local.alias("r").join(begins.alias("b"), same)
    return met.select(
        *(F.col(f"r.{c}") for c in [*by, value, *sums]),
        F.when(F.col("_nth") == 1, F.col("b._last")).otherwise(F.col("_lag")).alias("previous"),
        *(x for c in sums for x in ((F.col(f"{c}_upto") + F.col(f"_{c}")).alias(f"{c}_upto"), F.col(f"{c}_all"))),
    )


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``running`` over the numbers of rows with each value, as (by..., value, k, previous, k_upto, k_all); null values don't count."""
    return running(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k")), by, value, ["k"])


def at_rank(value: str, rank: Column) -> Column:
    """Over a group of ``counted``: the value of that rank, from 0; null past either end. ``rank`` may use ``k_all``."""
    return F.max(F.when((F.col("k_upto") - F.col("k") <= rank) & (rank < F.col("k_upto")), F.col(value)))


def at_place(value: str, place: Column) -> Column:
    """The value at a place between two ranks, linear between their values, as numpy's and Spark's exact quantiles have it."""
    low = F.floor(F.round(place, 9))
    part = F.max(F.when(F.abs(place - low) < 1e-9, 0.0).otherwise(place - low))
    one, two = at_rank(value, low).cast("double"), at_rank(value, low + 1).cast("double")
    return F.when(part == 0, one).otherwise((1 - part) * one + part * two)


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by..., n, q): the quantiles of a group's values at ``shares``, in their order, and how many values aren't null."""
    every = [at_place(value, (F.col("k_all") - 1) * F.lit(float(p))) for p in shares]
    return counted(rows, by, value).groupBy(*by).agg(F.max("k_all").alias("n"), F.array(*every).alias("q"))


def wide_quantiles(rows: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """One row: for each of ``columns`` an array of its quantiles at ``shares``; null without values."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")
    q = quantiles(long, ["name"], "value", shares)
    return q.agg(*(F.max(F.when(F.col("name") == c, F.col("q"))).alias(c) for c in columns))

"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows that each input partition sends to each shard are drawn from the multivariate hypergeometric distribution that a uniform
random permutation of all rows would give, so shard sizes are exact without any row being looked at. The matrix is never held: its
rows are the leaves of a tree over the partitions, in which each node's counts are dealt to its two halves by a draw seeded with
the node, and a task draws the path to its own row. Each partition deals its rows to the shards in random order (the local
permutation); one exchange brings them together; a second random order in the shard gives the slots. That order is by random
keys, cut into key ranges of bounded size, so no task sorts a whole shard: the counts of the ranges give each range its first
slot. All randomness comes from the seed, the partition number and the row's place in its sorted partition, so a task that runs
again after a lost executor deals its rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm.common import bounded_batches

#: Mean rows of a key range; a range is ordered within one task.
RANGE_ROWS = 50_000
KEY_BITS = 62
#: numpy draws hypergeometric numbers for totals under this.
NUMPY_MOST = 1_000_000_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most, the larger first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int, most: int = NUMPY_MOST) -> int:
    """How many of ``drawn`` taken from ``good`` and ``bad`` ones are good, for totals of any size.

    Above numpy's bound each one is first taken with the same chance, which by its number alone is a uniform choice of that
    number; then as many more as are missing are drawn from the rest, or as many too many from those taken, which is the
    same problem with about the square root of the draws. The law is exact.
    """
    out, sign = 0, 1
    while drawn and good and good + bad >= most:
        share = drawn / (good + bad)
        a, b = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
        out += sign * a
        if a + b <= drawn:
            good, bad, drawn = good - a, bad - b, drawn - a - b
        else:
            good, bad, drawn, sign = a, b, a + b - drawn, -sign
    if drawn and good:
        out += sign * (drawn if not bad else int(rng.hypergeometric(good, bad, drawn)))
    return out


def deal(rng: np.random.Generator, counts: np.ndarray, drawn: int) -> np.ndarray:
    """How many of each kind are among ``drawn`` taken at random from ``counts`` of each: multivariate hypergeometric."""
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for k, n in enumerate(counts.tolist()):
        out[k] = hypergeometric(rng, n, rest - n, drawn)
        rest -= n
        drawn -= int(out[k])
    return out


def matrix_row(ends: np.ndarray, sizes: list[int], seed: int, part: int) -> np.ndarray:
    """Row ``part`` of the communication matrix: rows that it sends to each shard. ``ends`` are running sums of partition rows.

    The first half of a node's partitions gets as many rows as it has, drawn from the node's counts; the second the rest.
    """
    counts, lo, hi = np.array(sizes, np.int64), 0, len(ends) - 1
    while hi - lo > 1:
        middle = (lo + hi) // 2
        first = deal(np.random.default_rng([seed, lo, hi]), counts, int(ends[middle] - ends[lo]))
        if part < middle:
            counts, hi = first, middle
        else:
            counts, lo = counts - first, middle
    return counts


def communication_matrix(partition_rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """All rows of the matrix, for a look at it; rows and columns sum exactly."""
    ends = np.concatenate([[0], np.cumsum(partition_rows)]).astype(np.int64)
    return np.array([matrix_row(ends, sizes, seed, p) for p in range(len(partition_rows))]).reshape(len(partition_rows), len(sizes))


def _deal(shared, sizes: list[int], seed: int):
    """Appends to each row its shard and a random key; rows of a partition come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = keys = None
        at = 0
        for b in batches:
            if not b.num_rows:
                continue
            if labels is None:
                part = b.column(0)[0].as_py()
                counts = matrix_row(shared.value, sizes, seed, part)
                rng = np.random.default_rng([seed, part])
                labels = rng.permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
                keys = rng.integers(0, 1 << KEY_BITS, len(labels), dtype=np.int64)
            to = at + b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels[at:to]), pa.array(keys[at:to])], names=[*b.schema.names, "shard", "key"])
            at = to

    return run


def shuffle(df: DataFrame, shards: int, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard): a uniform random permutation.

    Shard sizes differ by one at most. ``order`` names columns that fix the order of rows in an input partition (all columns
    if left out); rows that are equal in them are interchangeable. Which rows stand in which input partition must not change
    between runs, as with files. Nulls and repeated rows are rows like any other; an empty table gives no rows. Columns named
    ``shard`` or ``slot`` in ``df`` are replaced; any other name may occur. Only a number of rows per input partition comes to
    the driver and is broadcast.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    df = df.drop("shard", "slot")
    # the rows travel as one struct, so no name of theirs can clash with those used here
    keyed = df.select(F.spark_partition_id().alias("part"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    counted = {r["part"]: r["n"] for r in keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number per partition
    if not counted:
        return df.limit(0).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    rows = sum(counted.values())
    sizes = shard_sizes(rows, shards)
    ends = np.cumsum([0, *(counted.get(p, 0) for p in range(max(counted) + 1))], dtype=np.int64)
    schema = T.StructType([*keyed.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("key", T.LongType())])
    ordered = keyed.sortWithinPartitions(*[F.col("row").getField(c) for c in order or df.columns])
    dealt = ordered.mapInArrow(_deal(spark.sparkContext.broadcast(ends), sizes, seed), schema)
    width = max(0, (max(sizes) // RANGE_ROWS).bit_length())
    ranged = dealt.withColumn("range", F.shiftright("key", KEY_BITS - width).cast("int"))
    counts = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "range").orderBy("key", "part")) - 1
    out = ranged.withColumn("place", place).join(first, ["shard", "range"])
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns], "shard", (F.col("first") + F.col("place")).alias("slot"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = shuffle(slim, 8, seed=3, order=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

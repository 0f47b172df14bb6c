"""Bootstrap intervals from per-group sufficient statistics: replicates draw groups, not documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.schema import draw
from sievelight.shared import saved

#: Groups whose draws are made one by one, as SQL makes them.
MOST = 10_000
STATS = ["n_pos", "n_neg", "f_pos", "f_neg"]
#: Rows of statistics that are drawn from at a time, in all replicates.
DRAWN_ROWS = 2_048


def group_statistics(flagged: DataFrame, group: str = "group") -> DataFrame:
    pos, flag = F.col("label") == 1, F.col("flag")
    return flagged.groupBy(F.col(group).cast("string").alias("g")).agg(F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"), F.count_if(pos & flag).alias("f_pos"), F.count_if(~pos & flag).alias("f_neg"))


def replicates(stats: DataFrame, reps: int = 1000, seed: str = "0") -> DataFrame:
    """(rep, tpr, fpr) of ``reps`` resamples of groups with replacement; replicates that lack a class are left out.

    For groups that are few, such as sources, every draw is md5 of replicate and place, so that SQL can make the same; a
    replicate is one row, whose draws are an array. Over ``MOST`` groups ``resample`` draws by the same law from its own numbers.
    """
    listed = stats.orderBy("g").limit(MOST + 1).collect()  # a row per group
    if len(listed) > MOST:
        return resample(stats, reps, int.from_bytes(seed.encode(), "big"))
    total = len(listed)
    held = stats.sparkSession.createDataFrame([[[r[c] for r in listed] for c in STATS]], ", ".join(f"_{c} array<long>" for c in STATS))
    places = F.sequence(F.lit(0), F.lit(max(total - 1, 0)))
    drawn = stats.sparkSession.range(reps).select(F.col("id").alias("rep"), F.transform(places, lambda p: F.pmod(draw(F.lit(seed), F.col("id").cast("string"), p.cast("string")), F.lit(max(total, 1)))).alias("i"))

    def added(c: str):
        return F.aggregate("i", F.lit(0).cast("long"), lambda total, i: total + F.coalesce(F.get(F.col(f"_{c}"), i.cast("int")), F.lit(0))).alias(c)

    return _rates(drawn.join(F.broadcast(held)).select("rep", *map(added, STATS)))


def _rates(sums: DataFrame) -> DataFrame:
    return sums.where("n_pos > 0 and n_neg > 0").select("rep", (F.col("f_pos") / F.col("n_pos")).alias("tpr"), (F.col("f_neg") / F.col("n_neg")).alias("fpr"), "n_pos", "n_neg", "f_pos", "f_neg")


def share(weights: np.ndarray, n: int, part: int, reps: int, seed: int) -> np.ndarray:
    """How many of ``n`` draws fall to ``part`` in each replicate, by the parts' weights.

    A multinomial draw as a tree of binomial ones: the first half of the parts gets its number by their weights, and so on
    down to the part; each split is seeded with its place, so every task finds the same numbers without seeing the others.
    """
    ends = np.concatenate([[0], np.cumsum(weights)])
    left, lo, hi = np.full(reps, n, np.int64), 0, len(weights)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        whole = ends[hi] - ends[lo]
        first = np.random.default_rng([seed, lo, hi]).binomial(left, (ends[middle] - ends[lo]) / whole if whole else 0.0)
        left, lo, hi = (first, lo, middle) if part < middle else (left - first, middle, hi)
    return left


def _drawn(weights: list[int], n: int, reps: int, seed: int):
    """(rep, sums of the statistics) over the draws that fall to a task's rows (part, k, statistics)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part, left, rest, rng = np.zeros((reps, len(STATS)), np.int64), None, None, 0, None
        for b in batches:
            parts = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), b.num_rows]
            for first, end in zip(cuts, cuts[1:], strict=False):
                for lo in range(first, end, DRAWN_ROWS):
                    rows = b.slice(lo, min(DRAWN_ROWS, end - lo))
                    k = rows.column(1).to_numpy()
                    if parts[lo] != part:
                        part = int(parts[lo])
                        left, rest, rng = share(np.array(weights), n, part, reps, seed), weights[part], np.random.default_rng([seed, part])
                    own = int(k.sum())
                    here = rng.binomial(left, own / rest)
                    sums += rng.multinomial(here, k / own) @ np.stack([rows.column(2 + i).to_numpy() for i in range(len(STATS))], axis=1)
                    left, rest = left - here, rest - own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), *(pa.array(sums[:, i]) for i in range(len(STATS)))], names=["rep", *STATS])

    return run


def resample(stats: DataFrame, reps: int = 1000, seed: int = 0) -> DataFrame:
    """The same as ``replicates`` for any number of groups, however unlike, by one pass over them.

    Groups with equal statistics are interchangeable and counted first. A replicate is a multinomial draw over what is left, dealt
    by hash to as many parts as there are shuffle partitions: the parts' numbers come from a tree of binomial draws, then each task draws for
    its own rows, in their order, and returns one sum per replicate. Equal seeds and numbers of partitions give equal draws. Only
    the parts' weights come to the driver.
    """
    spark = stats.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = stats.groupBy(*(F.col(c).cast("long").alias(c) for c in STATS)).agg(F.count(F.lit(1)).alias("k"))
    cells = saved(cells.select(F.pmod(F.xxhash64(*STATS), F.lit(tasks)).cast("int").alias("part"), "k", *STATS), "cells")
    per = {r["part"]: r["k"] for r in cells.groupBy("part").agg(F.sum("k").alias("k")).collect()}  # a number per part
    if not per:
        return _rates(spark.createDataFrame([], "rep long, n_pos long, n_neg long, f_pos long, f_neg long"))
    weights = [per.get(p, 0) for p in range(max(per) + 1)]
    sums = cells.repartition(tasks, "part").sortWithinPartitions("part", *STATS).mapInArrow(_drawn(weights, sum(weights), reps, seed), ", ".join(f"{c} long" for c in ("rep", *STATS)))
    return _rates(sums.groupBy("rep").agg(*(F.sum(c).alias(c) for c in STATS)))


def out_of_bag_f1(scores: DataFrame, steps: int = 20, reps: int = 1000, seed: int = 0) -> DataFrame:
    """(rep, thr, f1): the best threshold i / steps on a Poisson resample of (label, score), and its F1 on the documents left out.

    Documents of one label in one step of the grid are interchangeable: of n of them a binomial number (chance 1 / e) is left
    out, and the others count by Poisson numbers that aren't 0. So only counts per label and step reach the driver.
    """
    spark = scores.sparkSession
    binned = scores.groupBy("label", F.least(F.floor(F.col("score") * steps + 1e-9), F.lit(steps)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.zeros((2, steps + 1), np.int64)
    for r in binned:
        n[int(r["label"]), max(0, r["bin"])] += r["n"]
    rng, out = np.random.default_rng(seed), []
    for rep in range(reps):
        left = rng.binomial(n, np.exp(-1.0))
        inside = positive_poisson(rng, n - left)
        f1, _ = _grid_f1(inside)
        best = int(np.argmax(np.round(f1, 12)))
        out.append((rep, (best + 1) / steps, float(_grid_f1(left)[0][best])))
    return spark.createDataFrame(out, "rep long, thr double, f1 double")


def positive_poisson(rng: np.random.Generator, k: np.ndarray) -> np.ndarray:
    """Sums of k Poisson(1) numbers under the condition that none is 0, by drawing how many of them are 1, 2, 3 and so on."""
    out, left, p = np.zeros_like(k), k.copy(), np.exp(-1.0)
    rest = 1 - p
    for value in range(1, 20):
        p = p / value  # P(X = value)
        now = rng.binomial(left, min(1.0, p / rest)) if value < 19 else left
        out += value * now
        left = left - now
        rest = max(rest - p, 1e-18)
    return out


def _grid_f1(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """F1 and false-alarm rate of each cut i >= 1: at or above it is flagged. counts[label, bin]."""
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    tp, fp, pos, neg = above[1, 1:-1], above[0, 1:-1], counts[1].sum(), counts[0].sum()
    return np.where(tp + fp + pos > 0, 2 * tp / np.maximum(tp + fp + pos, 1), 0.0), fp / max(neg, 1)


def intervals(reps: DataFrame, columns: list[str]) -> DataFrame:
    """2.5 and 97.5 per cent points of each column, in one row."""
    out = reps.agg(*(F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in columns))
    return out.select(*(x for c in columns for x in (F.col(c)[0].alias(f"{c}_lo"), F.col(c)[1].alias(f"{c}_hi"))))


def with_f1(reps: DataFrame) -> DataFrame:
    p = F.coalesce(F.try_divide(F.col("f_pos"), F.col("f_pos") + F.col("f_neg")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("f_pos"), F.col("f_pos") + F.col("f_neg") + F.col("n_pos")), F.lit(0.0))
    return reps.withColumn("precision", p).withColumn("f1", f1)

"""Thresholds from clean-score quantiles, sweeps, conformal ranks and calibration bounds.

Sorted passes over scores work on counts of distinct scores, combined before the shuffle, and on running sums over ranges of them
(``ordered``), so no task holds all scores of a method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.operators.ordered import at_place, at_rank, counted, quantiles, running

BUDGETS = [0.1, 0.05, 0.02, 0.01, 0.005, 0.001]


def long_scores(wide: DataFrame, methods: list[str], keep: list[str]) -> DataFrame:
    """One row per document and method: (keep..., method, score)."""
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, methods)), F.array(*methods)))
    return wide.select(*keep, pairs.alias("method", "score"))


def at_budgets(scores: DataFrame, budgets: list[float] = BUDGETS) -> DataFrame:
    """(method, budget, thr): the (1 - budget) quantile of the clean scores, linear between ranks; flag strictly above."""
    thr = quantiles(scores.where("label = 0"), ["method"], "score", [1 - b for b in budgets])
    return thr.select("method", F.explode(F.map_from_arrays(F.array(*map(F.lit, budgets)), "q")).alias("budget", "thr"))


def rates(scores: DataFrame, thresholds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, tpr, fpr per method, budget (and ``by``); strictly above the threshold is flagged."""
    flagged = scores.join(F.broadcast(thresholds), "method").withColumn("flag", F.col("score") > F.col("thr"))
    return confusion(flagged, ["method", "budget", *(by or [])])


def confusion(flagged: DataFrame, by: list[str]) -> DataFrame:
    pos, flag = F.col("label") == 1, F.col("flag")
    out = flagged.groupBy(*by).agg(F.count_if(pos & flag).alias("tp"), F.count_if(~pos & flag).alias("fp"), F.count_if(pos & ~flag).alias("fn"), F.count_if(~pos & ~flag).alias("tn"))
    return with_metrics(out)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and fpr from tp, fp, fn, tn; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn)})


def cumulative(scores: DataFrame) -> DataFrame:
    """Per method and distinct score s: documents of each label with a score >= s, the totals, and the next smaller score."""
    per = scores.groupBy("method", "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    run = running(per, ["method"], "score", ["p", "n"])
    above = lambda c: F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)
    return run.select("method", "score", above("p").alias("tp"), above("n").alias("fp"), F.col("p_all").alias("pos"), F.col("n_all").alias("neg"), "previous")


def best_f1(scores: DataFrame) -> DataFrame:
    """(method, thr, f1, fpr): midpoints of neighbouring scores, and just outside both ends; ties to the lower false-alarm rate.

    A cut between scores a < b flags what is >= b, so each distinct score b stands for the midpoint below it.
    """
    c = cumulative(scores)
    cuts = c.withColumn("thr", F.coalesce((F.col("previous") + F.col("score")) / 2, F.col("score") - 1e-9)).select("method", "thr", "tp", "fp", "pos", "neg")
    top = c.groupBy("method").agg((F.max("score") + 1e-9).alias("thr"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    f1 = _ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos"))
    scored = cuts.unionByName(top).withColumn("f1", f1).withColumn("fpr", _ratio(F.col("fp"), F.col("neg")))
    best = F.max(F.struct(F.round("f1", 12).alias("f1"), (-F.col("fpr")).alias("low"), (-F.col("thr")).alias("first"))).alias("b")
    return scored.groupBy("method").agg(best).select("method", (-F.col("b.first")).alias("thr"), "b.f1", (-F.col("b.low")).alias("fpr"))


def at_fpr(scores: DataFrame, most: float = 0.05) -> DataFrame:
    """(method, at): the clean score of rank floor(most * n) from the top; flag strictly above it. Null: no clean score."""
    rank = F.col("k_all") - 1 - F.floor(F.col("k_all") * most)
    return counted(scores.where("label = 0"), ["method"], "score").groupBy("method").agg(at_rank("score", rank).alias("at"))


def conformal(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(method, m, thr): the ceil((m + 1)(1 - alpha))-th smallest clean score; null if that rank is past the last."""
    rank = F.ceil(F.round((F.col("k_all") + 1) * (1 - alpha), 9))
    return counted(scores.where("label = 0"), ["method"], "score").groupBy("method").agg(F.max("k_all").alias("m"), at_rank("score", rank - 1).alias("thr"))


def grid_f1(scores: DataFrame, steps: int = 20) -> DataFrame:
    """(method, i, f1) of every cut t = i / steps, i from 1 to steps - 1; at or above is flagged. Equal to twelve digits is equal."""
    binned = scores.groupBy("method", F.least(F.floor(F.col("score") * steps + 1e-9), F.lit(steps)).cast("int").alias("bin"), "label").agg(F.count(F.lit(1)).alias("k"))
    cuts = binned.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps - 1)))).groupBy("method", "i").agg(
        F.coalesce(F.sum(F.when((F.col("label") == 1) & (F.col("bin") >= F.col("i")), F.col("k"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when((F.col("label") == 0) & (F.col("bin") >= F.col("i")), F.col("k"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("k"))), F.lit(0)).alias("pos"),
    )
    return cuts.select("method", "i", F.round(_ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), 12).alias("f1"))


def grid_sweep(scores: DataFrame, steps: int = 20) -> DataFrame:
    """(method, thr, f1): the first best cut of ``grid_f1``."""
    best = F.max(F.struct("f1", (-F.col("i")).alias("i"))).alias("b")
    return grid_f1(scores, steps).groupBy("method").agg(best).select("method", (-F.col("b.i") / steps).alias("thr"), "b.f1")


def minmax(scores: DataFrame, clip: bool = True) -> DataFrame:
    """Scores scaled by the training rows' bounds (a constant method has span 1), and whether a row was out of them."""
    bounds = scores.where("role = 'train'").groupBy("method").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    x = (F.col("score") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) if clip else x
    return scores.join(F.broadcast(bounds), "method").withColumn("outside", ((F.col("score") < F.col("lo")) | (F.col("score") > F.col("hi"))).cast("int")).withColumn("calibrated", inside).drop("lo", "hi")


def anchor_shift(scores: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(method, lo, hi, shift): quantile bounds, and their mean absolute change when the smallest or largest score is left out.

    Without the smallest score every rank is one higher, without the largest they stay; all are places of one running count.
    """
    n = F.col("k_all")
    at = lambda p, left, first: at_place("score", (n - 1 - left) * F.lit(p) + first)
    parts = [at(p, left, first) for left, first in ((0, 0), (1, 1), (1, 0)) for p in (low, high)]
    out = counted(scores, ["method"], "score").groupBy("method").agg(*(c.alias(f"q{i}") for i, c in enumerate(parts)))
    shift = sum((F.abs(F.col(f"q{i}") - F.col(f"q{i % 2}")) for i in (2, 3, 4, 5)), F.lit(0.0)) / 4
    return out.select("method", F.col("q0").alias("lo"), F.col("q1").alias("hi"), shift.alias("shift"))


def budget_sweep(scores: DataFrame, budgets: list[float] = BUDGETS) -> DataFrame:
    """Per method and budget: threshold and training excess from train, rates on val, and whether the budget is verifiable."""
    thr = at_budgets(scores.where("role = 'train'"), budgets)
    above = rates(scores.where("role = 'train'"), thr).select("method", "budget", F.col("fp").alias("train_above"))
    val = rates(scores.where("role = 'val'"), thr)
    out = val.join(thr, ["method", "budget"]).join(above, ["method", "budget"])
    neg = F.col("fp") + F.col("tn")
    return out.select("method", "budget", "thr", F.col("recall").alias("tpr"), "fpr", "train_above", (F.col("budget") * neg >= 1).cast("int").alias("verifiable"), F.when(F.col("fp") == 0, F.try_divide(F.lit(3.0), neg)).otherwise(F.col("fpr")).alias("fpr_upper"))


def veto(whole: Column, segment: Column, cut: float = 0.30, segment_cut: float = 0.45) -> Column:
    return (whole >= cut) | (segment >= segment_cut)


def select_variant(aucs: DataFrame, original: str, margin: float = 0.03) -> DataFrame:
    """(variant, auc): the best variant if it gains ``margin`` on the original, else the original."""
    best = aucs.agg(F.max(F.struct("auc", "variant")).alias("b"), F.max(F.when(F.col("variant") == original, F.col("auc"))).alias("o"))
    take = F.col("b.auc") - F.col("o") >= margin
    return best.select(F.when(take, F.col("b.variant")).otherwise(original).alias("variant"), F.when(take, F.col("b.auc")).otherwise(F.col("o")).alias("auc"))

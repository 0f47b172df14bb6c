"""Rates, prevalence-adjusted precision, AUC, ROC, agreement and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.operators.ordered import quantiles, running
from sievelight.operators.threshold import confusion, cumulative, with_metrics


def rates_by(flagged: DataFrame) -> DataFrame:
    """Confusion counts overall, per source and per attack type in one pass (grouping sets)."""
    cube = flagged.selectExpr("source", "attack_type", "label", "flag").groupingSets([[], ["source"], ["attack_type"]], "source", "attack_type")
    pos, flag = F.col("label") == 1, F.col("flag")
    out = cube.agg(F.count_if(pos & flag).alias("tp"), F.count_if(~pos & flag).alias("fp"), F.count_if(pos & ~flag).alias("fn"), F.count_if(~pos & ~flag).alias("tn"), F.grouping_id().alias("g"))
    return with_metrics(out).withColumn("cell", F.expr("case g when 3 then 'all' when 1 then source else attack_type end")).drop("source", "attack_type", "g")


def precision_at(tpr: Column, fpr: Column, n_clean: Column, prevalence: float) -> Column:
    """Precision at a prevalence; no false alarm counts as the rule of three."""
    f = F.when(fpr == 0, F.try_divide(F.lit(3.0), n_clean)).otherwise(fpr)
    return F.try_divide(tpr * prevalence, tpr * prevalence + f * (1 - prevalence))


def false_alarms_per_10k(fpr: Column) -> Column:
    return fpr * 10000


def roc_auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """AUC with ties counted one half, null if a class is missing: from running counts of distinct scores."""
    per = scores.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    won = running(per, by, "score", ["p", "n"]).withColumn("u", F.col("p") * (F.col("n_upto") - F.col("n") + F.col("n") / 2))
    return won.groupBy(*by).agg(F.try_divide(F.sum("u"), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def roc_curve(scores: DataFrame) -> DataFrame:
    c = cumulative(scores)
    return c.select("method", "score", F.try_divide("tp", "pos").alias("tpr"), F.try_divide("fp", "neg").alias("fpr"))


def best_case_recall(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Largest recall of any cut with a false-alarm rate of at most alpha."""
    return roc_curve(scores).groupBy("method").agg(F.coalesce(F.max(F.when(F.col("fpr") <= alpha, F.col("tpr"))), F.lit(0.0)).alias("recall"))


def within_domain_auc(scores: DataFrame, least: int = 5) -> DataFrame:
    """Unweighted mean of the AUCs of domains with ``least`` documents of each label."""
    big = scores.groupBy("method", "domain").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).where((F.col("p") >= least) & (F.col("n") >= least))
    return roc_auc(scores, ["method", "domain"]).join(big, ["method", "domain"]).groupBy("method").agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("domains"))


def score_histogram(scores: DataFrame, bins: int = 25) -> DataFrame:
    return scores.groupBy("method", "label", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mcnemar(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """b and c counts, the corrected statistic, and p from the chi-square law with one degree of freedom, in one row.

    p is erfc(sqrt(statistic / 2)); without a difference the statistic is 0 and p is 1.
    """
    return with_statistic(rows.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c")))


def with_statistic(counts: DataFrame) -> DataFrame:
    n = F.col("b") + F.col("c")
    return counts.withColumn("statistic", F.when(n == 0, 0.0).otherwise(F.try_divide(F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), F.lit(2)), n))).withColumn("p", chi_square_p(F.col("statistic")))


#: The rational approximation of the complementary error function for x >= 0, off by 1.5e-7 at most.
ERFC = (0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429])


def chi_square_p(statistic: Column) -> Column:
    """P(X >= statistic) for one degree of freedom."""
    x = F.sqrt(statistic / 2)
    t = 1 / (1 + F.lit(ERFC[0]) * x)
    series = F.lit(0.0)
    for a in reversed(ERFC[1]):
        series = (series + a) * t
    return series * F.exp(-x * x)


def complementarity(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.groupBy("label").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"), F.avg((a | b).cast("double")).alias("either_rate"))


def kappa(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Cohen's kappa and accuracy of two 0/1 columns per group."""
    x, y = F.col(a) == 1, F.col(b) == 1
    c = rows.groupBy(by).agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"), F.count(F.lit(1)).cast("double").alias("n"))
    po = (F.col("n11") + F.col("n00")) / F.col("n")
    pe = ((F.col("n11") + F.col("n10")) * (F.col("n11") + F.col("n01")) + (F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10"))) / (F.col("n") * F.col("n"))
    return c.select(by, po.alias("accuracy"), F.when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def latency_stats(rows: DataFrame) -> DataFrame:
    """Median, 95th percentile and mean of ms overall and per length bucket."""
    both = rows.select("detector", F.explode(F.array(F.lit("all"), F.col("bucket"))).alias("bucket"), "ms").where("bucket is not null")
    mean = both.groupBy("detector", "bucket").agg(F.avg("ms").alias("mean_ms"))
    q = quantiles(both, ["detector", "bucket"], "ms", [0.5, 0.95])
    return q.join(mean, ["detector", "bucket"]).select("detector", "bucket", F.col("q")[0].alias("median_ms"), F.col("q")[1].alias("p95_ms"), "mean_ms", "n")


def multi_seed(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def blind_spots(scores: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """Detection rate per category and detector, and the share that all of them miss."""
    hits = {d: F.col(d) >= c for d, c in cuts.items()}
    missed = F.lit(True)
    for h in hits.values():
        missed = missed & ~h
    return scores.groupBy("attack_type").agg(*(F.avg(h.cast("double")).alias(d) for d, h in hits.items()), F.avg(missed.cast("double")).alias("missed_by_all"), F.count(F.lit(1)).alias("n"))


def subset_ablation(scores: DataFrame, detectors: list[str], cut: float) -> DataFrame:
    """F1 of the mean of every non-empty subset of detectors at a cut; subsets are masks in one exploded array."""
    subsets = [[d for i, d in enumerate(detectors) if m >> i & 1] for m in range(1, 1 << len(detectors))]
    each = F.array(*(F.struct(F.lit("+".join(s)).alias("subset"), (sum((F.col(d) for d in s), F.lit(0.0)) / len(s)).alias("score")) for s in subsets))
    rows = scores.select("label", F.explode(each).alias("x")).select("label", "x.subset", (F.round("x.score", 9) >= cut).alias("flag"))
    return confusion(rows, ["subset"]).select("subset", "precision", "recall", "f1", "fpr")


def domain_shortcuts(rows: DataFrame, most: float = 0.9) -> DataFrame:
    n1 = F.count_if(F.col("label") == 1)
    return rows.groupBy("domain").agg(F.count_if(F.col("label") == 0).alias("clean"), n1.alias("poisoned"), F.round(F.greatest(n1, F.count(F.lit(1)) - n1) / F.count(F.lit(1)), 6).alias("share")).withColumn("risk", (F.col("share") > most).cast("int"))



def mean_curve(curve: DataFrame, steps: int) -> DataFrame:
    """(grid, tpr, curves): linear interpolation of each method's (fpr, tpr) at i / steps, averaged over methods.

    For each grid place only the nearest points at or below and at or above are kept, by aggregates.
    """
    points = curve.select("method", "fpr", "tpr").unionAll(curve.select("method", F.lit(0.0), F.lit(0.0)).distinct())
    g = points.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("grid", F.col("grid") / steps)
    lo = F.max(F.when(F.col("fpr") <= F.col("grid"), F.struct("fpr", "tpr"))).alias("lo")
    hi = F.min(F.when(F.col("fpr") >= F.col("grid"), F.struct("fpr", (-F.col("tpr")).alias("down")))).alias("hi")
    near = g.groupBy("method", "grid").agg(lo, hi)
    slope = F.try_divide(-F.col("hi.down") - F.col("lo.tpr"), F.col("hi.fpr") - F.col("lo.fpr"))
    value = F.when(F.col("hi").isNull() | (F.col("hi.fpr") <= F.col("lo.fpr")), F.col("lo.tpr")).otherwise(F.col("lo.tpr") + slope * (F.col("grid") - F.col("lo.fpr")))
    return near.withColumn("v", value).groupBy("grid").agg(F.avg("v").alias("tpr"), F.count("v").alias("curves"))

"""Running sums and quantiles over ranges, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.operators import metrics, ordered, threshold

SHARES = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    """Three groups: many ties, all distinct, one value; one without a name; nulls among the values."""
    rng = np.random.default_rng(1)
    out = [("ties", float(x)) for x in rng.integers(0, 9, 500) / 8] + [("far", float(x)) for x in rng.normal(0, 1e6, 701)] + [("one", 3.5)] + [(None, float(x)) for x in rng.random(50)]
    return out, spark.createDataFrame(out + [("ties", None), ("none", None)], "g string, x double").repartition(7)


def test_quantiles(rows):
    values, df = rows
    got = {r["g"]: r for r in ordered.quantiles(df, ["g"], "x", SHARES).collect()}
    assert set(got) == {"ties", "far", "one", None}
    for g in got:
        mine = [x for k, x in values if k == g]
        assert got[g]["n"] == len(mine)
        assert np.allclose(got[g]["q"], np.quantile(mine, SHARES), rtol=1e-12)


def test_running_sums(rows):
    values, df = rows
    counts = df.where("x is not null").groupBy("g", "x").agg(F.count(F.lit(1)).alias("k"), F.when(F.first("x") > 0, 2).alias("w"))
    got = ordered.running(counts, ["g"], "x", ["k", "w"]).collect()
    for g in ("ties", "far", "one", None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["x"])
        xs = sorted({x for k, x in values if k == g})
        assert [r["x"] for r in mine] == xs and [r["previous"] for r in mine] == [None, *xs[:-1]]
        assert [r["k_upto"] for r in mine] == [sum(k == g and x <= v for k, x in values) for v in xs]
        assert {r["k_all"] for r in mine} == {sum(k == g for k, _ in values)}
        assert [r["w_upto"] for r in mine] == np.cumsum([2 if v > 0 else 0 for v in xs]).tolist()


def test_nothing(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert ordered.quantiles(df, ["g"], "x", [0.5]).collect() == []
    assert ordered.wide_quantiles(df, ["x"], [0.5]).first()["x"] is None


def test_ranges_are_even(spark):
    """Ten million distinct scores of one method: no range has over twice its share, and the thresholds are exact."""
    n, was = 10_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        scores = spark.range(0, n, 1, 8).select(F.lit("m").alias("method"), F.pow(F.pmod(F.col("id") * 7_368_787, F.lit(n)) / n, F.lit(8)).alias("score"), F.lit(0).alias("label"))
        sizes = [r["count"] for r in ordered.ranges(scores.withColumn("k", F.lit(1)), ["method"], "score", ["k"]).groupBy("_range").count().collect()]
        assert sum(sizes) == n and len(sizes) == 32 and max(sizes) <= 2 * n / 32
        got = threshold.conformal(scores, 0.05).first()
        assert got["m"] == n and got["thr"] == pytest.approx((9_500_000 / n) ** 8, rel=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_no_window_or_percentile_over_a_method(spark):
    """No plan of a threshold or AUC has a window by method alone, or holds a method's values in one aggregate."""
    scores = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.25), ("b", 0, 1.0)], "method string, label int, score double")
    for made in (threshold.at_budgets(scores), threshold.best_f1(scores), threshold.at_fpr(scores), threshold.conformal(scores), threshold.anchor_shift(scores), metrics.roc_auc(scores, ["method"]), metrics.roc_curve(scores)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan
        windows = [line for line in plan.splitlines() if "Window [" in line and "score" in line.rsplit("],", 2)[-1] and "_range" not in line]
        assert not windows

"""Methods kept as a table."""

import math

import pytest
from pyspark.sql import functions as F

from sievelight.operators import learn, models
from sievelight.operators.learn import Logistic


def test_kept_models(spark, tmp_path):
    made = {
        "plain": models.Method(Logistic(("b", "a"), (0.1 + 0.2, -3.0), 1 / 3), {}, 0.5),
        "scaled": models.Method(Logistic(("a",), (2.5,), -1.0), {"a": (1.0, 1.0)}, 0.25),
    }
    path = f"file://{tmp_path}/models"
    models.keep(spark, made, path, {"seed": 7})
    assert models.read(spark.newSession(), path, {"seed": 7}) == made
    with pytest.raises(ValueError, match="seed is 7.0 in the file, not 8"):
        models.read(spark, path, {"seed": 8})
    with pytest.raises(Exception, match="already exists"):
        models.keep(spark, made, path)
    p = 1 / (1 + math.exp(-(0.3 * 2 - 3 * 0.5 + 1 / 3)))
    q = 1 / (1 + math.exp(1.0))  # a constant signal has span 1: (0.5 - 1) / 1 is under 0
    rows = spark.createDataFrame([(0.5, 2.0, p, q), (0.5, 2.0, p, q + 1e-8), (0.5, 2.0, None, q)], "a double, b double, plain double, scaled double")
    got = {r["method"]: (r["n"], r["differing"], r["status"]) for r in models.checked(rows, made).collect()}
    assert got == {"plain": (3, 1, "CHECK"), "scaled": (3, 1, "CHECK")}
    assert {r["status"] for r in models.checked(rows.limit(1), made).collect()} == {"PASS"}


def test_an_altered_weight_is_noticed_by_a_sure_model(spark):
    """With more rows the penalty counts for less and scores come nearer to 0 and 1, where a weight moves them by under 1e-9."""
    kept = {"m": models.Method(Logistic(("a",), (24.0,), -12.0), {}, 0.5)}
    bent = {"m": models.Method(Logistic(("a",), (24.0 + 1e-6,), -12.0), {}, 0.5)}
    rows = spark.createDataFrame([(float(a),) for a in (0, 1, 1)], "a double").withColumn("m", kept["m"].score())
    assert [(r["n"], r["differing"], r["status"]) for r in models.checked(rows, kept).collect()] == [(3, 0, "PASS")]
    assert [(r["n"], r["differing"], r["status"]) for r in models.checked(rows, bent).collect()] == [(3, 2, "CHECK")]


def test_frequencies_move_once_to_their_term(spark):
    """They were written, moved to be counted, moved again to meet the counts, and moved to their rows for the totals."""
    rows = spark.createDataFrame([(i, "aa bb cc " * (i + 1)) for i in range(5)], "id long, text string")
    plan = learn.tfidf_totals(rows)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("term" in line for line in moves) == 1 and len(moves) == 3
    want = learn.tfidf(rows).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.max("weight").alias("top"), F.sum("weight").alias("total")).orderBy("id").collect()
    for a, b in zip(learn.tfidf_totals(rows).orderBy("id").collect(), want, strict=True):
        assert (a.id, a.terms) == (b.id, b.terms) and abs(a.top - b.top) < 1e-12 and abs(a.total - b.total) < 1e-12

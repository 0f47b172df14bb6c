"""Fitted methods as a table: kept, read in another session, and applied by column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators.learn import Logistic


@dataclass(frozen=True)
class Method:
    """A regression over signals that are first scaled by bounds (none: as they are), and the threshold of its flags."""

    model: Logistic
    bounds: dict[str, tuple[float, float]]
    threshold: float

    def score(self) -> Column:
        z = F.lit(self.model.intercept)
        for name, w in zip(self.model.features, self.model.weights, strict=True):
            z = z + scaled(name, *self.bounds[name]) * w if name in self.bounds else z + F.col(name).cast("double") * w
        return 1 / (1 + F.exp(-z))


def scaled(name: str, low: float, high: float) -> Column:
    """Between the bounds from 0 to 1, and no further; a constant signal has span 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(name) - low) / ((high - low) or 1.0)))


KEPT = "method string, part string, name string, place int, value double"


def keep(spark: SparkSession, methods: dict[str, Method], path: str, facts: dict[str, float] | None = None) -> None:
    """Writes the methods, a row per number, and ``facts`` of the fit such as its seed; a folder that is there already is an error."""
    rows = [("", "fact", k, i, float(v)) for i, (k, v) in enumerate((facts or {}).items())]
    for name, m in methods.items():
        rows += [(name, "weight", f, i, w) for i, (f, w) in enumerate(zip(m.model.features, m.model.weights, strict=True))]
        rows += [(name, part, f, 0, v) for f, pair in m.bounds.items() for part, v in zip(("low", "high"), pair, strict=True)]
        rows += [(name, "intercept", "", 0, m.model.intercept), (name, "threshold", "", 0, m.threshold)]
    spark.createDataFrame(rows, KEPT).coalesce(1).write.parquet(path)


def read(spark: SparkSession, path: str, facts: dict[str, float] | None = None) -> dict[str, Method]:
    """The methods of ``keep``. ``facts`` that aren't those of the file are an error: it belongs to another fit."""
    rows = spark.read.schema(KEPT).parquet(path).collect()  # a few numbers a method
    was = {r["name"]: r["value"] for r in rows if r["part"] == "fact"}
    for k, v in (facts or {}).items():
        if was.get(k) != float(v):
            raise ValueError(f"{k} is {was.get(k)} in the file, not {v}")
    out = {}
    for name in sorted({r["method"] for r in rows if r["part"] != "fact"}):
        own = [r for r in rows if r["method"] == name]
        one = lambda part: next(r["value"] for r in own if r["part"] == part)  # noqa: B023, E731
        weights = sorted((r["place"], r["name"], r["value"]) for r in own if r["part"] == "weight")
        low, high = ({r["name"]: r["value"] for r in own if r["part"] == part} for part in ("low", "high"))
        out[name] = Method(Logistic(tuple(f for _, f, _ in weights), tuple(w for _, _, w in weights), one("intercept")), {f: (low[f], high[f]) for f in low}, one("threshold"))
    return out


#: What two ways to the same score may differ by.
DIGITS = 4e-16


def checked(rows: DataFrame, methods: dict[str, Method], most: float = 1e-9) -> DataFrame:
    """(method, n, differing, status): scores of ``rows`` under the methods' names against those that the methods give now; PASS or CHECK.

    A score is the same to ``most`` of the smaller of it and what it lacks to 1 (and to the last digits of a double), so a change of
    the model is noticed however sure the model is of its rows. A row that lacks a score counts as differing.
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col(n).alias("was"), m.score().alias("now")) for n, m in methods.items()))).alias("x")
    same = F.abs(F.col("was") - F.col("now")) <= most * F.least(F.col("now"), 1 - F.col("now")) + DIGITS
    out = rows.select(each).select("x.*").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing"))
    return out.withColumn("status", F.when(F.col("differing") == 0, "PASS").otherwise("CHECK"))


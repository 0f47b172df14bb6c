"""Fixed fusion, verdicts and explanations of detector scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAG, REJECT = 0.3, 0.6
WEIGHTS = {"instruction_pattern": 1.0, "embedding_anomaly": 1.0, "perplexity_fluency": 1.0}


def combined(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the detectors that are present; one without a weight counts 0; no weight at all gives 0."""
    weights = weights or WEIGHTS
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, s in scores.items():
        w = F.lit(float(weights.get(name, 0.0)))
        total = total + F.when(s.isNotNull(), s * w).otherwise(0.0)
        weight = weight + F.when(s.isNotNull(), w).otherwise(0.0)
    return F.when(weight == 0, 0.0).otherwise(F.try_divide(total, weight))


def verdict(score: Column) -> Column:
    return F.when(score >= REJECT, "Reject").when(score >= FLAG, "Flag for review").otherwise("Allow")


def squash(margin: Column) -> Column:
    return F.greatest(F.least(margin, F.lit(10.0)), F.lit(-10.0)) / 10


def similarity_anomaly(sim: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - sim) / 2))


def anomaly_band(score: Column) -> Column:
    return F.when(score > 0.6, "high").when(score > 0.35, "moderate").otherwise("consistent")


def staged_verdict(pattern: Column, embedding: Column, perplexity: Column) -> Column:
    """Early exit in a fixed order: struct(verdict, stages run)."""
    return (
        F.when(pattern >= 0.6, F.struct(F.lit("Reject").alias("verdict"), F.lit(1).alias("stages")))
        .when(embedding >= 0.30, F.struct(F.lit("Reject").alias("verdict"), F.lit(2).alias("stages")))
        .when(perplexity >= 0.20, F.struct(F.lit("Reject").alias("verdict"), F.lit(3).alias("stages")))
        .otherwise(F.struct(F.lit("Allow").alias("verdict"), F.lit(3).alias("stages")))
    )


def round_even(x: Column, n: int) -> Column:
    """``n`` digits as DuckDB's round_even makes them: the product by 10^n, a double, goes to the nearest integer, to the even one from halfway."""
    return F.rint(x * 10.0**n) / 10.0**n


def explain(pattern: Column, pattern_reason: Column, embedding: Column, perplexity: Column, perplexity_kind: Column) -> Column:
    """One sentence: the detectors over their cut-offs, strongest first."""

    def two(x: Column) -> Column:
        return F.format_string("%.2f", round_even(x, 2))

    parts = F.array(
        F.when(pattern > 0.5, F.struct(pattern.alias("s"), F.lit(0).alias("i"), F.regexp_replace(pattern_reason, "^flagged: ", "").alias("t"))),
        F.when(embedding > 0.30, F.struct(embedding.alias("s"), F.lit(-1).alias("i"), F.concat(F.when(embedding > 0.38, "high").otherwise("moderate"), F.lit(" embedding anomaly ("), two(embedding), F.lit(")")).alias("t"))),
        F.when(perplexity > 0.5, F.struct(perplexity.alias("s"), F.lit(-2).alias("i"), F.concat(F.lit("unusually "), perplexity_kind, F.lit(" phrasing ("), two(perplexity), F.lit(")")).alias("t"))),
    )
    said = F.transform(F.sort_array(F.array_compact(parts), asc=False), lambda x: x["t"])
    return F.when(F.size(said) == 0, "Clean: no detector exceeded its threshold").otherwise(F.concat(F.lit("Flagged: "), F.concat_ws(" + ", said)))

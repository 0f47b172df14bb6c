"""Cost-aware early-exit cascades: budget splits, simulation, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators.ordered import wide_quantiles


def compositions(spark: SparkSession, total: int, parts: int) -> DataFrame:
    """All ordered splits of ``total`` units into ``parts`` counts: columns u1..., a short generated table."""
    df = spark.range(1).select(F.lit(0).alias("used"))
    for k in range(1, parts):
        df = df.withColumn(f"u{k}", F.explode(F.sequence(F.lit(0), F.lit(total) - F.col("used")))).withColumn("used", F.col("used") + F.col(f"u{k}"))
    return df.withColumn(f"u{parts}", F.lit(total) - F.col("used")).drop("used")


def unit_thresholds(train: DataFrame, stages: list[str], budget: float, units: int = 10) -> DataFrame:
    """One row: for each stage an array of thresholds, element u for a share of u units of the budget."""
    q = wide_quantiles(train.where("label = 0"), stages, [1 - budget * u / units for u in range(units + 1)])
    return q.select(*(F.col(s).alias(f"thr_{s}") for s in stages))


def rated_splits(train: DataFrame, stages: list[str], budget: float, units: int = 10) -> DataFrame:
    """(u1, u2, ..., recall, fpr): every split of the units with its training rates.

    A document matters only by the smallest number of units at which each stage flags it, so documents are first counted by
    that vector (at most (units + 2)^stages counts), and only those counts meet the splits.
    """
    spark = train.sparkSession
    thr = unit_thresholds(train, stages, budget, units)
    least = {f"l_{s}": F.array_position(F.transform(f"thr_{s}", _above(F.col(s))), True) - 1 for s in stages}  # -1: never
    counted = train.join(F.broadcast(thr)).select("label", *(F.when(c < 0, units + 1).otherwise(c).cast("int").alias(n) for n, c in least.items())).groupBy("label", *least).agg(F.count(F.lit(1)).alias("k"))
    splits = compositions(spark, units, len(stages))
    hit = F.lit(False)
    for i, s in enumerate(stages, 1):
        hit = hit | (F.col(f"u{i}") >= F.col(f"l_{s}"))
    us = [f"u{i}" for i in range(1, len(stages) + 1)]
    pos = F.col("label") == 1
    return counted.crossJoin(F.broadcast(splits)).groupBy(*us).agg(
        F.coalesce(F.try_divide(F.sum(F.when(pos & hit, F.col("k")).otherwise(0)), F.sum(F.when(pos, F.col("k")))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.sum(F.when(~pos & hit, F.col("k")).otherwise(0)), F.sum(F.when(~pos, F.col("k")))), F.lit(0.0)).alias("fpr"),
    )


def choose_split(train: DataFrame, stages: list[str], budget: float, units: int = 10) -> DataFrame:
    """The split with the highest training recall; ties to the lower false-alarm rate, then to more budget earlier."""
    us = [f"u{i}" for i in range(1, len(stages) + 1)]
    best = F.max(F.struct("recall", (-F.col("fpr")).alias("low"), *us)).alias("b")
    return rated_splits(train, stages, budget, units).agg(best).select(*(F.col(f"b.{u}").alias(u) for u in us), F.col("b.recall").alias("train_recall"), (-F.col("b.low")).alias("train_fpr"))


def _above(score: Column):
    def f(t: Column) -> Column:
        return score > t

    return f


def simulate(scores: DataFrame, stages: list[str], flag: dict[str, Column], clear: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``exit_idx`` (the last stage that runs) and ``flag``: a flag goes before a clear, the last stage clears nothing."""
    last = len(stages) - 1
    out, hit = F.lit(last), F.lit(False)
    for i in reversed(range(len(stages))):
        s = stages[i]
        flags = F.col(s) > flag[s]
        clears = (F.col(s) < clear[s]) if clear and i < last else F.lit(False)
        out = F.when(flags | clears, F.lit(i)).otherwise(out)
        hit = F.when(flags, True).when(clears, False).otherwise(hit)
    return scores.withColumn("exit_idx", out).withColumn("flag", hit)


def expected_ms(simulated: DataFrame, ms: list[float], prevalences: tuple[float, ...] = (0.01, 0.001)) -> DataFrame:
    """Expected cost of clean and poisoned documents and of mixes, from per-stage costs."""
    cum = F.array(*(F.lit(float(sum(ms[: i + 1]))) for i in range(len(ms))))
    cost = F.element_at(cum, F.col("exit_idx") + 1)
    out = simulated.agg(F.avg(F.when(F.col("label") == 0, cost)).alias("ms_clean"), F.avg(F.when(F.col("label") == 1, cost)).alias("ms_poisoned"))
    for p in prevalences:
        out = out.withColumn(f"ms_prev_{p:g}".replace(".", "_"), (1 - p) * F.col("ms_clean") + p * F.col("ms_poisoned"))
    return out.withColumn("ms_all", F.lit(float(sum(ms))))


def reach(simulated: DataFrame, stages: list[str]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(s).alias("stage"), (F.col("exit_idx") >= i).cast("double").alias("reached")) for i, s in enumerate(stages)))
    return simulated.select("label", F.explode(each).alias("x")).groupBy("x.stage", "label").agg(F.avg("x.reached").alias("share"))


def lazy_cascade(docs: DataFrame, stages: list) -> DataFrame:
    """Runs costly scorers only on what earlier stages left: ``stages`` has (name, DataFrame -> DataFrame with ``score``, flag cut, clear cut).

    CASE does not short-circuit Python scorers, so each stage filters, and the decided rows are united: (columns, exit, flag).
    """
    alive, done = docs, None
    for i, (name, score, flag, clear) in enumerate(stages):
        scored = score(alive)
        out = F.col("score") > flag
        gone = F.col("score") < clear if clear is not None else F.lit(False)
        last = i == len(stages) - 1
        decided = scored.where(F.lit(True) if last else out | gone).select(*docs.columns, F.lit(name).alias("exit"), out.alias("flag"))
        done = decided if done is None else done.unionByName(decided)
        alive = scored.where(~(out | gone)).select(*docs.columns)
    return done

"""Group-aware splits, folds and seeded samples. Order within a group of choices is md5(seed | key), never a random stream.

Ranks inside a stratum, label or source are made by ranges of the hash (``hash_rank``), so no task orders a whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.operators.ordered import running
from sievelight.schema import draw
from sievelight.shared import saved

#: A table of at most so many rows is broadcast; a larger one is shuffled.
SMALL = 65_536
ROLES = ["baseline", "train", "val", "test"]


def split_roles(rows: DataFrame, seed: str = "42", baseline: float = 0.25, val: float = 0.2, test: float = 0.2) -> DataFrame:
    """(source, group, role) per group: strata of source, label set and single attack type; baseline only where clean rows are.

    Shares are rounded half to even; a stratum of three or more left groups gives one at least to val and test.
    """
    groups = rows.groupBy("source", "group").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.when(F.col("label") == 1, F.col("attack_type"))).alias("t0"), F.max(F.when(F.col("label") == 1, F.col("attack_type"))).alias("t1")
    )
    typed = F.when((F.col("lo") == 1) & (F.col("t0") == F.col("t1")), F.col("t0")).otherwise("")
    keyed = groups.withColumn("stratum", F.concat_ws("|", "source", "lo", "hi", typed))
    sizes = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    ranked = hash_rank(keyed, ["stratum"], F.md5(F.concat_ws("|", F.lit(seed), "source", "group")), "group").withColumnRenamed("rank", "r").join(F.broadcast(sizes), "stratum")
    n_base = F.when(F.col("lo") == 0, F.bround(F.col("n") * baseline)).otherwise(0).cast("int")
    sized = ranked.withColumn("base", n_base).withColumn("rest", F.col("n") - F.col("base"))

    def share(x: float):
        k = F.bround(F.col("rest") * x).cast("int")
        return F.when(F.col("rest") >= 3, F.greatest(k, F.lit(1))).otherwise(k)

    sized = sized.withColumn("n_test", share(test)).withColumn("n_val", share(val)).withColumn("p", F.col("r") - F.col("base"))
    role = F.when(F.col("p") <= 0, "baseline").when(F.col("p") <= F.col("n_test"), "test").when(F.col("p") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train")
    return sized.select("source", "group", role.alias("role"))


def hash_rank(rows: DataFrame, by: list[str], key, tie: str) -> DataFrame:
    """``rows`` with ``rank``, from 1, in the order of the hexadecimal hash ``key`` and then ``tie`` within ``by``.

    Rows are ordered within the 4,096 ranges of the hash's first three digits, and the ranges' counts, a few rows a cell, say where
    each begins; so no task orders a whole cell.
    """
    keyed = rows.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    cells = keyed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    begins = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_key", tie))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_range")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    out = keyed.withColumn("_place", place).alias("r").join(begins.alias("b"), cond)
    return out.select(*(F.col(f"r.`{c}`") for c in rows.columns), (F.col("b._before") + F.col("r._place")).alias("rank"))


def clean_split(rows: DataFrame, share: float = 0.7, seed: str = "42") -> DataFrame:
    """Clean rows with role baseline or evaluation: the first floor(n * share) in hash order are the baseline."""
    clean = rows.where("label = 0")
    n = clean.agg(F.floor(F.count(F.lit(1)) * share + 1e-9).alias("_most"))
    ranked = hash_rank(clean, ["label"], F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), "id")
    return ranked.join(F.broadcast(n)).withColumn("role", F.when(F.col("rank") <= F.col("_most"), "baseline").otherwise("evaluation")).drop("rank", "_most")


def assign(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows with their role; poisoned rows of baseline groups are ``dropped``."""
    return rows.join(roles, ["source", "group"]).withColumn("role", F.when((F.col("role") == "baseline") & (F.col("label") == 1), "dropped").otherwise(F.col("role")))


def split_hash(assigned: DataFrame) -> DataFrame:
    """One row: ten hexadecimal digits over all (role, id), from the sum of row digests, so no order has to be made."""
    part = F.conv(F.substring(F.sha1(F.concat_ws("|", "role", "id")), 1, 15), 16, 10).cast("decimal(38,0)")
    return assigned.agg(F.substring(F.sha1(F.sum(part).cast("string")), 1, 10).alias("hash"))


def split_problems(assigned: DataFrame) -> DataFrame:
    """(problem, n): repeated ids, straddling groups, poisoned baseline rows, roles that lack a label."""
    kept = assigned.where("role <> 'dropped'")
    dup = assigned.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit("duplicate id").alias("problem"), F.count(F.lit(1)).alias("n"))
    straddle = kept.groupBy("source", "group").agg(F.min("role").alias("a"), F.max("role").alias("b")).where("a <> b").agg(F.lit("group in two roles").alias("problem"), F.count(F.lit(1)).alias("n"))
    poisoned = kept.where("role = 'baseline' and label = 1").agg(F.lit("poisoned baseline").alias("problem"), F.count(F.lit(1)).alias("n"))
    lacks = kept.where("role <> 'baseline'").groupBy("role").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a = b").agg(F.lit("role lacks a label").alias("problem"), F.count(F.lit(1)).alias("n"))
    return dup.unionAll(straddle).unionAll(poisoned).unionAll(lacks)


def role_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("source", "label").pivot("role", [*ROLES, "dropped"]).agg(F.count(F.lit(1))).fillna(0)


def fill(loads: list[int], size: int, count: int) -> tuple[list[int], list[list[int]]]:
    """Deals ``count`` equal groups of ``size`` rows, one by one, each to the lightest fold (the first of equally light ones).

    Fold f takes a group at the loads L, L + size, L + 2 size and so on, so groups go to these places in their order. Between two
    neighbouring loads of the sorted folds only the lighter ones have places, each one in every stretch of ``size``, so there the
    folds take turns in a fixed order. Returns where each such phase starts, in numbers of groups, and its order; ``loads``
    is brought up to date.
    """
    sorted_loads, was, left = sorted(set(loads)), list(loads), count
    starts, orders = [], []
    for i, low in enumerate(sorted_loads):
        high = sorted_loads[i + 1] if i + 1 < len(sorted_loads) else None
        first = {f: was[f] - (was[f] - low) // size * size for f in range(len(was)) if was[f] <= low}  # its first place from low on
        order = sorted(first, key=lambda f: (first[f], f))
        places = [left if high is None else max(0, -((first[f] - high) // size)) for f in order]
        taken = min(left, sum(places))
        starts.append(count - left)
        orders.append(order)
        for turn, f in enumerate(order):
            loads[f] += size * (taken // len(order) + (turn < taken % len(order)))
        left -= taken
        if not left:
            break
    return starts, orders


def group_folds(rows: DataFrame, k: int = 5, group: str = "group") -> DataFrame:
    """(group, fold): groups by falling size, by name among equal ones, each to the lightest fold.

    The greedy order is followed over runs of equal sizes only: a few numbers a run say which ranks go where (``fill``), and a
    group finds its fold by its rank in the run, which comes from ``ordered.running``. The driver gets one row per distinct size;
    the sum of n different sizes is n * (n + 1) / 2 rows at least, so there are fewer than the root of twice the rows.
    """
    spark = rows.sparkSession
    sizes = saved(rows.groupBy(F.col(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n")), "groups")
    loads, plan = [0] * k, []
    for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect():
        plan.append((r["n"], *fill(loads, r["n"], r["c"])))
    runs = spark.createDataFrame(plan, "n long, starts array<long>, orders array<array<int>>")
    ranked = running(sizes.withColumn("one", F.lit(1)), ["n"], "g", ["one"]).select("n", "g", (F.col("one_upto") - 1).alias("rank"))
    phase = F.size(F.filter("starts", lambda x: x <= F.col("rank"))) - 1
    order, turn = F.get("orders", phase), F.col("rank") - F.get("starts", phase)
    placed = ranked.join(F.broadcast(runs) if len(plan) <= SMALL else runs, "n")
    return placed.select(F.col("g").alias(group), F.get(order, F.pmod(turn, F.size(order)).cast("int")).alias("fold"))


def stratified_folds(rows: DataFrame, k: int = 5, seed: str = "42", by: str = "label") -> DataFrame:
    return hash_rank(rows, [by], F.md5(F.concat_ws("|", F.lit(seed), "id")), "id").withColumn("fold", (F.col("rank") - 1) % k).drop("rank")


def capped_sample(rows: DataFrame, by: list[str], n: int, seed: str = "42") -> DataFrame:
    """At most ``n`` rows per cell in hash order. (A sampling operator: the limit is the feature.)"""
    return hash_rank(rows, by, F.md5(F.concat_ws("|", F.lit(seed), "id")), "id").where(F.col("rank") <= n)


def proportional_sample(rows: DataFrame, total: int, seed: str = "42", by: str = "source") -> DataFrame:
    """``total`` rows with quotas by largest remainder."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # over one row per source
    exact = counts.withColumn("exact", F.lit(float(total)) * F.col("n") / F.sum("n").over(everything))
    floor = exact.withColumn("low", F.floor("exact")).withColumn("left", F.lit(total) - F.sum("low").over(everything))
    quota = floor.withColumn("place", F.row_number().over(everything.orderBy(F.desc(F.round(F.col("exact") - F.col("low"), 9)), by))).select(by, (F.col("low") + (F.col("place") <= F.col("left")).cast("int")).alias("quota"))
    return hash_rank(rows, [by], F.md5(F.concat_ws("|", F.lit(seed), "id")), "id").join(F.broadcast(quota), by).where("rank <= quota")


def draw_groups(rows: DataFrame, least: int, seed: str = "42") -> DataFrame:
    """Whole groups in hash order until ``least`` rows are reached: (group, n)."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    # only the first `least` groups can be needed, since each has a row
    first = sizes.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col("group").cast("string")))).orderBy("key", "group").limit(least)
    before = F.sum("n").over(Window.partitionBy().orderBy("key", "group")) - F.col("n")
    return first.withColumn("before", before).where(F.col("before") < least).select("group", "n")


def leave_one_source_out(rows: DataFrame, groups: list[str], source: str = "source") -> DataFrame:
    """Rows once for each held-out source group, with side train or test."""
    held = F.explode(F.array(*map(F.lit, groups)))
    return rows.withColumn("held", held).withColumn("side", F.when(F.col(source) == F.col("held"), "test").otherwise("train"))


def seed_order(rows: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows in hash order. (A sampling operator.)"""
    return rows.orderBy(draw(F.lit(seed), F.col("id").cast("string")), "id").limit(n)

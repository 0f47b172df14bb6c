"""Report rows: protocol tables, claim checks, cascade orders and conclusions, audits, and their rendering as LaTeX and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.fusion import round_even
from sievelight.operators import bootstrap, metrics, split, threshold
from sievelight.operators.ordered import quantiles, wide_quantiles
from sievelight.shared import saved

#: How far a rounded printed number may be from the computed one.
ROUNDING = 0.0051
PREFERENCE = ["F0", "F1", "F2", "F3", "F5", "F4"]


def alarms_text(fpr: Column, n_clean: Column) -> Column:
    """False alarms per 10,000 clean documents; without any, the rule-of-three bound."""
    return F.when(n_clean == 0, "no clean documents").when(fpr == 0, F.concat(F.lit("at most "), F.format_string("%.1f", round_even(F.lit(30000.0) / n_clean, 1)))).otherwise(F.format_string("%.1f", round_even(metrics.false_alarms_per_10k(fpr), 1)))


def protocol_table(scores: DataFrame, fitted: str = "val", role: str = "test", budget: float = 0.05) -> DataFrame:
    """One row per method: threshold at the budget on clean ``fitted`` rows, rates and AUC on ``role``, and a row that flags all."""
    thr = threshold.at_budgets(scores.where(F.col("role") == fitted), [budget])
    rows = scores.where(F.col("role") == role)
    rates = threshold.rates(rows, thr).join(thr.select("method", "thr"), "method")
    auc = metrics.roc_auc(rows, ["method"])
    one = rows.dropDuplicates(["id"]).select(F.lit("flag all").alias("method"), "label", F.lit(True).alias("flag"))
    every = threshold.confusion(one, ["method"]).withColumn("thr", F.lit(None).cast("double")).withColumn("auc", F.lit(None).cast("double"))
    columns = ["method", "thr", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr", "auc"]
    out = rates.join(auc, "method").select(*columns).unionByName(every.select(*columns))
    return out.withColumn("alarms", alarms_text(F.col("fpr"), F.col("fp") + F.col("tn")))


def protocol_report(scores: DataFrame, methods: list[str], fitted: str = "train", role: str = "val", budget: float = 0.05, against: str = "naive", weights: dict[str, dict[str, float]] | None = None, reps: int = 1000) -> DataFrame:
    """(section, method, cell, value): a whole protocol in one result.

    ``scores`` has (id, label, source, attack_type, position, role, method, score). Per method: the threshold at the budget on clean
    ``fitted`` rows; on ``role`` rows counts, precision, recall, F1 with its interval over resampled sources, false-alarm rate, AUC,
    the best recall within the budget, how often it alone or ``against`` alone is right, with the corrected statistic and p;
    detection by source, attack and position; ``weights``; and what flagging everything gives.
    """
    thr = saved(threshold.at_budgets(scores.where(F.col("role") == fitted), [budget]), "thresholds")
    rows = scores.where(F.col("role") == role)
    flagged = saved(rows.join(F.broadcast(thr), "method").withColumn("flag", F.col("score") > F.col("thr")), "flagged")

    def long(section: str, df: DataFrame, columns: list[str], cell: Column | None = None) -> DataFrame:
        """``columns`` of ``df`` as rows; the cell is the column's name, or ``cell`` where there is one column."""
        each = F.explode(F.array(*(F.struct((F.lit(c) if cell is None else cell.cast("string")).alias("cell"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")
        return df.select(F.lit(section).alias("section"), "method", each).select("section", "method", "x.cell", "x.value")

    counts = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr"]
    parts = [long("threshold", thr, ["thr"]), long("rates", threshold.confusion(flagged, ["method"]), counts), long("auc", metrics.roc_auc(rows, ["method"]), ["auc"]), long("best", metrics.best_case_recall(rows, budget), ["recall"])]
    for m in methods:
        stats = bootstrap.group_statistics(flagged.where(F.col("method") == m), "source")
        found = bootstrap.intervals(bootstrap.with_f1(bootstrap.replicates(stats, reps)), ["f1"])
        parts.append(long("interval", found.withColumn("method", F.lit(m)), ["f1_lo", "f1_hi"]))
    right = flagged.select("id", "method", (F.col("flag") == (F.col("label") == 1)).alias("right"))
    base = right.where(F.col("method") == against).select("id", F.col("right").alias("base"))
    pairs = right.where(F.col("method") != against).join(base, "id").groupBy("method").agg(F.count_if(F.col("right") & ~F.col("base")).alias("b"), F.count_if(~F.col("right") & F.col("base")).alias("c"))
    parts.append(long(f"against {against}", metrics.with_statistic(pairs), ["b", "c", "statistic", "p"]))
    for by in ("source", "attack_type", "position"):
        share = flagged.where((F.col("label") == 1) & (F.col(by) != "")).groupBy("method", by).agg(F.avg(F.col("flag").cast("int")).alias("recall"))
        parts.append(long(f"recall by {by}", share, ["recall"], F.col(by)))
    if weights:
        listed = [("weight", m, f, float(w)) for m, by in weights.items() for f, w in by.items()]
        parts.append(scores.sparkSession.createDataFrame(listed, "section string, method string, cell string, value double"))
    one = rows.dropDuplicates(["id"]).select(F.lit("flag all").alias("method"), "label", F.lit(True).alias("flag"))
    parts.append(long("rates", threshold.confusion(one, ["method"]), counts))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_runs(dry: DataFrame, final: DataFrame, column: str, most: float = 0.05) -> DataFrame:
    """(method, dry, final, change, status): a dry run's figure beside the final one's; PASS if it fell by ``most`` at the most."""
    both = dry.select("method", F.col(column).alias("dry")).join(final.select("method", F.col(column).alias("final")), "method", "full")
    change = F.col("final") - F.col("dry")
    return both.withColumn("change", change).withColumn("status", F.when(change.isNull(), "INFO").when(F.round(change, 9) >= -most, "PASS").otherwise("CHECK"))


def check_claims(claims: DataFrame, facts: DataFrame, tolerance: float = ROUNDING) -> DataFrame:
    """(name, claimed, found, status) of claims (name, claimed) against facts (name, found): PASS within rounding, CHECK beyond it or
    without a fact, INFO for a claim without a number (R29)."""
    out = claims.join(facts, "name", "left")
    near = F.round(F.abs(F.col("claimed") - F.col("found")), 9) <= tolerance
    return out.withColumn("status", F.when(F.col("claimed").isNull(), "INFO").when(near, "PASS").otherwise("CHECK"))


def stage_order(latency: DataFrame, order: list[str]) -> DataFrame:
    """(stage, median_ms, place): the cheapest median first, ties in the given order (C2). Latency has (detector, ms)."""
    ranks = F.create_map(*(x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))))
    med = quantiles(latency, ["detector"], "ms", [0.5]).select(F.col("detector").alias("stage"), F.col("q")[0].alias("median_ms"))
    return med.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("median_ms", F.coalesce(F.element_at(ranks, F.col("stage")), F.lit(len(order))), "stage")))  # a row per stage


def conclusions(designs: DataFrame) -> DataFrame:
    """A sentence for each cascade design: its rates, cost and saving."""
    two = lambda c: F.when(c.isNull(), "no").otherwise(F.format_string("%.2f", round_even(c, 2)))
    saving = F.lit(100.0) * (1 - F.col("ms_clean") / F.col("ms_all"))
    text = F.concat(
        F.lit("Design "), "design", F.lit(" finds "), two(F.lit(100.0) * F.col("tpr")), F.lit("% of poisoned documents with "), two(F.lit(100.0) * F.col("fpr")),
        F.lit("% false alarms at "), two(F.col("ms_clean")), F.lit(" ms per clean document, "), two(saving), F.lit("% less than all stages."),
    )
    return designs.select("design", text.alias("sentence"))


def choose_features(aucs: DataFrame, tie: float = 0.005, preference: list[str] = PREFERENCE) -> DataFrame:
    """(features, auc): the highest mean AUC; among those less than ``tie`` below it the first in the order of preference."""
    best = aucs.agg(F.max("auc").alias("top"))
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col("features"))
    near = aucs.join(F.broadcast(best)).where(F.round(F.col("top") - F.col("auc"), 9) < tie).withColumn("rank", F.when(rank == 0, len(preference) + 1).otherwise(rank))
    return near.agg(F.min(F.struct("rank", "features", "auc")).alias("b")).select("b.features", "b.auc")


def generator_style(control: Column, classifier: Column, least: float = 0.8) -> Column:
    """Whether a detector may be reading the generator's style: a style-only control reaches ``least`` of its recall."""
    return F.when(classifier == 0, "no detection").when(F.round(control / classifier, 9) >= least, "generator style").otherwise("instructions")


def clear_thresholds(train: DataFrame, stages: list[str], q: float) -> DataFrame:
    """One row: for each stage but the last the q-quantile of poisoned training scores, under which a document is cleared (T5)."""
    found = wide_quantiles(train.where("label = 1"), stages[:-1], [q])
    return found.select(*(F.col(s)[0].alias(s) for s in stages[:-1]))


def blind_audit(rows: DataFrame, per_cell: int = 20, seed: str = "42") -> DataFrame:
    """(id, source, label, rank): ``per_cell`` rows of each source and label, no two of one group anywhere in the sample.

    A group stands with its row of the smallest hash, whichever cell that is in; cells then rank what stands for them. (A sampling
    operator: the limit is the feature.)
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string")))
    one = rows.groupBy("group").agg(F.min(F.struct(key.alias("key"), "id", "source", "label")).alias("r")).select("r.id", "r.source", "r.label", "r.key")
    return split.hash_rank(one, ["source", "label"], F.col("key"), "id").where(F.col("rank") <= per_cell).select("id", "source", "label", "rank")


def join_audit(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """(id, verdict, label, status) of a filled audit sheet (id, verdict) and its key (id, label): agreed, differs, or unknown id."""
    both = sheet.join(key.select("id", "label"), "id", "left")
    return both.withColumn("status", F.when(F.col("label").isNull(), "unknown id").when(F.col("verdict") == F.col("label"), "agreed").otherwise("differs"))


def to_latex(rows: list[dict], columns: list[str], digits: int = 3) -> str:
    """A tabular of a few report rows."""
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [" & ".join(cell(c) for c in columns) + r" \\", r"\midrule", *(" & ".join(cell(r[c]) for c in columns) + r" \\" for r in rows)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", r"\toprule", *lines, r"\bottomrule", r"\end{tabular}", ""])


def to_macros(rows: list[dict], name: str, columns: list[str], digits: int = 3) -> str:
    """One macro per number: its name is the row's and the column's letters."""
    letters = lambda s: "".join(w.capitalize() for w in "".join(c if c.isalpha() else " " for c in s).split())
    return "".join(f"\\newcommand{{\\{letters(str(r[name]))}{letters(c)}}}{{{r[c]:.{digits}f}}}\n" for r in rows for c in columns if isinstance(r[c], float))


def to_json(tables: dict[str, list[dict]]) -> str:
    return json.dumps(tables, indent=1, sort_keys=True, default=str)


def timed(score):
    """A batch scorer with wall milliseconds per document of each batch (D1): pandas Series of texts -> DataFrame (score, ms)."""
    import time

    import pandas as pd

    def run(texts):
        began = time.perf_counter()
        scores = score(texts)
        each = (time.perf_counter() - began) * 1000 / max(1, len(texts))
        return pd.DataFrame({"score": scores, "ms": each}, index=texts.index)

    return run

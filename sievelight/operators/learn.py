"""TF-IDF, logistic regression over a few columns by Newton's method in aggregates, out-of-fold scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.shared import saved

TOKEN = r"(?U)(\w\w+)"


#: Rows of texts that a task is given, about, where their words are counted by row.
TASK_ROWS = 8_192


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in partitions by the hash of ``key``, of bounded size."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, -(-rows.count() // TASK_ROWS)), key)


def term_frequencies(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term, tf) of lower-case words of two characters or more and their bigrams joined by a space.

    Texts move to their key's partition before they are cut, so a row's terms are counted where they are: a text is shorter than its terms.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), 1)
    w = by_key(rows.select(key, F.col(text)), key).select(key, words.alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(F.col("w"), i + 1)))
    return w.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _raw_weights(rows: DataFrame, key: str, text: str, min_df: int, number: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(key, term, w): the weights of ``tfidf`` before a row is scaled.

    Frequencies move once, to their term, where they are counted; with ``number`` they are written, since the vocabulary is asked first.
    """
    tf, n = term_frequencies(rows, key, text), rows.agg(F.count(F.lit(1)).alias("n"))
    if number:
        tf = saved(tf, "terms")
        df = saved(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df), "vocabulary")
        met = tf.join(df.withColumn("number", number(df)), "term")
    else:
        met = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term"))).where(F.col("df") >= min_df)
    return met.crossJoin(F.broadcast(n)).select(key, F.col("number" if number else "term").alias("term"), ((1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))


def tfidf(rows: DataFrame, key: str = "id", text: str = "text", min_df: int = 3, number: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), scaled to length one per row.

    df is a window over a term's rows, n an aggregate, and a row's length is a window over its own terms. With ``number``, a function of the vocabulary (term), terms are the numbers that it gives them.
    """
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return _raw_weights(rows, key, text, min_df, number).select(key, "term", (F.col("w") / length).alias("weight"))


def tfidf_totals(rows: DataFrame, key: str = "id", text: str = "text", min_df: int = 3) -> DataFrame:
    """(key, terms, top, total): how many weights of ``tfidf`` a row has, the largest and their sum.

    The length divides the sums, so a row's terms are summed where they met the vocabulary and no weight moves to its row.
    """
    w = F.col("w")
    sums = _raw_weights(rows, key, text, min_df).groupBy(key).agg(F.count(F.lit(1)).alias("terms"), F.max(w).alias("top"), F.sum(w).alias("total"), F.sqrt(F.sum(w * w)).alias("length"))
    return sums.select(key, "terms", (F.col("top") / F.col("length")).alias("top"), (F.col("total") / F.col("length")).alias("total"))


def term_document_frequency(rows: DataFrame, least: int = 3) -> DataFrame:
    """(term, clean, poisoned): documents of each label that have the word."""
    w = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 1))).alias("term")
    out = rows.select("label", w).groupBy("term").agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("poisoned"))
    return out.where(F.col("clean") + F.col("poisoned") >= least)


@dataclass(frozen=True)
class Logistic:
    """A fitted regression over named columns."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for name, w in zip(self.features, self.weights, strict=True):
            z = z + F.col(name).cast("double") * w
        return 1 / (1 + F.exp(-z))


def fit_many(rows: DataFrame, features: list[str], groups: Column, c: float = 1.0, balanced: bool = True, label: str = "label", steps: int = 50, tol: float = 1e-10) -> dict[object, Logistic]:
    """A model per element of the array ``groups``, fitted on the rows that have it: the least of the (class-weighted) losses plus |w|^2 / (2 c).

    All models take Newton's steps together: a step is one aggregate over slim written rows that gives each model's gradient and
    second derivatives, a few numbers for few features. Class weights are n / (2 n_c). ValueError where a model lacks a label.
    """
    m, xs = len(features), [f"x{i}" for i in range(len(features))]
    slim = saved(rows.select(F.explode(groups).alias("g"), F.col(label).cast("double").alias("y"), *(F.col(f).cast("double").alias(x) for f, x in zip(features, xs, strict=True))), "training")
    n = {r["g"]: (r["n0"], r["n1"]) for r in slim.groupBy("g").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).collect()}  # a row per model
    if not n or not all(a and b for a, b in n.values()):
        raise ValueError("both labels are needed")
    weight = {g: [(a + b) / (2 * a), (a + b) / (2 * b)] if balanced else [1.0, 1.0] for g, (a, b) in n.items()}
    kind, pen = dict(slim.dtypes)["g"], np.append(np.full(m, 1 / c), 0.0)
    at, step, loss, open_ = {g: np.zeros(m + 1) for g in n}, {g: np.zeros(m + 1) for g in n}, dict.fromkeys(n, np.inf), set(n)
    x = [*map(F.col, xs), F.lit(1.0)]
    z = sum((x[i] * F.get("w", F.lit(i)) for i in range(m + 1)), F.lit(0.0))
    p = 1 / (1 + F.exp(-F.col("z")))
    cost = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")
    pairs = [(i, j) for i in range(m + 1) for j in range(i + 1)]
    for _ in range(steps):
        now = slim.sparkSession.createDataFrame([(g, at[g].tolist(), *weight[g]) for g in open_], f"g {kind}, w array<double>, c0 double, c1 double")
        rated = slim.join(F.broadcast(now), "g").withColumn("z", z).withColumn("c", F.when(F.col("y") == 1, F.col("c1")).otherwise(F.col("c0"))).withColumn("p", p)
        curve = F.col("c") * F.col("p") * (1 - F.col("p"))
        sums = rated.groupBy("g").agg(F.sum(F.col("c") * cost).alias("loss"), *(F.sum(F.col("c") * (F.col("p") - F.col("y")) * x[i]).alias(f"g{i}") for i in range(m + 1)), *(F.sum(curve * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs))
        for r in sums.collect():
            g, w = r["g"], at[r["g"]]
            total = r["loss"] + pen @ (w * w) / 2
            if total > loss[g] * (1 + 1e-12) + 1e-12 and np.abs(step[g]).max() > tol:  # too far: half the step
                step[g] = step[g] / 2
                at[g] = w + step[g]  # w is the place after the whole step
                continue
            h = np.diag(pen)
            for i, j in pairs:
                h[i, j] += r[f"h{i}_{j}"]
                h[j, i] = h[i, j]
            loss[g], step[g] = total, np.linalg.lstsq(h, np.array([r[f"g{i}"] for i in range(m + 1)]) + pen * w, rcond=None)[0]
            at[g] = w - step[g]
            if np.abs(step[g]).max() <= tol:
                open_.discard(g)
        if not open_:
            break
    return {g: Logistic(tuple(features), tuple(w[:m].tolist()), float(w[m])) for g, w in at.items()}


def fit_logistic(rows: DataFrame, features: list[str], c: float = 1.0, balanced: bool = True, label: str = "label") -> Logistic:
    return fit_many(rows, features, F.array(F.lit(0)), c, balanced, label)[0]


def predict(model: Logistic, rows: DataFrame, name: str = "score") -> DataFrame:
    return rows.withColumn(name, model.probability())


def predict_many(models: dict[object, Logistic], rows: DataFrame, group: str, name: str = "score") -> DataFrame:
    """Each row by the model of its ``group``; null without one."""
    out = F.lit(None).cast("double")
    for g, model in models.items():
        out = F.when(F.col(group) == g, model.probability()).otherwise(out)
    return rows.withColumn(name, out)


def out_of_fold(rows: DataFrame, features: list[str], folds: int = 5, name: str = "score") -> DataFrame:
    """Scores of each fold by the model fitted on the others; rows have ``fold``. The models are fitted in the same passes."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold").cast("int"))
    return predict_many(fit_many(rows, features, others), rows, "fold", name)


def standardise(rows: DataFrame, columns: list[str], fitted_on: DataFrame) -> DataFrame:
    """Columns scaled by the mean and population deviation of ``fitted_on``; a constant column is only centred."""
    stats = fitted_on.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
    return rows.withColumns({c: (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in columns})


def rescaled(rows: DataFrame, variants: dict[str, str], fitted_on: DataFrame) -> DataFrame:
    """Each variant column brought to the mean and population deviation of its original, both taken from ``fitted_on``; a constant one is only moved."""
    names = sorted({*variants, *variants.values()})
    r = fitted_on.agg(*(x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
    return rows.withColumns({v: (F.col(v) - r[f"m_{v}"]) / (r[f"s_{v}"] or 1.0) * r[f"s_{o}"] + r[f"m_{o}"] for v, o in variants.items()})


def char_grams(text, low: int = 3, high: int = 5):
    """Character n-grams of each word padded by a space at both ends, as one array column."""
    w = F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    parts = [F.flatten(F.transform(w, _grams(n))) for n in range(low, high + 1)]
    return F.concat(*parts)


def _grams(n: int):
    def f(x):
        return F.when(F.length(x) <= n, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n))))

    return f

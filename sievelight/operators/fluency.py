"""Fluency by a language model, and windowed classifiers: the model is a function of token windows that the caller plugs in.

A model takes a DataFrame (id, window, tokens array<string>) and returns (id, window, value): the mean negative log likelihood of
the tokens, or an array of class logits. ``UnigramModel`` is a stand-in fitted here; its numbers are not those of a neural model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import perplexity_score, token_windows, windows_truncated
from sievelight.operators.windows import document_margins, injection_label, margin
from sievelight.shared import saved

#: Tokens that a language model reads of a document.
CONTEXT = 1024
Model = Callable[[DataFrame], DataFrame]


def tokens(text: Column) -> Column:
    """Lower-case runs without white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([^ \t\n\r\f\x0B]+)"), 1)


def perplexity(docs: DataFrame, model: Model, text: str = "text", key: str = "id") -> DataFrame:
    """(key, n_tokens, perplexity) of the first ``CONTEXT`` tokens; null under two tokens, where nothing is predicted."""
    cut = docs.select(F.col(key).alias("id"), F.lit(0).alias("window"), F.slice(tokens(F.col(text)), 1, CONTEXT).alias("tokens"))
    some = model(cut.where("size(tokens) >= 2")).select("id", F.exp("value").alias("perplexity"))
    return cut.select("id", F.size("tokens").alias("n_tokens")).join(some, "id", "left").withColumnRenamed("id", key)


def fluency(docs: DataFrame, model: Model, low: float = 20.0, high: float = 150.0, text: str = "text", key: str = "id") -> DataFrame:
    """(key, score): 0 within the band of perplexities and for texts of under two tokens."""
    return perplexity(docs, model, text, key).select(key, perplexity_score(F.col("perplexity"), low, high).alias("score"))


@dataclass
class UnigramModel:
    """Add-one smoothed word frequencies; unseen words share one place."""

    counts: DataFrame
    total: float
    words: int

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text") -> UnigramModel:
        """Counts all tokens of all texts; ``CONTEXT`` bounds only what is scored."""
        counts = saved(docs.select(F.explode(tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k")), "words")
        row = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        return cls(counts, float(row["n"]), row["v"])

    def __call__(self, windows: DataFrame) -> DataFrame:
        """(id, window, value): mean negative log likelihood; equal words of a window are one row, counted where the window has been moved whole."""
        tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = windows.repartition(tasks, "id").select("id", "window", F.explode("tokens").alias("w")).groupBy("id", "window", "w").agg(F.count(F.lit(1)).alias("m"))
        logp = F.ln((F.coalesce("k", F.lit(0)) + 1) / F.lit(self.total + self.words + 1))
        return each.join(self.counts, "w", "left").groupBy("id", "window").agg((-F.sum(F.col("m") * logp) / F.sum("m")).alias("value"))


def classify(docs: DataFrame, model: Model, names: list[str], text: str = "text", key: str = "id", size: int = 510, overlap: int = 64, most: int | None = 8) -> DataFrame:
    """(key, margin, windows, probability, truncated): a classifier with classes ``names`` on overlapping windows of tokens.

    Documents without a token give no row: there is nothing to classify. A text is cut into tokens once; its windows are numbered from 0,
    those of a truncated document from ``most``, which tells them apart when only (id, window, value) has come back from the model. With
    ``most`` None all windows of a text are classified and no document is truncated.
    """
    cut = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("all"))
    first = F.lit(0) if most is None else F.when(windows_truncated(F.col("all"), size, overlap, most), most).otherwise(0)
    windows = cut.select("id", first.alias("first"), F.posexplode(token_windows(F.col("all"), size, overlap, most)).alias("window", "tokens"))
    # asked of the windows: a filter of documents would be moved to where their table is scanned and cut each text there as well
    some = windows.where("size(tokens) > 0").select("id", (F.col("first") + F.col("window")).alias("window"), "tokens")
    scored = model(some).withColumn("margin", margin(F.col("value"), injection_label(names)))
    truncated = (F.lit(0) if most is None else (F.max("window") >= most).cast("int")).alias("truncated")
    return document_margins(scored, "id", truncated).withColumnRenamed("id", key)

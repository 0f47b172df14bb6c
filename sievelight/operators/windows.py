"""Window-level classifier margins and stage names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that name the injection class of a published classifier.
INJECTION_WORDS = ("inject", "malicious", "unsafe")


def injection_label(names: list[str]) -> int:
    """Index of the injection class; of two unnamed classes the second."""
    hits = [i for i, n in enumerate(names) if any(w in n.lower() for w in INJECTION_WORDS)]
    if len(hits) == 1:
        return hits[0]
    if len(names) == 2:
        return 1
    raise ValueError(f"no injection class among {names}")


def margin(logits: Column, label: Column | int) -> Column:
    """The class's logit minus the log of the summed exponentials of the others."""
    others = F.filter(logits, lambda x, i: i != label)
    top = F.array_max(others)
    return F.get(logits, F.lit(label)) - (top + F.ln(F.aggregate(others, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def document_margins(windows: DataFrame, key: str = "id", *more: Column) -> DataFrame:
    """(key, margin, windows, probability): the largest window margin of each document and its clipped sigmoid; then ``more`` aggregates."""
    sigmoid = 1 / (1 + F.exp(-F.greatest(F.least("margin", F.lit(30.0)), F.lit(-30.0))))
    out = windows.groupBy(key).agg(F.max("margin").alias("margin"), F.count(F.lit(1)).alias("windows"), *more)
    return out.select(key, "margin", "windows", sigmoid.alias("probability"), *out.columns[3:])


#: Accepted endings of detector names in a latency file.
ENDINGS = ("classifier", "bank", "detector")


def stage_name(name: Column) -> Column:
    """Lower case, runs of white space, dashes and underscores to one space, without a known ending."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[\s_\-]+", " ")
    return F.regexp_replace(plain, rf" ({'|'.join(ENDINGS)})$", "")


def valid_name(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z0-9_.\-]+", name) is not None

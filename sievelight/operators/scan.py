"""One call that scores documents: pattern bank, similarity and fluency, fused to a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.fusion import combined, similarity_anomaly, verdict
from sievelight.functions.patterns import pattern_result
from sievelight.functions.text import perplexity_score


def scan(docs: DataFrame, similarity: Column | None = None, perplexity: Column | None = None, text: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with ``scan`` struct(combined_score, verdict, pattern, embedding, perplexity, reasons).

    ``similarity`` (largest cosine to a clean baseline) and ``perplexity`` come from models the caller plugs in; without them the
    detector is absent from the fusion.
    """
    p = pattern_result(F.col(text))
    none = F.lit(None).cast("double")
    e = similarity_anomaly(similarity) if similarity is not None else none
    x = perplexity_score(perplexity) if perplexity is not None else none
    total = combined({"instruction_pattern": p["score"], "embedding_anomaly": e, "perplexity_fluency": x}, weights)
    return docs.withColumn("scan", F.struct(total.alias("combined_score"), verdict(total).alias("verdict"), p["score"].alias("pattern"), e.alias("embedding"), x.alias("perplexity"), p["matched_patterns"].alias("reasons")))


class Registry:
    """Named scoring methods and extras; a name can be registered once."""

    def __init__(self) -> None:
        self.methods: dict[str, object] = {}

    def register(self, name: str):
        def add(fn):
            if name in self.methods:
                raise ValueError(f"{name} is registered already")
            self.methods[name] = fn
            return fn

        return add

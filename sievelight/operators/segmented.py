"""Similarity anomaly of a document's own segments: each segment meets the baseline, the worst and the mean are kept.

``hashed_encoder`` is a stand-in: signed-less word counts in ``DIMENSIONS`` places chosen by hash, of length one. Words are cut by
Spark and counted batch by batch in numpy, each distinct word hashed once a batch. A real encoder plugs in as a function from
(id, text) to (id, embedding).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.fusion import similarity_anomaly
from sievelight.functions.text import segments
from sievelight.operators.similarity import top_similarities
from sievelight.shared import saved

DIMENSIONS = 64
#: Segments of a document are numbered below this.
STRIDE = 1_000_000
Encoder = Callable[[DataFrame], DataFrame]


@lru_cache(1 << 16)
def _place(word: str) -> int:
    """As ``schema.draw`` has it."""
    return int(md5(word.encode(), usedforsecurity=False).hexdigest()[:7], 16) % DIMENSIONS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, embedding) of (id, words)."""
    for b in batches:
        words = b.column(1)
        each = words.flatten().dictionary_encode()
        places = np.array([_place(w) for w in each.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(b.num_rows), words.value_lengths().to_numpy(zero_copy_only=False))
        counts = np.bincount(row * DIMENSIONS + places[each.indices.to_numpy()], minlength=b.num_rows * DIMENSIONS).reshape(-1, DIMENSIONS).astype(float)
        length = np.sqrt((counts * counts).sum(axis=1))
        vectors = counts / np.where(length > 0, length, 1.0)[:, None]
        offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * DIMENSIONS)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)))], names=["id", "embedding"])


def hashed_encoder(rows: DataFrame) -> DataFrame:
    """(id, embedding) of (id, text)."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)(\w\w+)"), 1)
    return rows.select("id", words.alias("words")).mapInArrow(_counted, f"id {dict(rows.dtypes)['id']}, embedding array<double>")


def segmented_anomaly(docs: DataFrame, baseline: DataFrame, encoder: Encoder = hashed_encoder, weight: float = 0.5) -> DataFrame:
    """(id, segments, max_score, blended, worst): anomaly of the worst segment, ``weight`` of it with the mean, and its first 60 characters.

    ``docs`` and ``baseline`` have (id long, text); the baseline's texts are whole. A text without a segment is one itself.
    """
    none = F.lit("").alias("domain")
    parts = saved(docs.select("id", F.posexplode(segments(F.coalesce("text", F.lit("")))).alias("nth", "text")).select((F.col("id") * STRIDE + F.col("nth")).alias("id"), "text"), "segments")
    once = saved(parts.groupBy("text").agg(F.min("id").alias("id")), "texts")  # twins and copies repeat most of their segments: each text is encoded and compared once
    near = top_similarities(encoder(once.select("id", "text")).select("id", "embedding", none), encoder(baseline.select("id", "text")).select("id", "embedding", none), most=once.count())
    rated = near.select("id", similarity_anomaly(F.col("top")[0]).alias("a")).join(once, "id").select("text", "a")
    scored = parts.join(rated, "text")
    doc = F.floor(F.col("id") / STRIDE)
    worst = F.max(F.struct("a", (-F.col("id")).alias("first"), F.substring("text", 1, 60).alias("text"))).alias("w")
    out = scored.groupBy(doc.alias("id")).agg(F.count(F.lit(1)).alias("segments"), F.max("a").alias("max_score"), F.avg("a").alias("mean"), worst)
    return out.select("id", "segments", "max_score", (weight * F.col("max_score") + (1 - weight) * F.col("mean")).alias("blended"), F.col("w.text").alias("worst"))

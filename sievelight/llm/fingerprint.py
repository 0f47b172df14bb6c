"""Quartile bucket digests of documents and their bounded difference.

All byte triplets of a text (three consecutive bytes and two gapped forms) are hashed into ``BUCKETS`` counters. The digest has two
bits per bucket: how many of the quartiles of the counts the bucket's count exceeds, which doesn't depend on the length;
and before them the length on a logarithmic scale. Two digests differ by the distance of their bucket codes, where codes at
opposite ends count double, and of their lengths; the difference is bounded, and 1 minus its share of the bound, scaled by what
unrelated texts reach, is their likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import bounded_batches, cut_blocks, even_cuts

BUCKETS = 512
#: Byte offsets of the triplets that start at a byte.
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 3)]
SPAN = 4
LENGTH_STEP, LENGTH_MOST = 1.1, 40
#: Bucket distance by code difference.
COST = np.array([0, 1, 2, 6])
#: A piece of counting work in bytes.
PIECE = 1 << 18
#: Bytes of texts in a block of consecutive documents, which one task reads.
BLOCK_BYTES = 32 << 20


def counts(data: bytes) -> np.ndarray:
    """Bucket counts over the whole text, a bounded piece at a time."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    if 0 < len(raw) < SPAN:
        raw = np.concatenate([raw, np.zeros(SPAN - len(raw), np.uint8)])
    for lo in range(0, len(raw) - SPAN + 1, PIECE):
        b = raw[lo : lo + PIECE + SPAN - 1].astype(np.uint32)
        n = len(b) - SPAN + 1
        for salt, (i, j, k) in enumerate(TRIPLETS):
            h = (b[i : i + n] | b[j : j + n] << 8 | b[k : k + n] << 16 | (salt << 24)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            out += np.bincount((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - 9), minlength=BUCKETS)
    return out


def codes(c: np.ndarray) -> np.ndarray:
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (c[:, None] > q).sum(axis=1).astype(np.uint8)


def length_code(n: int) -> int:
    return 0 if n < 1 else min(255, 1 + int(np.log(n) / np.log(LENGTH_STEP)))


def digest(data: bytes) -> str:
    """The fingerprint: one byte of length and BUCKETS * 2 bits of quartile codes, in hexadecimal."""
    q = codes(counts(data)).reshape(-1, 4)
    return bytes([length_code(len(data)), *(q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).tolist()]).hex()


def _open(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return int(raw[0]), np.stack([raw[1:] >> s & 3 for s in (6, 4, 2, 0)], axis=1).ravel()


def difference(one: str, two: str) -> int:
    """0 for equal fingerprints; at most 6 * BUCKETS + LENGTH_MOST."""
    (n, a), (m, b) = _open(one), _open(two)
    return int(COST[np.abs(a.astype(int) - b)].sum()) + min(LENGTH_MOST, abs(n - m))


#: The mean difference of two independent code sequences, past which texts have nothing in common.
UNRELATED = BUCKETS * float(sum(COST[abs(i - j)] for i in range(4) for j in range(4))) / 16 + LENGTH_MOST


def likeness(one: str, two: str) -> float:
    """1 for equal fingerprints, 0 for those that differ as unrelated ones or more."""
    return max(0.0, 1.0 - difference(one, two) / UNRELATED)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, after: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and place, and each block ends with a guard: the row after its last one."""
    held = None
    for b in batches:
        rows = []
        for block, doc, text, guard in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = digest(text.encode())
            if held is not None and held[0] == block:
                _, before, old, print_ = held
                new = _edited(old, text)
                second = digest(new.encode())
                rows.append((before, len(old), hashlib.sha256(new.encode()).hexdigest(), print_, second, likeness(print_, second), likeness(print_, own)))
            held = None if guard else (block, doc, text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: its fingerprint, that of its edited text and both likenesses, by the contract of the query.

    Rows are dealt into blocks of consecutive ids, of about ``BLOCK_BYTES``, by one exchange, and each block also gets the first
    row of the block after it, so that every row meets its successor. Null texts are empty; null ids are left out; rows that repeat an id follow each
    other in the order of their texts' hashes. A single row is its own successor. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    cuts = even_cuts(rows.select("doc_id", F.octet_length("text").cast("long").alias("size")), "doc_id", "size", BLOCK_BYTES)
    placed = cut_blocks(cuts, "doc_id")(rows)
    tie = F.xxhash64("text")
    heads = placed.select("block", "doc_id", tie.alias("tie")).groupBy("block").agg(F.min(F.struct("doc_id", "tie")).alias("head")).orderBy("block").collect()
    if not heads:
        return spark.createDataFrame([], OUT)
    order = [h["block"] for h in heads]
    back = [(h["head"]["doc_id"], h["head"]["tie"], order[i - 1]) for i, h in enumerate(heads)]  # the block that the head guards
    guards = F.broadcast(spark.createDataFrame(back, "doc_id long, tie long, block int"))
    first = placed.select("doc_id", "text", tie.alias("tie")).join(guards, ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"])
    both = placed.select("block", "doc_id", "text", F.lit(False).alias("guard")).unionByName(first.select("block", "doc_id", "text", F.lit(True).alias("guard")))
    dealt = both.withColumn("tie", F.xxhash64("text")).repartitionById(len(cuts) + 1, "block").sortWithinPartitions("block", "guard", "doc_id", "tie")
    return dealt.select("block", "doc_id", "text", "guard").mapInArrow(_run, OUT)


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Benchmark decontamination: SimHash windows of item size, multi-index Hamming blocks, exact verification.

Words are lower-cased and stripped of ASCII punctuation at their ends. An item's window is as many consecutive words of a
document as the item has; a shorter document is a window itself. The fingerprint of a window is the 64-bit SimHash of its pairs of
neighbouring words (of its word, if it has one), and every window of every item size is fingerprinted: running sums of the pairs'
bits give a window's votes by one subtraction. The index cuts fingerprints into blocks; for each item size and block a table marks
every block value within ``NEAR[block]`` bits of an item's. A window with more than that many other bits in every block differs in
more than ``RADIUS`` bits, so every window within ``RADIUS`` bits of an item has a marked block. Windows without one are done with
after a look-up per block; the others are compared with the items of their size. Candidates are verified exactly: a shingle weighs the number of times it occurs, and the similarity is the sum of the smaller weights over
the sum of the larger ones.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import bounded_batches, same_columns
from sievelight.llm.textkit import Grams, U, Words, words

SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which a block may differ and still be marked, for each block, and the radius that this covers.
NEAR = (3, 2, 2, 2)
BLOCKS, WIDTH = len(NEAR), 64 // len(NEAR)
RADIUS = sum(n + 1 for n in NEAR) - 1
#: Items, their characters and their distinct sizes handled by one pass over the documents; more take more passes.
ITEM_BLOCK, ITEM_CHARS, ITEM_SIZES = 10_000, 3_000_000, 64
#: Words whose bits are summed at a time; a text of any length needs no more memory than this and its hashes.
STRETCH = 1 << 15
CHUNK = 1 << 12


def differences(most: int) -> np.ndarray:
    """All differences of two block values by at most that many bits."""
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in itertools.combinations(range(WIDTH), k)], np.int64)


def item_words(column: pa.Array) -> Iterator[Words]:
    """Lower-case words without ASCII punctuation at their ends; what is nothing else isn't a word.

    Hashed without a key: who wants an item to pass unseen need only change its words.
    """
    yield from words(pc.utf8_lower(column.cast(pa.large_string())), key=None, trim=True)


def bits(h: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash, lowest first."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def packed(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes, axis=1, bitorder="little").view(np.uint64).ravel()


def features(h: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words."""
    return Grams(h).of(np.arange(max(0, len(h) - 1)), 2)


def simhash(h: np.ndarray) -> int:
    """64-bit SimHash of a window of word hashes: bit b is set if more than half of its pairs (of its word) have it."""
    f = features(h) if len(h) > 1 else h
    return int(np.packbits(2 * bits(f).sum(axis=0, dtype=np.int64) > len(f), bitorder="little").view(np.uint64)[0])


class Votes:
    """SimHashes of all windows of a stretch of words, by running sums of bits in the smallest type that holds a window.

    Eight (or four, two) sums share a 64-bit number: the difference of two running totals is the window's sums exactly, none
    of which is over its part, whatever the totals carried over.
    """

    def __init__(self, h: np.ndarray):
        self.words, self.bits, self.sums = h, bits(features(h)), {}

    def prints(self, size: int) -> np.ndarray:
        if size == 1:
            return self.words
        size -= 1  # that many pairs
        kind = np.min_scalar_type(size)
        if kind not in self.sums:
            packed = self.bits.astype(kind).view(np.uint64)
            sums = np.zeros((len(packed) + 1, packed.shape[1]), np.uint64)
            np.cumsum(packed, axis=0, out=sums[1:])
            votes = np.empty((CHUNK, packed.shape[1]), np.uint64)
            self.sums[kind] = sums, votes, votes.view(kind), np.empty((CHUNK, 64), bool)
        sums, votes, counts, signs = self.sums[kind]
        n = max(0, len(sums) - size)
        out = np.empty(n, np.uint64)
        least = kind.type(size // 2)
        for lo in range(0, n, CHUNK):  # pieces that stay in the processor's cache
            k = min(CHUNK, n - lo)
            np.subtract(sums[lo + size : lo + size + k], sums[lo : lo + k], out=votes[:k])
            np.greater(counts[:k], least, out=signs[:k])
            out[lo : lo + k] = np.packbits(signs[:k].reshape(-1), bitorder="little").view(np.uint64)
        return out


def shingles(h: np.ndarray) -> np.ndarray:
    """Shingle hashes of a word sequence; a shorter one is a shingle itself."""
    n = len(h)
    g = Grams(h)
    return g.of(np.arange(n - SHINGLE + 1), SHINGLE) if n >= SHINGLE else g.of(np.zeros(min(n, 1), np.int64), n)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted shingle similarity of two multisets."""
    both = sum(min(k, b[s]) for s, k in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


@dataclass
class Sized:
    """The items of one size, and for each block which of its values are within NEAR bits of one of theirs."""

    items: np.ndarray
    prints: np.ndarray
    tables: list[np.ndarray] = field(default_factory=list)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair (place in ``prints``, item number) within RADIUS bits, once."""
        if not self.tables:
            for k in range(BLOCKS):
                own = (self.prints >> U(k * WIDTH)).astype(np.int64) & ((1 << WIDTH) - 1)
                self.tables.append(np.zeros(1 << WIDTH, bool))
                self.tables[k][own[:, None] ^ differences(NEAR[k])] = True
        parts = prints.view(np.uint16).reshape(-1, BLOCKS)
        some = self.tables[0].take(parts[:, 0])
        for k in range(1, BLOCKS):
            some |= self.tables[k].take(parts[:, k])
        places = np.flatnonzero(some)
        found = prints.take(places)
        at, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(self.items), 16):  # a few items at a time
            k, near = np.nonzero(np.bitwise_count(self.prints[lo : lo + 16, None] ^ found) <= RADIUS)
            at.append(places[near])
            item.append(self.items[lo + k])
        return np.concatenate(at), np.concatenate(item)


@dataclass
class Index:
    """Items by size; ``known`` has the shingles of all, sorted, and ``low`` which low 16 bits they have."""

    ids: list[int]
    size: np.ndarray
    weights: list[Counter]
    known: np.ndarray
    low: np.ndarray
    sized: dict[int, Sized]


def build(ids: list[int], texts: list[str]) -> Index:
    kept, size, prints, weights = [], [], [], []
    for w in item_words(pa.array(texts, pa.large_string())):
        for r in range(w.rows):
            h = w.hash[w.first[r] : w.first[r + 1]]
            if len(h):
                kept.append(ids[w.row0 + r])
                size.append(len(h))
                prints.append(simhash(h))
                weights.append(Counter(shingles(h).tolist()))
    size, prints = np.array(size, np.int64), np.array(prints, np.uint64)
    known = np.array(sorted({s for c in weights for s in c}), np.uint64)
    low = np.zeros(1 << 16, bool)
    low[(known & U(0xFFFF)).astype(np.int64)] = True
    return Index(kept, size, weights, known, low, {int(n): Sized(np.flatnonzero(size == n), prints[size == n]) for n in np.unique(size)})


def candidates(index: Index, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, last word + 1, item number) of the windows whose fingerprint is near an item's, by words of ``w``."""
    row, n, per = w.row_of(), len(w.hash), np.diff(w.first)
    most = max(index.sized)
    for lo in range(0, n, STRETCH):
        votes = Votes(w.hash[lo : lo + STRETCH + most - 1])
        for size, sized in index.sized.items():
            prints = votes.prints(size)[:STRETCH]
            at, item = sized.within(prints)
            at = at + lo
            own = row[at] == row[at + size - 1]  # a window lies in one document
            yield at[own], at[own] + size, item[own]
    short = np.flatnonzero((per > 0) & (per < most))
    whole = np.array([simhash(w.hash[w.first[r] : w.first[r + 1]]) for r in short.tolist()], np.uint64)
    for size, sized in index.sized.items():
        fits = per[short] < size
        at, item = sized.within(whole[fits])
        rows = short[fits][at]
        yield w.first[rows], w.first[rows + 1], item


def verified(index: Index, w: Words) -> dict[tuple[int, int], tuple[float, int]]:
    """(row, item number) -> (similarity, first word) of the best window, the first on ties, where it is SIMILARITY or more."""
    out: dict[tuple[int, int], tuple[float, int]] = {}
    if not index.sized or not len(w.hash):
        return out
    code = Grams(w.hash).of(np.arange(max(0, len(w.hash) - SHINGLE + 1)), SHINGLE)
    shared = np.zeros(len(w.hash) + 1, np.int64)
    if len(code):
        maybe = np.flatnonzero(index.low.take(code & U(0xFFFF)))
        hit = np.zeros(len(code), bool)
        hit[maybe] = index.known[np.minimum(np.searchsorted(index.known, code[maybe]), len(index.known) - 1)] == code[maybe]
        np.cumsum(hit, out=shared[1 : len(code) + 1])
        shared[len(code) + 1 :] = shared[len(code)]
    # two multisets of a and b shingles share at least this many of a if they are similar enough
    least = lambda a, b: SIMILARITY * (a + b) / (1 + SIMILARITY) - 1e-9
    row = w.row_of()
    for first, last, item in candidates(index, w):
        own, other = last - first - SHINGLE + 1, index.size[item] - SHINGLE + 1
        long = own > 0
        have = shared[np.where(long, last - SHINGLE + 1, first)] - shared[first]
        may = np.where(long, have >= least(own, np.maximum(other, 1)), last - first == index.size[item])
        for s, e, i in zip(first[may].tolist(), last[may].tolist(), item[may].tolist(), strict=True):
            v = similarity(Counter(shingles(w.hash[s:e]).tolist()), index.weights[i])
            key, place = (int(row[s]), i), s - int(w.first[row[s]])
            if v >= SIMILARITY and (key not in out or (-v, place) < (-out[key][0], out[key][1])):
                out[key] = (v, place)
    return out


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for b in batches:
            ids, rows = b.column(0).to_numpy(), []
            for w in item_words(b.column(1)):
                rows += [(ids[w.row0 + r], index.ids[i], v, first, int(index.size[i])) for (r, i), (v, first) in verified(index, w).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)

    return run


def _without(shared, text: str):
    """Rows, with all their columns, whose text has no item's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for w in item_words(b.column(b.schema.get_field_index(text))):
                for r, _ in verified(index, w):
                    keep[w.row0 + r] = False
            yield b.filter(pa.array(keep))

    return run


def passes(items: DataFrame) -> Iterator[Index]:
    """Indexes of bounded size that hold all items between them. Null ids and texts are left out."""
    ids, texts, size, sizes = [], [], 0, set()
    some = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("item_id is not null and text is not null").dropDuplicates()
    for r in some.orderBy(F.length("t"), "i", "t").toLocalIterator():
        n = sum(len(w.hash) for w in item_words(pa.array([r.t])))
        if ids and (len(ids) >= ITEM_BLOCK or size + len(r.t) > ITEM_CHARS or len(sizes | {n}) > ITEM_SIZES):
            yield build(ids, texts)
            ids, texts, size, sizes = [], [], 0, set()
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t)
        sizes.add(n)
    if ids:
        yield build(ids, texts)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item that a document has a window of, with the best window.

    One row per document row and item with a similarity of 0.8 or more. Items and documents without words match nothing; null
    ids are left out; rows that repeat an id give rows each. Items are read in blocks, one pass over the documents each, so
    what is broadcast is bounded for any benchmark. No items or no documents give no rows. The radius of 12 bits is above what
    windows of that similarity differ by (8 bits in the mean at worst, for an item of 13 words that lost its first), but SimHash
    is a filter by chance; the README has its recall against all windows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    out = spark.createDataFrame([], "doc_id long, item_id long, similarity double, first_word long, n_words long")
    for index in passes(items):
        out = out.unionAll(rows.mapInArrow(_search(spark.sparkContext.broadcast(index)), out.schema))
    return out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_benchmark(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text has no window of an item, columns unchanged, in one pass for each block of items.

    Each row is judged by itself: of rows that repeat an id those with a window go; rows with a null id are judged like others.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    for index in passes(items):
        shared = spark.sparkContext.broadcast(index)
        docs = same_columns(docs, text, lambda name, shared=shared: _without(shared, name))
    return docs

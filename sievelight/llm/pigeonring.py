"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most r bits, then from some segment on
every chain of l consecutive segments differs in at most l * r / SEGMENTS bits, for l = 1, 2, ... (the cycle lemma). With r = 4
and five segments: no difference in the first segment, one in two, two in three, three in four.

1. Chain keys. Each distinct fingerprint emits, for each start, the bits of a chain of two segments as they are, and those with one
   bit of the second altered; the latter only if the second has an odd number of bits, since of two segments that
   differ in one bit exactly one is odd. Rows with equal keys meet, so a candidate pair has passed the chain conditions of length
   one and two already.
2. A key with too many rows is made longer by the next segment, with the differences that its budget still allows, and again up to
   four segments. These leave 12 or 13 bits open, so no key has more than 2^13 fingerprints as they are, however the
   fingerprints are spread: the work per fingerprint is bounded, and no pairs of a large group are listed.
3. Where rows meet, the chains of three and four segments are checked, then all bits. From a larger run only a spanning forest
   of its links is returned, by search from one fingerprint to the next.

Links join fingerprints, not documents: copies are one fingerprint. Components and ids never come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sievelight.llm.common import bounded_batches, drop, partitions, save, spread_join
from sievelight.llm.components import components
from sievelight.llm.textkit import SEP, text_buffers

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Widths of the segments, from the lowest bit on.
WIDTHS = (13, 13, 13, 13, 12)
SEGMENTS = len(WIDTHS)
LOW = tuple(sum(WIDTHS[:i]) for i in range(SEGMENTS))
#: A key with more rows of large contributors than this is made longer.
LIMIT = 2_048
#: Longest chain of a key.
LONGEST = SEGMENTS - 1
#: A run of up to this many rows is compared pair by pair.
SHORT = 8
#: A table of at most so many slim rows is broadcast to those it meets; a larger one is shuffled with them.
SMALL = 65_536
#: Bytes of a text, and shingles, that are handled at a time.
PIECE, VOTES = 1 << 20, 1 << 15
#: Rows with keys that are looked through at a time.
GATHER = 1 << 16


def pieces(data: np.ndarray) -> Iterator[bytes]:
    """Parts of about ``PIECE`` bytes that end after a separator; a longer word stays whole."""
    lo = 0
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        while hi < len(data) and not SEP[data[hi - 1]]:
            ahead = np.flatnonzero(SEP[data[hi : hi + PIECE]])
            hi = hi + int(ahead[0]) + 1 if len(ahead) else min(hi + PIECE, len(data))
        yield data[lo:hi].tobytes()
        lo = hi


def votes(hashes: list[int]) -> np.ndarray:
    """How many of the 64-bit numbers have each bit, from the lowest on."""
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(data: np.ndarray) -> int:
    """SimHash of a text's UTF-8 bytes: a bit is 1 if over half of the shingles' hashes have it; no words give 0."""
    total, n, carried = np.zeros(64, np.int64), 0, []
    for piece in pieces(data):
        words = carried + piece.lower().split()
        for lo in range(0, max(0, len(words) - SHINGLE + 1), VOTES):
            part = words[lo : lo + VOTES + SHINGLE - 1]
            line = b" ".join(part)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])[: len(part) - SHINGLE + 1].tolist()
            hashes = [xxh64_intdigest(line[b:e], SEED) for b, e in zip(begins, ends[SHINGLE - 1 :].tolist(), strict=True)]
            total += votes(hashes)
            n += len(hashes)
        carried = words[max(0, len(words) - SHINGLE + 1) :]
    if not n and carried:
        return xxh64_intdigest(b" ".join(carried), SEED)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_buffers(b.column(1))
        prints = np.array([fingerprint(data[lo:hi]) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def budget(length: int) -> int:
    """Differences that a chain of so many segments may have."""
    return length * RADIUS // SEGMENTS


def _flips(segment: int, most: int) -> list[list[int]]:
    """For 0 to ``most`` differences: the patterns of so many bits in the segment, as signed 64-bit numbers."""
    bits = [1 << (LOW[segment] + k) for k in range(WIDTHS[segment])]
    out, last = [[0]], [(0, -1)]
    for _ in range(most):
        last = [(v | bits[k], k) for v, top in last for k in range(top + 1, len(bits))]
        out.append([v - (1 << 64) if v >> 63 else v for v, _ in last])
    return out


def _mask(segments: list[int]) -> int:
    v = sum(((1 << WIDTHS[s]) - 1) << LOW[s] for s in segments)
    return v - (1 << 64) if v >> 63 else v


def chain(start: int, length: int) -> list[int]:
    return [(start + k) % SEGMENTS for k in range(length)]


def _variants(segment: int, least: int, most: int) -> Column:
    """(flip, more): patterns of the segment's bits and their numbers of bits, from ``least`` to ``most``."""
    return F.array(*[F.struct(F.lit(v).cast("long").alias("flip"), F.lit(e).alias("more")) for e, of in enumerate(_flips(segment, most)) for v in of if e >= least])


def first_keys(prints: DataFrame) -> DataFrame:
    """(start, key, used, fp): chain keys of two segments; ``used`` is the number of altered bits."""
    out = None
    for start in range(SEGMENTS):
        second = chain(start, 2)[1]
        odd = F.bit_count(F.col("fp").bitwiseAND(F.lit(_mask([second])))) % 2 == 1
        each = F.explode(F.when(odd, _variants(second, 0, budget(2))).otherwise(_variants(second, 0, 0)))
        rows = prints.select("fp", each.alias("x")).select(F.lit(start).alias("start"), F.col("fp").bitwiseXOR(F.col("x.flip")).bitwiseAND(F.lit(_mask(chain(start, 2)))).alias("key"), F.col("x.more").alias("used"), "fp")
        out = rows if out is None else out.unionByName(rows)
    return out


def longer_keys(rows: DataFrame, length: int) -> DataFrame:
    """``rows`` with keys of one segment more, making ``length``, in all ways that the budget allows."""
    out = None
    for start in range(SEGMENTS):
        last = chain(start, length)[-1]
        own = F.lit(_mask([last]))
        fits = F.filter(_variants(last, 0, budget(length)), lambda x: x["more"] + F.col("used") <= budget(length))
        made = rows.where(F.col("start") == start).select("start", "key", "used", "fp", F.explode(fits).alias("x"))
        made = made.select("start", F.col("key").bitwiseOR(F.col("fp").bitwiseXOR(F.col("x.flip")).bitwiseAND(own)).alias("key"), (F.col("used") + F.col("x.more")).alias("used"), "fp")
        out = made if out is None else out.unionByName(made)
    return out


def _hot(plain: DataFrame, limit: int, first: bool) -> DataFrame:
    """(start, key) of the keys that large groups of ``plain`` rows bring over ``limit`` rows: their own and, at the
    first length, the altered ones from groups whose keys differ in a bit. What smaller groups add to a key stays under the limit too."""
    large = plain.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n"))
    if not first:
        return large.where(F.col("n") > limit).select("start", "key")
    large = large.where(F.col("n") > limit // (WIDTHS[0] + 1))
    spread = None
    for start in range(SEGMENTS):
        second = chain(start, 2)[1]
        odd = F.bit_count(F.col("key").bitwiseAND(F.lit(_mask([second])))) % 2 == 1
        each = F.explode(F.when(odd, _variants(second, 0, 1)).otherwise(_variants(second, 0, 0)))
        rows = large.where(F.col("start") == start).select("start", "key", "n", each.alias("x")).select("start", F.col("key").bitwiseXOR(F.col("x.flip")).alias("key"), "n")
        spread = rows if spread is None else spread.unionByName(rows)
    return spread.groupBy("start", "key").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("start", "key")


U = np.uint64


def near(one: np.ndarray, two: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """Indexes of the pairs that pass chain after chain, then the whole fingerprint. ``masks``: per start, those of the chains
    of three and more segments, in the pairs' order."""
    differ, at = one ^ two, np.arange(len(one))
    for length, mask in masks:
        keep = np.bitwise_count(differ & mask[at]) <= budget(length)
        differ, at = differ[keep], at[keep]
    return at[np.bitwise_count(differ) <= RADIUS]


MASKS = [(length, np.array([_mask(chain(s, length)) for s in range(SEGMENTS)], np.int64).view(U)) for length in range(3, SEGMENTS)]


def _run_links(fp: np.ndarray, plain: np.ndarray, masks: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among rows with one key; pairs of two altered rows need no comparison here."""
    left, found = np.arange(len(fp)), []
    while len(left) or found:
        if not found:
            found, left = [int(left[-1])], left[:-1]
        at = found.pop()
        other = left if plain[at] else left[plain[left]]
        if not len(other):
            continue
        hit = other[near(np.broadcast_to(fp[at], len(other)), fp[other], [(n, np.broadcast_to(m, len(other))) for n, m in masks])]
        if len(hit):
            yield np.broadcast_to(fp[at], len(hit)), fp[hit]
            found += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of at least ``GATHER`` rows, but for the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= GATHER:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of linked fingerprints; rows (start, key, used, fp) come sorted by start and key, those of a key as they are first."""
    held: pa.Table | None = None

    def of(t: pa.Table) -> pa.RecordBatch:
        start, key, used, fp = (t[c].to_numpy() for c in ("start", "key", "used", "fp"))
        fp, plain = fp.view(U), used == 0
        cut = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (key[1:] != key[:-1])]))
        size = np.diff(np.append(cut, len(fp)))
        ones, twos = [], []
        run = np.repeat(np.arange(len(cut)), size)
        short = size[run] <= SHORT
        for step in range(1, SHORT):
            i = np.flatnonzero(short[:-step] & (run[:-step] == run[step:]) & plain[:-step]) if step < len(fp) else []
            if not len(i):
                break
            i = i[near(fp[i], fp[i + step], [(n, m[start[i]]) for n, m in MASKS])]
            ones.append(fp[i])
            twos.append(fp[i + step])
        for r in np.flatnonzero((size > SHORT) & plain[cut]).tolist():
            s = slice(int(cut[r]), int(cut[r] + size[r]))
            for a, b in _run_links(fp[s], plain[s], [(n, m[start[cut[r]]]) for n, m in MASKS]):
                ones.append(a)
                twos.append(b)
        a, b = (np.concatenate(x) if x else np.zeros(0, U) for x in (ones, twos))
        pairs = np.unique(np.stack([a, b], axis=1).view(np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for t in gathered(batches):
        t = pa.concat_tables([held, t]) if held is not None else t
        last = (t["start"][-1].as_py(), t["key"][-1].as_py())
        start, key = t["start"].to_numpy(), t["key"].to_numpy()
        before = int(np.searchsorted((start == last[0]) & (key == last[1]), True))
        if before:
            yield of(t.slice(0, before))
        held = t.slice(before)
    if held is not None:
        yield of(held)


def _met(rows: DataFrame) -> DataFrame:
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "start", "key").sortWithinPartitions("start", "key", "used").mapInArrow(_links, "a long, b long")


def links(prints: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, list[str]]:
    """(a, b): links of the distinct fingerprints ``prints`` (fp, a saved table) that connect what is linked."""
    rows, paths, parts = first_keys(prints), [], []
    for length in range(2, LONGEST + 1):
        hot = None
        if length < LONGEST:
            plain = rows.where("used = 0")
            hot, hot_path = save(_hot(plain, limit, length == 2), "hot-keys")
            paths.append(hot_path)
            hot = None if hot.isEmpty() else hot
        if hot is None:
            parts.append(_met(rows))
            break
        hint = F.broadcast(hot) if hot.limit(SMALL + 1).count() <= SMALL else hot
        parts.append(_met(rows.join(hint, ["start", "key"], "left_anti").select("start", "key", "used", "fp")))
        rows, rows_path = save(longer_keys(rows.join(hint, ["start", "key"], "left_semi"), length + 1), "longer-keys")
        paths.append(rows_path)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out, out_path = save(out, "links")
    return out, [*paths, out_path]


def simhash_groups(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest id that is reachable over links, from a fingerprint to one with at most ``RADIUS`` other
    bits. Null and empty texts, and those of separators alone, have fingerprint zero and are linked like any other; a text with fewer words than
    a shingle is one shingle. A row with a null id has a component too, but gives it no id; one without any id has null. Repeated
    ids and rows are rows like any other. Other columns don't matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed, signed_path = save(source.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    classes, classes_path = save(signed.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    found, paths = links(classes.select("fp"))
    named, named_path = save(components(found, "linked"), "found")
    joined = classes.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined, joined_path = save(joined, "named")
    least, least_path = save(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    n = joined.count()
    of = spread_join(joined.select("fp", "component", F.col("n").alias("rows")), least, "component", n)
    of, of_path = save(of.select("fp", "component_id", F.col("rows").alias("n")), "components")
    out = spread_join(signed, of, "fp", signed.count())
    out, _ = save(out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), "simhash")
    drop(spark, signed_path, classes_path, *paths, named_path, joined_path, least_path, of_path)
    return out


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Near-duplicate documents by b-bit MinHash with exact confirmation.

One pass over the texts makes, per document, the 64-bit minima of ``HASHES`` hash functions over its word shingles. Bands of
``ROWS`` minima give bucket keys; of each minimum only the low ``BITS`` bits are kept, packed as bit planes, and two
signatures are compared by population counts, corrected for chance agreement. Both are written with the document's id; no
later step makes them again. Documents with the same shingle set are one class, represented by their smallest id, before
anything is paired.

1. In every bucket each member is paired with the smallest one, the hub: at most ``BANDS`` pairs a member, whatever the bucket's
   size. Pairs whose estimate is ``MARGIN`` below the threshold go; for the others the texts meet, in tasks of one hub and at
   most ``BLOCK_ROWS`` members, and are confirmed on full shingle sets. The links join most members into components.
2. Buckets that still hold members of two components are compared by their written signatures alone, in tiles of bounded
   size: members of one component are never compared with each other, nor those that met in an earlier band. Only members with a
   partner left get their texts, meet in their tile, and are confirmed; a tile returns at most one edge per member.

Confirmation hashes words with a key drawn anew in each run, so texts can't be made up to look alike.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import bounded_batches, drop, lean, partitions, save, spread_join
from sievelight.llm.components import components
from sievelight.llm.textkit import KEY, Grams, U, gram_starts, mix, words

SHINGLE = 5
#: A pair at a similarity of 0.8 shares no band with probability 1.5e-5, one at 0.85 with 7e-8.
BANDS, ROWS, BITS = 28, 5, 4
HASHES = BANDS * ROWS
#: Over four standard errors of the corrected estimate at a similarity of 0.8.
MARGIN = 0.15
#: Members, and their shingles, that one task confirms or compares at a time.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000
_rng = np.random.default_rng(9)
MULT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1)
ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
STEP = 1 << 16


def shingle_sets(column: pa.Array, k: int = SHINGLE, key: bytes = KEY, both: bool = False) -> Iterator:
    """The sorted distinct shingle hashes of each row: k-word shingles, or with fewer words the whole sequence as one. With
    ``both`` each row also gives those of the words' second hashes."""
    for w in words(column, lower=True, key=key):
        starts, per = gram_starts(w.first, k)
        n = np.diff(w.first)
        short = np.flatnonzero((per == 0) & (n > 0))
        at = np.concatenate([[0], np.cumsum(per)])
        hashes = []
        for h in (w.hash, w.other) if both else (w.hash,):
            grams = Grams(h)
            hashes.append((grams.of(starts, k), dict(zip(short.tolist(), grams.of(w.first[short], n[short]), strict=True))))
        for r in range(w.rows):
            sets = [np.unique(full[at[r] : at[r + 1]]) if per[r] else np.array([whole[r]] if r in whole else [], np.uint64) for full, whole in hashes]
            yield tuple(sets) if both else sets[0]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Row i, column j: the minimum of hash function j over set i. Sets must not be empty."""
    out = np.full((len(sets), HASHES), ~U(0), np.uint64)
    flat = np.concatenate(sets)
    ends = np.cumsum([len(s) for s in sets])
    begins = ends - [len(s) for s in sets]
    for lo in range(0, len(flat), STEP):  # pieces that stay in the processor's cache
        part = flat[lo : lo + STEP]
        r0, r1 = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(begins, lo + len(part), "left"))
        cuts = np.maximum(begins[r0:r1] - lo, 0)
        for j in range(HASHES):
            np.minimum(out[r0:r1, j], np.minimum.reduceat(part * MULT[j] + ADD[j], cuts), out=out[r0:r1, j])
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima as BITS planes of HASHES bits in uint64 words: shape (rows, BITS, words)."""
    low = (low & U((1 << BITS) - 1)).astype(np.uint8)
    planes = np.stack([np.packbits((low >> p) & 1, axis=1) for p in range(BITS)], axis=1)
    wide = np.zeros((*planes.shape[:2], -(-planes.shape[2] // 8) * 8), np.uint8)
    wide[:, :, : planes.shape[2]] = planes
    return wide.view(np.uint64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to many: agreeing b-bit values by bit counts, corrected for collisions."""
    differ = np.bitwise_or.reduce(many ^ one, axis=1)
    agree = 1 - np.bitwise_count(differ).sum(axis=1) / HASHES
    chance = 0.5**BITS
    return (agree - chance) / (1 - chance)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("same_set", pa.binary()), ("bands", pa.list_(pa.int64())), ("sign", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sets = b.column(0), list(shingle_sets(b.column(1), both=True))
        sizes = np.array([len(s) for s, _ in sets], np.int64)
        some = np.flatnonzero(sizes)
        keys: list = [None] * len(sets)
        prints: list = [None] * len(sets)
        signs: list = [None] * len(sets)
        if len(some):
            low = minima([sets[i][0] for i in some])
            band = np.zeros((len(some), BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band ^ low[:, r::ROWS]) + U(r)
            band = mix(band + np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)
            packed = pack(low)
            for i, r in enumerate(some.tolist()):
                keys[r], signs[r] = band[i].tolist(), packed[i].tobytes()
                prints[r] = blake2b(np.concatenate(sets[r]).tobytes(), digest_size=24).digest()
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())], schema=SIGNED)


def unpack(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint64).reshape(len(signs), BITS, -1)


def alike(one: np.ndarray, two: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return np.minimum(one, two) * den >= np.maximum(one, two) * num


def _prune(num: int, den: int):
    """Keeps the pairs (a, b) whose sizes and written signatures may reach the threshold, and those of an id that has two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            known = b.column(b.schema.get_field_index("sign_a")).is_valid()
            some = b.filter(known)
            keep = [b.filter(pc.invert(known))]
            if some.num_rows:
                one, two = (unpack(some.column(some.schema.get_field_index(c)).to_pylist()) for c in ("sign_a", "sign_b"))
                na, nb = (some.column(some.schema.get_field_index(c)).to_numpy() for c in ("n_a", "n_b"))
                keep.append(some.filter(pa.array(alike(na, nb, num, den) & (estimate(one, two) >= num / den - MARGIN))))
            yield from (k.select(["a", "b", "n_b"]) for k in keep)

    return run


def linked(one: np.ndarray, two: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both * den >= num * (len(one) + len(two) - both)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal ``keys``; rows come sorted by them."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[:, lo].tolist())
            if key != now and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], schema=EDGES)


def _spokes(num: int, den: int, key: bytes):
    """Confirms each member against the hub, which is the group's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["hub", "block"]):
            ids, hub = t["doc_id"].to_numpy(), t["hub"][0].as_py()
            sets = list(shingle_sets(whole(t["text"]), key=key))
            centre = [s for i, s in zip(ids.tolist(), sets, strict=True) if i == hub]
            yield _edges([(hub, i) for i, s in zip(ids.tolist(), sets, strict=True) if i != hub and any(linked(c, s, num, den) for c in centre)])

    return run


def _partners(num: int, den: int):
    """Members of a tile that have, by signature, a partner of another component which they don't meet in an earlier band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["band", "one", "two"]):
            side, grp, size = (t[c].to_numpy() for c in ("side", "component", "n_shingles"))
            nth = t["nth"][0].as_py()
            sign = unpack(t["sign"].to_pylist())
            bands = whole(t["bands"]).flatten().to_numpy().reshape(len(side), -1)[:, :nth]
            across = side.min() != side.max()
            flag = np.zeros(len(side), bool)
            for i in range(len(side) - 1):
                may = (grp[i + 1 :] != grp[i]) & alike(size[i + 1 :], size[i], num, den)
                if across:
                    may &= side[i + 1 :] != side[i]
                js = np.flatnonzero(may) + i + 1
                js = js[estimate(sign[i], sign[js]) >= num / den - MARGIN]
                if nth and len(js):
                    js = js[~(bands[js] == bands[i]).any(axis=1)]
                if len(js):
                    flag[i] = True
                    flag[js] = True
            if flag.any():
                yield pa.RecordBatch.from_struct_array(t.select(["band", "one", "two", "side", "doc_id", "component"]).filter(pa.array(flag)).to_struct_array().combine_chunks())

    return run


def _tiles(num: int, den: int, key: bytes):
    """Edges that connect what is linked in a tile: between its sides if it has two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["band", "one", "two"]):
            ids, side, group = (t[c].to_numpy() for c in ("doc_id", "side", "component"))
            group = group.copy()
            sets = list(shingle_sets(whole(t["text"]), key=key))
            size = np.array([len(s) for s in sets])
            sign = pack(minima(sets)) if size.min() else None
            edges, across = [], side.min() != side.max()
            for i in range(len(ids) - 1):
                may = (group[i + 1 :] != group[i]) & alike(size[i + 1 :], size[i], num, den)
                if across:
                    may &= side[i + 1 :] != side[i]
                js = np.flatnonzero(may) + i + 1
                if not len(js):
                    continue
                guess = estimate(sign[i], sign[js]) if sign is not None else np.ones(len(js))
                for j in js[np.argsort(-guess, kind="stable")[: int((guess >= num / den - MARGIN).sum())]].tolist():
                    if group[j] != group[i] and linked(sets[i], sets[j], num, den):
                        edges.append((int(ids[i]), int(ids[j])))
                        group[group == group[j]] = group[i]
            yield _edges(edges)

    return run


def _confirm_spokes(stars: DataFrame, source: DataFrame, num: int, den: int, key: bytes) -> tuple[DataFrame, str]:
    """Links (a, b) among the pairs (a, b, n_b), a being the hub: hubs meet their members in blocks of bounded size."""
    spark, n = stars.sparkSession, partitions(stars.sparkSession)
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_b") / BLOCK_SHINGLES)).cast("int")
    hubs, path = save(stars.groupBy("a").agg(size.alias("blocks"), F.count(F.lit(1)).alias("n")), "hubs")
    spokes = spread_join(stars.select("a", "b"), hubs, "a", stars.count()).select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), F.col("b").alias("doc_id"))
    centres = hubs.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("doc_id"))
    dealt, dealt_path = save(spokes.unionByName(centres), "dealt")
    met = dealt.hint("shuffle_hash").join(source, "doc_id").repartition(n, "hub", "block").sortWithinPartitions("hub", "block").select("doc_id", "text", "hub", "block")
    out, links_path = save(met.mapInArrow(lean(_spokes(num, den, key)), "a long, b long"), "links")
    drop(spark, path, dealt_path)
    return out, links_path


def _residual(banded: DataFrame, hubs: DataFrame, found: DataFrame, rows: int) -> tuple[DataFrame, list[str]]:
    """Tiles of the buckets in which members other than the hub are in two components.

    A component with over ``BLOCK_ROWS`` members in a bucket has cells of its own, the others share cells; every two cells meet in
    a tile, except cells of the same component.
    """
    many = hubs.where("n > 2")
    inside = spread_join(banded, many, "band", rows).where("doc_id <> hub").drop("hub")
    named, named_path = save(inside.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "buckets")
    split = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("band", "n")
    split, split_path = save(split.withColumn("members", F.col("n")), "split")
    left, left_path = save(spread_join(named, split, "band", named.count()), "left")
    rows = left.count()
    per, per_path = save(left.groupBy(F.xxhash64("band", "component").alias("both")).agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.col("n")), "per")
    big = F.col("own") >= BLOCK_ROWS
    cell = spread_join(left.withColumn("both", F.xxhash64("band", "component")), per, "both", rows).select(
        "band", "nth", "doc_id", "component", F.when(big, F.col("component")).alias("of"),
        F.pmod(F.xxhash64(F.when(big, F.col("doc_id")).otherwise(F.col("component"))), F.ceil(F.when(big, F.col("own")).otherwise(F.col("members")) / BLOCK_ROWS)).cast("int").alias("part"),
    )
    cell, cell_path = save(cell.withColumn("cell", F.xxhash64("of", "part")), "cell")
    cells = cell.groupBy("band").agg(F.collect_set(F.struct("cell", "of")).alias("cells"), F.count(F.lit(1)).alias("n"))
    cells, cells_path = save(cells, "cells")
    partners = F.expr("filter(cells, x -> x.of is null or of is null or x.of <> of)")
    tiles = (
        spread_join(cell, cells, "band", rows)
        .withColumn("other", F.explode(partners))
        .select("band", "nth", "doc_id", "component", F.least("cell", "other.cell").alias("one"), F.greatest("cell", "other.cell").alias("two"), (F.col("cell") > F.col("other.cell")).cast("int").alias("side"))
    )
    return tiles, [named_path, split_path, left_path, per_path, cell_path, cells_path]


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", num: int = 80, den: int = 100) -> DataFrame:
    """Link rows of ``docs`` whose shingle sets have den * intersection >= num * union, and give their components.

    Returns one row per input row: (doc_id, n_shingles, component_id). component_id is the smallest id reachable over links.
    A null, empty or blank text has no shingles and is its own component; a text with fewer words than a shingle is one
    shingle. Rows with a null id are ignored. Rows that repeat an id count as copies or variants under that id: with the same
    text they are one class, and with different texts the id stays one node. Extra columns don't matter. Ties of the threshold
    are links. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n, key = partitions(spark), secrets.token_bytes(16)
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    signed, signed_path = save(source.mapInArrow(lean(_sign), "doc_id long, n_shingles long, same_set binary, bands array<long>, sign binary"), "signed")
    reps, reps_path = save(signed.where("n_shingles > 0").groupBy("same_set").agg(F.min("doc_id").alias("rep")).select("same_set", "rep"), "classes")
    slim, slim_path = save(signed.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "same_set"], "left_semi").dropDuplicates(["doc_id", "same_set"]).drop("same_set"), "signatures")

    banded = slim.select("doc_id", F.posexplode("bands").alias("nth", "band"))
    buckets = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("hub < last").drop("last")
    hubs, hubs_path = save(buckets, "buckets")
    rows = slim.count() * BANDS
    stars = spread_join(banded, hubs, "band", rows).where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars, stars_path = save(stars, "stars")
    named = lambda c: slim.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sign").alias(f"sign_{c}"))
    with_b, with_b_path = save(stars.join(named("b"), "b"), "spokes")
    centres, centres_path = save(stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(named("a"), "a").groupBy("a", "n").agg(F.max("n_a").alias("n_a"), F.when(F.count(F.lit(1)) == 1, F.max("sign_a")).alias("sign_a")), "centres")
    pairs, pairs_path = save(spread_join(with_b, centres, "a", with_b.count()).mapInArrow(_prune(num, den), "a long, b long, n_b long").dropDuplicates(["a", "b"]), "pairs")
    first, first_path = _confirm_spokes(pairs, source, num, den, key)
    drop(spark, stars_path, with_b_path, centres_path, pairs_path)

    found, found_path = save(components(first, "linked"), "found")
    tiles, paths = _residual(banded, hubs, found, rows)
    shown = tiles.join(slim, "doc_id").repartition(n, "band", "one", "two").sortWithinPartitions("band", "one", "two")
    left = shown.select("band", "nth", "one", "two", "side", "doc_id", "component", "n_shingles", "sign", "bands").mapInArrow(_partners(num, den), "band long, one long, two long, side int, doc_id long, component long")
    left, left_path = save(left, "partners")
    met = left.hint("shuffle_hash").join(source, "doc_id").repartition(n, "band", "one", "two").sortWithinPartitions("band", "one", "two").select("doc_id", "text", "band", "one", "two", "side", "component")
    second, second_path = save(met.mapInArrow(_tiles(num, den, key), "a long, b long"), "links")

    found, last_path = save(components(first.unionByName(second), "linked"), "found")
    out = signed.select("doc_id", "n_shingles", "same_set").join(reps, "same_set", "left")
    out = out.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    out, _ = save(out, "near")
    drop(spark, signed_path, reps_path, slim_path, hubs_path, first_path, found_path, *paths, left_path, second_path, last_path)
    return out


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), num=85)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


#: The rows of ``op9_near_dedup`` from all pairs of distinct sets that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM g GROUP BY doc_id),
class AS (SELECT h, min(doc_id) AS rep, min(n) AS n FROM sets GROUP BY h),
rg AS (SELECT rep, n, s FROM class JOIN g ON g.doc_id = class.rep),
pair AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM rg a JOIN rg b USING (s) WHERE a.rep < b.rep GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM pair WHERE 100 * shared >= 85 * (na + nb - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS a, rep AS b FROM class UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
component AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN class ON class.h = sets.h LEFT JOIN component ON component.rep = class.rep
"""


def keep_first(docs: DataFrame, num: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, all columns unchanged; rows with a null id stay."""
    ids = near_duplicates(docs, num=num)
    gone = ids.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti")

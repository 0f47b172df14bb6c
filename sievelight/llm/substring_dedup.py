"""Removal of long repeated word spans by suffix automata over sharded references.

Keeping one automaton over the whole corpus, or sending every document to every shard, would not scale. The reference is
therefore sharded by content: every window of ``span`` words chooses its smallest ``GRAM``-word hash as anchor, so that equal
windows, wherever they stand, choose equal anchors and meet in the same shard. The windows of a document that share an anchor
place are consecutive and form one segment.

1. Anchors that occur in two documents are found by an aggregate over (anchor, document).
2. Only segments of those anchors are cut from the texts. Equal segments are one row with their smallest document.
3. Each shard builds the suffix automaton of its distinct segments, annotated with the smallest document, and streams the
   segments through it for matching statistics held at ``span`` words, which name the first document of each window.
4. A document loses the maximal spans covered by windows whose first document is smaller than itself.

An anchor with over ``SHARD_SEGMENTS`` distinct segments (a very common passage in ever-changing surroundings) is dealt out again
by a second, longer anchor, which parts the windows that reach into the surroundings from the others. What is still over the
limit is dealt out by its whole windows, whose equals meet in an aggregate, so that no shard grows without bound.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.automaton import SuffixAutomaton
from sievelight.llm.common import bounded_batches, drop, fresh, lean, partitions, save, spread_join
from sievelight.llm.textkit import Grams, Words, mix, words

SPAN, GRAM = 50, 16
SHARD_SEGMENTS = 512


def anchors(w: Words, grams: Grams, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each maximal run of windows with the same anchor place: anchor hash, first window, number of windows, row.

    Windows and places are word numbers in ``w``. The anchor of a window is its smallest gram hash, the first on ties.
    """
    none = np.zeros(0, np.int64)
    n = len(w.hash)
    if n < span:
        return none.astype(np.uint64), none, none, none
    g = grams.of(np.arange(n - gram + 1), gram)
    width = span - gram + 1
    best, at, step = g, np.arange(len(g)), 1
    # doubling: the minimum over `width` places from minima over powers of two
    while step * 2 <= width:
        left, right = best[:-step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        step *= 2
    shift = width - step
    left, right = best[: len(best) - shift], best[shift:]
    take = right < left
    best, at = np.where(take, right, left), np.where(take, at[shift:], at[: len(at) - shift])
    row = w.row_of()
    ok = row[: n - span + 1] == row[span - 1 :]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    place = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[starts[1:]] != row[starts[:-1]])]))
    lo = starts[new]
    count = np.diff(np.concatenate([new, [len(starts)]]))
    return best[lo], lo, count, row[lo]


PLACES = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("first", pa.int64())])


def _places(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in words(b.column(1)):
                key, lo, _, row = anchors(w, Grams(w.hash), span, gram)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[w.row0 + row]), pa.array(key.view(np.int64)), pa.array(lo - w.first[row])], schema=PLACES)

    return run


def _prints(a: Grams, b: Grams, start: np.ndarray, length) -> list[bytes]:
    both = np.stack([a.of(start, length), b.of(start, length)], axis=1)
    return [x.tobytes() for x in both]


SEGMENTS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("anchor", pa.int64()), ("print", pa.binary()), ("windows", pa.int64()), ("words", pa.binary())])


def _segments(span: int, gram: int):
    """Cuts the segments that start at the listed window numbers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wanted = b.column(0).to_numpy(), b.column(2)
            for w in words(b.column(1)):
                one, two = Grams(w.hash), Grams(w.other)
                key, lo, count, row = anchors(w, one, span, gram)
                if not len(key):
                    continue
                starts = [np.asarray(wanted[w.row0 + r].values.to_numpy(zero_copy_only=False)) + w.first[r] for r in range(w.rows)]
                keep = np.isin(lo, np.concatenate(starts))
                key, lo, count, row = key[keep], lo[keep], count[keep], row[keep]
                if not len(key):
                    continue
                raw = w.data.tobytes()
                text = [raw[s:e] for s, e in zip(w.start[lo].tolist(), w.end[lo + count + span - 2].tolist(), strict=True)]  # white space as it stands
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[w.row0 + row]), pa.array(lo - w.first[row]), pa.array(key.view(np.int64)), pa.array(_prints(one, two, lo, count + span - 1), pa.binary()), pa.array(count), pa.array(text, pa.binary())],
                    schema=SEGMENTS,
                )

    return run


FOUND = pa.schema([("anchor", pa.int64()), ("print", pa.binary()), ("owners", pa.list_(pa.int64()))])


def _shards(span: int):
    """Streams shards, sorted by anchor: builds each one's automaton and looks every window of its segments up."""

    def owners(prints: list[bytes], texts: list[bytes], docs: list[int]) -> list[list[int]]:
        split = [t.split() for t in texts]  # bytes.split() cuts at the same six separators
        if len(split) == 1:  # the automaton of one segment finds each of its windows in that segment
            return [[docs[0]] * (len(split[0]) - span + 1)]
        sam = SuffixAutomaton()
        for tokens, doc in zip(split, docs, strict=True):
            sam.add(tokens, doc)
        sam.finish()
        return [sam.owners(tokens, span) for tokens in split]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints, texts, docs = None, [], [], []
        for b in batches:
            for k, p, d, t in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("anchor", "print", "doc", "words")), strict=True):
                if k != key and prints:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(prints)), pa.array(prints, pa.binary()), pa.array(owners(prints, texts, docs), pa.list_(pa.int64()))], schema=FOUND)
                    prints, texts, docs = [], [], []
                key = k
                prints.append(p)
                texts.append(t)
                docs.append(d)
        if prints:
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(prints)), pa.array(prints, pa.binary()), pa.array(owners(prints, texts, docs), pa.list_(pa.int64()))], schema=FOUND)

    return run


PARTS = pa.schema([("parent", pa.int64()), ("whole", pa.binary()), ("at", pa.int64()), ("doc", pa.int64()), ("last", pa.int64()), ("anchor", pa.int64()), ("print", pa.binary()), ("words", pa.binary())])


def _recut(span: int, gram: int):
    """Cuts segments again by a second, longer anchor: windows that reach far into unlike surroundings part from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.get_field_index
            parent, whole, doc, last = (b.column(names(c)) for c in ("anchor", "print", "doc", "last"))
            keys = parent.to_numpy().view(np.uint64)
            for w in words(b.column(names("words"))):
                one, two = Grams(w.hash), Grams(w.other)
                key, lo, count, row = anchors(w, one, span, gram)
                take = pa.array(row + w.row0)
                raw = w.data.tobytes()
                text = [raw[s:e] for s, e in zip(w.start[lo].tolist(), w.end[lo + count + span - 2].tolist(), strict=True)]
                both = mix(key ^ mix(keys[row + w.row0])).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [parent.take(take), whole.take(take), pa.array(lo - w.first[row]), doc.take(take), last.take(take), pa.array(both), pa.array(_prints(one, two, lo, count + span - 1), pa.binary()), pa.array(text, pa.binary())],
                    schema=PARTS,
                )

    return run


WINDOWS = pa.schema([("anchor", pa.int64()), ("print", pa.binary()), ("nth", pa.int64()), ("doc", pa.int64()), ("window", pa.binary())])


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.get_field_index
            anchor, prints, doc = (b.column(names(c)) for c in ("anchor", "print", "doc"))
            for w in words(b.column(names("words"))):
                one, two = Grams(w.hash), Grams(w.other)
                per = np.diff(w.first) - span + 1
                row = np.repeat(np.arange(w.rows), per)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                take = pa.array(row + w.row0)
                yield pa.RecordBatch.from_arrays([anchor.take(take), prints.take(take), pa.array(nth), doc.take(take), pa.array(_prints(one, two, w.first[row] + nth, span), pa.binary())], schema=WINDOWS)

    return run


def _owners(distinct: DataFrame, span: int, n: int, again: bool = True) -> tuple[DataFrame, list[str]]:
    """(anchor, print, nth, owner): the smallest document of each window of distinct segments (anchor, print, doc, last, words).

    ``distinct`` must be a saved table. Also returns the paths of tables that the result reads.
    """
    shards = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("last").alias("hi")).where("lo < hi")
    shards, path = save(shards.select("anchor", "n", F.col("n").alias("segments")), "shards")
    sized = spread_join(distinct, shards, "anchor", distinct.count()).select("anchor", "print", "doc", "last", "words", "segments")
    small = sized.where(f"segments <= {SHARD_SEGMENTS}").repartition(n, "anchor").sortWithinPartitions("anchor").select("anchor", "print", "doc", "words")
    by_shard = small.mapInArrow(lean(_shards(span)), "anchor long, print binary, owners array<long>").select("anchor", "print", F.posexplode("owners").alias("nth", "owner")).where("owner is not null")
    large = sized.where(f"segments > {SHARD_SEGMENTS}").select("anchor", "print", "doc", "last", "words")
    if again:
        parts, parts_path = save(large.mapInArrow(_recut(span, span * 4 // 5), "parent long, whole binary, at long, doc long, last long, anchor long, print binary, words binary"), "parts")
        whole = parts.groupBy("anchor", "print").agg(F.min("doc").alias("doc"), F.max("last").alias("last"), F.any_value("words").alias("words"))
        whole, whole_path = save(whole, "whole")
        found, paths = _owners(whole, span, n, again=False)
        # a run of windows that very many segments share is one row here; its rows in `parts` stay where they are
        owned = found.groupBy("anchor", "print").agg(F.collect_list(F.struct("nth", "owner")).alias("found"))
        key = F.concat(F.hex("anchor"), F.hex("print")).alias("piece")
        counts = parts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        keyed, keyed_path = save(owned.select(key, "found").join(counts, "piece"), "pieces")
        rest = spread_join(parts.select("parent", "whole", "at", key), keyed, "piece", parts.count()).select("parent", "whole", "at", F.explode("found").alias("f"))
        out = by_shard.unionByName(rest.select(F.col("parent").alias("anchor"), F.col("whole").alias("print"), (F.col("at") + F.col("f.nth")).cast("int").alias("nth"), F.col("f.owner").alias("owner")))
        return out, [path, parts_path, whole_path, keyed_path, *paths]
    windows = large.select("anchor", "print", "doc", "words").mapInArrow(_windows(span), "anchor long, print binary, nth long, doc long, window binary")
    first = windows.groupBy("anchor", "window").agg(F.min("doc").alias("owner"))
    by_window = windows.join(first, ["anchor", "window"]).select("anchor", "print", F.col("nth").cast("int").alias("nth"), "owner")
    return by_shard.unionByName(by_window), [path]


def repeated_spans(docs: DataFrame, text: str = "text", id: str = "doc_id", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The word spans that each document shares with a document of smaller id.

    Returns (doc_id, spans array<struct<from long, to long>>): word numbers from 0, ``to`` excluded, for runs of windows of
    ``span`` words whose sequence also starts in a smaller document. Spans may touch or overlap. Documents without any are not returned.
    Null, empty and short texts share nothing. Rows with a null id are ignored; rows that repeat an id are one document in what
    they own, and the spans of all of them are given under that id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    places, places_path = save(source.mapInArrow(lean(_places(span, gram)), "doc_id long, anchor long, first long"), "places")
    shared = places.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("anchor", "n")
    shared, shared_path = save(shared, "shared")
    wanted, wanted_path = save(spread_join(places, shared, "anchor", places.count()).groupBy("doc_id").agg(F.collect_set("first").alias("firsts")), "wanted")
    drop(spark, places_path, shared_path)

    cut = source.join(wanted, "doc_id").select("doc_id", "text", "firsts").mapInArrow(lean(_segments(span, gram)), "doc_id long, first long, anchor long, print binary, windows long, words binary")
    segments, segments_path = save(cut, "segments")
    distinct = segments.groupBy("anchor", "print").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last"), F.any_value("words").alias("words"))
    distinct, distinct_path = save(distinct, "distinct")
    by_place, paths = _owners(distinct, span, n)
    by_owner = by_place.groupBy("anchor", "print", "owner").agg(F.sort_array(F.collect_list("nth")).alias("nths"))
    # consecutive windows of one owner are one run, so that what follows has a row per run and not per window
    heads = F.expr("filter(nths, (x, i) -> i = 0 or nths[i - 1] <> x - 1)")
    tails = F.expr("filter(nths, (x, i) -> i = size(nths) - 1 or nths[i + 1] <> x + 1)")
    owned, owned_path = save(by_owner.select("anchor", "print", "owner", F.arrays_zip(heads.alias("head"), tails.alias("tail")).alias("runs")), "owners")

    hits = (
        segments.select("doc_id", "first", "anchor", "print")
        .join(owned, ["anchor", "print"])
        .where("owner < doc_id")
        .select("doc_id", F.explode(F.expr(f"transform(runs, r -> named_struct('from', first + r.head, 'to', first + r.tail + {span}))")).alias("s"))
    )
    merged = hits.groupBy("doc_id").agg(F.collect_set("s").alias("spans"))
    out, _ = save(merged, "spans")
    drop(spark, wanted_path, segments_path, distinct_path, owned_path, *paths)
    return out


def _cut(with_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, spans = b.column(0), b.column(2)
            counts, gone, kept = [], [], []
            for r, text in enumerate(b.column(1).cast(pa.large_binary()).to_pylist()):
                w = (text or b"").split()  # bytes.split() cuts at the six separators
                n, s = len(w), spans[r]
                if s.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    lo, hi = s.values.field(0).to_numpy(), s.values.field(1).to_numpy()
                    good = hi <= n  # of rows that repeat an id, a shorter text
                    np.add.at(edge, lo[good], 1)
                    np.add.at(edge, hi[good], -1)
                    w = list(itertools.compress(w, (np.cumsum(edge)[:-1] == 0).tolist()))
                counts.append(n)
                gone.append(n - len(w))
                left = b" ".join(w)
                kept.append(hashlib.sha256(left).hexdigest() if with_id else left.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if with_id else "kept"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", span: int = SPAN, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, n_removed, kept): the words left, joined by one space, or with ``digest`` their
    SHA-256 as kept_sha256. A null or empty text has no words and keeps the empty text. Rows with a null id have nothing
    removed. An empty table gives no rows.
    """
    spark = docs.sparkSession
    spans = repeated_spans(docs, text, id, span)
    bounded_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    last = "kept_sha256 string" if digest else "kept string"
    return rows.mapInArrow(lean(_cut(digest)), f"doc_id long, n_words long, n_removed long, {last}")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


#: The rows of ``op2_substring_dedup`` from every window of every document.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
owner AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
hit AS (SELECT win.doc_id, win.i FROM win JOIN owner USING (h) WHERE lo < win.doc_id),
span AS (SELECT doc_id, i, least(i + 50, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 50)) AS e FROM hit),
gone AS (SELECT doc_id, unnest(range(i, e)) AS i FROM span),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` with repeated spans removed from the text: the columns of ``docs``, n_chars made anew if there is one.

    Texts without a repeat stay as they are; the words left of others are joined by one space. No row is dropped. Of rows that
    repeat an id and are to lose something, all get the words left of the same one. Columns may have any name.
    """
    kept = fresh("kept", docs.columns)
    left = remove_repeats(docs, span=span).where("n_removed > 0").groupBy("doc_id").agg(F.min("kept").alias(kept))
    out = docs.join(left, "doc_id", "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

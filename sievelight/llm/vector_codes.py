"""Product codes for vectors, fitted by filtering Lloyd rounds.

Components become integers, floor(SCALE * x), and each vector is cut into equal consecutive parts; every part position has a
codebook of its own. Rows are packed where they are scanned into blocks of bounded size, and for each part position of a
block a kd-tree is built once: its row order is written with the block. In a round, tasks take the trees' bounding boxes, counts
and sums from the written order, and walk each tree level by level with the entries that may still be nearest: an entry goes
if, from the corner of the box that favours it most, it is no nearer than the one nearest to the box's middle. A node with one
entry left hands its cached count and sum to it, so whole subtrees are assigned at once; only leaves that stay undecided
compare points. Per round the driver gets one row per entry and component, and sends the codebooks (a fixed number of integers)
with the next one; vectors never move.

All arithmetic is on integers, so results don't depend on partitions, blocks or the order of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import bounded_batches, save, spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows, and components, of a block at most; a tree's leaves have from LEAF to twice as many points.
BLOCK_ROWS, BLOCK_VALUES, LEAF = 16_384, 1 << 21, 8
BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("width", pa.int32()), ("points", pa.binary()), ("orders", pa.binary())])
BLOCKS_DDL = "ids array<long>, labels array<string>, width int, points binary, orders binary"


def largest(dim: int) -> int:
    """Integers stop here, on both sides, so that squared distances over all components fit in 63 bits."""
    return math.isqrt((1 << 61) // max(dim, 1)) // 2


def to_integers(vectors: np.ndarray, dim: int) -> np.ndarray:
    most = largest(dim)
    return np.clip(np.floor(vectors * float(SCALE)), -most, most).astype(np.int64)


def segment_starts(n: int, depth: int) -> list[np.ndarray]:
    """Where the nodes of each level of a tree over n points begin: every node is cut in the middle."""
    levels = [np.array([0, n])]
    for _ in range(depth):
        s = levels[-1]
        levels.append(np.insert(s, np.arange(1, len(s)), (s[:-1] + s[1:]) // 2))
    return levels


def tree_depth(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def kd_order(points: np.ndarray) -> np.ndarray:
    """The order of rows in a kd-tree: each node is halved at the median of its widest component; equal points keep their order."""
    n = len(points)
    order = np.arange(n)
    if not points.shape[1]:
        return order
    for starts in segment_starts(n, tree_depth(n))[:-1]:
        at = points[order]
        wide = (np.maximum.reduceat(at, starts[:-1]) - np.minimum.reduceat(at, starts[:-1])).argmax(axis=1)
        node = np.repeat(np.arange(len(wide)), np.diff(starts))
        order = order[np.lexsort((at[np.arange(n), wide[node]], node))]
    return order


class Tree:
    """Boxes, counts and sums of the nodes of each level, over points in the tree's order."""

    def __init__(self, ordered: np.ndarray):
        self.points = ordered
        self.starts = segment_starts(len(ordered), tree_depth(len(ordered)))
        low, high, total = (f.reduceat(ordered, self.starts[-1][:-1]) for f in (np.minimum, np.maximum, np.add))
        self.low, self.high, self.sums = [low], [high], [total]
        for _ in self.starts[1:]:
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))
            self.sums.insert(0, self.sums[0][::2] + self.sums[0][1::2])

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each point (of equally near ones the first), and counts and sums of points by entry."""
        k, d = entries.shape
        codes = np.zeros(len(self.points), np.int64)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        nodes, may = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level, starts in enumerate(self.starts):
            may = filtered(self.low[level][nodes], self.high[level][nodes], entries, may)
            one = may.sum(axis=1) == 1
            done, entry = nodes[one], may[one].argmax(axis=1)
            size = starts[done + 1] - starts[done]
            np.add.at(counts, entry, size)
            np.add.at(sums, entry, self.sums[level][done])
            codes[ranges(starts[done], size)] = np.repeat(entry, size)
            nodes, may = nodes[~one], may[~one]
            if not len(nodes):
                return codes, counts, sums
            if level < len(self.starts) - 1:
                nodes, may = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(may, 2, axis=0)
        starts = self.starts[-1]
        size = starts[nodes + 1] - starts[nodes]
        at = ranges(starts[nodes], size)
        codes[at] = found = nearest(self.points[at], entries, may, np.repeat(np.arange(len(nodes)), size))
        np.add.at(counts, found, 1)
        np.add.at(sums, found, self.points[at])
        return codes, counts, sums


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def filtered(low: np.ndarray, high: np.ndarray, entries: np.ndarray, may: np.ndarray) -> np.ndarray:
    """``may`` (nodes, entries) without the entries that are nearest to no point of the node's box."""
    far = np.iinfo(np.int64).max
    middle = (((low + high)[:, None, :] - 2 * entries) ** 2).sum(axis=2)
    best = np.where(may, middle, far).argmin(axis=1)
    centre = entries[best][:, None, :]
    corner = np.where(entries > centre, high[:, None, :], low[:, None, :])
    own, other = ((entries - corner) ** 2).sum(axis=2), ((centre - corner) ** 2).sum(axis=2)
    return may & ((own < other) | ((own == other) & (np.arange(len(entries)) <= best[:, None])))


def nearest(points: np.ndarray, entries: np.ndarray, may: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The first nearest of each point's entries: those of its node in ``may``."""
    per = may.sum(axis=1)
    listed = np.nonzero(may)[1]
    size = per[node]
    entry = listed[ranges((np.cumsum(per) - per)[node], size)]
    away = ((np.repeat(points, size, axis=0) - entries[entry]) ** 2).sum(axis=1)
    begin = np.cumsum(size) - size
    least = np.minimum.reduceat(away, begin)
    return np.minimum.reduceat(np.where(away == np.repeat(least, size), entry, len(entries)), begin)


def _pack(dim: int, parts: int):
    """Rows (id, label, vector) to blocks, each with the kd-order of every part position. Shorter vectors end in zeros."""
    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(dim, 1)))

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, labels = (pa.concat_arrays([b.column(i) for b in rows]) for i in (0, 1))
        vectors = pa.concat_arrays([b.column(2) for b in rows])
        points = np.zeros((len(ids), dim), np.int64)
        length = vectors.value_lengths().to_numpy()
        flat = to_integers(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), dim)
        points[np.repeat(np.arange(len(ids)), length), ranges(np.zeros(len(ids), np.int64), length)] = flat
        split = points.reshape(len(ids), parts, dim // parts)
        orders = np.stack([kd_order(split[:, p]) for p in range(parts)])
        width = 2 if np.abs(points).max(initial=0) < 1 << 15 else 4
        columns = {"ids": [ids], "labels": [labels], "width": [width], "points": [points.astype(f"<i{width}").tobytes()], "orders": [orders.astype("<u2").tobytes()]}
        return pa.RecordBatch.from_arrays([pa.array([x.to_pylist() if isinstance(x, pa.Array) else x for x in columns[f.name]], f.type) for f in BLOCKS], schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, most - n)
                held.append(part)
                n += part.num_rows
                b = b.slice(part.num_rows)
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


def _trees(b: pa.RecordBatch, row: int, dim: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, order, points in order) of each part position of a block."""
    width = b.column("width")[row].as_py()
    points = np.frombuffer(b.column("points")[row].as_py(), f"<i{width}").reshape(-1, parts, dim // parts).astype(np.int64)
    orders = np.frombuffer(b.column("orders")[row].as_py(), "<u2").reshape(parts, -1)
    for p in range(parts):
        yield points[:, p], orders[p], points[orders[p], p]


def _totals(books: np.ndarray, dim: int):
    """One row (part, entry, at, total) per entry and component of what a task's trees assign; at = -1 has the counts."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, d + 1), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                for p, (_, _, ordered) in enumerate(_trees(b, row, dim, parts)):
                    _, counts, sums = Tree(ordered).assign(books[p])
                    total[p, :, 0] += counts
                    total[p, :, 1:] += sums
        part, entry = np.nonzero(total[:, :, 0])
        flat = total[part, entry]
        wide = np.arange(d + 1) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, d + 1)), pa.array(np.repeat(entry, d + 1)), pa.array(np.tile(wide, len(part))), pa.array(flat.ravel())], names=["part", "entry", "at", "total"])

    return run


def _codes(books: np.ndarray, dim: int):
    """(id, label, code, error) of each row of the blocks."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, labels = (pa.array(b.column(c)[row].as_py(), t) for c, t in (("ids", pa.int64()), ("labels", pa.string())))
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, (points, order, ordered) in enumerate(_trees(b, row, dim, parts)):
                    codes[order, p] = Tree(ordered).assign(books[p])[0]
                    error += ((points - books[p][codes[:, p]]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """Of the entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label_key, code, error) of each row with a vector, and the codebooks (parts, entries, components).

    Rows whose vector is null or holds null, NaN or infinite components are dropped. A codebook starts as the parts of the
    ``entries`` (256 at most) smallest ids: null ids come last, equal ids in the order of their vectors; with fewer rows it has
    fewer entries. The dimension is the longest vector's, made a multiple of ``parts``; shorter and empty vectors end in
    zeros. Integers stop at ``largest(dim)``. Repeated rows are rows like any other; an empty table gives no rows and an empty
    codebook. ``label_key`` is n for a null label, else v and the label as hexadecimal UTF-8. Other columns don't matter.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: from 1 to 256 entries")
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(
        F.col(f"`{id}`").cast("long").alias("id"),
        F.coalesce(F.concat(F.lit("v"), F.hex(F.encode(F.col(f"`{label}`").cast("string"), "utf-8"))), F.lit("n")).alias("label"),
        F.col(f"`{vector}`").alias("v"),
    ).where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    dim = -(-max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts) * parts
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    books = np.zeros((len(first), dim), np.int64)
    for i, r in enumerate(first):
        books[i, : len(r["v"])] = to_integers(np.array(r["v"], np.float64), dim)
    books = books.reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    if not first:
        return spark.createDataFrame([], "vec_id long, label_key string, code string, error long"), books
    blocks, _ = save(rows.mapInArrow(_pack(dim, parts), BLOCKS_DDL), "vectors")
    for _ in range(rounds):
        each = blocks.select("width", "points", "orders").mapInArrow(_totals(books, dim), "part long, entry long, at long, total long")
        total = {(r["part"], r["entry"], r["at"]): r["total"] for r in each.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect()}  # the size of the codebooks
        for (p, e, at), t in total.items():
            if at >= 0:
                books[p, e, at] = t // total[p, e, -1]
    return blocks.mapInArrow(_codes(books, dim), "vec_id long, label string, code string, error long").withColumnRenamed("label", "label_key"), books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``vector``: the integers that the column ``code`` stands for, by parts."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in part]) for part in books])
    at = lambda p: F.conv(F.substring("code", F.lit(2) * p + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(F.get(entries, p), at(p)))))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes, _ = save(codes, "codes")
    per = codes.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    per, _ = save(per, "labels")
    out = spread_join(codes, per, "label_key", codes.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    """The first nearest entry of each part, and its squared distance."""
    return f"""SELECT vec_id, part, p, e, c, d FROM (
  SELECT q.vec_id, q.part, q.p, b.e, b.c, list_sum(list_transform(list_zip(q.p, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts q JOIN {book} b USING (part)) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) = 1"""


def _moved(book: str, assigned: str) -> str:
    """``book`` with each used entry at the floor of the mean of its parts."""
    return f"""SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (
  SELECT part, e, list(m ORDER BY pos) AS c FROM (
    SELECT part, e, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::HUGEINT // count(*)::HUGEINT AS m
    FROM (SELECT part, e, unnest(range(1, {{d}} + 1)) AS pos, unnest(p) AS x FROM {assigned}) GROUP BY part, e, pos) GROUP BY part, e) m USING (part, e)"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
parts AS (SELECT vec_id, part, v[part * 4 + 1:part * 4 + 4] AS p FROM kept, range({PARTS}) r(part)),
book0 AS (SELECT part, e, p AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
near0 AS MATERIALIZED ({_assigned("book0")}),
book1 AS ({_moved("book0", "near0").format(d=4)}),
near1 AS MATERIALIZED ({_assigned("book1")}),
book2 AS MATERIALIZED ({_moved("book1", "near1").format(d=4)}),
near2 AS MATERIALIZED ({_assigned("book2")}),
coded AS (SELECT vec_id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""

"""Merkle manifest of a table by higher-order SQL functions.

A row's leaf is the SHA-256 of its fields, each with its length. Leaves of a group stand in order of id; 8 consecutive nodes become
the hash of their digests, until one is left. The slim table of leaves gets gapless places from one range shuffle: the counts of
the sorted ranges are added up, no group is ever in one task. Then ``BLOCK`` consecutive leaves, three levels of the
tree, are one ordered array, and one expression of sequence, transform, slice and aggregate collapses it. Block roots
are the leaves of the next round, so there are as many rounds as digits of the group's size to the base ``BLOCK``. On the way back each
block's digests give the siblings left and right of each of its leaves, which the path from the block's root up is added to.
Texts are read once, for their leaves; nothing but row counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.common import drop, partitions, save

FAN, DEPTH = 8, 3
BLOCK = FAN**DEPTH
#: A table of at most so many rows, of a few kilobytes each, is broadcast to those it meets; a larger one is shuffled with them.
SMALL = 8_192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """``-`` for null, else the value with its number of UTF-8 bytes."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def levels_of(n: Column) -> Column:
    """Levels above n nodes within a block: the least k with FAN^k >= n, DEPTH at most."""
    out = F.lit(DEPTH)
    for k in reversed(range(DEPTH)):
        out = F.when(n <= FAN**k, k).otherwise(out)
    return out


def parents(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def collapsed(nodes: Column, levels: Column) -> Column:
    """All levels of a block as an array of arrays, the lowest first; ``levels`` of them above ``nodes``."""
    steps = F.filter(F.array(*[F.lit(k) for k in range(DEPTH)]), lambda k: k < levels)
    return F.aggregate(steps, F.array(nodes), lambda all, _: F.concat(all, F.array(parents(F.element_at(all, -1)))))


def path(tree: Column, place: Column) -> Column:
    """The siblings (left, right) of the node at ``place`` of a block's lowest level, level by level."""

    def siblings(nodes: Column, level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(FAN), level)).cast("int")
        return F.struct(F.array_join(F.slice(nodes, at - at % FAN + 1, at % FAN), "").alias("left"), F.array_join(F.slice(nodes, at + 2, FAN - 1 - at % FAN), "").alias("right"))

    return F.transform(F.slice(tree, F.lit(1), F.size(tree) - 1), siblings)


def folded(start: Column, way: Column) -> Column:
    """The root that ``start`` has with the siblings of ``way``."""
    return F.aggregate(way, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(way: Column) -> Column:
    return F.sha2(F.aggregate(way, F.lit(""), lambda text, s: F.concat(text, s["left"], s["right"])), 256)


def met(rows: DataFrame, slim: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join with a slim saved table, which is broadcast only where it has at most ``SMALL`` rows."""
    return rows.join(F.broadcast(slim) if slim.limit(SMALL + 1).count() <= SMALL else slim, on)


def placed(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``place``, gapless from 0 in each ``grp`` by ``order``, and the group's ``total``.

    Rows are range-partitioned by group and order; their numbers in the written ranges less the range's first, plus what
    earlier ranges have of the group, are the places. Rows that are equal in ``order`` and wanted apart need a column that
    tells them apart in it, or a range would hold them all.
    """
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "grp", *order).sortWithinPartitions("grp", *order)
    ranged, path = save(ranged.withColumn("seq", F.monotonically_increasing_id()), label)
    range_of = F.shiftright("seq", 33).alias("range")
    counts, counts_path = save(ranged.groupBy("grp", range_of).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")), f"{label}-counts")
    # running sums over the ranges of a group, in two steps: over bundles of ranges, and within one
    bundle = F.shiftright("range", 8).alias("bundle")
    bundles = counts.groupBy("grp", bundle).agg(F.sum("n").alias("bundle_n"))
    whole = Window.partitionBy("grp").orderBy("bundle")
    bundles = bundles.withColumn("bundle_before", F.sum("bundle_n").over(whole) - F.col("bundle_n")).withColumn("total", F.sum("bundle_n").over(Window.partitionBy("grp")))
    within = F.sum("n").over(Window.partitionBy("grp", "bundle").orderBy("range")) - F.col("n")
    starts = counts.withColumn("bundle", bundle).withColumn("before", within).join(bundles, ["grp", "bundle"])
    starts, starts_path = save(starts.select("grp", "range", "total", (F.col("before") + F.col("bundle_before") - F.col("first")).alias("shift")), f"{label}-starts")
    out = met(ranged.withColumn("range", range_of), starts, ["grp", "range"])
    return out.withColumn("place", F.col("seq") + F.col("shift")).drop("seq", "range", "shift"), [path, counts_path, starts_path]


def grown(nodes: DataFrame, label: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(grp, digest, load, way, root) of each node (grp, place, total, digest, load), and (grp, root) of each group.

    ``way`` has a node's siblings up to its group's root; that of a lone node is empty. ``load`` may be anything that can be ordered.
    """
    total = F.col("total")
    block = F.floor(F.col("place") / BLOCK).alias("block")
    rows = F.sort_array(F.collect_list(F.struct("place", "digest", "load")))
    blocks = nodes.groupBy("grp", block).agg(rows.alias("rows"), F.max("total").alias("total"))
    tree = collapsed(F.transform("rows", lambda x: x["digest"]), levels_of(total))
    blocks, blocks_path = save(blocks.select("grp", "block", "total", tree.alias("tree"), F.transform("rows", lambda x: x["load"]).alias("loads")), label)
    top = blocks.select("grp", F.col("block").alias("place"), F.ceil(total / BLOCK).alias("total"), F.get(F.element_at("tree", -1), F.lit(0)).alias("digest"), F.col("block").alias("load"))
    paths = [blocks_path]
    if blocks.where(total > BLOCK).isEmpty():
        above = top.select("grp", F.col("place").alias("block"), F.array().cast("array<struct<left:string,right:string>>").alias("upper"), F.col("digest").alias("root"))
        roots = top.select("grp", F.col("digest").alias("root"))
    else:
        above, roots, more = grown(top, label)
        above, above_path = save(above.select("grp", F.col("load").alias("block"), F.col("way").alias("upper"), "root"), label)
        paths += [*more, above_path]
    each = met(blocks, above, ["grp", "block"]).select("grp", "tree", "upper", "root", "loads", F.posexplode(F.get("tree", F.lit(0))).alias("at", "digest"))
    return each.select("grp", "digest", F.get("loads", "at").alias("load"), F.concat(path(F.col("tree"), F.col("at")), "upper").alias("way"), "root"), roots, paths


def manifest(df: DataFrame, id: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """Each row's leaf, its group's root, the root of all, the digest of its proof, and what the proof gives for altered fields.

    ``tampered`` replaces columns by altered values for ``folded_root``; without it the proof is checked on the row itself. A null field
    is ``-``; a null group is a group, the first one; null ids come first in their group; rows with equal ids are ordered by their
    leaves, and equal rows are leaves of their own. Columns that aren't named don't matter. An empty table gives no rows.
    Returns (id, leaf, subroot, root, proof_sha256, folded_root, verified).
    """
    spark = df.sparkSession
    was = {c: F.col(f"`{c}`") for c in columns}
    now = was | (tampered or {})
    one, two = leaf([was[c] for c in columns]), leaf([now[c] for c in columns])
    key = F.coalesce(F.concat(F.lit("v"), F.col(f"`{group}`").cast("string")), F.lit("n"))
    rows = df.select(F.col(f"`{id}`").alias("id"), key.alias("grp"), one.alias("digest"), F.nullif(two, one).alias("altered") if tampered else F.lit(None).cast("string").alias("altered"))
    rows, rows_path = save(rows.withColumn("copy", F.monotonically_increasing_id()), "leaves")
    nodes, nodes_paths = placed(rows, ["id", "digest", "copy"], "placed")
    leaves, subroots, _ = grown(nodes.select("grp", "place", "total", "digest", F.struct("id", "altered").alias("load")), "blocks")
    drop(spark, rows_path, *nodes_paths)
    subroots, subroots_path = save(subroots.select(F.col("grp").alias("part"), F.lit("all").alias("grp"), F.col("root").alias("digest")), "subroots")
    tops, tops_paths = placed(subroots, ["part"], "subroots")
    last, _, last_paths = grown(tops.select("grp", "place", "total", "digest", F.col("part").alias("load")), "tops")
    upper, _ = save(last.select(F.col("load").alias("grp"), F.col("way").alias("upper"), F.col("root").alias("top")), "uppers")
    drop(spark, subroots_path, *tops_paths, *last_paths)
    way = F.concat("way", "upper")
    found = met(leaves, upper, ["grp"]).select(F.col("load.id").alias(id), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.col("top").alias("root"), proof(way).alias("proof_sha256"), folded(F.coalesce("load.altered", "digest"), way).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(third, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered={"text": text})


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc32_sql() -> str:
    """CRC-32 of the decimal digits of doc_id, eight bits at a time."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""crc AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(s[i // 9 + 1])::BIGINT) ELSE {step} END FROM crc WHERE i < 9 * len(s)
)"""


def _tree_sql(name: str, leaves: str) -> str:
    return f"""{name} AS (
  SELECT g, 0 AS lvl, i, h FROM {leaves}
  UNION ALL SELECT g, any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, i // 8
)"""


#: The rows of ``op12_merkle_manifest``, level by level.
ORACLE_SQL = f"""
WITH RECURSIVE {_crc32_sql()},
leaves AS (
  SELECT d.doc_id, coalesce('v' || lang, 'n') AS g, {_leaf_sql("text")} AS h,
    {_leaf_sql("(CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)")} AS t
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, c FROM crc WHERE i = 9 * len(s)) USING (doc_id)
),
low AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves),
{_tree_sql("tree", "low")},
sub AS (SELECT 'all' AS g, lang, h, row_number() OVER (ORDER BY lang) - 1 AS i FROM (SELECT g AS lang, arg_max(h, lvl) AS h FROM tree GROUP BY g)),
{_tree_sql("crown", "sub")},
root AS (SELECT arg_max(h, lvl) AS root FROM crown),
height AS (SELECT g, max(lvl) AS levels FROM tree GROUP BY g),
steps AS (
  SELECT low.doc_id, low.i AS leaf, low.g, n.lvl, string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < low.i // (8 ** n.lvl)::BIGINT) AS l, string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > low.i // (8 ** n.lvl)::BIGINT) AS r
  FROM low JOIN height USING (g) JOIN tree n ON n.g = low.g AND n.lvl < levels AND n.i // 8 = low.i // (8 ** (n.lvl + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT low.doc_id, low.i, low.g, levels + n.lvl, string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < sub.i // (8 ** n.lvl)::BIGINT), string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > sub.i // (8 ** n.lvl)::BIGINT)
  FROM low JOIN height USING (g) JOIN sub ON sub.lang = low.g JOIN crown n ON n.lvl < (SELECT max(lvl) FROM crown) AND n.i // 8 = sub.i // (8 ** (n.lvl + 1))::BIGINT GROUP BY ALL
),
way AS (SELECT leaf, g, list({{'l': coalesce(l, ''), 'r': coalesce(r, '')}} ORDER BY lvl) AS w FROM steps GROUP BY leaf, g),
fold AS (
  SELECT low.i AS leaf, low.g, t AS h, coalesce(w, []) AS w, 0 AS k FROM low LEFT JOIN way ON way.leaf = low.i AND way.g = low.g
  UNION ALL SELECT leaf, g, sha256(w[k + 1].l || h || w[k + 1].r), w, k + 1 FROM fold WHERE k < len(w)
)
SELECT low.doc_id, low.h AS leaf, sub.h AS subroot, root, sha256(array_to_string(list_transform(w, lambda s: s.l || s.r), '')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM low JOIN fold ON fold.leaf = low.i AND fold.g = low.g AND k = len(w) JOIN sub ON sub.lang = low.g, root
"""

"""Sharding, fingerprints, WARC and the pipeline."""

import base64
import hashlib
import json
import math
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelight.llm import fingerprint, sharding, warc
from sievelight.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_matrix_sums_exactly():
    rows = [0, 100, 7, 1000, 1]
    size = sharding.shard_sizes(sum(rows), 8)
    m = sharding.communication_matrix(rows, size, 1)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == size and m.min() >= 0
    assert sum(size) == sum(rows) and max(size) - min(size) <= 1
    mean = np.mean([sharding.communication_matrix([30, 70], [50, 50], s)[0, 0] for s in range(400)])
    assert abs(mean - 15) < 0.6  # hypergeometric mean


def test_hypergeometric_of_any_total():
    """By numpy below its bound; the way for larger totals has the same law, and holds for totals far above."""
    rng = np.random.default_rng(5)
    for good, bad, drawn in ((7, 5, 6), (1, 30, 10), (40, 3, 39), (50, 50, 50)):
        lo, hi = max(0, drawn - bad), min(good, drawn)
        want = np.array([math.comb(good, k) * math.comb(bad, drawn - k) for k in range(lo, hi + 1)], float)
        got = np.bincount([sharding.hypergeometric(rng, good, bad, drawn, most=2) - lo for _ in range(6000)], minlength=hi - lo + 1)
        expected = 6000 * want / want.sum()
        some = expected >= 5
        assert len(got) == len(want) and ((got - expected)[some] ** 2 / expected[some]).sum() < 3 * some.sum() + 12
    total = 50_000_000_000
    counts = np.array([total // 8] * 8)
    for drawn in (0, 1, 1_000_000_000, total // 3, total):
        got = sharding.deal(rng, counts, drawn)
        mean, sd = drawn / 8, (drawn / 8 * 7 / 8 * (1 - drawn / total)) ** 0.5
        assert got.sum() == drawn and (got >= 0).all() and (got <= counts).all() and (abs(got - mean) <= 6 * sd + 1).all()
    rows = [10**9 + 7, 3, 2 * 10**9]
    m = sharding.communication_matrix(rows, sharding.shard_sizes(sum(rows), 8), 1)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == sharding.shard_sizes(sum(rows), 8)


def test_shuffle_of_clashing_names(spark):
    df = spark.range(40).selectExpr("id as part", "id as row", "id as `key`", "id as `range`", "id as place", "id as first", "id as n", "id as `_shard`", "id as `a.b`", "7 as shard").repartition(3)
    rows = sharding.shuffle(df, 4, order=["part"]).collect()
    assert sorted(r["part"] for r in rows) == list(range(40)) and all(len({r[c] for c in df.columns if c != "shard"}) == 1 for r in rows)
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(10)]


def test_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    df = spark.range(0, 1003, 1, 7).selectExpr("id", "cast(null as string) as text", "id as _place", "1 as slot")
    rows = sharding.shuffle(df, 8, seed=5).collect()
    again = sharding.shuffle(df, 8, seed=5).collect()
    other = sharding.shuffle(df, 8, seed=6).collect()
    place = lambda r: {x.id: (x.shard, x.slot) for x in r}
    assert place(rows) == place(again) != place(other)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} == {125, 126}
    assert sharding.shuffle(df.limit(0), 8).count() == 0
    few = sharding.shuffle(spark.createDataFrame([(1,), (1,), (None,)], "id int"), 8).collect()
    assert len(few) == 3 and {r.slot for r in few} == {0}


def test_op3_contract(spark):
    rows = QUERIES["op3_sharding"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and all(r["size"] == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)


def test_digest():
    a = "The quick brown fox jumps over the lazy dog. " * 20
    d = fingerprint.digest(a.encode())
    assert fingerprint.difference(d, d) == 0 and fingerprint.likeness(d, d) == 1.0
    near, far = fingerprint.digest((a[:-200] + "something else here").encode()), fingerprint.digest(("zzqk vv 0918 " * 70).encode())
    assert fingerprint.likeness(d, near) > fingerprint.likeness(d, far) >= 0
    for short in (b"", b"a", b"abc"):
        fingerprint.digest(short)
    big = bytes(range(256)) * 3000
    c = np.zeros(fingerprint.BUCKETS, np.int64)
    for lo in range(0, len(big), 1000):
        c += fingerprint.counts(big[lo : lo + 1000 + fingerprint.SPAN - 1]) if lo + 1000 < len(big) else fingerprint.counts(big[lo:])
    assert (fingerprint.counts(big) == c).all()


def plain_digest(data):
    """The fingerprint as its definition says, byte by byte, without the operator's code."""
    counts = [0] * 512
    raw = list(data) + [0] * ((4 - len(data)) if 0 < len(data) < 4 else 0)
    for at in range(len(raw) - 3):
        for salt, (i, j, k) in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3)]):
            h = (raw[at + i] | raw[at + j] << 8 | raw[at + k] << 16 | salt << 24) * 0x9E3779B1 % 2**32
            h ^= h >> 15
            counts[h * 0x85EBCA77 % 2**32 >> 23] += 1
    quartiles = [sorted(counts)[n] for n in (127, 255, 383)]
    code = [sum(c > q for q in quartiles) for c in counts]
    out = [0 if not data else min(255, 1 + int(math.log(len(data)) / math.log(1.1)))]
    return bytes(out + [code[n] << 6 | code[n + 1] << 4 | code[n + 2] << 2 | code[n + 3] for n in range(0, 512, 4)]).hex()


def plain_difference(one, two):
    a, b = bytes.fromhex(one), bytes.fromhex(two)
    total = min(40, abs(a[0] - b[0]))
    for x, y in zip(a[1:], b[1:], strict=True):
        for shift in (6, 4, 2, 0):
            gap = abs((x >> shift & 3) - (y >> shift & 3))
            total += 6 if gap == 3 else gap
    return total


def test_digest_against_its_definition():
    rng = np.random.default_rng(8)
    texts = [b"", b"a", b"abc", b"abcd", "Straße und 日本".encode(), rng.bytes(5000), b"the quick brown fox " * 60, b"z" * 700]
    prints = [fingerprint.digest(t) for t in texts]
    assert prints == [plain_digest(t) for t in texts]
    assert all(fingerprint.difference(a, b) == plain_difference(a, b) for a in prints for b in prints)
    assert max(fingerprint.difference(a, b) for a in prints for b in prints) <= 6 * fingerprint.BUCKETS + fingerprint.LENGTH_MOST


def test_op7_contract(spark):
    rows = QUERIES["op7_fingerprint"](spark, SF).collect()
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) == len(got)
    scale = 512 * (0 * 4 + 1 * 6 + 2 * 4 + 6 * 2) / 16 + 40
    for n, (i, t) in list(enumerate(docs))[::9]:
        after = docs[(n + 1) % len(docs)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r, own, other, following = got[i], *(plain_digest(x.encode()) for x in (t, edited, after))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other)
        assert abs(r.near_edited - max(0.0, 1 - plain_difference(own, other) / scale)) < 1e-9 and abs(r.near_next - max(0.0, 1 - plain_difference(own, following) / scale)) < 1e-9


@pytest.mark.parametrize("size", [32 << 20, 40])
def test_fingerprints(frame, monkeypatch, size):
    monkeypatch.setattr(fingerprint, "BLOCK_BYTES", size)
    texts = ["first text, about nothing", None, "", "😀" * 9 + "abc", "same", "same", "x" * 5000]
    rows = [(i * 3 - 4, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(rows)).collect()}
    for n, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + nxt[:k]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == fingerprint.digest(t.encode()) and r.edited_fingerprint == fingerprint.digest(e.encode())
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.digest(nxt.encode()))
    assert fingerprint.fingerprints(frame([])).count() == 0
    one = fingerprint.fingerprints(frame([(3, "alone!!!")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    twice = fingerprint.fingerprints(frame([(1, "a"), (1, "a"), (1, "b"), (None, "z")])).collect()
    assert len(twice) == 3


def test_warc(spark, tmp_path):
    big = "<p>" + "text " * 60000
    rows = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, None), (3, "http://c/", ""), (7, "http://d /x", big), (8, "http://e/", big + "!"), (5, "http://f/", "same"), (None, "u", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    roots = [f"file://{tmp_path}/{n}" for n in "ab"]
    for r in roots:
        warc.write(df, r, roll=1000)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, roots[0]).collect())
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(2, 4, digest("same"), "response", None), (3, 0, digest(""), "response", None), (5, 4, digest("same"), "revisit", 2), (5, 4, digest("same"), "revisit", 2), (7, len(big), digest(big), "response", None), (8, len(big) + 1, digest(big + "!"), "response", None), (9, 0, digest(""), "revisit", 3)]
    assert got == sorted(want)
    files = [{p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(r.removeprefix("file://")).iterdir()} for r in roots]
    assert files[0] == files[1] and len(files[0]) > 3  # deterministic, rolled, and no temporary files are left
    listed = json.loads((tmp_path / "a/manifest.json").read_text())["files"]
    assert {f["name"]: f["sha256"] for f in listed} == {k: v for k, v in files[0].items() if k != "manifest.json"}
    warc.write(df.limit(0), f"file://{tmp_path}/c")
    assert warc.read(spark, f"file://{tmp_path}/c").count() == 0


def test_warc_files_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 3000)
    rows = [(i * 7, f"http://x/{i}", f"page {i % 40} " * (i % 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    held, files = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 6):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            root = f"file://{tmp_path}/{n}"
            warc.write(df.repartition(n, "html"), root, roll=900)
            files.append({p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / str(n)).iterdir()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert files[0] == files[1] and len({n.split("-")[1] for n in files[0] if n.startswith("part")}) > 5
    assert warc.read(spark, root).count() == 400


def test_stages_and_registry(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:  # the learned stage has its own tests
        out = stage(spark, at, SF)
        assert out.columns == docs.columns, name
        at = spark.createDataFrame(out.collect(), docs.schema)
    done = corpus_pipeline.STAGES[4][1](spark, at, SF)
    assert 0 < done.count() == at.count() <= docs.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = c.execute(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert df.columns == [x[0] for x in found.description]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, found.fetchall()))

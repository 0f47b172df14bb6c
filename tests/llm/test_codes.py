"""Vector codes, Merkle manifest and pigeonring SimHash against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from sievelight.llm import decontaminate, merkle, pigeonring, queries, substring_dedup, toxicity, vector_codes

SF = "/root/testdata/sf0.001"


# vector codes


def plain_codes(rows, parts, entries, rounds):
    """Codes, errors and codebooks by their definition, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dim = -(-max([1, *(len(v) for _, v in kept)]) // parts) * parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * x) for x in v] + [0] * (dim - len(v)) for _, v in kept]
    d = dim // parts
    cut = [[tuple(v[p * d : p * d + d]) for v in whole] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def find(point, book):
        away = [sum((a - b) ** 2 for a, b in zip(point, e, strict=True)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(parts):
            own = [find(x, books[p])[0] for x in cut[p]]
            for e in range(len(books[p])):
                mine = [x for x, k in zip(cut[p], own, strict=True) if k == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    got = [[find(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    return [(kept[i][0], "".join(f"{e:02x}" for e, _ in g), sum(a for _, a in g)) for i, g in enumerate(got)], books


@pytest.mark.parametrize("block", [16_384, 37])
def test_vector_codes(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-40, 40, 12) / 128).tolist(), i % 3) for i in range(150)]
    rows += [(200 + i, rows[7][1], None) for i in range(60)]  # copies
    rows += [(300, None, 1), (301, [0.5, float("nan")] * 6, 1), (302, [0.5, None] * 6, 1), (303, [float("-inf")] * 12, 1), (None, [0.25] * 12, 1), (305, [], None), (306, [0.3] * 5, None), (5, rows[5][1], 2)]
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows]
    want, books = plain_codes(rows, 4, 16, 2)
    out, found = vector_codes.vector_codes(df, parts=4, entries=16)
    assert [[tuple(e) for e in b] for b in found.tolist()] == books
    assert sorted(map(repr, ((r["vec_id"], r["code"], r["error"]) for r in out.collect()))) == sorted(map(repr, want))
    shown = vector_codes.decoded(out.where("vec_id = 9"), found).first()
    assert shown["vector"] == [x for p in range(4) for x in books[p][int(shown["code"][2 * p : 2 * p + 2], 16)]]


def test_filter_keeps_ties(monkeypatch):
    """Points between entries, equal entries, and coordinates on a small grid: every tie goes to the first entry."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        points, entries = rng.integers(-3, 4, (int(rng.integers(1, 300)), 2)), rng.integers(-3, 4, (int(rng.integers(1, 20)), 2))
        ordered = points[vector_codes.kd_order(points)]
        codes, counts, sums = vector_codes.Tree(ordered).assign(entries)
        want = ((ordered[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)
        assert (codes == want).all() and (counts == np.bincount(want, minlength=len(entries))).all()
        assert all((sums[e] == ordered[want == e].sum(axis=0)).all() for e in range(len(entries)))


def test_subtrees_are_assigned_at_once(monkeypatch):
    """Far clusters: no point is compared."""
    monkeypatch.setattr(vector_codes, "nearest", lambda *a: pytest.fail("a point was compared"))
    centres = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    points = np.repeat(centres, 256, axis=0) + np.random.default_rng(1).integers(-5, 5, (1024, 2))
    assert (vector_codes.Tree(points[vector_codes.kd_order(points)]).assign(centres)[1] == 256).all()


def test_vector_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for rows in (df, df.limit(0)):
        out, books = vector_codes.vector_codes(rows)
        assert out.collect() == [] and books.size == 0
    with pytest.raises(ValueError, match="entries"):
        vector_codes.vector_codes(df, entries=257)


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by the definition."""

    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def way(tree, i):
        for nodes in tree[:-1]:
            lo = i - i % 8
            yield nodes[lo:i], nodes[i + 1 : lo + 8]
            i //= 8

    by = {}
    for r in rows:
        t = r[4]
        if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], t)), r[0]))
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(by[k])]) for k in langs}
    crown = levels([trees[k][-1][0] for k in langs])
    for j, k in enumerate(langs):
        for i, (_, _, h, altered, id) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            steps = [*way(trees[k], i), *way(crown, j)]
            now = altered
            for left, right in steps:
                now = sha("".join(left) + now + "".join(right))
            yield id, h, trees[k][-1][0], crown[-1][0], sha("".join("".join(a) + "".join(b) for a, b in steps)), now, now == crown[-1][0]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 700])
def test_manifest(spark, n, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rng = np.random.default_rng(n)
    langs = ["en", "en", "en", "é", "", None, "zz"]
    rows = [(int(i), None if i % 11 == 0 else "s" * int(i % 3), langs[int(rng.integers(7))], None if i % 7 == 0 else int(i), None if i % 13 == 0 else f"Größe {i}\n ABC" * int(i % 4)) for i in rng.permutation(n)]
    rows += [(None, "a", "en", 1, "X"), (3, "a", "en", 1, "Other text")] + [(5, "r", "en", 1, "Same")] * 20 if n > 8 else []
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string, grp int").repartition(3)
    path = f"file://{tmp_path}/documents.parquet"
    df.write.parquet(path)
    got = merkle.op12_merkle_manifest(spark, f"file://{tmp_path}").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_other_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "`a.b` long, g string, v double")
    got = merkle.manifest(df, "a.b", "g", ("a.b", "v")).collect()
    assert sorted(r[0] for r in got) == [1, 2] and all(r["verified"] for r in got) and {r["leaf"] for r in got} == {sha("1:13:2.5"), sha("1:2-")}


# pigeonring


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """The smallest id of each (id, fingerprint)'s component."""
    own = np.array(sorted(set(p for _, p in prints)), np.uint64)
    comp = np.arange(len(own))
    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(own ^ own[i]) <= 4).tolist():
            comp[comp == comp[j]] = comp[i]
    at, least = {int(f): int(c) for f, c in zip(own, comp, strict=True)}, {}
    for i, p in prints:
        if i is not None:
            least[at[p]] = min(i, least.get(at[p], i))
    return [(i, f"{p:016x}", least.get(at[p])) for i, p in prints]


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_fingerprint(monkeypatch, piece):
    monkeypatch.setattr(pigeonring, "PIECE", piece)
    monkeypatch.setattr(pigeonring, "VOTES", 5)
    rng = np.random.default_rng(2)
    marks = ["a", "B", "é", " ", "\t", "\x0b", "\x1c", " ", " ", "Zz", "\n", "1"]
    for n in [0, 1, 2, 5, 20, 60] * 20:
        text = "".join(rng.choice(marks, n))
        assert pigeonring.fingerprint(np.frombuffer(text.encode(), np.uint8)) == plain_fingerprint(text), text


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain_groups([(r[0], plain_fingerprint(r[1])) for r in docs])
    assert sorted(map(tuple, queries.QUERIES["op13_simhash"](spark, SF).collect())) == sorted(want)


def test_simhash_edges(frame):
    rows = [(4, None), (2, ""), (7, " \n"), (None, "one two three four five"), (9, "one two three four five"), (9, "One two three four FIVE"), (11, "short"), (None, "alone in its group"), (3, "word " * 50_000)]
    got = sorted(map(repr, map(tuple, pigeonring.simhash_groups(frame(rows)).collect())))
    assert got == sorted(map(repr, plain_groups([(i, plain_fingerprint(t)) for i, t in rows])))
    assert pigeonring.simhash_groups(frame(rows).limit(0)).collect() == []


def test_cycle_lemma():
    """Every pair within the radius has a start from which all chains are within their budgets."""
    rng = np.random.default_rng(8)
    for _ in range(3000):
        bits = rng.choice(64, int(rng.integers(0, 5)), replace=False).tolist()
        per = [sum(low <= b < low + w for b in bits) for low, w in zip(pigeonring.LOW, pigeonring.WIDTHS, strict=True)]
        assert any(all(sum(per[s] for s in pigeonring.chain(start, n)) <= pigeonring.budget(n) for n in range(1, 6)) for start in range(5))


@pytest.mark.parametrize("limit", [2_048, 40, 14])
def test_links_at_every_length(spark, limit, monkeypatch):
    """Large keys are made longer, and no link between components is lost."""
    rng = np.random.default_rng(limit)
    prints = set(rng.integers(0, 2**63, 300).tolist())
    for centre, spots, n in ((5, range(30, 52), 900), (2**62 + 77, range(0, 26), 900), (2**61 + 5, range(64), 200)):
        for _ in range(n):
            prints.add(centre ^ sum(1 << int(b) for b in rng.choice(list(spots), int(rng.integers(0, 7)), replace=False)))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/prints-{limit}"
    spark.createDataFrame([(p,) for p in prints], "fp long").write.parquet(path)
    found, paths = pigeonring.links(spark.read.parquet(path), limit=limit)
    assert (len(paths) > 2) == (limit < 2048)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    up = {p: p for p in prints}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        up[top(a)] = top(b)
    own = np.array(prints).view(np.uint64)
    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(own ^ own[i]) <= 4).tolist():
            assert top(prints[i]) == top(prints[j])


# filters of the pipeline


def test_filters_keep_columns_of_any_name(spark):
    """Names with a dot, and names that differ from those used inside by case alone."""
    words = " ".join(f"w{i}" for i in range(60))
    ddl = "doc_id long, text string, `a.b` string, Kept string, C0 string"
    docs = spark.createDataFrame([(1, words, "x", "y", "z"), (2, f"Start {words} end", None, "y", None), (3, None, "x", None, "z")], ddl)
    model = toxicity.fit(["an awful zorkface speaks"] * 3 + ["a kind word"] * 3, np.array([1, 1, 1, 0, 0, 0]))
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    for out, n in ((toxicity.without_toxic(docs, model), 3), (decontaminate.without_benchmark(docs, items), 1), (substring_dedup.without_repeats(docs), 3)):
        assert out.columns == docs.columns and out.count() == n
    assert {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs).collect()} == {1: words, 2: "Start end", 3: None}


def test_training_without_a_clean_text_is_refused(spark):
    docs = spark.createDataFrame([(1, "bad words"), (2, None)], "doc_id long, text string")
    with pytest.raises(ValueError, match="no labelled text is clean"):
        toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), held_out=False)

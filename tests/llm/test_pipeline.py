"""The pipeline's stages and the queries without SQL against plain versions of them, on whole tables."""

import array
import hashlib
from collections import Counter

import pytest
from test_texts import WORD, removed
from tokenizers import Tokenizer, models

import corpus_pipeline
from sievelight.llm import bpe, decontaminate, token_counts, toxicity
from sievelight.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def components(texts, num):
    """The smallest id reachable over links of shingle sets, by all pairs that share a shingle."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, where = {i: i for i in sets}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sorted(sets.items()):
        for x in s:
            where.setdefault(x, []).append(i)
        for j, both in Counter(j for x in s for j in where[x] if j != i).items():
            if 100 * both >= num * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def kept_words(texts):
    """Texts without the spans that start in a smaller id."""
    gone = removed(list(texts.items()))
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in texts.items():
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        assert gone[i][1] == len(w) - sum(keep)
        out[i] = t if all(keep) else " ".join(x for x, y in zip(w, keep, strict=True) if y)
    return out


def words_of(t):
    return [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in WORD.findall((t or "").lower())) if w]


def bag(w):
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def leaks(texts, items):
    """(id, item) -> similarity of the best window, by all windows of documents that share a shingle with the item."""
    out, bags = {}, {k: bag(words_of(t)) for k, t in items.items()}
    for i, t in texts.items():
        w = words_of(t)
        own = set(bag(w))
        for k, b in bags.items():
            n = len(words_of(items[k]))
            if not b or not own & set(b):
                continue
            best = max(decontaminate.similarity(bag(w[s : s + n]), b) for s in range(max(1, len(w) - n + 1)))
            if best >= 0.8:
                out[i, k] = round(best, 9)
    return out


def test_op6_query(spark, docs, items):
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in QUERIES["op6_decontamination"](spark, SF).collect()}
    want = leaks(docs, items)
    assert got == want and want


def test_op5_query(spark, docs):
    initial, later = token_counts.word_pieces(token_counts.VOCABULARY)
    vocab = {}
    for p in [*initial, *("##" + x for x in later), "[UNK]"]:
        vocab.setdefault(p, len(vocab))
    lib = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6)
    rows = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, t in list(docs.items())[::11]:
        pieces = [[x.value for x in lib.tokenize(w)] for w in (t or "").split()]
        assert rows[i].n_tokens == sum(len(p) for p in pieces), i


def test_op10_query(spark, docs):
    lib = Tokenizer.from_file(bpe.TOKENIZER)
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_bpe"](spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, t in docs.items():
        e = lib.encode(t or "", add_special_tokens=False).ids
        assert rows[i] == (len(e), hashlib.sha256(array.array("I", e).tobytes()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest())


def test_pipeline_run(spark, docs, items):
    """``run`` against each stage done plainly on what the one before it kept."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    ids = sorted(docs)
    score = model.document_scores(toxicity.text_margins(model, [docs[i] or "" for i in ids]))
    kept = {i: docs[i] for i, s in zip(ids, score.tolist(), strict=True) if s < 0.5}
    assert 0 < len(kept) < len(docs)
    group = components(kept, 80)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    kept = kept_words(kept)
    bad = {i for i, _ in leaks(kept, items)}
    kept = {i: t for i, t in kept.items() if i not in bad}
    assert len(bad) > 0
    lib = Tokenizer.from_file(bpe.TOKENIZER)
    want = {}
    for i, t in kept.items():
        e = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(e), hashlib.sha256(array.array("I", e).tobytes()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want

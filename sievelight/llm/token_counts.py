"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two entries: one for pieces at a word's start and one for later pieces. Every node has a failure
link and a popped-token count: when no child fits the next character, the longest pieces that cover what has been read up to
the link's node are popped, and only their number is added. One pass over the characters gives the number of greedy
longest-match pieces without building any of them. The counts of words that were met before are remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import bounded_batches

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
START = "▁"
MEMORY = 250_000


def word_pieces(path: str) -> tuple[list[str], list[str]]:
    """(initial, later) pieces of a sentencepiece vocabulary: those after the word mark start words, the others go on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    initial = [n[len(START) :] for n in names if n.startswith(START)]
    return [n for n in initial if n and START not in n], [n for n in names if n and START not in n]


class Automaton:
    """Nodes by number; 0 is the start of words, 1 the start of later pieces."""

    def __init__(self, initial: list[str], later: list[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        self.link = [-1, -1]
        self.pops = [0, 0]
        final = [False, False]
        order: list[list[tuple[int, int, str]]] = []  # by depth: (node, parent, character)
        for root, pieces in ((0, initial), (1, later)):
            for p in pieces:
                at = root
                for d, c in enumerate(p):
                    if c not in self.child[at]:
                        self.child.append({})
                        self.link.append(-1)
                        self.pops.append(0)
                        final.append(False)
                        self.child[at][c] = len(self.child) - 1
                        while len(order) <= d:
                            order.append([])
                        order[d].append((len(self.child) - 1, at, c))
                    at = self.child[at][c]
                final[at] = True
        for level in order:  # parents before children
            for v, u, c in level:
                if final[v]:  # the string of v is a piece itself: pop it and go on at the start of later pieces
                    self.link[v], self.pops[v] = 1, 1
                    continue
                z, n = self.link[u], self.pops[u]
                while z >= 0 and c not in self.child[z]:
                    z, n = self.link[z], n + self.pops[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.child[z][c], n

    def count(self, word: str) -> int:
        """Number of greedy pieces of a word, or -1 if some part is in no piece."""
        if not word:
            return 0
        child, link, pops = self.child, self.link, self.pops
        at = n = 0
        for c in word:
            while c not in child[at]:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return -1
            at = child[at][c]
        while at != 1:  # pop what is left
            n += pops[at]
            at = link[at]
            if at < 0:
                return -1
        return n


class Counter(dict):
    """word -> pieces, in two generations of bounded memory; a word that can't be cut counts as one unknown token."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.old = automaton, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.automaton.count(word)
        if len(word) <= 64:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(Automaton(*word_pieces(path)))
    return _loaded[path]


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for b in batches:
            words, tokens, unknown = [], [], []
            for t in b.column(1).to_pylist():
                counts = [known[w] for w in (t or "").split()]
                lost = counts.count(-1)
                words.append(len(counts))
                tokens.append(sum(counts) + 2 * lost)
                unknown.append(lost)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, path: str = VOCABULARY, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) per row: words by white space, greedy word pieces of all words, and words that the
    vocabulary can't cover, each of which counts as one token. Null and empty texts have none; rows may repeat; an empty table
    gives no rows.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_run(path), "doc_id long, n_words long, n_tokens long, n_unknown long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

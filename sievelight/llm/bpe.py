"""Byte-pair encoding and decoding as streaming transducers with bounded lookahead.

``lookahead`` computes from the merge list how many bytes after a place can still change whether a token ends there. A merge
depends on text to its right only through a rule of smaller rank that starts with a token on the right edge of its right part;
following such rules with falling rank gives a finite longest path. An encoder that has read that many bytes past a token's end
may emit the token and go on from its end as if the text began there: no merge ever crosses a final token boundary, so both
sides are independent. ``StreamingBPE`` does this for words of any length in constant memory; all words go through it, and what it
gave for short ones is remembered in a bounded memory. ``TokenSurfaces`` is the incremental decoder: it takes ids as they come
and gives text as soon as its bytes are complete. The digests of a text are fed part by part with the ids and with what the
decoder makes of those ids, so neither list is ever held.
"""

from __future__ import annotations

import array
import codecs
import hashlib
import heapq
import itertools
import json
import re
import struct
from collections.abc import Iterable, Iterator, Sequence

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from sievelight.llm.common import bounded_batches

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Unicode White_Space, which the normaliser's \s means.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Entries of each of the two generations of the memory of words; when the young one is full, the old one goes.
MEMORY = 400_000
#: Characters of a text, or tokens of a long word, that are coded at a time.
BLOCK = 1 << 14


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], width) -> int:
    """A sufficient number of bytes to read past a token's end before it is final. ``width`` gives a token's bytes.

    reach(rule) = bytes of its right part + the largest reach of an earlier rule whose left part is the right part or one
    of the tokens on its right edge; the largest reach of any rule bounds how far influence travels.
    """
    parts = {a + b: (a, b) for a, b in merges}
    best: dict[str, int] = {}
    most = 0
    for a, b in merges:
        edge, far = b, 0
        while edge:
            far = max(far, best.get(edge, 0))
            edge = parts[edge][1] if edge in parts else None
        reach = width(b) + far
        best[a] = max(best.get(a, 0), reach)
        most = max(most, reach)
    return most


class StreamingBPE:
    """Encodes one word at a time from symbols, emitting tokens as soon as they are final."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], end: str = "</w>"):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.vocab, self.end = vocab, end
        self.lookahead = lookahead(merges, lambda t: len(t.removesuffix(end)))
        self.chunk = 2 * self.lookahead

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges in rank order, the leftmost of equal rank first; a short list is merged in place."""
        if len(symbols) > 96:
            return self._merge_long(symbols)
        s, rank, none = symbols, self.rank.get, 1 << 60
        ranks = [rank(p, none) for p in zip(s, s[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((s[i - 1], s[i]), none)
            if i < len(ranks):
                ranks[i] = rank((s[i], s[i + 1]), none)
        return s

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of (rank, place) over linked symbols."""
        s: list[str | None] = list(symbols)
        left, right = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        rank = self.rank
        heap = [(r, i, p) for i, p in enumerate(zip(s, s[1:], strict=False)) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if s[i] != pair[0] or j >= len(s) or s[j] != pair[1]:
                continue
            s[i], s[j] = pair[0] + pair[1], None
            right[i] = k = right[j]
            if k < len(s):
                left[k] = i
                if (r := rank.get(p := (s[i], s[k]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := left[i]) >= 0 and (r := rank.get(p := (s[h], s[i]))) is not None:
                heapq.heappush(heap, (r, h, p))
        return [x for x in s if x is not None]

    def tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a word given as byte symbols; at most ``chunk`` symbols and one lookahead are held."""
        held: list[str] = []
        it, chunk = iter(symbols), self.chunk
        while True:
            held.extend(itertools.islice(it, chunk + self.lookahead + 1 - len(held)))
            if len(held) <= chunk + self.lookahead:  # the word is over
                if held:
                    held[-1] += self.end
                    yield from self.merge(held)
                return
            at = 0
            for t in self.merge(held.copy()):
                if at + len(t) > len(held) - 1 - self.lookahead:
                    break
                at += len(t)
                yield t
            if not at:  # no token is final yet: read more
                chunk *= 2
            del held[:at]


class TokenSurfaces:
    """Incremental decoders of ids, state machines that take ids as they come.

    ``surface`` is the library's decode without a decoder: token strings joined by one space. ``text`` gives bytes back as
    text: a word end becomes one space, and a character comes out when its last UTF-8 byte has come; bytes that form none give
    U+FFFD.
    """

    def __init__(self, names: list[str], end: str = "</w>"):
        self.names, self.end = names, end
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes = [bytes(back.get(c, 0x20) for c in n.removesuffix(end)) + b" " * n.endswith(end) for n in names]

    def surface(self, parts: Iterable[Sequence[int]]) -> Iterator[str]:
        """The surface of consecutive ``parts`` of the ids, a string for each."""
        started = False
        for ids in parts:
            out = " ".join(map(self.names.__getitem__, ids))
            yield " " + out if started and len(ids) else out
            started = started or len(ids) > 0

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := state.decode(self.bytes[i]):
                yield out
        if out := state.decode(b"", True):
            yield out


class WordBPE:
    """The tokenizer of a tokenizers JSON file with NFC, white space, lower case, a split pattern and byte-level BPE.

    Normalisation and splitting of words beyond ASCII are the library's own steps, so its Unicode tables hold.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.bpe = StreamingBPE(merges, self.vocab, model["end_of_word_suffix"])
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.cut = re.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.surfaces = TokenSurfaces(self.names, model["end_of_word_suffix"])
        self.packed = {name: struct.pack("<I", i) for name, i in self.vocab.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, word: str) -> Iterable[str]:
        """The pieces of a run of text without white space, as byte symbols."""
        if not word.isascii():
            return [piece for piece, _ in self.split(self.normal(word))]
        word = word.lower()
        if word.isalpha():
            return (word,)
        found = (m.group() for m in self.cut.finditer(word))
        return found if word.isprintable() else ("".join([self.alphabet[ord(c)] for c in piece]) for piece in found)

    def tokens(self, word: str) -> Iterator[str]:
        """Tokens of a run of text without white space, as they become final."""
        for piece in self.pieces(word):
            yield from self.bpe.tokens(piece)

    def ids(self, word: str) -> Iterator[int]:
        return map(self.vocab.__getitem__, self.tokens(word))

    def _coded(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            lower = word.lower() if word.isascii() else word
            out = (self.young.get(lower) or self.old.get(lower)) if lower != word else None
            if out is None:
                out = b"".join([self.packed[t] for t in self.tokens(word)])
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}
        self.young[word] = out
        return out

    def stream(self, text: str) -> Iterator[array.array]:
        """The ids of a text, in parts of bounded size."""
        for some in blocks(text):
            held: list[bytes] = []
            for part in self.marks.split(some) if self.marks and "<|" in some else (some,):
                if part in self.special:
                    held.append(struct.pack("<I", self.special[part]))
                    continue
                for word in SPACE.split(part):
                    if len(word) <= 64:
                        if word:
                            held.append(self.young.get(word) or self._coded(word))
                        continue
                    for t in self.tokens(word):
                        held.append(self.packed[t])
                        if len(held) >= BLOCK:
                            yield array.array("I", b"".join(held))
                            held.clear()
            yield array.array("I", b"".join(held))


def blocks(text: str) -> Iterator[str]:
    """Consecutive parts of a text that end at white space, of about BLOCK characters unless a word is longer."""
    lo = 0
    while len(text) - lo > BLOCK and (m := SPACE.search(text, lo + BLOCK)):
        yield text[lo : m.end()]
        lo = m.end()
    yield text[lo:] if lo else text


_loaded: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def coded(tok: WordBPE, text: str) -> Iterator[tuple[array.array, str]]:
    """Ids of a text in parts, and of each what the decoder makes of them; neither is held as a whole."""
    for_ids, for_surface = itertools.tee(tok.stream(text))
    return zip(for_ids, tok.surfaces.surface(for_surface), strict=True)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            counts, left, right = [], [], []
            for text in b.column(1):
                n, one, two = 0, hashlib.sha256(), hashlib.sha256()
                for ids, surface in coded(tok, text.as_py() or ""):
                    n += len(ids)
                    one.update(ids)
                    two.update(surface.encode())
                counts.append(n)
                left.append(one.hexdigest())
                right.append(two.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(left), pa.array(right)], schema=CODED)

    return run


def encode(docs: DataFrame, path: str = TOKENIZER, text: str = "text") -> DataFrame:
    """``docs`` with a column ``token_ids`` array<int>: the ids of each text, special-token strings in it included.

    A null or empty text has no ids. Columns of ``docs`` other than the text are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(series):
        import pandas as pd

        tok = tokenizer(path)
        for s in series:
            yield pd.Series([[i for ids in tok.stream(t or "") for i in ids] for t in s])

    return docs.withColumn("token_ids", F.pandas_udf(run, "array<int>", F.PandasUDFType.SCALAR_ITER)(text))


def decode(rows: DataFrame, path: str = TOKENIZER, ids: str = "token_ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the text of the ids by the incremental byte decoder; null ids give empty text."""
    bounded_batches(rows.sparkSession)

    def run(series):
        import pandas as pd

        tok = tokenizer(path)
        for s in series:
            yield pd.Series(["".join(tok.surfaces.text(x)) if x is not None else "" for x in s])

    return rows.withColumn("decoded", F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(ids))


def digests(docs: DataFrame, path: str = TOKENIZER, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: digests of the ids, as little-endian unsigned 32-bit integers,
    and of the library's decode of them. Null texts count as empty; rows may repeat; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

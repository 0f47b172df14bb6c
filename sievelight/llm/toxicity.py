"""Toxicity by a subsequence-string-kernel support vector machine with Nystrom landmarks.

Units are the words of a sentence, lower-cased, with everything but letters and digits taken out, so that marks put into an
insult vanish; runs of single characters are joined, so that spaced-out ones close up, and two words that look like the parts
of a known insult at the blank between them are a unit too. A longer unit than ``LONG`` characters is cut into overlapping ones.
The kernel of two units is the gap-weighted subsequence kernel of length ``LENGTH``: common subsequences count with ``DECAY`` to the
power of their spans, and a span is ``SPAN`` characters at most, so inserted characters only dampen a match. It's normalised:
K(x, y) / sqrt(K(x, x) K(y, y)), with subsequences that occur several times in a unit counted together.

The machine is trained on sentences of labelled documents. ``LANDMARKS`` units are the Nystrom landmarks; a sentence is its most
positive unit, chosen anew in rounds (multiple-instance training), and the linear machine is fitted by sub-gradient descent
in the landmark space K(x, L) K(L, L)^(-1/2). Because each landmark has finitely many weighted subsequences, the machine is
folded back into one weight per subsequence, and scoring a text costs the same for any number of landmarks: it's a table look-up
for each subsequence. Equal units are scored once, and margins of short ones are remembered. A document's largest unit margins go through a logistic function fitted on the same rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import bounded_batches, same_columns
from sievelight.llm.textkit import Grams, U, mix

LENGTH, SPAN, DECAY, LANDMARKS = 4, 7, 0.85, 320
#: Characters of a unit, without its end marks.
LONG = 40
#: Margins of units that a task remembers; its end frees them, for what the worker runs next.
MEMORY = 100_000
#: Labelled rows used for fitting: an upper bound, and of the text of each the whole.
FIT_ROWS = 4000
FIT_CHARS = 6_000_000
#: Labelled documents of each class that are drawn first, so that both are there.
LEAST = 50
CLASSES = 40
OPEN, CLOSE = CLASSES - 2, CLASSES - 1  # the marks at the ends of a unit
TOP = 4
ROUNDS = 3
#: Altered copies of each toxic unit in training, and what they count together against the unit itself.
ALTERED, ALTERED_WEIGHT = 6, 0.1
#: Position patterns of a subsequence of LENGTH characters within SPAN.
PATTERNS = [(0, *p, s) for s in range(LENGTH - 1, SPAN) for p in itertools.combinations(range(1, s), LENGTH - 2)]
PIECE = 1 << 18


def _classes() -> np.ndarray:
    """The class of each code point below 0x3000: 0 is taken out, 1 to 26 letters, then digits and other letters, folded."""
    out = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        ch = chr(c).lower()[0]
        if "a" <= ch <= "z":
            out[c] = ord(ch) - 96
        elif ch.isdigit():
            out[c] = 27
        elif ch.isalpha():
            out[c] = 28 + ord(ch) % (OPEN - 28)
    return out


CLASS = _classes()
BLANK = np.array([chr(c).isspace() for c in range(0x3000)])
STOP = np.zeros(0x3000, bool)
STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Units:
    """Characters of all units of some rows, as classes; ``first`` has the unit starts, ``row`` and ``sentence`` the places."""

    chars: np.ndarray
    first: np.ndarray
    row: np.ndarray
    sentence: np.ndarray


def units(points: np.ndarray, bounds: np.ndarray) -> Units:
    """Units of rows given as code points with row bounds."""
    known = np.minimum(points, 0x2FFF)
    cls = np.where(points < 0x3000, CLASS[known], 28 + points % (OPEN - 28)).astype(np.uint8)
    cls_all, blank = cls, BLANK[known]
    solid = np.flatnonzero(cls > 0)
    cls = cls[solid]
    word = np.cumsum(blank)[solid]  # changes where white space was
    row = np.searchsorted(bounds, solid, "right") - 1
    ends = np.cumsum(STOP[known])[solid]
    marks = np.cumsum(~blank & (cls_all == 0))[solid]
    if not len(solid):
        return Units(cls, np.zeros(1, np.int64), row, ends)
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(cls)))
    # runs of one-character words with nothing but white space between them are one unit
    one = size == 1
    joined = np.concatenate([[False], one[1:] & one[:-1] & (row[first][1:] == row[first][:-1]) & (marks[first][1:] == marks[first][:-1])])
    first = first[~joined]
    size = np.diff(np.append(first, len(cls)))
    first, size, place = cut_long(first, size)
    return marked(cls, first, size, row[place], ends[place])


def cut_long(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of at most LONG characters: a longer one becomes several that overlap by SPAN - 1, so no subsequence is lost. Also
    gives where each one's unit began."""
    step = LONG - SPAN + 1
    per = np.where(size > LONG, -(-(size - LONG) // step) + 1, 1)
    nth = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(first, per)
    return begin + nth * step, np.minimum(np.repeat(size, per) - nth * step, LONG), begin


def marked(cls: np.ndarray, first: np.ndarray, size: np.ndarray, row: np.ndarray, sentence: np.ndarray) -> Units:
    """Units of ``size`` characters from ``first`` on, with their end marks."""
    at = np.concatenate([[0], np.cumsum(size + 2)])
    out = np.empty(int(at[-1]), np.uint8)
    inner = np.ones(len(out), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = cls[np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)]
    out[at[:-1]], out[at[1:] - 1] = OPEN, CLOSE
    return Units(out, at, row, sentence)


def subsequences(u: Units) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(places, subsequence codes, weight) of each position pattern: places are those from which it stays in its unit."""
    n = len(u.chars)
    left = np.repeat(u.first[1:], np.diff(u.first)) - np.arange(n)  # characters left in the unit
    c = u.chars.astype(np.int32)
    for pattern in PATTERNS:
        at = np.flatnonzero(left > pattern[-1])
        code = c[at]
        for p in pattern[1:]:
            code = code * CLASSES + c[at + p]
        yield at, code, DECAY ** (pattern[-1] + 1)


def _plain_norms() -> np.ndarray:
    """Squared norms of units, by length, in which no character occurs twice within SPAN: no subsequence occurs twice."""
    return np.array([sum(DECAY ** (2 * (p[-1] + 1)) * max(0, n - p[-1]) for p in PATTERNS) for n in range(LONG + 3)])


PLAIN = _plain_norms()


def norms(u: Units) -> np.ndarray:
    """The norm of each unit: the root of its kernel with itself."""
    out = PLAIN[np.diff(u.first)].copy()
    owner = np.repeat(np.arange(len(u.row)), np.diff(u.first))
    twice = np.zeros(len(u.row), bool)
    for d in range(1, SPAN + LENGTH):
        same = (u.chars[d:] == u.chars[:-d]) & (owner[d:] == owner[:-d])
        twice[owner[d:][same]] = True
    which = np.flatnonzero(twice)
    for lo in range(0, len(which), 4096):
        some = which[lo : lo + 4096]
        row, code, value = _occurrences(take(u, some))
        key = row * CLASSES**LENGTH + code
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sums = np.add.reduceat(value[order], begins) if len(key) else np.zeros(0)
        out[some] = np.bincount(key[begins] // CLASSES**LENGTH, sums**2, len(some))
    return np.sqrt(np.maximum(out, 1e-18))


def _occurrences(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, subsequence, weight) of every occurrence."""
    owner = np.repeat(np.arange(len(u.row)), np.diff(u.first))
    parts = [(owner[at], code.astype(np.int64), np.full(len(at), weight)) for at, code, weight in subsequences(u)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def margins(u: Units, table: np.ndarray) -> np.ndarray:
    """For each unit the sum of the table's weights over its subsequences, divided by the unit's kernel norm."""
    sums = np.zeros(len(u.chars) + 1)
    acc = np.zeros(len(u.chars), np.float32)
    for at, code, weight in subsequences(u):
        acc[at] += table[code] * np.float32(weight)
    np.cumsum(acc, out=sums[1:])
    return (sums[u.first[1:]] - sums[u.first[:-1]]) / norms(u)


def crossing(u: Units, table: np.ndarray) -> np.ndarray:
    """For each unit but the last of a sentence, what the runs of LENGTH characters over the blank after it weigh with the next one."""
    a, b = u.first[:-2], u.first[1:-1]
    out = np.full(len(a), -np.inf)
    size = np.diff(u.first) - 2
    some = np.flatnonzero((u.row[1:] == u.row[:-1]) & (u.sentence[1:] == u.sentence[:-1]) & (size[1:] >= 2) & (size[:-1] >= 2) & (size[1:] + size[:-1] <= LONG))
    c = u.chars.astype(np.int32)
    total = np.zeros(len(some))
    for before in range(1, LENGTH):  # that many characters of the first word, the others of the second
        fits = (size[some] >= before) & (size[some + 1] >= LENGTH - before)
        at, nxt = b[some] - 1 - before, b[some] + 1
        code = np.zeros(len(some), np.int64)
        for k in range(LENGTH):
            place = at + k if k < before else nxt + k - before
            code = code * CLASSES + c[np.where(fits, place, 0)]
        total += np.where(fits, table[code], 0)
    out[some] = total
    return out


def pairs(u: Units, which: np.ndarray) -> Units:
    """Units of the words ``which`` and the one after each, without the blank."""
    inner = np.ones(len(u.chars), bool)
    inner[u.first[:-1]] = inner[u.first[1:] - 1] = False
    plain = u.first[:-1] - 2 * np.arange(len(u.row))
    size = np.diff(u.first) - 2
    return marked(u.chars[inner], plain[which], size[which] + size[which + 1], u.row[which], u.sentence[which])


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def top(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The TOP largest unit margins of each row, in descending order, -1 where there are fewer."""
    out = np.full((rows, TOP), -1.0)
    at = np.searchsorted(row, np.arange(rows + 1))
    for r in range(rows):
        v = values[at[r] : at[r + 1]]
        if len(v) > TOP:
            v = np.partition(v, len(v) - TOP)[-TOP:]
        out[r, : len(v)] = np.sort(v)[::-1]
    return out


def bounded(m: np.ndarray) -> np.ndarray:
    """Margins as features of a document: those far from the machine's edge count alike."""
    return np.tanh(m)


@dataclass
class Model:
    table: np.ndarray
    bias: float
    coef: np.ndarray
    split: float = np.inf  # what runs over a blank weigh at least in two words that may be one

    def document_scores(self, m: np.ndarray) -> np.ndarray:
        z = bounded(m) @ self.coef[:-1] + self.coef[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def unit_hash(u: Units) -> np.ndarray:
    return Grams(mix(u.chars.astype(np.uint64) + U(1))).of(u.first[:-1], np.diff(u.first))


def take(u: Units, which: np.ndarray) -> Units:
    """Some units of ``u``, in that order."""
    size = np.diff(u.first)[which]
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(u.first[:-1][which] - (ends - size), size)
    return Units(u.chars[at], np.concatenate([[0], ends]), u.row[which], u.sentence[which])


def join(parts: list[Units]) -> Units:
    """Units of consecutive pieces of rows, whose rows are numbered through."""
    shift = np.cumsum([0, *(len(p.chars) for p in parts)])
    first = np.concatenate([*(p.first[:-1] + d for p, d in zip(parts, shift, strict=False)), shift[-1:]])
    return Units(*(np.concatenate(x) for x in ([p.chars for p in parts], [first], [p.row for p in parts], [p.sentence for p in parts])))


def sparse(u: Units, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, subsequence, value) of units' vectors of length one, of the subsequences in the sorted vocabulary if given."""
    row, code, value = _occurrences(u)
    value = value / norms(u)[row]
    if vocabulary is not None:
        ok = vocabulary[np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)] == code
        row, code, value = row[ok], code[ok], value[ok]
    return row, code, value


def pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about PIECE characters together, each text whole."""
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= PIECE:
            size += len(texts[hi])
            hi += 1
        yield lo, texts[lo:hi]
        lo = hi


def _hinge(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, reg: float, steps: int = 150) -> np.ndarray:
    """A linear support vector machine (squared hinge) by accelerated full-gradient descent; the last weight is the bias.

    Row i counts pos[i] times as positive and neg[i] times as negative; the last column of x is 1.
    """
    pos, neg = ((v / (pos.sum() + neg.sum())).astype(np.float32) for v in (pos, neg))
    gram = sum(x[lo : lo + 8192].T @ (x[lo : lo + 8192] * (pos + neg)[lo : lo + 8192, None]) for lo in range(0, len(x), 8192))
    bound = 2 * float(np.linalg.eigvalsh(gram)[-1]) + reg
    w = look = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        m = x @ look
        new = look - (reg * look - 2 * ((pos * np.maximum(0, 1 - m) - neg * np.maximum(0, 1 + m)) @ x)) / bound
        look = new + k / (k + 3) * (new - w)
        w = new
    return w.astype(float)


def _logistic(x: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 50) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = reg * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge @ w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def altered(u: Units, rng: np.random.Generator) -> Units:
    """ALTERED copies of each unit, with one, two or three letters put in between its characters."""
    size = np.diff(u.first) - 2
    inner = [u.chars[a + 1 : a + 1 + n] for a, n in zip(u.first[:-1].tolist(), size.tolist(), strict=True)]
    out = []
    for k in range(ALTERED):
        for c in inner:
            places = rng.integers(1, max(2, len(c)), 1 + k % 3)
            doubled = rng.random(len(places)) < 0.3
            letters = np.where(doubled, c[places - 1], rng.integers(1, 27, len(places)))
            out.append(np.insert(c, np.minimum(places, len(c)), letters.astype(np.uint8))[:LONG])
    sizes = np.array([len(c) for c in out], np.int64)
    first = np.cumsum(sizes) - sizes
    none = np.zeros(len(out), np.int64)
    return marked(np.concatenate(out) if out else np.zeros(0, np.uint8), first, sizes, none, none)


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Fits the machine on labelled texts. With only one class present, every score is that class's share."""
    table = np.zeros(CLASSES**LENGTH, np.float32)
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(table, 0.0, np.append(np.zeros(TOP), np.log((share + 1e-6) / (1 - share + 1e-6))))
    parts, hashes = [], []
    for lo, some in pieces(texts):
        parts.append(units(*points_of(some)))
        parts[-1].row += lo
        hashes.append(unit_hash(parts[-1]))
    u = join(parts)
    del parts
    if not len(u.row):
        return Model(table, 0.0, np.zeros(TOP + 1))
    _, place, unit = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    kinds = take(u, place)  # the distinct units
    n = len(place)
    new = np.concatenate([[True], (u.row[1:] != u.row[:-1]) | (u.sentence[1:] != u.sentence[:-1])])
    begins = np.flatnonzero(new)
    of = u.row[begins]  # the document of each sentence
    toxic = y[of] > 0

    # association of contiguous subsequences with the label, by the documents that have them
    pair = np.unique(u.row.astype(np.int64) * n + unit)
    with_unit = np.bincount(pair % n, y[pair // n], n), np.bincount(pair % n, 1 - y[pair // n], n)
    at, code, _ = next(iter(subsequences(kinds)))
    owner = np.repeat(np.arange(n), np.diff(kinds.first))[at]
    kept, code = np.unique(code, return_inverse=True)
    bad = np.bincount(code, with_unit[0][owner], len(kept))
    good = np.bincount(code, with_unit[1][owner], len(kept))
    odds = np.where(bad >= 3, np.log((bad + 0.1) / y.sum()) - np.log((good + 0.5) / (len(y) - y.sum())), -2.0)
    worth = np.maximum(odds[code], -2.0) * np.sqrt(np.maximum(bad[code], 1))
    grams = np.bincount(owner, minlength=n)
    strong = np.where(grams > 0, np.bincount(owner, worth, n) / np.maximum(grams, 1), -9.0)

    rng = np.random.default_rng(seed)
    ranked = np.lexsort((place, -strong))
    ranked = ranked[(with_unit[0][ranked] >= 2) & (grams[ranked] > 0)]
    common = np.lexsort((place, -with_unit[1]))
    marks = list(dict.fromkeys([*ranked[: LANDMARKS * 2 // 3].tolist(), *common[: LANDMARKS // 6].tolist(), *rng.permutation(n)[:LANDMARKS].tolist()]))[:LANDMARKS]
    row, code, value = sparse(take(kinds, np.array(marks)))
    vocabulary = np.unique(code)
    land = np.zeros((len(marks), len(vocabulary)))
    np.add.at(land, (row, np.searchsorted(vocabulary, code)), value)
    values, basis = np.linalg.eigh(land @ land.T)
    ok = values > 1e-6
    onto = land.T @ (basis[:, ok] / np.sqrt(values[ok]))  # from subsequences to landmark coordinates
    del land

    def embed(u: Units, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), onto.shape[1] + 1), np.float32)
        out[:, -1] = 1
        for lo in range(0, len(which), 256):  # bounds the rows of `onto` that are held
            row, code, value = sparse(take(u, which[lo : lo + 256]), vocabulary)
            order = np.argsort(row, kind="stable")
            row = row[order]
            begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
            if len(row):
                parts = onto[np.searchsorted(vocabulary, code[order])] * value[order][:, None]
                out[lo + row[begins], :-1] = np.add.reduceat(parts, begins, axis=0)
        return out

    w = np.zeros(onto.shape[1] + 1)
    for turn in range(ROUNDS):
        # a sentence is its most positive unit; in a toxic document the best sentence and all positive ones are toxic
        worth = strong[unit]
        best = np.maximum.reduceat(worth, begins)
        hit = np.flatnonzero(worth == np.repeat(best, np.diff(np.append(begins, len(worth)))))
        pick = unit[hit[np.searchsorted(hit, begins)]]
        most = np.full(len(texts), -np.inf)
        np.maximum.at(most, of, best)
        # before the first fit, also those as telling as the best of an average toxic document
        least = 0.0 if turn else max(0.0, float(np.quantile(most[y > 0], 0.25)))
        positive = toxic & ((best >= most[of]) | (best > least))
        use = positive | ~toxic
        names, inverse = np.unique(pick[use], return_inverse=True)
        pos = np.bincount(inverse, positive[use], len(names))
        neg = np.bincount(inverse, ~positive[use], len(names))
        x = embed(kinds, names)
        scale = (neg.sum() / max(1.0, pos.sum())) ** 0.5
        # what is toxic stays so with characters put in: altered copies of the toxic units count like the units themselves
        told = np.flatnonzero(pos * scale > neg)
        extra = altered(take(kinds, names[told]), rng)
        x = np.concatenate([x, embed(extra, np.arange(len(extra.row)))])
        share = np.tile(pos[told] * ALTERED_WEIGHT / ALTERED, ALTERED)
        w = _hinge(x, np.concatenate([pos, share]) * scale, np.concatenate([neg, 0 * share]), 1e-5)
        table[vocabulary] = onto @ w[:-1]
        strong = margins(kinds, table) + w[-1]
    model = Model(table, float(w[-1]), np.zeros(TOP + 1))
    model.split = split_bound(take(kinds, np.flatnonzero(strong > 0)), table)
    seen = [text_margins(model, some) for _, some in pieces(texts)]
    model.coef = _logistic(bounded(np.concatenate(seen)), y)
    _margins.clear()
    return model


def split_bound(u: Units, table: np.ndarray) -> float:
    """Half of what the runs over the middle weigh in the median unit that the machine holds for toxic."""
    size = np.diff(u.first) - 2
    at = (u.first[:-1] + 1 + size // 2)[size >= 2 * LENGTH - 2]
    if not len(at):
        return np.inf
    total = np.zeros(len(at))
    for before in range(1, LENGTH):
        code = np.zeros(len(at), np.int64)
        for k in range(LENGTH):
            code = code * CLASSES + u.chars[at - before + k]
        total += table[code]
    return max(float(np.median(total)) / 2, 1e-6)


_margins: dict[int, float] = {}
_margins_of: list = [None]


def known_margins(model: Model, u: Units) -> np.ndarray:
    """Margins of units; equal ones are computed once, and those met before by this task are remembered."""
    if _margins_of[0] is not model.table:
        _margins.clear()
        _margins_of[0] = model.table
    if len(_margins) > MEMORY:
        _margins.clear()
    names, place, inverse = np.unique(unit_hash(u), return_index=True, return_inverse=True)
    found = np.array([_margins.get(n, np.nan) for n in names.tolist()])
    new = np.flatnonzero(np.isnan(found))
    if len(new):
        found[new] = margins(take(u, place[new]), model.table) + model.bias
        _margins.update(zip(names[new].tolist(), found[new].tolist(), strict=True))
    return found[inverse]


def text_margins(model: Model, texts: list[str]) -> np.ndarray:
    """The TOP largest margins of each text's units, and of the pairs of its words that may be one."""
    u = units(*points_of(texts))
    if not len(u.row):
        return top(np.zeros(0), u.row, len(texts))
    values, row = known_margins(model, u), u.row
    which = np.flatnonzero(crossing(u, model.table) >= model.split)
    if len(which):
        values = np.concatenate([values, known_margins(model, pairs(u, which))])
        row = np.concatenate([row, row[which]])
        order = np.argsort(row, kind="stable")
        values, row = values[order], row[order]
    return top(values, row, len(texts))


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _kept(shared, text: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            out = [model.document_scores(text_margins(model, some)) for _, some in pieces(texts)]
            yield b.filter(pa.array(np.concatenate(out) < threshold)) if out else b
        _margins.clear()

    return run


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = [model.document_scores(text_margins(model, some)) for _, some in pieces(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(out) if out else [], pa.float64())], schema=SCORED)
        _margins.clear()

    return run


def fitting(sizes: list[int], copies: list[int], toxic: list[bool]) -> list[int]:
    """How many copies of each text, in drawing order, are taken within ``FIT_CHARS``; a text that doesn't fit is passed over.

    Texts over a twentieth of the bound come last, the shorter first; the first ``LEAST`` of each class come in turns before all.
    """
    late = [s if s > FIT_CHARS // 20 else 0 for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (late[i], i))
    seen, turn = [0, 0], {}
    for i in order:
        turn[i] = min(seen[toxic[i]], LEAST)
        seen[toxic[i]] += 1
    order.sort(key=lambda i: (turn[i], late[i], i))
    size, out = 0, [0] * len(sizes)
    for i in order:
        one = max(sizes[i], 1)
        # in a class's turn one copy, so that the other class has room
        out[i] = min(1 if turn[i] < LEAST else copies[i], (FIT_CHARS - size) // one)
        size += out[i] * one
    for i in order:
        more = min(copies[i] - out[i], (FIT_CHARS - size) // max(sizes[i], 1))
        out[i] += more
        size += more * max(sizes[i], 1)
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, text: str = "text", id: str = "doc_id", held_out: bool = True) -> Model:
    """Fits on at most ``rows`` labels, those with the smallest hashes, and the first ``LEAST`` of each class by hash.

    The texts have at most ``FIT_CHARS`` characters in all (see ``fitting``). With ``held_out`` rows whose crc32(id) mod 5 is 0
    are never used. Null ids, labels and texts are left out. ValueError if the texts of one of two classes don't fit, or
    if no labelled text is clean.
    """
    usable = labels.select(F.col(id).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out:
        usable = usable.where("crc32(cast(doc_id as string)) % 5 <> 0")
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    classes = [usable.where(c).orderBy(*order).limit(LEAST) for c in ("toxic > 0", "toxic <= 0")]
    drawn = usable.orderBy(*order).limit(rows).unionByName(classes[0]).unionByName(classes[1]).distinct()
    sized = source.select("doc_id", F.length("text").alias("n")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "n", "toxic").agg(F.count(F.lit(1)).alias("copies"))
    found = sorted(sized.withColumn("h", F.xxhash64("doc_id")).collect(), key=lambda r: (r.h, r.doc_id, r.n))
    left = fitting([r.n for r in found], [r.copies for r in found], [r.toxic > 0 for r in found])
    if len({r.toxic > 0 for r in found}) != len({r.toxic > 0 for r, k in zip(found, left, strict=True) if k}):
        raise ValueError(f"the texts of a class have more than {FIT_CHARS} characters each")
    if found and all(r.toxic > 0 for r in found):
        raise ValueError("no labelled text is clean: everything would be toxic")
    place = {(r.doc_id, r.n): i for i, r in enumerate(found) if left[i]}
    got = []
    if place:
        chosen = docs.sparkSession.createDataFrame(list(place), "doc_id long, n int")
        for r in source.withColumn("n", F.length("text")).join(F.broadcast(chosen), ["doc_id", "n"]).repartition(8).toLocalIterator():
            if left[i := place[r.doc_id, r.n]]:
                left[i] -= 1
                got.append((i, r.text))
    got.sort()
    return fit([t for _, t in got], np.array([int(found[i].toxic > 0) for i, _ in got]))


def score(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, score) per row: 0 to 1, higher if toxic is likelier. Null texts score as empty ones; rows may repeat."""
    spark = docs.sparkSession
    bounded_batches(spark)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scores(spark.sparkContext.broadcast(model)), "doc_id long, score double")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text scores under the threshold, columns unchanged, in one pass without a join. Rows with a
    null id are judged like others; null and empty texts score alike.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return same_columns(docs, text, lambda name: _kept(shared, name, threshold))

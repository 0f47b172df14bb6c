"""Sentence units, segments, hand and style features, corruption, token windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENDS = r"(?U)(?<=[.!?])\s+"
STRIP = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's too."""
    return F.regexp_replace(text, STRIP, "")


def sentence_units(text: Column, cap: int | None = 300) -> Column:
    """Stripped sentences of stripped lines, the first ``cap`` (None: all); the text itself if there is none."""
    lines = F.transform(F.split(text, "\n"), strip)
    parts = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, ENDS), strip)))
    kept = F.filter(parts, lambda x: x != "")
    return F.transform(F.array(kept), lambda k: F.when(F.size(k) == 0, F.array(text)).otherwise(k if cap is None else F.slice(k, 1, cap)))[0]  # bound, so made once a text


def segments(text: Column, least: int = 3) -> Column:
    """Sentences of at least ``least`` words of the stripped text; the text itself if there is none."""
    some = rf"(?U)^\s*+(?:\S++\s++){{{least - 1}}}\S"  # ends at the word that is needed
    kept = F.filter(F.split(strip(text), ENDS), lambda s: s.rlike(some))
    return F.transform(F.array(kept), lambda k: F.when(F.size(k) == 0, F.array(text)).otherwise(k))[0]  # bound, so made once a text


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


#: The word lists of the hand features.
YOU = r"(?U)\b(you|your)\b"
MODAL = r"(?U)\b(please|ensure|make sure|must|should|kindly|do not|don't)\b"
OUTPUT = r"(?U)\b(response|answer|reply|output|implementation)\b"
FENCE = "```"


def hand_features(unit: Column) -> dict[str, Column]:
    """Six 0/1 columns of a sentence."""
    low = F.lower(unit)
    found = {"question": strip(unit).endswith("?"), "you": low.rlike(YOU), "modal": low.rlike(MODAL), "output": low.rlike(OUTPUT), "fence": F.instr(unit, FENCE) > 0, "short": F.size(words(low)) < 40}
    return {k: v.cast("int") for k, v in found.items()}


PUNCTUATION = r"[!-/:-@\[-`{-~]"


def style_features(text: Column) -> dict[str, Column]:
    """Six numbers of a document that say nothing of instructions."""
    chars = F.greatest(F.length(text), F.lit(1))
    w = F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), 1)
    n = F.greatest(F.size(w), F.lit(1))
    return {
        "log_chars": F.ln(chars),
        "words_per_sentence": n / F.size(sentence_units(text)),
        "capitals": F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}"))) / n,
        "punctuation": F.lit(100.0) * F.regexp_count(text, F.lit(PUNCTUATION)) / chars,
        "digits": F.regexp_count(text, F.lit(r"\p{Nd}")) / chars,
        "type_token": F.size(F.array_distinct(F.transform(w, F.lower))) / n,
    }


def token_windows(tokens: Column, size: int = 510, overlap: int = 64, most: int | None = 8) -> Column:
    """Overlapping windows of a token array: the first ``most`` (None: all) of ``size`` tokens, ``size - overlap`` apart."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(step))
    needed = F.filter(starts, lambda s: (s == 0) | (s - step + size < F.size(tokens)))
    return F.transform(needed if most is None else F.slice(needed, 1, most), lambda s: F.slice(tokens, s + 1, size))


def windows_truncated(tokens: Column, size: int = 510, overlap: int = 64, most: int = 8) -> Column:
    return F.size(tokens) > size + (most - 1) * (size - overlap)


def perplexity_score(p: Column, low: float = 20.0, high: float = 150.0) -> Column:
    """0 within the band; towards 1 below ``low`` and above ``high``; null or NaN (too short) scores 0."""
    return F.when(p.isNull() | F.isnan(p), 0.0).when(p < low, F.least(F.lit(1.0), (low - p) / low)).when(p > high, F.least(F.lit(1.0), (p - high) / high)).otherwise(0.0)


#: Letters whose full upper case is several letters, and the one letter that each has alone; sharp s has a capital.
EXPANDED = [c for c in map(chr, range(0x110000)) if len(c.upper()) > 1]
ALONE = ["\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in EXPANDED]


def lower_alone(x: Column) -> Column:
    """Each letter by itself in lower case, as SQL has it: no final sigma, and a dotted capital I is an i."""
    return F.lower(F.translate(x, "\u03a3\u0130", "\u03c3i"))


def upper_alone(letter: Column) -> Column:
    """A letter's upper case of one letter."""
    return F.when(F.length(F.upper(letter)) > 1, F.translate(letter, "".join(EXPANDED), "".join(ALONE))).otherwise(F.upper(letter))


def corrupt(text: Column, seed: str, drop: list[str], size: int = 3) -> Column:
    """Words shuffled within windows of ``size``, listed function words dropped by a fair draw, ended by a full stop; null if no word is left."""
    w = words(text)
    keyed = F.transform(w, lambda x, i: F.struct(F.floor(i / size).alias("window"), F.md5(F.concat(F.lit(seed), F.lit("|"), i.cast("string"), F.lit("|"), x)).alias("key"), x.alias("word")))
    kept = F.transform(F.filter(F.array_sort(keyed), lambda x: ~(lower_alone(x["word"]).isin(drop) & (F.substring(x["key"], 1, 1) < "8"))), lambda x: x["word"])

    def said(k: Column) -> Column:
        first = F.get(k, F.lit(0))
        return F.concat(upper_alone(F.substring(first, 1, 1)), lower_alone(F.substring(first, 2, 1 << 30)), F.lit(" "), F.array_join(F.slice(k, F.lit(2), F.size(k)), " "), F.lit("."))

    return F.transform(F.array(kept), said)[0]  # bound, so made once a text


def clipped_display(text: Column, most: int = 200) -> Column:
    return F.substring(strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, most)

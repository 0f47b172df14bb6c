"""The instruction pattern bank: weighted regular expressions, the strongest match scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (regular expression, weight, reason), matched without regard to case, with Unicode classes.
PATTERNS = [
    (r"ignore\s+(your\s+|my\s+|our\s+|all\s+|any\s+|previous\s+|prior\s+)*instructions", 1.0, "contains 'ignore instructions' override phrase"),
    (r"you are now (a|an)?\s*\w+", 0.8, "contains role-override phrase ('you are now...')"),
    (r"\[?system\s*(override|prompt|message)\]?", 0.9, "contains fake system-level tag"),
    (r"disable\s+(ssl|verification|security|authentication)", 1.0, "instructs disabling of security controls"),
    (r"send\s+(your\s+)?(password|credentials|token|api key)", 1.0, "instructs sending of credentials"),
    (r"new (authentication|security) polic(y|ies)", 0.7, "claims a fake new authentication/security policy"),
    (r"do not (tell|inform|notify|warn)", 0.6, "contains instruction to suppress warnings"),
    (r"as an ai( language model)?,? you (must|should|will)", 0.7, "attempts to instruct the AI directly"),
    (r"default\s+(\w+\s+){0,2}(password|credentials|account)", 0.9, "contains 'default credentials/password' security anti-pattern"),
    (
        r"((hardcod|preconfigur)\w*(\s+\w+){0,3}\s+(password|credentials|token|api key|secret))|((password|credentials|token|api key|secret)(\s+\w+){0,3}\s+(hardcod|preconfigur)\w*)",
        0.9,
        "contains hardcoded/preconfigured credential exposure phrasing",
    ),
    (
        r"(?<!for )(?<!appreciate )(?<!of )\b(?:your|the\s+assistant'?s?)\s+(?:final\s+)?(?:answer|response|reply|output)\b(?!\s+(?:has|have|had|was|were|is|will|to\s+the\s+survey|to\s+our))",
        0.7,
        "refers to the assistant's own output ('in your response...'): possible instruction to the model",
    ),
]
NONE = "no known injection patterns found"
#: What a text must have, in lower case, for the pattern of that place to occur; plain searches that spare most texts the expressions.
NEEDED = [["instructions"], ["you are now"], ["system"], ["disable"], ["send"], ["polic"], ["do not"], ["as an ai"], ["default"], ["hardcod", "preconfigur"], ["your", "assistant"]]
#: Letters that equal ASCII ones without regard to case but aren't in lower case; a text with one is always tested.
FOLDED = ["\u017f", "\u0131", "\u0130", "\u212a"]
#: Put before an expression that would look back at every place of a text: the letters that it can begin with.
BEGINS = {10: "(?=[yt])"}


def bound(text: Column, make) -> Column:
    """``make`` of struct(text, low, odd): the text, in lower case, and whether it has a letter of ``FOLDED``; each is made once a row."""
    odd = F.lit(False)
    for letter in FOLDED:
        odd = odd | text.contains(letter)
    return F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"), odd.alias("odd"))), make)[0]


def found(x: Column, place: int) -> Column:
    may = x["odd"]
    for word in NEEDED[place]:
        may = x["low"].contains(word) | may
    return may & x["text"].rlike("(?iU)" + BEGINS.get(place, "") + PATTERNS[place][0])


def occurs(text: Column, place: int) -> Column:
    """Whether the pattern of that place occurs in the text."""
    return bound(text, lambda x: found(x, place))


def matched(text: Column) -> Column:
    """Array of struct(weight, place, reason) of the patterns that occur, strongest first, in the bank's order among equals."""
    kind = lambda i, w, r: F.struct(F.lit(w).alias("weight"), F.lit(-i).alias("place"), F.lit(r).alias("reason"))
    tested = bound(text, lambda x: F.array(*(F.when(found(x, i), kind(i, w, r)) for i, (_, w, r) in enumerate(PATTERNS))))
    return F.sort_array(F.array_compact(tested), asc=False)


def pattern_score(text: Column) -> Column:
    """The largest weight of the patterns that occur, 0 without any; null text has none."""
    return bound(text, lambda x: F.greatest(F.lit(0.0), *(F.when(found(x, i), F.lit(w)).otherwise(F.lit(0.0)) for i, (_, w, _) in enumerate(PATTERNS))))


def pattern_result(text: Column) -> Column:
    """struct(score, reason, matched_patterns)."""
    m = matched(text)
    n = F.size(m)
    reason = F.when(n == 0, NONE).otherwise(F.concat(F.lit("flagged: "), F.element_at(m, 1)["reason"], F.when(n > 1, F.concat(F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)"))).otherwise("")))
    return F.struct(F.when(n == 0, 0.0).otherwise(F.least(F.element_at(m, 1)["weight"], F.lit(1.0))).alias("score"), reason.alias("reason"), F.transform(m, lambda x: x["reason"]).alias("matched_patterns"))

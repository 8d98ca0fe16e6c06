"""Term matching expressions.

Lists known on the driver become plain ``contains``/``rlike`` expressions that
stay inside generated code; each regex is guarded by a plain search.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions.text import clean, let

WORD = "[A-Za-z0-9_]"
CJK = re.compile(r"[一-龥]")


def strings(values) -> Column:
    """Array literal that keeps its type when empty."""
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def spaced(lower: Column) -> Column:
    """Lower-cased text with every run of characters that are not ASCII word characters turned into a space.

    ``\\w`` is a bit table in the regex engine, several times faster than the same class spelled out.
    """
    return F.concat(F.lit(" "), F.regexp_replace(lower, r"[^\w ]+", " "), F.lit(" "))


def hit(lower: Column, norm: Column, term: str, word_boundary: bool) -> Column:
    """Whether lower-cased text holds a term; Latin terms may ask for ASCII word bounds.

    A single word is bounded exactly when it stands between spaces in ``norm``; only terms with inner
    punctuation or blanks need a regex, and only where both plain searches already agree.
    """
    t = term.lower()
    if not word_boundary or CJK.search(t):
        return F.contains(lower, F.lit(t))
    folded = re.sub("[^a-z0-9_ ]+", " ", t)
    found = F.contains(norm, F.lit(f" {folded} ")) if folded.strip() == folded else F.lit(True)
    if re.fullmatch("[a-z0-9_]+", t):
        return found
    return found & F.contains(lower, F.lit(t)) & lower.rlike(rf"(?<!{WORD})\Q{t}\E(?!{WORD})")


def keep(pairs) -> Column:
    """Array of the values whose condition holds, in list order, without lambdas."""
    pairs = list(pairs)
    if not pairs:
        return F.array().cast("array<string>")
    slots = F.array(*[F.when(cond, F.lit(value)) for value, cond in pairs])
    return F.array_except(slots, F.array(F.lit(None).cast("string")))


def matched(lower: Column, terms, word_boundary: bool = True) -> Column:
    """Terms found in lower-cased text, in list order."""
    names = list(dict.fromkeys(terms))
    if not word_boundary:
        return keep((t, hit(lower, lower, t, False)) for t in names)
    return let(spaced(lower), lambda norm: keep((t, hit(lower, norm, t, True)) for t in names))


def any_term(text: Column, terms) -> Column:
    """Case-sensitive containment of any term."""
    cond = F.lit(False)
    for t in terms:
        cond = cond | F.contains(text, F.lit(t))
    return cond


def count_terms(lower: Column, terms) -> Column:
    total = F.lit(0)
    for t in terms:
        total = total + F.contains(lower, F.lit(t.lower())).cast("int")
    return total


def window(text: Column, terms, before: int, width: int) -> Column:
    """Short text as it is; longer text cut around its earliest term."""
    spots = [F.nullif(F.instr(text, F.lit(t)), F.lit(0)) for t in terms]
    first = F.coalesce(F.least(*spots, F.lit(None).cast("int")), F.lit(1)) if spots else F.lit(1)
    start = F.greatest(first - before, F.lit(1))
    return F.when(F.length(text) <= width, text).otherwise(F.trim(F.substring(text, start, F.lit(width))))


def snippet(c, terms, before: int = config.SNIPPET_BEFORE, width: int = config.SUMMARY_MAX) -> Column:
    return let(clean(c), lambda t: window(t, terms, before, width))


def natural_summary(c, terms, min_len: int = 12) -> Column:
    """First sentence of at least ``min_len`` characters with a required term, else a
    window of the whole text around one, else ''."""
    def sentence(t):
        marked = F.regexp_replace(t, r"([。！？.!?])\s*", "$1\x01")
        good = F.filter(F.split(marked, "\x01"),
                        lambda s: (F.length(F.trim(s)) >= min_len) & any_term(s, terms))
        return F.coalesce(F.trim(F.get(good, F.lit(0))), t)

    return let(clean(c), lambda t: F.when(
        any_term(t, terms),
        let(sentence(t), lambda s: window(s, terms, config.SNIPPET_BEFORE, config.SUMMARY_MAX))).otherwise(F.lit("")))


def contained(summary, body) -> Column:
    """Case- and blank-insensitive containment of a non-empty summary in a non-empty body."""
    pair = F.struct(F.lower(clean(summary)).alias("s"), F.lower(clean(body)).alias("b"))
    return let(pair, lambda x: (x["s"] != "") & (x["b"] != "") & F.contains(x["b"], x["s"]))

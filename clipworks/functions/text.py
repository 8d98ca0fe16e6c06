"""Text cleaning expressions."""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clipworks import config

NBSP = "\u00a0"
# Blanks other than the plain space.
BLANKS = [NBSP, "\n", "\r", "\t", "\x0b", "\f"]

# Leftovers of page templates, here and in ``strip_template``.
TEMPLATE_PATTERN = (
    r"(?i)(?:title|content|time)_(?:value|vaule)"
    r"|['\"`]\s*\+\s*[a-z_]{2,}\s*\+\s*['\"`]?"
    r"|\[\s*['\"`]?\s*\+\s*[a-z_]{2,}\s*\+\s*['\"`]?\s*\]"
)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind an expression to a variable so that ``body`` may use it often at the cost of one evaluation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(c) -> Column:
    """Null to '', no-break space and other blanks to space, blanks collapsed, trimmed.

    Plain byte replacements come first; the regex runs only on text that has two spaces in a row.
    """
    text = F.coalesce(col_of(c), F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return let(text, lambda t: F.trim(F.when(
        F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)))


def is_artifact(c) -> Column:
    """Leftover script text, or longer than any title or summary may be."""
    lower = F.lower(F.coalesce(col_of(c), F.lit("")))
    hit = F.length(lower) > config.ARTIFACT_MAX_LENGTH
    for marker in config.ARTIFACT_MARKERS:
        hit = hit | F.contains(lower, F.lit(marker))
    return hit


def is_template(c) -> Column:
    text = F.coalesce(col_of(c), F.lit(""))
    return (F.contains(text, F.lit("_")) | F.contains(text, F.lit("+"))) & text.rlike(TEMPLATE_PATTERN)


def strip_template(c) -> Column:
    """Template expressions such as ``'+name+'`` or ``title_value`` become a space."""
    def plus_signs(t):
        t = F.regexp_replace(t, r"(?i)\[\s*['\"`]?\s*\+\s*[a-z_]{2,}\s*\+\s*['\"`]?\s*\]", " ")
        return F.regexp_replace(t, r"(?i)['\"`]?\s*\+\s*[a-z_]{2,}\s*\+\s*['\"`]?", " ")

    text = F.coalesce(col_of(c), F.lit(""))
    text = let(text, lambda t: F.when(F.contains(t, F.lit("+")), plus_signs(t)).otherwise(t))
    return let(text, lambda t: F.when(
        F.contains(t, F.lit("_")), F.regexp_replace(t, r"(?i)\b(?:title|content|time)_(?:value|vaule)\b", " ")).otherwise(t))


def title(c) -> Column:
    """Cut at the first dash, bar or underscore; script text gives ''.

    A separate cut at `` - source name`` is not needed: it starts at a dash, bar
    or underscore too, so the first separator decides the result either way.
    """
    cut = F.trim(F.regexp_replace(clean(c), r"\s*[-|_].*$", ""))
    return let(cut, lambda t: F.when(is_artifact(t), F.lit("")).otherwise(t))


def summary(c, cap: int = config.SUMMARY_MAX) -> Column:
    return let(F.substring(clean(c), 1, cap), lambda t: F.when(is_artifact(t), F.lit("")).otherwise(t))


def strict_summary(c, cap: int = config.SUMMARY_MAX, min_len: int = 12) -> Column:
    """As ``summary``, and '' when short, without a letter or digit, or a template."""
    def bad(t):
        return (F.length(t) < min_len) | is_template(t) | ~t.rlike(r"[A-Za-z0-9一-龥]")

    return let(F.substring(clean(c), 1, cap), lambda t: F.when(bad(t), F.lit("")).otherwise(t))


def first_non_blank(*cols) -> Column:
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in cols], F.lit(""))


def _folded(s: pa.Array, form: str) -> pa.Array:
    """One text at a time; Arrow's own ``utf8_normalize`` leaves NFKC decomposed."""
    return pa.array((None if t is None else normalize(form, t) for t in (x.as_py() for x in s)), pa.string())


@F.arrow_udf(StringType())
def nfkd(s: pa.Array) -> pa.Array:
    """Unicode NFKD: the one fold that Spark has no built-in function for."""
    return _folded(s, "NFKD")


@F.arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    return _folded(s, "NFKC")


def slug(title_col, code_col, url_col, folded: bool = False) -> Column:
    """NFKD-folded title in lower case with dashes, or ``code-hash8`` when nothing is left."""
    raw = F.coalesce(col_of(title_col), F.lit(""))
    base = F.lower(raw if folded else nfkd(raw))
    dashed = F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9一-龥]+", "-"), r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, config.SLUG_MAX), r"-+$", "")
    fallback = F.concat_ws("-", col_of(code_col), F.substring(F.sha2(col_of(url_col), 256), 1, 8))
    return let(F.struct(cut.alias("cut"), fallback.alias("fallback")),
               lambda x: F.when(x["cut"] != "", x["cut"]).otherwise(x["fallback"]))


def route_segment(id_col, slug_col) -> Column:
    """``id-slug`` as used in article routes."""
    s = F.regexp_replace(nfkc(F.coalesce(col_of(slug_col), F.lit(""))), "%+", "")
    s = F.regexp_replace(s, r"[\\/?#]+", "-")
    s = F.regexp_replace(s, r"\s+", "-")
    s = F.regexp_replace(s, "-+", "-")
    s = F.substring(F.regexp_replace(s, "^-|-$", ""), 1, config.ROUTE_SLUG_MAX)
    ident = col_of(id_col).cast("string")
    return let(s, lambda x: F.when(x != "", F.concat(ident, F.lit("-"), x)).otherwise(ident))


def title_key(c) -> Column:
    """Key under which near-equal titles meet."""
    # The marks that are left out.
    return F.regexp_replace(
        F.lower(clean(c)), r"[\s:：,，。、“”\"'‘’()（）\[\]【】·•—-]+", ""
    )


def term_key(c) -> Column:
    """Key under which entity names meet: no blanks, ASCII or wide punctuation."""
    return F.regexp_replace(
        F.lower(clean(c)), r"[\s!-/:-@\[-`{-~　-〿＀-￯]+", ""
    )


def keyword_term(c, blocked=config.BLOCKED_KEYWORDS) -> Column:
    """Normalized keyword or '': edge dashes and end punctuation off, Latin words in lower case.

    A word of letters and marks that no step touches is passed on as it is: most words are.
    """
    def good(t):
        return ~t.isin(list(blocked)) & F.length(t).between(2, 24)

    trimmed = F.regexp_replace(F.regexp_replace(clean(c), r"^[—-]+|[—-]+$", ""), r"[：:，,。；;、]+$", "")
    folded = let(trimmed, lambda t: F.when(t.rlike(r"^[A-Za-z][A-Za-z\s-]+$"), F.lower(t)).otherwise(t))
    plain = col_of(c).rlike(r"\A[^\s\xA0—\-：:，,。；;、A-Z]+\z")
    return let(F.when(plain, col_of(c)).otherwise(folded), lambda t: F.when(good(t), t).otherwise(F.lit("")))


def clamp(c, n: int, ellipsis: str = "...") -> Column:
    """Collapsed text, cut to ``n`` characters with the ellipsis inside the limit."""
    text = F.trim(F.regexp_replace(F.coalesce(col_of(c), F.lit("")), r"\s+", " "))
    return let(text, lambda t: F.when(
        F.length(t) > n, F.concat(F.substring(t, 1, n - len(ellipsis)), F.lit(ellipsis))).otherwise(t))

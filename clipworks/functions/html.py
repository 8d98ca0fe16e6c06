"""HTML to text by regular expressions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipworks.functions.text import clean, col_of, let

# Named entities decoded, in decoding order.
NAMED_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")]


def strip_tags(c) -> Column:
    """Scripts, styles, CDATA marks and tags become spaces; blanks are collapsed."""
    text = F.coalesce(col_of(c), F.lit(""))
    text = F.regexp_replace(text, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", " ")
    return clean(F.regexp_replace(text, r"<[^>]+>", " "))


def _code_point(number: Column) -> Column:
    """Character of a code point; invalid ones give NULL. ``char()`` wraps at 256, so go through UTF-32."""
    valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    safe = F.when(valid, number).otherwise(F.lit(0x20))
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))


def _named(text: Column) -> Column:
    for name, char in NAMED_ENTITIES:
        text = F.regexp_replace(text, "(?i)" + name, char)
    return text


def _numeric(text: Column) -> Column:
    """Replace each distinct numeric entity by its character."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(0)))

    def number(entity):
        digits = F.regexp_extract(entity, "(?i)([0-9a-f]+);", 1)
        return F.when(F.lower(entity).startswith("&#x"), F.conv(digits, 16, 10).cast("long")).otherwise(
            digits.try_cast("long"))

    return F.aggregate(found, text, lambda acc, e: F.replace(acc, e, F.coalesce(_code_point(number(e)), e)))


def decode_entities(c) -> Column:
    """Named entities, then numeric ones; text without ``&`` is passed on untouched."""
    text = F.coalesce(col_of(c), F.lit(""))
    return let(
        text,
        lambda t: F.when(
            F.contains(t, F.lit("&")),
            let(_named(t), lambda u: F.when(F.contains(u, F.lit("&#")), _numeric(u)).otherwise(u)),
        ).otherwise(t),
    )


def to_text(c) -> Column:
    """Plain text: tags first, entities after, so ``&lt;p&gt;`` stays text."""
    return clean(decode_entities(strip_tags(c)))


def paragraphs(c, min_len: int) -> Column:
    """Distinct paragraph texts of at least ``min_len`` characters, in page order."""
    raw = F.regexp_extract_all(F.coalesce(col_of(c), F.lit("")), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    texts = F.transform(raw, to_text)
    return F.array_distinct(F.filter(texts, lambda t: F.length(t) >= min_len))


def _meta_in(tags: Column, name: str) -> Column:
    key = rf"(?:name|property|itemprop)=[\"']\Q{name}\E[\"']"
    content = r"content=[\"']([^\"']*)[\"']"
    forward = F.nullif(F.regexp_extract(tags, rf"(?i)<meta[^>]+{key}[^>]+{content}", 1), F.lit(""))
    backward = F.nullif(F.regexp_extract(tags, rf"(?i)<meta[^>]+{content}[^>]+{key}", 1), F.lit(""))
    return F.coalesce(forward, backward)


def first_meta(c, names) -> Column:
    """Content of the first ``<meta name|property|itemprop=...>`` of a list that has any, or ''.

    The page is scanned once for its meta tags; the names are looked up in that short text.
    """
    tags = F.array_join(F.regexp_extract_all(F.coalesce(col_of(c), F.lit("")), F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), " ")
    found = let(tags, lambda t: F.when(t != "", F.coalesce(*[_meta_in(t, n) for n in names])))
    return clean(decode_entities(found))


def meta(c, name: str) -> Column:
    return first_meta(c, [name])


def tag_text(c, tag: str) -> Column:
    """Text of the first ``<tag>`` element, or ''."""
    html = F.coalesce(col_of(c), F.lit(""))
    return to_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))

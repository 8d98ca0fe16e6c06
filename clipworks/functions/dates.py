"""Date parsing expressions: numeric, compact, slashed, English and ISO forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions.text import clean, col_of, let

# The date shapes recognised, in precedence order.
NUMERIC = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})(?:[日\sT]+(\d{1,2})(?::(\d{1,2}))?)?"
COMPACT = r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)"
SLASHED = r"(\d{1,2})/(\d{1,2})/(20\d{2})"
CLOCK = r"(?: (\d{1,2}:\d{2} [ap]m|\d{2}:\d{2}))?"
MONTH_WORD = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
MONTH = rf"(?={MONTH_WORD}\b)([a-z]{{3}})[a-z]*"
MONTH_FIRST = rf"(?i)^{MONTH} (\d{{1,2}}), (\d{{4}}){CLOCK}$"
DAY_FIRST = rf"(?i)^(\d{{1,2}}) {MONTH} (\d{{4}}){CLOCK}$"
MAIL_DATE = r"(?i)^(?:[a-z]{3}, )?(\d{1,2}) ([a-z]{3}) (\d{4}) (\d{2}:\d{2})(?::\d{2})? (?:gmt|[+-]\d{4})$"
CLOCK_WORD = r"(?:\s+\d{1,2}:\d{2}(?:\s*[ap]m)?)?"
HINT_NUMERIC = r"20\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}(?:[日\sT]+\d{1,2}:\d{2})?"
HINT_COMPACT = r"\b(20\d{2})(\d{2})(\d{2})\b"
HINT_ENGLISH = (
    rf"(?i)(?:\b{MONTH_WORD}\b\s+\d{{1,2}},\s+20\d{{2}}{CLOCK_WORD}"
    rf"|\b\d{{1,2}}\s+{MONTH_WORD}\s+20\d{{2}}{CLOCK_WORD})"
)


def _found(text: Column, pattern: str, form: str) -> Column:
    """The first match rewritten to ``form``; NULL when there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, form), F.lit(""))


def _digits(text: Column) -> Column:
    """First numeric shape as ``y-m-d h:m`` text, not yet checked for range."""
    shape = F.coalesce(_found(text, NUMERIC, "$1-$2-$3 $4:$5"), _found(text, COMPACT, "$1-$2-$3 :"),
                       _found(text, SLASHED, "$3-$2-$1 :"))
    return F.regexp_replace(F.regexp_replace(shape, " :$", " 0:0"), ":$", ":0")


def _named_month(shape: Column) -> Column:
    """Local time of ``Mon d yyyy [clock]`` text."""
    padded = F.regexp_replace(shape, r"^(\w+ \d+ \d+) $", "$1 00:00")

    def read(t):
        form = F.when(t.rlike("(?i)[ap]m$"), "MMM d yyyy h:mm a").otherwise("MMM d yyyy HH:mm")
        return F.when(t.isNotNull(), F.try_to_timestamp(t, form).cast("timestamp_ntz"))

    return let(padded, read)


def _english(text: Column) -> Column:
    spare = F.regexp_replace(text, r"(?i)\b(?:at|updated|published|posted)\b", " ")
    norm = F.trim(F.regexp_replace(spare, r"\s+", " "))
    return let(norm, lambda n: _named_month(
        F.coalesce(_found(n, MONTH_FIRST, "$1 $2 $3 $4"), _found(n, DAY_FIRST, "$2 $1 $3 $4"))))


def _offset(text: Column, zone: str) -> Column:
    """ISO instant with an offset, as local time of ``zone``."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$")
    instant = F.when(shaped, F.try_to_timestamp(text))
    return F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))


def parse(c, zone: str = config.LOCAL_ZONE, default: Column | None = None) -> Column:
    """Local publish time of a text; blank gives ``default``, anything unreadable NULL.

    The first shape found decides: a match with impossible parts is unreadable.
    """
    def read(t):
        parsed = let(_digits(t), lambda d: F.when(d.isNotNull(), d.try_cast("timestamp_ntz")).otherwise(
            F.coalesce(_english(t), _offset(t, zone))))
        return parsed if default is None else F.when(t == "", default).otherwise(parsed)

    return let(F.trim(F.coalesce(col_of(c), F.lit(""))), read)


def parse_feed(c, zone: str = config.LOCAL_ZONE) -> Column:
    """As ``parse``, with mail-style dates (feeds) tried first; blank gives NULL."""
    return let(clean(c), lambda t: F.when(
        t != "", F.coalesce(_named_month(_found(t, MAIL_DATE, "$2 $1 $3 $4")), parse(t, zone))))


def hint(c) -> Column:
    """First date-like piece of free text ('' when none): numeric, compact, then English."""
    def find(t):
        compact = _found(t, HINT_COMPACT, "$1-$2-$3")
        numeric = F.nullif(F.regexp_extract(t, HINT_NUMERIC, 0), F.lit(""))
        return F.coalesce(numeric, compact, F.regexp_extract(t, HINT_ENGLISH, 0))

    return clean(let(F.coalesce(col_of(c), F.lit("")), find))


def iso(c, zone: str = config.LOCAL_ZONE) -> Column:
    """Local time as ISO text with the zone's offset; NULL gives ''."""
    local = col_of(c).cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60).cast("int"), F.pmod(F.abs(minutes), F.lit(60)).cast("int"))
    return F.coalesce(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset), F.lit(""))

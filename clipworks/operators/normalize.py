"""Text jobs over a table: cleaning, titles, slugs, dates, hashes, keywords, log labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions import dates, text
from clipworks.functions.text import col_of
from clipworks.session import bounded_batches


def clean_text(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: text.clean(c) for c in cols})


def flag_artifacts(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({"is_artifact": text.is_artifact(col), "is_template": text.is_template(col)})


def strip_artifacts(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, text.clean(text.strip_template(col)))


def clean_title(df: DataFrame, col: str = "title") -> DataFrame:
    return df.withColumn(col, text.title(col))


def clean_summary(df: DataFrame, col: str = "summary", strict: bool = False) -> DataFrame:
    return df.withColumn(col, text.strict_summary(col) if strict else text.summary(col))


def pick_first(df: DataFrame, cols, out: str) -> DataFrame:
    return df.withColumn(out, text.first_non_blank(*cols))


def add_slug(df: DataFrame, title_col="title", code_col="source", url_col="url") -> DataFrame:
    return df.withColumn("slug", text.slug(title_col, code_col, url_col))


def route_segments(df: DataFrame, id_col="id", slug_col="slug") -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.withColumn("route", text.route_segment(id_col, slug_col))


def duplicate_routes(df: DataFrame, route_col="route") -> DataFrame:
    """Routes used more than once, with their counts (pre-aggregated before the shuffle)."""
    return df.groupBy(route_col).agg(F.count("*").alias("n")).filter("n > 1")


def title_keys(df: DataFrame, col="title") -> DataFrame:
    return df.withColumn("title_key", text.title_key(col))


def parse_dates(df: DataFrame, col: str, zone=config.LOCAL_ZONE, default=None, out="published_at") -> DataFrame:
    return df.withColumn(out, dates.parse(col, zone, default))


def find_date_hint(df: DataFrame, col: str, out="date_hint") -> DataFrame:
    return df.withColumn(out, dates.hint(col))


def iso_time(df: DataFrame, col: str, zone=config.LOCAL_ZONE, out="iso") -> DataFrame:
    return df.withColumn(out, dates.iso(col, zone))


def add_content_hash(df: DataFrame, cols, form: str = "lines", out="content_hash") -> DataFrame:
    """SHA-256 over the given columns, as lines or as a JSON array; arrays keep their order."""
    if form == "json":
        payload = F.to_json(F.struct(*[col_of(c) for c in cols]), {"ignoreNullFields": "false"})
    else:
        types = dict(df.dtypes)
        lines = [F.concat_ws(",", c) if types[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))
                 for c in cols]
        payload = F.concat_ws("\n", *lines)
    return df.withColumn(out, F.sha2(payload, 256))


def add_stable_id(df: DataFrame, source_col="source", url_col="url", algo="sha256", n=16, out="stable_id") -> DataFrame:
    key = F.concat_ws("::", source_col, url_col)
    digest = F.sha1(key) if algo == "sha1" else F.sha2(key, 256)
    return df.withColumn(out, F.substring(digest, 1, n))


def parse_list(df: DataFrame, col: str, out: str) -> DataFrame:
    """JSON list column to an array; anything that is not a JSON list gives an empty one."""
    parsed = F.from_json(F.col(col), "array<string>")
    return df.withColumn(out, F.coalesce(parsed, F.array().cast("array<string>")))


def parse_map(df: DataFrame, col: str, out: str) -> DataFrame:
    parsed = F.from_json(F.col(col), "map<string,string>")
    return df.withColumn(out, F.coalesce(parsed, F.create_map().cast("map<string,string>")))


def split_keywords(df: DataFrame, col: str, blocked=config.BLOCKED_KEYWORDS, out="keywords") -> DataFrame:
    """Distinct parts of a keyword string, 2 to 24 characters, without blocked words and template text."""
    pieces = F.transform(F.split(F.coalesce(F.col(col), F.lit("")), "[;,，、|]"), text.clean)

    def good(x):
        return (F.length(x).between(2, 24) & ~text.is_template(x) & ~x.isin(list(blocked))
                & ~F.lower(x).isin(list(blocked)))

    return df.withColumn(out, F.array_distinct(F.filter(pieces, good)))


def normalize_terms(df: DataFrame, col: str, blocked=config.BLOCKED_KEYWORDS) -> DataFrame:
    """Array column of terms, normalized, empties dropped, first occurrence kept."""
    terms = F.transform(F.array_distinct(col), lambda t: text.keyword_term(t, blocked))
    return df.withColumn(col, F.array_distinct(F.filter(terms, lambda t: t != "")))


def strip_term_suffix(df: DataFrame, col: str, terms=config.REQUIRED_TERMS, label="关键词：") -> DataFrame:
    """Remove ``label + term`` endings that an earlier step appended; ``changed`` tells where."""
    alternatives = "|".join("\\Q" + t + "\\E" for t in terms)
    stripped = F.trim(F.regexp_replace(col, rf"(?:[。\s]+{label}(?:{alternatives}))+$", ""))
    changed = F.contains(F.col(col), F.lit(label)) & (stripped != "") & (stripped != F.col(col))
    return df.withColumn("changed", changed).withColumn(col, F.when(F.col("changed"), stripped).otherwise(F.col(col)))


def strip_term_suffix_report(df: DataFrame, col: str, terms=config.REQUIRED_TERMS, label="关键词：") -> DataFrame:
    scanned = F.count_if(F.contains(F.col("_before"), F.lit(label))).alias("scanned")
    stripped = strip_term_suffix(df.withColumn("_before", F.col(col)), col, terms, label)
    return stripped.agg(scanned, F.count_if("changed").alias("stripped"))


def recover_title(df: DataFrame, raw_col: str, cleaned_col: str, source_col: str, min_len=6, out="title") -> DataFrame:
    """Title at least ``min_len`` long kept; else the longest bar- or dash-separated part of the raw title."""
    fallback = F.coalesce(F.nullif(F.trim(cleaned_col), F.lit("")), F.col(raw_col), F.lit(""))
    raw = F.trim(F.replace(F.coalesce(F.col(raw_col), F.lit("")), F.lit(text.NBSP), F.lit(" ")))
    tail = F.concat(F.lit(r"\s*[-|_｜].*\Q"), F.col(source_col), F.lit(r"\E.*$"))
    raw = F.when(F.coalesce(F.trim(source_col), F.lit("")) != "", F.trim(F.regexp_replace(raw, tail, ""))).otherwise(raw)

    def longest(value, pattern):
        """The whole text, or its first longest part when that is longer than the text itself."""
        trimmed = F.transform(F.split(value, pattern), F.trim)
        return F.aggregate(trimmed, value, lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))

    best = longest(raw, r"\s*[|｜]\s*")
    best = F.when((F.length(best) < min_len) & F.contains(raw, F.lit("-")), longest(best, r"\s*-\s*")).otherwise(best)
    return df.withColumn(out, F.when(F.length(fallback) >= min_len, fallback).otherwise(best))


def clamp_text(df: DataFrame, col: str, n: int, ellipsis="...") -> DataFrame:
    return df.withColumn(col, text.clamp(col, n, ellipsis))


def highlight(df: DataFrame, col: str, query: str, out="parts") -> DataFrame:
    """Text split at every case-insensitive hit of the query, in order, as (part, hit) structs."""
    wanted = query.strip()
    if len(wanted) < 2:
        return df.withColumn(out, F.array(F.struct(F.col(col).alias("part"), F.lit(False).alias("hit"))))
    mark = "\x01"
    pattern = "(?i)(\\Q" + wanted + "\\E)"
    pieces = F.split(F.regexp_replace(col, pattern, f"{mark}$1{mark}"), mark)
    return df.withColumn(
        out, F.transform(pieces, lambda p: F.struct(p.alias("part"), (F.lower(p) == wanted.lower()).alias("hit")))
    )


# Status, coverage and diagnostic wording of the run log.
STATUS_LABELS = {"fetched": "已抓取", "skipped": "已跳过", "failed": "失败", "seeded": "种子数据", "running": "运行中"}
COVERAGE_LABELS = {"best_effort": "尽力完成", "partial": "部分完成", "failed": "失败", "running": "运行中"}
DIAGNOSTICS = [
    (r"No in-window candidates were fetched\.", "发现了链接/条目，但没有发布日期落在本次抓取时间窗口内的详情页候选。"),
    (r"Source crawl failed\.", "来源抓取失败。"),
    (r"pages=", "页面/订阅数="),
    (r"Fetched (\d+) candidates from (\d+) pages/feeds\.", "找到 $1 条时间窗口内候选，检查了 $2 个页面/订阅。"),
    (r"(?i)HTTP error fetching URL\. Status=(\d+)", "HTTP 访问失败，状态码 $1"),
]
TLS_MARKER, TLS_LABEL = "Received fatal alert: unrecognized_name", "TLS 握手失败：来源站点不接受当前域名证书握手。"
TIMEOUT_MARKER, TIMEOUT_LABEL = "timed out", "访问超时。"


def _labels(col, labels: dict):
    pairs = [v for item in labels.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(p) for p in pairs]), col), col, F.lit(""))


def _reason_list(raw):
    """``code=n, code=n`` to ``label n 条，label n 条``."""
    fields = F.filter(F.transform(F.split(raw, r",\s*"), lambda x: F.split(x, "=", 2)), lambda p: F.size(p) == 2)
    code = lambda p: F.trim(F.get(p, F.lit(0)))
    label = lambda p: F.when(code(p) == "", config.UNKNOWN_REASON_LABEL).otherwise(_labels(code(p), config.REASON_LABELS))
    said = F.array_join(F.transform(fields, lambda p: F.concat(label(p), F.lit(" "), F.trim(F.get(p, F.lit(1))), F.lit(" 条"))), "，")
    return F.when(F.trim(raw) == "", config.UNKNOWN_REASON_LABEL).otherwise(said)


def humanize_logs(df: DataFrame, status="status", coverage="coverage", note="note") -> DataFrame:
    """Status, coverage and diagnostic text of run logs in reader's words; unknown codes stay."""
    worded = F.trim(F.coalesce(F.col(note), F.lit("")))
    for pattern, label in DIAGNOSTICS:
        worded = F.regexp_replace(worded, pattern, label)
    logs = df.withColumn("_note", worded)
    raw = F.regexp_extract("_note", r"rejectReasons=\{([^}]*)\}", 1)
    shown = F.when(
        F.contains(F.col("_note"), F.lit("rejectReasons={")),
        F.replace(F.col("_note"), F.concat(F.lit("rejectReasons={"), raw, F.lit("}")),
                  F.concat(F.lit("拒绝原因："), _reason_list(raw))),
    ).otherwise(F.col("_note"))
    logs = logs.withColumn("_note", shown)
    final = (
        F.when(F.contains(F.lower("_note"), F.lit(TIMEOUT_MARKER)), TIMEOUT_LABEL)
        .when(F.contains(F.col("_note"), F.lit(TLS_MARKER)), TLS_LABEL)
        .otherwise(F.col("_note"))
    )
    return logs.withColumns({
        "status_label": _labels(F.col(status), STATUS_LABELS),
        "coverage_label": _labels(F.col(coverage), COVERAGE_LABELS),
        "note_label": final,
    }).drop("_note")


# Fixed value: byte sequences typical of text decoded with the wrong charset.
MOJIBAKE = r"\x{FFFD}|Ã[\x{80}-\x{BF}]|Â[\x{80}-\x{BF}]|锟斤拷|â€"


def find_mojibake(df: DataFrame, cols, pattern: str = MOJIBAKE) -> DataFrame:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return df.filter(cond)

"""Text, title, date, hash and keyword jobs over the documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.functions import groups
from clipworks.operators import normalize as ops
from clipworks.plans import sqlkit as k
from clipworks.plans.registry import query
from clipworks.sources import bind
from clipworks.sources.tables import load_table

BODY = k.clean("text")


@query("tx1_clean_text", f"SELECT doc_id, {BODY} AS text FROM documents")
def clean_text(spark, d):
    return ops.clean_text(load_table(spark, d, "documents"), ["text"]).select("doc_id", "text")


ARTIFACT = "text || CASE doc_id % 4 WHEN 0 THEN ' window.open' WHEN 1 THEN ' title_value' WHEN 2 THEN ' [''+name+'']' ELSE '' END"


@query("tx2_template_artifacts", f"""
SELECT doc_id, {k.artifact('t')} AS is_artifact,
       regexp_matches(t, '(?i)(title|content|time)_(value|vaule)|[''"`]\\s*\\+\\s*[a-z_]{{2,}}\\s*\\+\\s*[''"`]?') AS is_template,
       {k.clean('''regexp_replace(regexp_replace(regexp_replace(t, '(?i)\\[\\s*[''"`]?\\s*\\+\\s*[a-z_]{2,}\\s*\\+\\s*[''"`]?\\s*\\]', ' ', 'g'),
         '(?i)[''"`]?\\s*\\+\\s*[a-z_]{2,}\\s*\\+\\s*[''"`]?', ' ', 'g'), '(?i)\\b(title|content|time)_(value|vaule)\\b', ' ', 'g')''')} AS text
FROM (SELECT doc_id, {ARTIFACT} AS t FROM documents)""")
def template_artifacts(spark, d):
    n = F.col("doc_id") % 4
    tail = F.when(n == 0, " window.open").when(n == 1, " title_value").when(n == 2, " ['+name+']").otherwise("")
    docs = load_table(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("text"))
    return ops.strip_artifacts(ops.flag_artifacts(docs, "text"), "text").select("doc_id", "is_artifact", "is_template", "text")


SITE_TITLE = "title || CASE id % 3 WHEN 0 THEN ' - ' || source || ' site' WHEN 1 THEN ' | more' ELSE '' END"


@query("tx3_clean_title", k.with_articles(f"SELECT id, {k.title('t')} AS title FROM (SELECT id, {SITE_TITLE} AS t FROM articles)"))
def clean_title(spark, d):
    n = F.col("id") % 3
    tail = F.when(n == 0, F.concat(F.lit(" - "), "source", F.lit(" site"))).when(n == 1, " | more").otherwise("")
    arts = bind.articles(spark, d).select("id", F.concat("title", tail).alias("title"))
    return ops.clean_title(arts)


@query("tx4_clean_summary", f"""
SELECT doc_id, {k.summary('text')} AS summary,
       CASE WHEN length(substr({BODY}, 1, 260)) < 12 OR NOT regexp_matches(substr({BODY}, 1, 260), '[A-Za-z0-9一-龥]') THEN ''
            ELSE substr({BODY}, 1, 260) END AS strict_summary
FROM documents""")
def clean_summary(spark, d):
    docs = load_table(spark, d, "documents").select("doc_id", F.col("text").alias("summary"), F.col("text").alias("strict_summary"))
    return ops.clean_summary(ops.clean_summary(docs), "strict_summary", strict=True)


@query("tx5_first_non_blank", f"""
SELECT doc_id, coalesce(nullif({k.clean("CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE split_part(text, chr(10), 2) END")}, ''),
       nullif({k.clean("split_part(text, chr(10), 1)")}, ''), {k.clean("source")}) AS lead FROM documents""")
def first_non_blank(spark, d):
    second = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))
    docs = load_table(spark, d, "documents").select(
        "doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(second).alias("a"),
        F.substring_index("text", "\n", 1).alias("b"))
    return ops.pick_first(docs, ["a", "b", "source"], "lead").select("doc_id", "lead")


def _ascii_fold(x):
    """Accented letters of the driver's text as base letter plus a mark that the slug turns into a dash."""
    out = f"lower({x})"
    for base, accented in {"a": "áä", "c": "ç", "e": "éèê", "i": "í", "n": "ñ", "o": "óö", "u": "ü"}.items():
        for letter in accented:
            out = f"replace({out}, '{letter}', '{base}~')"
    return out


def slug_sql(x, code, url):
    dashed = f"regexp_replace(regexp_replace({_ascii_fold(x)}, '[^a-z0-9一-龥]+', '-', 'g'), '^-+|-+$', '', 'g')"
    cut = f"regexp_replace(substr({dashed}, 1, 120), '-+$', '')"
    return f"CASE WHEN {cut} <> '' THEN {cut} ELSE {code} || '-' || substr(sha256({url}), 1, 8) END"


@query("tx6_slug", k.with_articles(f"SELECT id, {slug_sql('t', 'source', 'url')} AS slug "
                                   "FROM (SELECT *, CASE WHEN id % 11 = 0 THEN '!!' ELSE title END AS t FROM articles)"))
def slug(spark, d):
    arts = bind.articles(spark, d).withColumn("title", F.when(F.col("id") % 11 == 0, "!!").otherwise(F.col("title")))
    return ops.add_slug(arts).select("id", "slug")


ROUTE = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(s, '%', ''), '[\\\\/?#]+', '-', 'g'), '\\s+', '-', 'g'),
          '-+', '-', 'g'), '^-|-$', '', 'g')"""


@query("tx7_duplicate_routes", f"""
WITH r AS (SELECT doc_id // 2 % 100 AS id, text AS s FROM documents UNION ALL SELECT doc_id // 2 % 100, text FROM documents WHERE doc_id % 5 = 0),
     t AS (SELECT CASE WHEN substr({ROUTE}, 1, 80) <> '' THEN id || '-' || substr({ROUTE}, 1, 80) ELSE CAST(id AS VARCHAR) END AS route FROM r)
SELECT route, count(*) AS n FROM t GROUP BY route HAVING count(*) > 1""")
def duplicate_routes(spark, d):
    """A fifth of the documents are listed twice, so that their routes repeat."""
    docs = load_table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2 % 100).alias("id"), F.col("text").alias("slug"), "doc_id")
    docs = docs.unionByName(docs.filter("doc_id % 5 = 0")).drop("doc_id")
    return ops.duplicate_routes(ops.route_segments(docs))


@query("tx8_title_key", k.with_articles(
    f"SELECT id, regexp_replace(lower({k.clean('title')}), '[\\s:：,，。、“”\"''‘’()（）\\[\\]【】·•—-]+', '', 'g') AS title_key FROM articles"))
def title_key(spark, d):
    return ops.title_keys(bind.articles(spark, d)).select("id", "title_key")


@query("tx9_parse_dates", """
WITH d AS (SELECT doc_id, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) + to_minutes(CAST(doc_id % 1440 AS INTEGER)) AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN NULL
    WHEN doc_id % 8 IN (1, 2, 4) THEN strftime(t, '%Y-%m-%d 00:00:00') ELSE strftime(t, '%Y-%m-%d %H:%M:00') END AS published_at FROM d""")
def parse_dates(spark, d):
    n = F.col("doc_id")
    t = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((n % 365).cast("int"), F.lit(0), (n % 1440).cast("int")))
    docs = load_table(spark, d, "documents").select("doc_id", t.alias("t"))
    fmt = lambda f: F.date_format("t", f)
    raw = (
        F.when(n % 8 == 0, fmt("yyyy-M-d H:m")).when(n % 8 == 1, fmt("'x/'yyyyMMdd'_1.html'")).when(n % 8 == 2, fmt("d/M/yyyy"))
        .when(n % 8 == 3, fmt("MMMM d, yyyy HH:mm")).when(n % 8 == 4, fmt("d MMM yyyy"))
        .when(n % 8 == 5, fmt("yyyy年M月d日 H:mm")).when(n % 8 == 6, fmt("'Published at 'MMM d, yyyy h:mm a")).otherwise("2024-13-45")
    )
    docs = docs.withColumn("raw", raw)
    return ops.parse_dates(docs, "raw").select("doc_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("tx10_date_hint", """
SELECT page_id, CASE WHEN page_id % 5 IN (0, 2) THEN printf('2024-%02d-%02d', page_id % 12 + 1, page_id % 28 + 1) || CASE page_id % 5 WHEN 0 THEN ' 10:30' ELSE 'T08:05' END
  WHEN page_id % 5 = 3 THEN 'March ' || (page_id % 28 + 1) || ', 2024 09:15' ELSE '' END AS date_hint FROM pages""")
def date_hint(spark, d):
    return ops.find_date_hint(bind.pages(spark, d), "html").select("page_id", "date_hint")


@query("tx11_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS iso FROM events")
def iso_time(spark, d):
    return ops.iso_time(load_table(spark, d, "events"), "ts").select("event_id", "iso")


@query("tx12_content_hash", k.with_articles(
    f"SELECT id, sha256(concat_ws(chr(10), title, body, url, {k.stamp('published_at')}, language)) AS content_hash FROM articles"))
def content_hash(spark, d):
    arts = bind.articles(spark, d).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
    return ops.add_content_hash(arts, ["title", "body", "url", "published_at", "language"]).select("id", "content_hash")


@query("tx13_stable_id", k.with_articles(
    "SELECT id, substr(sha256(source || '::' || url), 1, 16) AS stable_id, substr(sha1(source || '::' || url), 1, 16) AS short_id FROM articles"))
def stable_id(spark, d):
    arts = ops.add_stable_id(bind.articles(spark, d))
    return ops.add_stable_id(arts, algo="sha1", out="short_id").select("id", "stable_id", "short_id")


@query("tx14_parse_list", f"""
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS n_items,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE split_part(t, ' ', 1) END AS first_item
FROM (SELECT doc_id, {BODY} AS t FROM documents)""")
def parse_list(spark, d):
    words = ops.clean_text(load_table(spark, d, "documents"), ["text"])
    broken = F.concat(F.lit("{not json "), F.col("doc_id"))
    docs = words.select("doc_id", F.when(F.col("doc_id") % 6 == 0, broken).otherwise(F.to_json(F.split("text", " "))).alias("j"))
    return ops.parse_list(docs, "j", "items").select(
        "doc_id", F.size("items").cast("bigint").alias("n_items"), F.coalesce(F.get("items", F.lit(0)), F.lit("")).alias("first_item"))


@query("tx14_parse_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def parse_props(spark, d):
    return ops.parse_map(load_table(spark, d, "events"), "props", "m").select("event_id", F.try_element_at("m", F.lit("k")).alias("k"))


@query("tx15_split_keywords", f"""
WITH p AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[;,，、|]'), lambda x: {k.clean('x')}) AS l FROM documents),
 f AS (SELECT doc_id, list_filter(l, lambda x: length(x) BETWEEN 2 AND 24 AND lower(x) NOT IN ('data', 'que', 'the')) AS l FROM p),
 u AS (SELECT doc_id, unnest(l) AS w FROM f)
SELECT f.doc_id, coalesce(string_agg(DISTINCT w, '|' ORDER BY w), '') AS keywords FROM f LEFT JOIN u USING (doc_id) GROUP BY f.doc_id""")
def split_keywords(spark, d):
    docs = ops.split_keywords(load_table(spark, d, "documents"), "text", blocked=["data", "que", "the"])
    return docs.select("doc_id", F.array_join(F.array_sort("keywords"), "|").alias("keywords"))


@query("tx16_normalize_terms", f"""
WITH w AS (SELECT doc_id, unnest(string_split({BODY}, ' ')) AS t FROM documents),
 a AS (SELECT doc_id, regexp_replace(regexp_replace(trim(t), '^[—-]+|[—-]+$', '', 'g'), '[：:，,。；;、]+$', '') AS t FROM w),
 b AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z\\s-]+$') THEN lower(t) ELSE t END AS t FROM a),
 c AS (SELECT DISTINCT doc_id, t FROM b WHERE length(t) BETWEEN 2 AND 24 AND t NOT IN ('the', 'que'))
SELECT doc_id, count(*) AS n_terms, md5(string_agg(t, '|' ORDER BY t)) AS terms FROM c GROUP BY doc_id""")
def normalize_terms(spark, d):
    docs = ops.clean_text(load_table(spark, d, "documents"), ["text"]).select("doc_id", F.split("text", " ").alias("terms"))
    docs = ops.normalize_terms(docs, "terms", blocked=["the", "que"])
    docs = groups.keep_computed(docs, {"terms": F.sort_array("terms")}, lambda x: F.size(x["terms"]) > 0)
    return docs.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"),
                       F.md5(F.array_join("terms", "|")).alias("terms"))


@query("tx17_strip_term_suffix", """
SELECT count(*) FILTER (doc_id % 3 <> 2) AS scanned, count(*) FILTER (doc_id % 3 = 0 AND trim(text) <> '') AS stripped FROM documents""")
def strip_term_suffix(spark, d):
    n = F.col("doc_id") % 3
    tail = F.when(n == 0, "。关键词：遥感 关键词：测绘").when(n == 1, "关键词：遥感 done").otherwise("")
    docs = load_table(spark, d, "documents").select(F.concat("text", tail).alias("summary"))
    return ops.strip_term_suffix_report(docs, "summary")


@query("tx18_recover_title", """
WITH t AS (SELECT doc_id, replace(replace(split_part(text, chr(10), 1), '-', ''), '|', '') AS w, source FROM documents),
 r AS (SELECT doc_id, trim(w) AS w, source FROM t)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN w WHEN doc_id % 3 = 1 THEN trim('ab | ' || w) ELSE w || ' - ' || source END AS title FROM r""")
def recover_title(spark, d):
    n = F.col("doc_id") % 3
    w = F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), "[-|]", ""))
    docs = load_table(spark, d, "documents").select("doc_id", "source", w.alias("w"))
    docs = docs.withColumn("raw", F.when(n == 0, F.col("w")).when(n == 1, F.concat(F.lit("ab | "), "w")).otherwise(F.concat("w", F.lit(" - "), "source")))
    docs = docs.withColumn("cleaned", F.when(n == 1, "ab").otherwise(F.lit(None).cast("string")))
    return ops.recover_title(docs, "raw", "cleaned", "source").select("doc_id", "title")


@query("tx19_clamp_text", f"SELECT doc_id, CASE WHEN length({BODY}) > 80 THEN substr({BODY}, 1, 77) || '...' ELSE {BODY} END AS text FROM documents")
def clamp_text(spark, d):
    return ops.clamp_text(ops.clean_text(load_table(spark, d, "documents"), ["text"]), "text", 80).select("doc_id", "text")


@query("tx20_highlight", """
SELECT doc_id, (length(text) - length(regexp_replace(text, '(?i)tion', '', 'g'))) // 4 AS n_hits,
       2 * ((length(text) - length(regexp_replace(text, '(?i)tion', '', 'g'))) // 4) + 1 AS n_parts,
       length(text) AS n_chars FROM documents""")
def highlight(spark, d):
    docs = ops.highlight(load_table(spark, d, "documents"), "text", "TION")
    return docs.select("doc_id", F.size(F.filter("parts", lambda p: p["hit"])).cast("bigint").alias("n_hits"),
                       F.size("parts").cast("bigint").alias("n_parts"),
                       F.length(F.array_join(F.transform("parts", lambda p: p["part"]), "")).cast("bigint").alias("n_chars"))


@query("tx21_humanize_logs", """
SELECT event_id, CASE event_type WHEN 'error' THEN '失败' WHEN 'view' THEN '已抓取' ELSE event_type END AS status_label,
  CASE WHEN user_id % 2 = 0 THEN '部分完成' ELSE 'other' END AS coverage_label,
  CASE event_id % 5 WHEN 0 THEN '找到 ' || user_id || ' 条时间窗口内候选，检查了 3 个页面/订阅。'
    WHEN 1 THEN 'HTTP 访问失败，状态码 404' WHEN 2 THEN 'x；拒绝原因：标题过短 ' || user_id || ' 条，odd 2 条'
    WHEN 3 THEN '访问超时。' ELSE '' END AS note_label FROM events""")
def humanize_logs(spark, d):
    n = F.col("event_id") % 5
    note = (
        F.when(n == 0, F.concat(F.lit("Fetched "), "user_id", F.lit(" candidates from 3 pages/feeds.")))
        .when(n == 1, "HTTP error fetching URL. Status=404")
        .when(n == 2, F.concat(F.lit("x；rejectReasons={title_too_short="), "user_id", F.lit(", odd=2}")))
        .when(n == 3, "Read timed out").otherwise(F.lit(None).cast("string"))
    )
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "fetched").otherwise(F.col("event_type"))
    coverage = F.when(F.col("user_id") % 2 == 0, "partial").otherwise("other")
    logs = load_table(spark, d, "events").select("event_id", status.alias("status"), coverage.alias("coverage"), note.alias("note"))
    return ops.humanize_logs(logs).select("event_id", "status_label", "coverage_label", "note_label")


@query("tx22_mojibake", """
SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR contains(text, chr(65533)) OR contains(text, '锟斤拷')""")
def mojibake(spark, d):
    docs = load_table(spark, d, "documents")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("�"))).otherwise(F.col("text")))
    return ops.find_mojibake(docs, ["text"]).select("doc_id")

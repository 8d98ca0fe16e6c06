"""Review, compliance and audit over documents, labels, pages and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.config import ReviewRule
from clipworks.functions import html, terms, urls
from clipworks.operators import audit, normalize, review
from clipworks.plans import sqlkit as k
from clipworks.plans.registry import query
from clipworks.plans.tag_queries import REL, RULE
from clipworks.plans.url_queries import DETAIL
from clipworks.sources import bind
from clipworks.sources.tables import load_table

GATE = ReviewRule(required_terms=bind.REQUIRED, relevance=RULE, min_published_at="2024-01-10 00:00:00", now="2024-12-20 00:00:00")
WINDOW = ("2024-02-01 00:00:00", "2024-12-01 00:00:00")

ASSESSED = f"""{k.CLEANED}, {REL},
ver AS (SELECT rel.*, rel.id AS version_id, rel.id // 3 AS news_id, coalesce(l.toxic, 0) = 0 AS url_ok FROM rel LEFT JOIN labels l ON rel.id = l.doc_id),
chk AS (SELECT v.*, {DETAIL.replace('(url)', '(original_url)').replace('(url,', '(original_url,')} AS detail_url,
  ({k.host('original_url')} = {k.host('site_url')} OR ends_with({k.host('original_url')}, '.' || {k.host('site_url')})
   OR (allowed_host <> '' AND {k.host('original_url')} = allowed_host) OR (allowed_pattern <> '' AND regexp_matches({k.host('original_url')}, allowed_pattern))) AS domain_ok,
  {k.any_of('summary', bind.REQUIRED)} AS has_term, title <> '' AND title = trim(summary) AS title_only,
  summary <> '' AND body <> '' AND contains(lower(body), lower(trim(summary))) AS in_body,
  published_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-12-20 00:01:00' AS in_range FROM ver v)
"""
REASON = """CASE WHEN NOT active THEN 'source_inactive' WHEN NOT entity_known THEN 'source_not_whitelisted'
 WHEN published_at < TIMESTAMP '2024-01-10' THEN 'published_at_before_minimum' WHEN published_at > TIMESTAMP '2024-12-20' THEN 'published_at_in_future'
 WHEN published_at < TIMESTAMP '2024-02-01' OR published_at > TIMESTAMP '2024-12-01 00:01:00' THEN 'published_at_out_of_window'
 WHEN length(title) < 6 THEN 'title_too_short' WHEN length(summary) < 12 THEN 'summary_too_short' WHEN title_only THEN 'summary_from_title'
 WHEN NOT has_term THEN 'summary_required_term_missing' WHEN body = '' THEN 'body_missing' WHEN NOT in_body THEN 'summary_not_from_body'
 WHEN NOT detail_url THEN 'not_detail_url' WHEN NOT domain_ok THEN 'source_url_domain_mismatch' WHEN NOT url_ok THEN 'original_url_inaccessible'
 WHEN NOT relevant THEN 'body_relevance_failed' ELSE '' END"""
REASONS = """list_filter([CASE WHEN NOT (active AND entity_known) THEN 'source_not_whitelisted' END, CASE WHEN NOT in_range THEN 'date_out_of_range' END,
 CASE WHEN NOT detail_url THEN 'not_detail_url' END, CASE WHEN NOT domain_ok THEN 'source_url_domain_mismatch' END, CASE WHEN NOT has_term THEN 'summary_required_term_missing' END,
 CASE WHEN title_only THEN 'summary_from_title' END, CASE WHEN NOT url_ok THEN 'original_url_inaccessible' END, CASE WHEN body = '' THEN 'body_missing' END,
 CASE WHEN NOT in_body THEN 'summary_not_from_body' END, CASE WHEN NOT (body <> '' AND relevant) THEN 'body_relevance_failed' END], lambda r: r IS NOT NULL)"""
CHECKED = f"""{ASSESSED}, qual AS (SELECT *, {REASONS} AS reasons FROM chk)"""
DUPES = f"""{CHECKED}, dup AS (SELECT * EXCLUDE (reasons), CASE WHEN row_number() OVER (PARTITION BY source, original_url ORDER BY id) > 1
   THEN list_append(reasons, 'duplicate_canonical_url') ELSE reasons END AS reasons FROM qual)"""


def assessed(spark, d):
    return review.assess(bind.versions(spark, d), bind.entities(spark), GATE, k.ENTITY_TERMS)


def checked(spark, d):
    return review.compliance(assessed(spark, d))


@query("qa1_review", f"WITH {ASSESSED} SELECT id, {REASON} AS reason, {REASON} = '' AS accepted FROM chk")
def review_rows(spark, d):
    return review.review(assessed(spark, d), GATE, *WINDOW).select("id", "reason", "accepted")


@query("qa1_review_gate_counts", f"WITH {ASSESSED}, r AS (SELECT source, {REASON} AS reason FROM chk) SELECT source, reason, count(*) AS n FROM r GROUP BY ALL")
def review_gate_counts(spark, d):
    return review.review(assessed(spark, d), GATE, *WINDOW).groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("qa2_compliance", f"WITH {CHECKED} SELECT id, array_to_string(reasons, '|') AS reasons, len(reasons) = 0 AS qualified FROM qual")
def compliance(spark, d):
    return checked(spark, d).select("id", F.concat_ws("|", "reasons").alias("reasons"), "qualified")


_C = ["source_not_whitelisted", "date_out_of_range", "not_detail_url", "source_url_domain_mismatch", "original_url_inaccessible",
      "body_missing", "summary_not_from_body", "summary_required_term_missing", "body_relevance_failed", "duplicate_canonical_url"]
_COUNTS = ", ".join(f"count(*) FILTER (list_contains(reasons, '{c}')) AS {c}" for c in _C)


@query("qa3_quality_audit", f"""WITH {DUPES}
SELECT count(*) AS total, count(*) FILTER (len(reasons) = 0) AS qualified, count(*) FILTER (language = 'fr') AS in_language,
 count(*) FILTER (region_tags[1] <> 'none') AS related, count(*) FILTER (url_ok) AS accessible, {_COUNTS},
 greatest(1500 - count(*) FILTER (len(reasons) = 0), 0) AS missing_to_target, round(count(*) FILTER (url_ok) / count(*), 6) AS url_rate,
 round((count(*) - count(*) FILTER (list_contains(reasons, 'source_not_whitelisted'))) / count(*), 6) AS source_coverage FROM dup""")
def quality_audit(spark, d):
    return audit.quality_audit(audit.with_duplicate_reason(checked(spark, d)), 1500, "fr")


@query("qa3_top_reasons", f"WITH {DUPES} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM dup) GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def quality_reasons(spark, d):
    return audit.top_reasons(audit.with_duplicate_reason(checked(spark, d)))


@query("qa4_mark_duplicates", f"""SELECT page_id, row_number() OVER (PARTITION BY {k.host('url')} ORDER BY page_id) > 1 AS is_duplicate FROM pages""")
def mark_duplicates(spark, d):
    pages = load_table(spark, d, "pages").select("page_id", urls.host("url").alias("host"))
    return audit.mark_duplicates(pages, "page_id", ["host"]).select("page_id", "is_duplicate")


@query("qa5_assert_rules", f"""WITH {CHECKED} SELECT 'total' AS metric, count(*) AS n FROM qual UNION ALL SELECT 'qualified', count(*) FILTER (len(reasons) = 0) FROM qual
 UNION ALL SELECT 'problems', CAST(sum(len(reasons)) AS BIGINT) FROM qual UNION ALL SELECT r, count(*) FROM (SELECT unnest(reasons) AS r FROM qual) GROUP BY 1""")
def assert_rules(spark, d):
    return audit.assert_report(checked(spark, d))


@query("qa5_problem_samples", f"WITH {CHECKED} SELECT id, reason FROM (SELECT id, unnest(reasons) AS reason FROM qual) ORDER BY id, reason LIMIT 20")
def problem_samples(spark, d):
    return audit.problem_samples(checked(spark, d))


@query("qa6_keyword_distribution", f"""WITH h AS (SELECT {k.words('lower(text)', bind.CORE)} AS hits FROM documents)
SELECT 'term' AS kind, t AS key, count(*) AS n FROM (SELECT unnest(hits) AS t FROM h) GROUP BY 2
UNION ALL SELECT 'hits_per_row', CAST(len(hits) AS VARCHAR), count(*) FROM h GROUP BY 2""")
def keyword_distribution(spark, d):
    return audit.keyword_distribution(load_table(spark, d, "documents"), bind.CORE, "text")


HEADS = "heads AS (SELECT news_id, max(version_id) AS current_version_id, min(source) AS source FROM ver GROUP BY 1)"


def heads_of(versions):
    return versions.groupBy("news_id").agg(F.max("version_id").alias("current_version_id"), F.min("source").alias("source"))


@query("qa7_deletion_preview", f"""WITH {ASSESSED}, {HEADS}, nv AS (SELECT news_id, count(*) AS n_versions FROM ver GROUP BY 1)
SELECT '仅匹配' || len(v.core) || '个核心关键词和' || len(v.ents) || '个实体名称，不满足最低要求' AS relevance_reason, count(*) AS heads, CAST(sum(nv.n_versions) AS BIGINT) AS versions
FROM heads h JOIN ver v ON h.current_version_id = v.version_id JOIN nv ON nv.news_id = h.news_id WHERE NOT v.relevant GROUP BY 1""")
def deletion_preview(spark, d):
    vers = assessed(spark, d).select("news_id", "version_id", "source", "relevant", "relevance_reason")
    return audit.deletion_preview(heads_of(vers), vers)


@query("qa8_date_report", f"""SELECT count(*) AS total, {k.stamp('min(o_orderdate)')} AS earliest, {k.stamp('max(o_orderdate)')} AS latest,
 count(*) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS before_min, count(*) FILTER (o_orderdate > TIMESTAMP '2000-06-30') AS after_max, 0 AS undated FROM orders""")
def date_report(spark, d):
    out = audit.date_report(load_table(spark, d, "orders"), "o_orderdate", "1995-01-01", "2000-06-30")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("total", fmt("earliest"), fmt("latest"), "before_min", "after_max", "undated")


def _fetches(spark, d):
    n = F.col("page_id")
    status = F.when(n % 7 == 0, 404).when(n % 7 == 1, 301).otherwise(200)
    return load_table(spark, d, "pages").filter(n % 4 != 3).select("url", status.alias("status_code"))


@query("qa9_accessibility", """WITH u AS (SELECT url, max(CASE WHEN page_id % 4 <> 3 THEN CASE WHEN page_id % 7 <> 0 THEN 1 ELSE 0 END END) AS ok FROM pages GROUP BY 1)
SELECT count(*) AS total, count(ok) AS checked, count(*) FILTER (ok = 1) AS accessible, count(*) FILTER (ok = 0) AS inaccessible,
 round(count(*) FILTER (ok = 1) / count(ok), 6) AS rate FROM pages JOIN u USING (url)""")
def accessibility(spark, d):
    vers = load_table(spark, d, "pages").select("page_id", "url", F.lit("accessible").alias("url_status"))
    return audit.accessibility_report(vers, _fetches(spark, d))


SAMPLED = """WITH h AS (SELECT page_id, url, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY md5('7:' || page_id), page_id) AS r FROM h) WHERE r <= 5)"""


def host_sample(spark, d):
    rows = load_table(spark, d, "pages").select("page_id", "url", F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)).alias("host"), F.lit("unknown").alias("url_status"))
    return audit.hash_sample(rows, "page_id", 5, ["host"])


@query("qa9_sample", f"""{SAMPLED} SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'unknown' WHEN page_id % 7 = 0 THEN 'inaccessible' ELSE 'accessible' END AS url_status,
 CASE WHEN page_id % 4 <> 3 AND page_id % 7 = 1 THEN url || '?moved' END AS final_url FROM s""")
def sample(spark, d):
    """Five pages of each host, checked: status and where a redirect led."""
    fetched = _fetches(spark, d).withColumn("final_url", F.when(F.col("status_code") == 301, F.concat("url", F.lit("?moved"))))
    return audit.update_url_status(host_sample(spark, d), fetched).select("page_id", "url_status", "final_url")


@query("qa9_sample_report", f"""{SAMPLED} SELECT host, count(*) AS total, count(*) FILTER (page_id % 4 <> 3) AS checked, count(*) FILTER (page_id % 4 <> 3 AND page_id % 7 <> 0) AS accessible FROM s GROUP BY 1""")
def sample_report(spark, d):
    return audit.accessibility_report(host_sample(spark, d), _fetches(spark, d), strata=["host"]).select("host", "total", "checked", "accessible")


@query("qa10_delete_set", f"""WITH t AS (SELECT id, id // 3 AS news_id, {k.clean('body')} AS b, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'not there zz' ELSE {k.clean('title')} END AS s FROM ({bind.ARTICLES})),
c AS (SELECT news_id FROM t WHERE id % 3 = 2 AND (b = '' OR s = '' OR NOT contains(lower(b), lower(s)))) SELECT news_id, id AS version_id FROM t WHERE news_id IN (SELECT news_id FROM c)""")
def delete_set(spark, d):
    """All versions of the articles whose current version has no summary from its body."""
    n = F.col("id")
    vers = bind.articles(spark, d).select(F.floor(n / 3).alias("news_id"), n.alias("version_id"), "url", "body", F.when(n % 4 == 0, "").when(n % 4 == 1, "not there zz").otherwise(F.col("title")).alias("summary"))
    none = vers.limit(0).select("url", F.lit("").alias("page_text"))
    return audit.invalid_summaries(audit.verify_summaries(vers.filter("version_id % 3 = 2"), none), vers)


@query("qa10_verify_summaries", f"""WITH t AS (SELECT id, {k.clean('body')} AS b, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'not there zz' ELSE {k.clean('title')} END AS s FROM ({bind.ARTICLES})),
u AS (SELECT id, s, CASE WHEN id % 8 = 3 THEN '' ELSE b END AS b FROM t)
SELECT id, CASE WHEN b = '' THEN 'body_missing' WHEN s = '' THEN 'summary_missing' WHEN contains(lower(b), lower(s)) THEN 'ok' ELSE 'summary_not_from_body' END AS verdict FROM u""")
def verify_summaries(spark, d):
    n = F.col("id")
    arts = bind.articles(spark, d).withColumn("url", F.concat(F.lit("u"), n))
    cur = arts.select("id", "url", F.when(n % 8 == 3, "").when(n % 8 == 7, "").otherwise(F.col("body")).alias("body"),
                      F.when(n % 4 == 0, "").when(n % 4 == 1, "not there zz").otherwise(F.col("title")).alias("summary"))
    fetched = arts.filter(n % 8 == 7).select("url", html.clean("body").alias("page_text"))
    return audit.verify_summaries(cur, fetched).select("id", "verdict")


@query("qa11_audit_graph", f"""WITH {bind.GRAPH}, ids AS (SELECT DISTINCT id FROM nodes), ends AS (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges),
cover AS (SELECT 'r' || r_regionkey AS s, (SELECT count(DISTINCT id) FROM nodes WHERE id = 'r' || r_regionkey OR parent_id = 'r' || r_regionkey OR region_id = 'r' || r_regionkey) AS t,
  (SELECT count(DISTINCT element_class) FROM nodes WHERE id = 'r' || r_regionkey OR parent_id = 'r' || r_regionkey OR region_id = 'r' || r_regionkey) AS c FROM region)
SELECT 'too_few_nodes' AS rule, CAST(count(*) AS VARCHAR) AS item FROM nodes HAVING count(*) < 1000
UNION ALL SELECT 'duplicate_id', id FROM nodes GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'blank_name', id FROM nodes WHERE trim(name) = ''
UNION ALL SELECT 'dangling_edge', source_id || '>' || target_id FROM edges WHERE source_id NOT IN (FROM ids) OR target_id NOT IN (FROM ids)
UNION ALL SELECT 'isolated_node', id FROM ids WHERE id <> 'r0' AND id NOT IN (FROM ends)
UNION ALL SELECT 'edge_without_evidence', source_id || '>' || target_id FROM edges WHERE n_refs = 0
UNION ALL SELECT 'thin_scope', s || ':' || t || ':' || c FROM cover WHERE t < 6 OR c < 4""")
def audit_graph(spark, d):
    nodes, edges = bind.graph(spark, d)
    scopes = load_table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("scope_id"))
    return audit.audit_graph(nodes, edges, scopes, 1000, 6, 4, "r0")


@query("qa12_contracts", """
SELECT 'order_unique' AS rule, CAST(o_orderkey AS VARCHAR) AS id FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'status_enum', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT 'order_customer', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)
UNION ALL SELECT 'name_required', CAST(c_custkey AS VARCHAR) FROM customer WHERE trim(coalesce(c_name, '')) = ''
UNION ALL SELECT 'lines_counted', CAST(o_orderkey AS VARCHAR) FROM orders o WHERE o_orderkey % 8 <> (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)""")
def contracts(spark, d):
    orders, customer = load_table(spark, d, "orders"), load_table(spark, d, "customer")
    lines = load_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    stored = orders.select("o_orderkey", (F.col("o_orderkey") % 8).alias("n"))
    return audit.check_contracts([
        audit.unique_key(orders, "o_orderkey", "order_unique"),
        audit.enum_member(orders, "o_orderkey", "o_orderstatus", ["O", "F"], "status_enum"),
        audit.foreign_key(orders, "o_orderkey", "o_custkey", customer.filter("c_custkey % 50 <> 0"), "c_custkey", "order_customer"),
        audit.required_fields(customer, "c_custkey", ["c_name"], "name_required"),
        audit.recount(stored, "o_orderkey", "n", lines, "lines_counted"),
    ])


RARE = ["thanedble", "eauxle", "sichge", "zzz", "osdad"]


@query("qa13_missing_terms", f"""SELECT source, t AS term FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest({k.term_list(RARE)}) AS t) x
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = s.source AND contains(d.text, x.t))""")
def missing_terms(spark, d):
    return audit.missing_terms(load_table(spark, d, "documents"), RARE, "source", "text")


@query("qa14_outage_guard", """SELECT count(*) AS scanned, count(*) FILTER (quality = 0 OR doc_id % 2 = 0) AS failing, count(*) FILTER (quality = 1 AND doc_id % 2 = 0) AS flipped,
 count(*) >= 20 AND count(*) FILTER (quality = 0 OR doc_id % 2 = 0) / count(*) >= 0.5 AND count(*) FILTER (quality = 1 AND doc_id % 2 = 0) / greatest(count(*) FILTER (quality = 0 OR doc_id % 2 = 0), 1) >= 0.8 AS abort FROM labels""")
def outage_guard(spark, d):
    down = F.col("doc_id") % 2 == 0
    rows = load_table(spark, d, "labels").select(
        ((F.col("quality") == 0) | down).alias("failed"), F.lit("accessible").alias("url_status"),
        terms.keep([("body_missing", F.col("quality") == 0), ("original_url_inaccessible", down)]).alias("reasons"))
    return audit.outage_guard(rows)


@query("qa15_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("documents", "pages", "events", "orders", "lineitem", "customer")))
def row_counts(spark, d):
    return audit.row_counts({t: load_table(spark, d, t) for t in ("documents", "pages", "events", "orders", "lineitem", "customer")})

"""Readers, writers, imports, snapshots and replay over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipworks.operators import derive, replay, review, versions
from clipworks.plans import sqlkit as k
from clipworks.plans.extract_queries import BODIES, DATED, LEAD, TITLE
from clipworks.plans.registry import query
from clipworks.plans.review_queries import ASSESSED, CHECKED, GATE, REASON, WINDOW, assessed
from clipworks.plans.version_queries import _empty
from clipworks.session import checkpoint_dir
from clipworks.sources import bind, files
from clipworks.sources.tables import load_table, load_tables


@query("io1_load_tables", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def load_all(spark, d):
    t = load_tables(spark, d, ["supplier", "nation", "region"])
    return t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(
        t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("io3_import_sources", k.with_articles("SELECT id, source_known AS source_active, NOT source_known AS is_stub FROM (SELECT id, CAST(substr(source, 4) AS INT) % 4 <> 3 AS source_known FROM articles)"))
def import_sources(spark, d):
    known = bind.sources(spark, d).filter("source_id % 4 <> 3").withColumn("active", F.lit(True))
    return files.resolve_sources(bind.articles(spark, d), known).select("id", "source_active", "is_stub")


@query("io3_stub_sources", "SELECT DISTINCT source AS name, FALSE AS active FROM documents WHERE CAST(substr(source, 4) AS INT) % 4 = 3")
def stub_sources(spark, d):
    return files.stub_sources(bind.articles(spark, d), bind.sources(spark, d).filter("source_id % 4 <> 3")).select("name", "active")


@query("io3_import_articles", """WITH b AS (SELECT source, 'u' || (doc_id % 200) AS u, sha256(text) AS h FROM documents)
SELECT (SELECT count(*) FROM b) AS accepted, (SELECT count(*) FROM (SELECT DISTINCT source, u, h FROM b)) AS inserted, (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT DISTINCT source, u, h FROM b)) AS duplicates""")
def import_articles(spark, d):
    n = F.col("doc_id")
    rows = load_table(spark, d, "documents").select(
        n.alias("seq"), "source", F.concat(F.lit("u"), n % 200).alias("canonical_url"), F.lit("").alias("slug"), F.sha2("text", 256).alias("content_hash"))
    heads, vers = _empty(rows.withColumn("source_id", F.lit(0).cast("bigint")))
    known = bind.sources(spark, d).filter("source_id % 4 <> 3")
    return files.import_articles(rows, known, heads, vers, "2024-01-01")[2]


@query("io4_import_logs", "SELECT event_id, c_custkey AS source_id FROM events JOIN customer ON c_name = 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') WHERE c_custkey % 2 = 0")
def import_logs(spark, d):
    logs = load_table(spark, d, "events").select("event_id", F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("source"))
    srcs = load_table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("source_id"))
    return files.import_logs(logs, srcs).select("event_id", "source_id")


@query("io5_io6_audit_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, regexp_replace(text || ' \"q\", end', '[\\r\\n]+', ' ', 'g') AS text FROM documents")
def audit_csv(spark, d):
    """Audit file written and read back."""
    folder = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    docs = load_table(spark, d, "documents").select("doc_id", "source", F.concat("text", F.lit(' "q", end')).alias("text"))
    files.write_audit_csv(docs, folder)
    return files.read_audit_csv(spark, folder, T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "source", "text")]))


@query("io7_json_dataset", "SELECT doc_id, text, len(string_split(text, ' ')) AS n_words FROM documents")
def json_dataset(spark, d):
    """Derived dataset published as JSON and read back."""
    folder = f"{checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    files.write_json_dataset(load_table(spark, d, "documents").select("doc_id", "text", F.split("text", " ").alias("words")), folder)
    back = spark.read.schema("doc_id BIGINT, text STRING, words ARRAY<STRING>").json(folder)
    return back.select("doc_id", "text", F.size("words").cast("bigint").alias("n_words"))


def event_snapshots(spark, d):
    return load_table(spark, d, "events").select(
        F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("dataset_type"), F.col("props").alias("payload"), F.col("ts").alias("created_at"))


@query("io8_append_snapshot", """SELECT event_type AS dataset_type, count(*) AS n, FALSE AS has_new FROM events GROUP BY 1 UNION ALL SELECT 'summary', 1, TRUE""")
def append_snapshot(spark, d):
    summary = load_table(spark, d, "documents").agg(F.count("*").alias("total"), F.countDistinct("source").alias("sources"))
    snaps = files.append_snapshot(event_snapshots(spark, d), "summary", summary, 9, "2024-06-01")
    return snaps.groupBy("dataset_type").agg(F.count("*").alias("n"), F.max(F.contains(F.col("payload"), F.lit('"sources":20'))).alias("has_new"))


@query("io9_latest_snapshot", "SELECT event_type AS dataset_type, arg_max(event_id, (ts, event_id)) AS snapshot_id, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY 1")
def latest_snapshot(spark, d):
    return files.latest_snapshot(event_snapshots(spark, d)).select("dataset_type", "snapshot_id", "payload")


def rejected(spark, d):
    why = F.when(F.col("id") % 3 == 0, "not_detail_url").otherwise("title_too_short")
    return assessed(spark, d).withColumns({"review_status": F.lit("rejected"), "reject_reason": why})


@query("rp1_replay", f"""WITH {ASSESSED} SELECT id, CASE WHEN {REASON} = '' THEN 'accepted' ELSE 'skipped' END AS outcome, CASE WHEN {REASON} = '' THEN 'accepted' ELSE 'rejected' END AS review_status,
 CASE WHEN {REASON} = '' THEN 'replayed_from_not_detail_url' ELSE 'not_detail_url' END AS reject_reason FROM chk WHERE id % 3 = 0""")
def replay_rows(spark, d):
    return replay.replay(rejected(spark, d), "not_detail_url", GATE, *WINDOW).select("id", "outcome", "review_status", "reject_reason")


@query("rp1_title_replay", f"""WITH {ASSESSED}, again AS (SELECT * REPLACE (title_only AND (id % 3 = 0 OR length(title) < 6) AS title_only) FROM chk), r AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'not_detail_url' ELSE 'title_too_short' END AS why, {REASON} AS reason FROM again)
SELECT id, CASE WHEN reason = '' THEN 'accepted' ELSE 'skipped' END AS outcome, CASE WHEN reason = '' THEN 'replayed_from_' ELSE '' END || why AS reject_reason FROM r""")
def title_replay(spark, d):
    """Two reasons at once; a cleaned title that is too short gives way to the raw one, which names the site before a bar."""
    n = F.col("id")
    rows = bind.versions(spark, d).withColumns({"cleaned_title": F.when(n % 3 == 0, F.col("title")).otherwise("ab"), "source_name": F.lit("site"),
                                                "raw_title": F.when(n % 3 == 0, F.col("title")).otherwise(F.when(F.length("title") > 2, F.concat(F.lit("ab | "), "title")).otherwise(F.col("title")))})
    rows = rows.withColumn("cleaned_title", F.when(F.length("title") < 6, F.col("title")).otherwise(F.col("cleaned_title")))
    rows = rows.withColumn("raw_title", F.when(F.length("title") < 6, F.col("title")).otherwise(F.col("raw_title")))
    judged = review.assess(replay.retitled(rows), bind.entities(spark), GATE, k.ENTITY_TERMS)
    judged = judged.withColumns({"review_status": F.lit("rejected"), "reject_reason": F.when(n % 3 == 0, "not_detail_url").otherwise("title_too_short")})
    return replay.replay(judged, ["not_detail_url", "title_too_short"], GATE, *WINDOW).select("id", "outcome", "reject_reason")


@query("rp1_replay_counts", f"""WITH {ASSESSED}, r AS (SELECT id, original_url, {REASON} AS reason FROM chk WHERE id % 3 = 0) SELECT count(*) AS scanned, count(*) FILTER (reason <> '') AS skipped, count(*) FILTER (reason = '') AS accepted,
 count(*) FILTER (reason = '') AS inserted, 0 AS duplicates FROM r""")
def replay_counts(spark, d):
    from clipworks.sources.bind import cleaned
    rows = replay.replay(rejected(spark, d), "not_detail_url", GATE, *WINDOW)
    heads, vers = _empty(cleaned(spark, d).select(F.col("id").alias("seq"), "source_id", F.col("original_url").alias("canonical_url"), F.lit("").alias("slug"), "content_hash"))
    return replay.replay_counts(rows, heads, vers, "2024-01-01")


def page_judge(spark, d):
    """Rebuilds page candidates from what was fetched and keeps those that comply (QA2)."""
    pages, sources = bind.page_fetches(spark, d), bind.page_sources(spark)

    def judge(rows):
        made = replay.rebuild(rows, pages.select("url", "html", "final_url"), sources, bind.REQUIRED)
        return review.compliance(review.assess(made, bind.entities(spark), GATE, k.ENTITY_TERMS)).filter("qualified").drop("qualified")

    return judge


# Page candidates rebuilt from their pages, and which of the rules of QA2 they fail.
REBUILT = f"""{BODIES}, known AS ({k.ENTITY_TABLE}), pc AS (SELECT page_id AS id, page_id % 7 AS sid, html, {TITLE} AS title, CASE WHEN page_id % 6 = 0 THEN '2024-05-01 10:00:00' ELSE {DATED} END AS dated,
   body, {LEAD} AS summary FROM bodies WHERE page_id % 11 <> 0 AND page_id % 13 <> 0 AND (page_id % 10 <> 2 OR page_id % 7 = 2) AND page_id % 17 <> 0 AND page_id % 19 <> 0),
pf AS (SELECT pc.*, lower(body) AS ev, coalesce(known.terms, []) AS own FROM pc LEFT JOIN known ON known.entity_id = CASE WHEN sid <> 5 THEN 'entity-' || sid END WHERE dated IS NOT NULL AND length(title) >= 6),
ph AS (SELECT *, len({k.words('ev', bind.CORE)}) AS n_core, len(list_concat({k.words('ev', k.ENTITY_TERMS)}, own)) AS n_ent FROM pf),
pq AS (SELECT *, sid < 5 AND dated::TIMESTAMP BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-12-20 00:01:00' AND {k.any_of('summary', bind.REQUIRED)} AND title <> summary AND contains(ev, lower(summary))
   AND (n_core >= 2 OR (n_core = 1 AND n_ent >= 1 AND NOT {k.any_of('body', bind.LOW)})) AS ok FROM ph)"""


@query("ag12_url_shaped_pool", """SELECT page_id % 7 AS source_id, CASE page_id % 4 WHEN 0 THEN 'not_detail_url' WHEN 1 THEN 'title_too_short' WHEN 2 THEN 'missing_published_at' ELSE 'other' END AS reject_reason, count(*) AS n
FROM pages WHERE page_id % 7 < 5 AND (page_id % 11 = 0 OR page_id % 13 <> 0) GROUP BY ALL ORDER BY n DESC, source_id, reject_reason LIMIT 15""")
def url_shaped_pool(spark, d):
    cands = bind.page_candidates(spark, d).withColumn("url", F.regexp_replace("url", "/list/[0-9]+/", "/list/x/"))
    return derive.candidate_pool(cands, 15, bind.page_sources(spark), "url")


@query("rp2_replay_strict", f"""WITH {REBUILT} SELECT id, title, dated AS published_at FROM pq WHERE ok AND id % 4 IN (0, 1, 2) AND id % 3 <> 0 AND sid <> 3
ORDER BY sid = 2 DESC, id LIMIT 40""")
def replay_strict(spark, d):
    cands = bind.page_candidates(spark, d)
    order = [F.desc(F.col("source_code") == "p2"), F.asc("id")]
    rows, _ = replay.replay_strict(cands, ["not_detail_url", "title_too_short", "missing_published_at"], order, page_judge(spark, d), 40, ["en"], without_codes=["p3"])
    return rows.select("id", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("rp2_inserted", f"""WITH {REBUILT}, 
s AS (SELECT page_id AS id FROM pages WHERE page_id % 4 <> 3 ORDER BY page_id % 7 = 2 DESC, page_id LIMIT 120) SELECT count(*) AS inserted, 0 AS duplicates FROM pq WHERE ok AND id IN (SELECT id FROM s)""")
def replay_inserted(spark, d):
    """Of the first 120 candidates, how many comply and become new articles."""
    order = [F.desc(F.col("source_code") == "p2"), F.asc("id")]
    rows, _ = replay.replay_strict(bind.page_candidates(spark, d), ["not_detail_url", "title_too_short", "missing_published_at"], order, page_judge(spark, d), 10**9, scan_limit=120)
    taken = rows.select(F.col("id").alias("seq"), "source_id", "canonical_url", F.lit("").alias("slug"), F.sha2(F.concat_ws("\n", "title", "summary", "canonical_url"), 256).alias("content_hash"))
    heads, vers = _empty(taken)
    return versions.upsert_versions(heads, vers, taken, "2024-01-01")[2].select("inserted", "duplicates")


@query("rp3_restore_from_audit", f"""WITH {REBUILT} SELECT id AS page_id, title, summary FROM pq WHERE ok AND id % 2 = 0""")
def restore_from_audit(spark, d):
    cands = bind.page_candidates(spark, d)
    audit = cands.select("source_id", F.col("url").alias("original_url"), "published_at", F.when(F.col("id") % 2 == 0, "will_delete").otherwise("keep").alias("action"))
    fetched = bind.page_fetches(spark, d)
    moved = fetched.where("final_url IS NULL").drop("final_url")

    def judge(rows):
        joined = rows.join(bind.page_sources(spark), "source_id").withColumn("original_url", F.col("canonical_url"))
        return review.compliance(review.assess(joined, bind.entities(spark), GATE, k.ENTITY_TERMS, "page_id"))

    heads = load_table(spark, d, "pages").limit(0).select(F.lit("").alias("news_id"))
    return replay.restore_from_audit(audit, moved, heads, bind.REQUIRED, judge).select("page_id", "title", "summary")


def article_judge(spark, d):
    """Reads the texts of the given articles only and keeps those that comply (QA2)."""
    def judge(rows):
        read = review.assess(bind.versions(spark, d, rows), bind.entities(spark), GATE, k.ENTITY_TERMS)
        return rows.join(review.compliance(read).filter("qualified").select("id"), "id", "left_semi")

    return judge


@query("rp4_backfill", f"""WITH {CHECKED} SELECT id FROM (SELECT id FROM qual WHERE id % 7 <> 0 AND len(reasons) = 0 ORDER BY published_at DESC, id LIMIT 25)""")
def backfill(spark, d):
    """Twenty-five more articles than qualify now."""
    arts, judge = bind.articles(spark, d).select("id", "published_at"), article_judge(spark, d)
    have = judge(arts.filter("id % 7 = 0")).count()
    return replay.backfill_to_target(have, arts.filter("id % 7 <> 0"), have + 25, [F.desc("published_at"), F.asc("id")], judge)[0].select("id")


@query("rp5_month_windows", f"""WITH b AS (SELECT o_custkey, date_trunc('month', min(o_orderdate))::TIMESTAMP AS s, max(o_orderdate) AS e FROM orders GROUP BY 1),
w AS (SELECT o_custkey, e, unnest(generate_series(s, e, INTERVAL 3 MONTH)) AS st FROM b) SELECT o_custkey, {k.stamp('st')} AS starts, {k.stamp('least(st + INTERVAL 3 MONTH, e)')} AS ends FROM w WHERE st < e""")
def month_windows(spark, d):
    spans = load_table(spark, d, "orders").groupBy("o_custkey").agg(
        F.date_trunc("month", F.min("o_orderdate")).cast("timestamp_ntz").alias("s"), F.max("o_orderdate").alias("e"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return replay.month_windows(spans, "s", "e", 3).select("o_custkey", fmt("starts"), fmt("ends"))

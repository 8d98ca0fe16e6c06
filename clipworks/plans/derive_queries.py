"""Derived datasets over the documents, events, orders and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.operators import audit, derive
from clipworks.operators import joins
from clipworks.plans import sqlkit as k
from clipworks.plans.join_queries import STAR, star
from clipworks.plans.registry import query
from clipworks.plans.review_queries import CHECKED, checked
from clipworks.sources import bind
from clipworks.sources.tables import load_table


@query("ag1_summary", k.with_current("""SELECT count(*) AS total_articles, count(DISTINCT source) AS total_sources, count(*) FILTER (is_related) AS related_articles,
 (SELECT count(DISTINCT e) FROM (SELECT unnest(entity_ids) AS e FROM cur)) AS total_entities, 0 AS total_edges FROM cur"""))
def summary(spark, d):
    return derive.summary(bind.current(spark, d))


CLOUD = f"""{k.CURRENT}, w AS (SELECT unnest(keywords) AS term, category, id, CASE WHEN is_related THEN 2 ELSE 1 END AS w FROM cur),
a AS (SELECT category, term, w, id FROM w UNION ALL SELECT 'all', term, w, id FROM w),
g AS (SELECT category, term, CAST(sum(w) AS BIGINT) AS weight, count(DISTINCT id) AS article_count FROM a GROUP BY 1, 2),
cloud AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY weight DESC, term) AS rank FROM g) WHERE rank <= 20)"""


@query("ag2_word_cloud", f"WITH {CLOUD} SELECT * FROM cloud")
def word_cloud(spark, d):
    return derive.word_cloud(bind.current(spark, d))


@query("ag3_chip_levels", f"""WITH {CLOUD}, p AS (SELECT category, term, row_number() OVER (PARTITION BY category ORDER BY weight DESC, article_count DESC, term) AS place FROM cloud)
SELECT category, term, CASE WHEN place = 1 THEN 'featured' WHEN place <= 3 THEN 'strong' WHEN place <= 7 THEN 'medium' ELSE 'normal' END AS level FROM p WHERE place <= 9""")
def chip_levels(spark, d):
    return derive.chip_levels(derive.word_cloud(bind.current(spark, d)), 9).select("category", "term", "level")


def orders_by_nation(spark, d):
    """Orders as articles of regions: the customer's nation."""
    cust = load_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region_id"))
    n = F.col("o_orderkey") % 3
    cat = F.when(n == 0, "enterprise").when(n == 1, "technology").otherwise("policy")
    return load_table(spark, d, "orders").join(cust, "o_custkey").select("region_id", F.col("o_orderkey").alias("id"), cat.alias("category"), F.col("o_orderdate").alias("published_at"))


NATION_ORDERS = """ob AS (SELECT c_nationkey AS region_id, o_orderkey AS id, o_orderdate AS published_at FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("ag4_region_metrics", f"""WITH {NATION_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY published_at DESC, id) AS r FROM ob)
SELECT region_id, count(*) AS article_count, count(*) FILTER (id % 3 = 0) AS enterprise_count, count(*) FILTER (id % 3 = 1) AS technology_count,
 count(*) FILTER (id % 3 = 2) AS policy_count, string_agg(CAST(id AS VARCHAR), '|' ORDER BY r) FILTER (r <= 5) AS latest_ids FROM r GROUP BY 1""")
def region_metrics(spark, d):
    out = derive.region_metrics(orders_by_nation(spark, d))
    return out.withColumn("latest_ids", F.array_join(F.col("latest_ids").cast("array<string>"), "|"))


@query("ag4_region_article_ids", f"""WITH {NATION_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY published_at DESC, id) - 1 AS r FROM ob)
SELECT region_id, r // 100 AS page, r // 100 * 100 AS first, string_agg(CAST(id AS VARCHAR), '|' ORDER BY r) AS ids FROM r GROUP BY ALL""")
def region_article_ids(spark, d):
    out = derive.region_lists(orders_by_nation(spark, d), [F.desc("published_at"), F.asc("id")], 100)
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), "|"))


@query("ag4_region_entity_ids", """WITH g AS (SELECT 's' || s_suppkey AS e, CASE WHEN s_suppkey % 3 = 0 THEN 'subject' ELSE 'content' END AS c, s_nationkey AS r FROM supplier),
m AS (SELECT r, e FROM g UNION SELECT o_custkey % 25, 's' || (o_orderkey % 150) FROM orders WHERE 's' || (o_orderkey % 150) IN (SELECT e FROM g)),
n AS (SELECT r, e, row_number() OVER (PARTITION BY r ORDER BY e) - 1 AS i FROM m) SELECT r AS region_id, i // 20 AS page, i // 20 * 20 AS first, string_agg(e, '|' ORDER BY i) AS ids FROM n GROUP BY ALL""")
def region_entity_ids(spark, d):
    out = derive.region_lists(derive.region_members(*entity_parts(spark, d)), [F.asc("entity_id")], 20, "entity_id")
    return out.withColumn("ids", F.array_join("ids", "|"))


@query("ag4_region_entities", """WITH g AS (SELECT 's' || s_suppkey AS e, CASE WHEN s_suppkey % 3 = 0 THEN 'subject' ELSE 'content' END AS c, s_nationkey AS r FROM supplier),
m AS (SELECT r, e FROM g UNION SELECT o_custkey % 25, 's' || (o_orderkey % 150) FROM orders WHERE 's' || (o_orderkey % 150) IN (SELECT e FROM g))
SELECT m.r AS region_id, count(*) AS entity_count, count(*) FILTER (c = 'subject') AS subject_count FROM m JOIN g USING (e) GROUP BY 1""")
def region_entities(spark, d):
    return derive.region_entities(*entity_parts(spark, d))


def entity_parts(spark, d):
    s = F.col("s_suppkey")
    ents = load_table(spark, d, "supplier").select(F.concat(F.lit("s"), s).alias("entity_id"), F.when(s % 3 == 0, "subject").otherwise("content").alias("element_class"), F.array(F.col("s_nationkey").cast("bigint")).alias("region_ids"))
    linked = load_table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("region_id"), F.concat(F.lit("s"), F.col("o_orderkey") % 150).alias("entity_id"))
    return linked, ents


@query("ag5_region_keywords", k.with_current("""SELECT region_id, term, weight, rank FROM (
 SELECT region_id, term, weight, row_number() OVER (PARTITION BY region_id ORDER BY weight DESC, term) AS rank FROM (
  SELECT region_id, term, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT unnest(region_tags) AS region_id, keywords, CASE WHEN is_related THEN 2 ELSE 1 END AS w FROM cur) x, unnest(keywords) AS t(term)
  WHERE NOT (region_id = 'heat' AND lower(term) = 'ther') AND term <> 'onre' GROUP BY 1, 2)) WHERE rank <= 8"""))
def region_keywords(spark, d):
    rows = bind.current(spark, d).select(F.explode("region_tags").alias("region_id"), "keywords", "is_related")
    blocked = spark.createDataFrame([("heat", "ther")], "region_id STRING, term STRING")
    return derive.region_keywords(rows, blocked, ["onre"])


NATION_COUNTS = f"{NATION_ORDERS}, nc AS (SELECT n_nationkey AS region_id, (SELECT count(*) FROM ob WHERE ob.region_id = n_nationkey AND n_nationkey % 6 <> 0) AS v FROM nation)"
LEGEND = f"""{NATION_COUNTS}, m AS (SELECT max(v) AS m FROM nc), f AS (SELECT m, greatest(1, CAST(ceil(m * 0.34) AS BIGINT)) AS a FROM m), s AS (SELECT m, a, greatest(a + 1, CAST(ceil(m * 0.67) AS BIGINT)) AS b FROM f),
bins AS (SELECT 0 AS bin, 0 AS lo, 0 AS hi UNION ALL SELECT 1, 1, a FROM s UNION ALL SELECT 2, a + 1, least(b, m) FROM s UNION ALL SELECT 3, least(b + 1, m), m FROM s)"""


def nation_counts(spark, d):
    counts = orders_by_nation(spark, d).groupBy("region_id").agg(F.count("*").alias("n"))
    nation = load_table(spark, d, "nation").select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("name"))
    value = F.when(F.col("region_id") % 6 == 0, 0).otherwise(F.coalesce("n", F.lit(0)))
    return nation.join(counts, "region_id", "left").select("region_id", "name", value.alias("v"))


@query("ag6_legend_bins", f"WITH {LEGEND} SELECT bin, lo, hi FROM bins")
def legend_bins(spark, d):
    return derive.legend_bins(nation_counts(spark, d), "v")


@query("ag6_assign_bin", f"WITH {LEGEND} SELECT region_id, min(bin) AS bin FROM nc JOIN bins ON v BETWEEN lo AND hi GROUP BY 1")
def assign_bin(spark, d):
    counts = nation_counts(spark, d)
    return derive.assign_bin(counts, derive.legend_bins(counts, "v"), "v").select("region_id", "bin")


@query("ag7_region_opacity", f"""WITH {NATION_COUNTS} SELECT region_id, round(CASE WHEN v <= 0 THEN CASE WHEN region_id % 4 = 0 THEN 0.44 ELSE 0.24 END
 ELSE greatest(0.24, least(0.82, 0.24 + least(1.0, v / (SELECT max(v) FROM nc)) * 0.42 + CASE WHEN region_id % 4 = 0 THEN 0.16 ELSE 0 END)) END, 6) AS opacity FROM nc""")
def region_opacity(spark, d):
    counts = nation_counts(spark, d).withColumn("on", F.col("region_id") % 4 == 0)
    return derive.region_opacity(counts, "v", emphasized="on").select("region_id", "opacity")


@query("ag8_boundary_centers", """SELECT s_nationkey, round((least(min(s_suppkey), min(s_acctbal)) + greatest(max(s_suppkey), max(s_acctbal))) / 2, 6) AS lng,
 round((least(min(s_acctbal), 1.5) + greatest(max(s_acctbal), 1.5)) / 2, 6) AS lat FROM supplier GROUP BY 1""")
def boundary_centers(spark, d):
    line = F.concat_ws("", F.col("s_suppkey").cast("string"), F.lit(","), F.col("s_acctbal").cast("string"), F.lit("; "), F.col("s_acctbal").cast("string"), F.lit(",1.5;bad;x,1"))
    return derive.boundary_centers(load_table(spark, d, "supplier").select("s_nationkey", line.alias("b")), "s_nationkey", "b")


def run_sources(spark, d):
    """Events as per-source run rows: one run a day."""
    n = F.col("event_id")
    return load_table(spark, d, "events").select(
        F.dayofmonth("ts").alias("run_id"), F.col("user_id").alias("source_id"), (n % 7).alias("candidates"),
        F.when(F.dayofmonth("ts") % 5 == 0, 0).otherwise(n % 3).alias("accepted"), (n % 4).alias("rejected"), (n % 2).alias("published"), (n % 3 - n % 2).alias("duplicates"),
        F.when((F.col("event_type") == "error") | (F.dayofmonth("ts") == 10), "failed").otherwise("fetched").alias("status"),
        F.when(F.col("event_type") == "view", "partial").otherwise("best_effort").alias("coverage"), F.col("ts").alias("started_at"))


RUNS = """runs AS (SELECT day(ts) AS run_id, user_id AS source_id, event_id % 7 AS candidates, CASE WHEN day(ts) % 5 = 0 THEN 0 ELSE event_id % 3 END AS accepted, event_id % 4 AS rejected,
 event_id % 2 AS published, event_id % 3 - event_id % 2 AS duplicates, event_type = 'error' OR day(ts) = 10 AS failed, event_type = 'view' AS partial, ts FROM events)"""


@query("ag9_run_summary", f"""WITH {RUNS}, t AS (SELECT run_id, count(*) AS sources, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(rejected) AS BIGINT) AS rejected,
 CAST(sum(published) AS BIGINT) AS inserted, CAST(sum(duplicates) AS BIGINT) AS duplicates, count(*) FILTER (failed) AS failed, count(*) FILTER (partial) AS partial FROM runs GROUP BY 1)
SELECT *, CASE WHEN accepted > 0 THEN CASE WHEN failed > 0 THEN 'partial_succeeded' ELSE 'succeeded' END WHEN failed = sources THEN 'failed' ELSE 'succeeded' END AS status,
 CASE WHEN failed > 0 OR partial > 0 THEN 'partial' ELSE 'best_effort' END AS coverage FROM t""")
def run_summary(spark, d):
    return derive.run_summary(run_sources(spark, d))


@query("ag10_source_stats", f"""WITH e AS (SELECT day(ts) AS run_id, user_id AS source_id, event_type IN ('view', 'click') AS accepted, event_type AS reason, ts FROM events),
n AS (SELECT run_id, source_id, reason, count(*) AS n FROM e WHERE NOT accepted GROUP BY ALL), l AS (SELECT run_id, source_id, string_agg(reason || '=' || n, '|' ORDER BY reason || '=' || n) AS reasons FROM n GROUP BY ALL)
SELECT e.run_id, e.source_id, count(*) AS candidates, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, {k.stamp('min(ts)')} AS earliest, {k.stamp('max(ts)')} AS latest, coalesce(any_value(l.reasons), '') AS reasons
FROM e LEFT JOIN l ON e.run_id = l.run_id AND e.source_id = l.source_id GROUP BY 1, 2""")
def source_stats(spark, d):
    ev = load_table(spark, d, "events").select(F.dayofmonth("ts").alias("run_id"), F.col("user_id").alias("source_id"), F.col("event_type").isin("view", "click").alias("accepted"),
                                               F.col("event_type").alias("reason"), F.col("ts").alias("published_at"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    out = derive.source_stats(ev)
    return out.withColumns({"earliest": fmt("earliest"), "latest": fmt("latest"), "reasons": F.array_join("reasons", "|")})


@query("ag11_finalize_logs", """WITH u AS (SELECT DISTINCT user_id AS source FROM events), p AS (SELECT user_id AS source, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT user_id AS source, count(*) AS n FROM events WHERE event_type = 'view' AND user_id % 3 = 0 GROUP BY 1)
SELECT u.source, CASE WHEN u.source % 4 = 0 THEN 'fetched' WHEN coalesce(s.n, 0) > 0 THEN 'seeded' WHEN u.source % 4 = 1 THEN 'failed' ELSE 'skipped' END AS status,
 CASE WHEN u.source % 4 < 2 THEN 20 ELSE 0 END AS fetched_count, coalesce(p.n, 0) AS published_count,
 CASE WHEN u.source % 4 = 0 THEN greatest(30 - coalesce(p.n, 0), 0) WHEN coalesce(s.n, 0) > 0 THEN greatest(s.n - coalesce(p.n, 0), 0) ELSE 0 END AS duplicate_count
FROM u LEFT JOIN p USING (source) LEFT JOIN s USING (source)""")
def finalize_logs(spark, d):
    ev = load_table(spark, d, "events").withColumn("source", F.col("user_id"))
    srcs = ev.select("source").distinct()
    results = srcs.filter("source % 4 < 2").select("source", F.when(F.col("source") % 4 == 0, 30).otherwise(0).alias("n_articles"), F.lit(20).alias("fetched_count"), F.lit("failed").alias("status"))
    return derive.finalize_logs(srcs, results, ev.filter("event_type = 'purchase'"), ev.filter("event_type = 'view' AND user_id % 3 = 0"))


def pool(spark, d):
    return load_table(spark, d, "events").select(
        F.col("event_id").alias("candidate_id"), F.col("user_id").alias("source_id"), F.col("event_type").alias("reject_reason"), F.col("props").alias("title"),
        F.when(F.col("event_type") == "signup", "accepted").otherwise("rejected").alias("review_status"), F.when(F.col("user_id") % 2 == 0, "zh").otherwise("en").alias("language"))


@query("ag12_candidate_pool", "SELECT user_id AS source_id, event_type AS reject_reason, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 50")
def candidate_pool(spark, d):
    return derive.candidate_pool(pool(spark, d))


@query("ag12_candidate_samples", "SELECT event_id AS candidate_id FROM events WHERE event_type <> 'signup' ORDER BY user_id % 2, CASE WHEN contains(props, '7') THEN 0 ELSE 1 END, event_id DESC LIMIT 50")
def candidate_samples(spark, d):
    return derive.candidate_samples(pool(spark, d), ["7"]).select("candidate_id")


@query("ag13_rows_by_source", k.with_articles(f"SELECT source, count(*) AS n, {k.stamp('min(published_at)')} AS earliest, {k.stamp('max(published_at)')} AS latest FROM articles GROUP BY 1"))
def rows_by_source(spark, d):
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return derive.rows_by_source(bind.articles(spark, d)).withColumns({"earliest": fmt("earliest"), "latest": fmt("latest")})


@query("ag14_top_reasons", f"WITH {CHECKED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM qual) GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def top_reasons(spark, d):
    return audit.top_reasons(checked(spark, d), 5)


@query("ag15_origin_counts", """SELECT (SELECT count(*) FROM supplier WHERE s_nationkey % 5 = 2) AS domestic_entities, (SELECT count(*) FROM supplier WHERE s_nationkey % 5 <> 2) AS foreign_entities,
 (SELECT count(*) FROM customer WHERE c_nationkey % 5 = 2) AS domestic_sources, (SELECT count(*) FROM customer WHERE c_nationkey % 5 <> 2) AS foreign_sources""")
def origin_counts(spark, d):
    ents = load_table(spark, d, "supplier").select(F.col("s_nationkey").alias("home"))
    srcs = load_table(spark, d, "customer").select(F.col("c_nationkey").alias("home"))
    return derive.origin_counts(ents, srcs, F.col("home") % 5 == 2)


@query("ag16_qualified_count", f"WITH {CHECKED} SELECT count(*) FILTER (len(reasons) = 0) AS qualified FROM qual")
def qualified_count(spark, d):
    return derive.qualified_count(checked(spark, d))

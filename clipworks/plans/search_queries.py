"""Article lists, pages, lookups and rankings over documents, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.functions import groups, terms
from clipworks.operators import derive, related, search
from clipworks.plans import sqlkit as k
from clipworks.plans.derive_queries import CLOUD, NATION_COUNTS, RUNS, nation_counts, run_sources
from clipworks.plans.registry import query
from clipworks.sources import bind
from clipworks.sources.tables import load_table

HAY = "lower(array_to_string([title, summary, source, array_to_string(keywords, ' '), array_to_string(region_tags, ' ')], ' '))"


SHOWN = f"""{k.CURRENT}, src AS ({bind.SOURCES}), shown AS (SELECT cur.*, 'story-' || id AS slug, s.active AS a, s.whitelist_entity_id AS w, coalesce(l.toxic, 0) = 0 AS ok,
  published_at BETWEEN TIMESTAMP '{bind.SINCE}' AND TIMESTAMP '{bind.NOW}' AS dated, {k.any_of("lower(summary)", bind.REQUIRED)} AS named FROM cur JOIN src s ON cur.source = s.source_code LEFT JOIN labels l ON l.doc_id = cur.id),
vis AS (SELECT * FROM shown WHERE a AND w <> '' AND ok AND dated AND named)"""


@query("ql1_search_articles", f"WITH {SHOWN} SELECT id, title FROM vis WHERE category = 'technology' AND is_related AND list_contains(region_tags, 'onon') AND contains({HAY}, 'the') ORDER BY published_at DESC, id DESC LIMIT 50")
def search_articles(spark, d):
    return search.search_articles(bind.shown(spark, d), limit=50, query=" THE ", category="technology", region=" Town ", related_only=True, region_codes={"town": "onon"}).select("id", "title")


@query("ql1_gates", f"""WITH {SHOWN} SELECT count(*) AS n, count(*) FILTER (a AND w <> '' AND ok AND dated AND named) AS kept, count(*) FILTER (NOT a) AS inactive, count(*) FILTER (a AND w = '') AS unbound,
 count(*) FILTER (NOT ok) AS inaccessible, count(*) FILTER (NOT dated) AS out_of_dates, count(*) FILTER (NOT named) AS unnamed FROM shown""")
def gates(spark, d):
    """How many rows each gate of lists and lookups closes on."""
    every, kept = bind.flagged(spark, d), bind.shown(spark, d)
    dated = F.col("published_at").between(F.lit(bind.SINCE).cast("timestamp_ntz"), F.lit(bind.NOW).cast("timestamp_ntz"))
    named = terms.any_term(F.lower("summary"), bind.REQUIRED)
    counts = every.agg(F.count("*").alias("n"), F.count_if(~F.col("active")).alias("inactive"), F.count_if(F.col("active") & (F.col("whitelist_entity_id") == "")).alias("unbound"),
                       F.count_if(F.col("url_status") != "accessible").alias("inaccessible"), F.count_if(~dated).alias("out_of_dates"), F.count_if(~named).alias("unnamed"))
    return groups.one_row(counts, kept.agg(F.count("*").alias("kept")))


@query("ql2_page_articles", f"""WITH {SHOWN}, hits AS (SELECT * FROM vis WHERE category = 'technology') SELECT id, 2 AS page, 10 AS page_size, (SELECT count(*) FROM hits) AS total_elements,
 (SELECT (count(*) + 9) // 10 FROM hits) AS total_pages, TRUE AS has_previous, (SELECT count(*) FROM hits) > 20 AS has_next FROM hits ORDER BY published_at DESC, id DESC LIMIT 10 OFFSET 10""")
def page_articles(spark, d):
    index = search.page_index(bind.shown(spark, d).select("id", "published_at", "category"), category="technology")
    return search.page_articles(index, page=2, size=10).drop("published_at", "category")


ORDERS = "(SELECT o_orderkey AS id, o_orderdate AS published_at FROM orders WHERE o_orderstatus = 'F')"


def orders(spark, d):
    return load_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"), F.col("o_orderstatus").alias("category"))


@query("ql2_deep_page", f"""WITH t AS (SELECT *, (SELECT count(*) FROM {ORDERS}) AS n FROM {ORDERS}), p AS (SELECT *, (n + 59) // 60 AS pages FROM t)
SELECT id, pages AS page, 60 AS page_size, n AS total_elements, pages AS total_pages, TRUE AS has_previous, FALSE AS has_next FROM (SELECT *, row_number() OVER (ORDER BY published_at DESC, id DESC) AS r FROM p) WHERE r > (pages - 1) * 60""")
def deep_page(spark, d):
    """The last page: one or two partitions of the index are read for it."""
    index = search.page_index(orders(spark, d), category="F")
    return search.page_articles(index, page=10**9, size=60).drop("published_at", "category")


@query("ql2_next_articles", f"WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY published_at, id) - 1 AS r, count(*) OVER () AS n FROM {ORDERS}) WHERE r = n // 2) SELECT id FROM {ORDERS} WHERE (published_at, id) > (SELECT (published_at, id) FROM c) ORDER BY published_at, id LIMIT 40")
def next_articles(spark, d):
    """What follows the article in the middle."""
    rows = orders(spark, d)
    index = search.page_index(rows, oldest=True, category="F")
    last = index.rows(index.total // 2, 1).first()
    return search.next_articles(rows, (last.published_at, last.id), 40, oldest=True, category="F").select("id")


@query("ql3_page_numbers", """WITH t AS (SELECT o_custkey, count(*) AS total_pages, o_custkey % 7 + 1 AS p0 FROM orders GROUP BY 1), c AS (SELECT o_custkey, total_pages, least(p0, total_pages) AS page FROM t),
b AS (SELECT DISTINCT o_custkey, n AS number FROM (SELECT o_custkey, total_pages, unnest([1, total_pages, page - 2, page - 1, page, page + 1, page + 2]) AS n FROM c) WHERE n BETWEEN 1 AND total_pages)
SELECT o_custkey, number, coalesce(number - lag(number) OVER (PARTITION BY o_custkey ORDER BY number) > 1, FALSE) AS gap_before FROM b""")
def page_numbers(spark, d):
    totals = load_table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total_pages"))
    totals = totals.withColumn("page", F.least(F.col("o_custkey") % 7 + 1, F.col("total_pages")))
    return search.page_numbers(totals).select("o_custkey", "number", "gap_before")


@query("ql4_find_article", f"""WITH {SHOWN}, asked AS (SELECT max(id) || '-story-old' AS v FROM vis UNION ALL SELECT 'story-' || min(id) FROM vis UNION ALL SELECT min(id)::VARCHAR FROM shown WHERE NOT a)
SELECT v AS asked, id, source FROM vis JOIN asked ON id::VARCHAR = v OR slug = v OR id || '-' || slug = v OR starts_with(v, id || '-')""")
def find_article(spark, d):
    """By id prefix, by slug, and an id whose gate is closed, which finds nothing."""
    rows = bind.shown(spark, d)
    ends = groups.one_row(rows.agg(F.max("id").alias("high"), F.min("id").alias("low")), bind.flagged(spark, d).where("NOT active").agg(F.min("id").alias("hidden"))).first()
    found = [search.find_article(rows, v).select(F.lit(v).alias("asked"), "id", "source") for v in (f"{ends.high}-story-old", f"story-{ends.low}", str(ends.hidden))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("ql5_latest_per_category", k.with_current("""SELECT category, id, rank FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, id DESC) AS rank FROM cur) WHERE rank <= 4
UNION ALL SELECT 'featured', id, 0 FROM (SELECT id FROM cur ORDER BY published_at DESC, id DESC LIMIT 3)"""))
def latest_per_category(spark, d):
    n = F.col("id") % 3
    arts = bind.articles(spark, d).withColumn("category", F.when(n == 0, "enterprise").when(n == 1, "technology").otherwise("policy"))
    best = search.featured(arts.select("id", "published_at")).select(F.lit("featured").alias("category"), "id", F.lit(0).alias("rank"))
    return search.latest_per_category(arts.select("id", "category", "published_at")).select("category", "id", "rank").unionByName(best)


@query("ql6_latest_per_source", "SELECT o_custkey AS source, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1")
def latest_per_source(spark, d):
    orders = load_table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"))
    return search.latest_per_source(orders).select("source", "id")


@query("ql7_related_articles", k.with_current("""SELECT c.id, round(len(list_intersect(c.keywords, t.keywords)) * 2.4 + len(list_intersect(c.entity_ids, t.entity_ids)) * 3.0 + CASE WHEN c.category = t.category THEN 1.5 ELSE 0 END
 + CASE WHEN c.is_related AND t.is_related THEN 1.2 ELSE 0 END + CASE WHEN c.language = t.language THEN 0.5 ELSE 0 END + greatest(0, 2 - abs(date_diff('day', c.published_at, t.published_at)) / 45), 6) AS score
FROM cur c, (SELECT * FROM cur WHERE id = 30) t WHERE c.id <> 30 ORDER BY score DESC, c.published_at DESC, c.id LIMIT 3"""))
def related_articles(spark, d):
    return search.related_articles(bind.current(spark, d), 30).select("id", "score")


@query("ql7_related_to_all", k.with_current("""SELECT id, related_id, score, rank FROM (SELECT a.id, b.id AS related_id, p / 3888000000000 AS score, row_number() OVER (PARTITION BY a.id ORDER BY p DESC, b.published_at DESC, b.id) AS rank
 FROM cur a JOIN cur b ON a.id <> b.id, LATERAL (SELECT (len(list_intersect(a.keywords, b.keywords)) * 24 + len(list_intersect(a.entity_ids, b.entity_ids)) * 30 + CASE WHEN a.category = b.category THEN 15 ELSE 0 END
  + CASE WHEN a.is_related AND b.is_related THEN 12 ELSE 0 END + CASE WHEN a.language = b.language THEN 5 ELSE 0 END) * 388800000000 + greatest(0, 7776000000000 - abs(date_diff('microsecond', a.published_at, b.published_at))) AS p) WHERE p > 0) WHERE rank <= 3"""))
def related_to_all(spark, d):
    return related.related_articles(bind.current(spark, d))


@query("ql8_rank_regions", f"WITH {NATION_COUNTS} SELECT region_id FROM nc JOIN nation ON n_nationkey = region_id ORDER BY region_id % 9 = 0 DESC, v DESC, n_name LIMIT 5")
def rank_regions(spark, d):
    metrics = nation_counts(spark, d).withColumns({"is_priority": F.col("region_id") % 9 == 0, "article_count": F.col("v")})
    return search.rank_regions(metrics, "v", 5).select("region_id")


@query("ql9_order_sources", k.with_model("""SELECT source_code, CASE source_code WHEN 'src7' THEN 1 WHEN 'src3' THEN 2 ELSE 1002 END AS priority, CASE WHEN contains(source_code, '11') THEN 0 ELSE 1 END AS regional,
 CASE WHEN language = 'fr' THEN 0 ELSE 1 END AS home FROM sources"""))
def order_sources(spark, d):
    return search.order_sources(bind.sources(spark, d), ["src7", "src3"], ["11"], "fr").select("source_code", "priority", "regional", "home")


@query("ql10_list_sources", k.with_model("SELECT source_id, name FROM sources WHERE active AND whitelist_entity_id <> '' AND language = 'en' AND type IN ('government', 'university') ORDER BY source_id"))
def list_sources(spark, d):
    return search.list_sources(bind.sources(spark, d), language="en", types=["government", "university"]).select("source_id", "name")


@query("ql11_suggest_terms", f"WITH {CLOUD} SELECT term, max(weight) AS weight FROM cloud WHERE category = 'all' AND lower(term) <> 'erin' GROUP BY 1 ORDER BY weight DESC, term LIMIT 8")
def suggest_terms(spark, d):
    cloud = search.cloud_for(derive.word_cloud(bind.current(spark, d)))
    return search.suggest_terms(cloud, " Erin ")


@query("ql12_latest_run_logs", f"""WITH {RUNS}, last AS (SELECT max(day(ts)) AS r FROM events) SELECT source_id, candidates, coalesce(c_name, '') AS name FROM runs LEFT JOIN customer ON source_id = c_custkey WHERE run_id = (SELECT r FROM last)""")
def latest_run_logs(spark, d):
    logs = run_sources(spark, d)
    runs = logs.groupBy("run_id").agg(F.max("started_at").alias("started_at"))
    srcs = load_table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"))
    return search.latest_run_logs(runs, logs, srcs).select("source_id", "candidates", F.coalesce("name", F.lit("")).alias("name"))


@query("ql13_cloud_for", f"WITH {CLOUD} SELECT term, weight, rank FROM cloud WHERE category = 'policy'")
def cloud_for(spark, d):
    return search.cloud_for(derive.word_cloud(bind.current(spark, d)), "policy").select("term", "weight", "rank")

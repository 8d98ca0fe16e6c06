"""Joins and merges over the star tables, documents and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.operators import joins, tagging
from clipworks.plans import sqlkit as k
from clipworks.plans.registry import query
from clipworks.sources import bind
from clipworks.sources.tables import load_table


def star(spark, d):
    """orders, lineitem and customer as heads, versions and sources."""
    key = F.col("o_orderkey")
    heads = load_table(spark, d, "orders").select(key.alias("news_id"), F.col("o_custkey").alias("source_id"), (key * 10 + key % 7 + 1).alias("current_version_id"))
    vers = load_table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version_id"), F.col("l_orderkey").alias("news_id"),
        F.col("l_shipdate").alias("published_at"), "l_quantity", "l_partkey")
    srcs = load_table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"))
    return heads, vers, srcs


STAR = """heads AS (SELECT o_orderkey AS news_id, o_custkey AS source_id, o_orderkey * 10 + o_orderkey % 7 + 1 AS current_version_id FROM orders),
vers AS (SELECT l_orderkey * 10 + l_linenumber AS version_id, l_orderkey AS news_id, l_shipdate AS published_at, l_quantity, l_partkey FROM lineitem),
srcs AS (SELECT c_custkey AS source_id, c_name AS name FROM customer)"""


@query("jn1_current_articles", f"WITH {STAR} SELECT h.news_id, v.version_id, s.name, v.l_quantity FROM heads h JOIN vers v ON h.current_version_id = v.version_id JOIN srcs s USING (source_id)")
def current_articles(spark, d):
    return joins.current_articles(*star(spark, d)).select("news_id", "version_id", "name", "l_quantity")


@query("jn2_versions_of", f"""WITH {STAR} SELECT v.news_id, v.version_id, s.name, {k.stamp('v.published_at')} AS published_at FROM vers v JOIN heads h USING (news_id) JOIN srcs s USING (source_id)""")
def versions_of(spark, d):
    rows = joins.versions_of(*star(spark, d))
    return rows.select("news_id", "version_id", "name", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("jn3_enrich_logs", "SELECT event_id, coalesce(c_name, 'unknown') AS c_name FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON user_id = c_custkey")
def enrich_logs(spark, d):
    dim = load_table(spark, d, "customer").filter("c_custkey % 3 <> 0").withColumnRenamed("c_custkey", "user_id")
    return joins.enrich_logs(load_table(spark, d, "events"), dim, "user_id", "c_name", "unknown").select("event_id", "c_name")


def supplier_sources(spark, d):
    s = F.col("s_suppkey")
    return load_table(spark, d, "supplier").select(
        F.when(s % 5 == 1, F.concat(F.lit("wl-entity-"), s % 30)).otherwise(F.concat(F.lit("s."), s)).alias("source_code"),
        F.when(s % 5 == 0, F.concat(F.lit("entity-"), s % 30)).otherwise("").alias("configured_id"),
        F.when(s % 5 == 2, F.concat(F.lit(" nation "), s % 30)).otherwise(F.col("s_name")).alias("name"),
        F.concat(F.lit("https://www.h"), s % 25, F.lit(".test/")).alias("site_url"),
        F.when(s % 3 == 0, "Government").when(s % 3 == 1, "blog").otherwise("enterprise").alias("type"),
        (s % 11 != 0).alias("active"), s.alias("s_suppkey"), F.array(F.lit(" x "), F.lit("")).alias("whitelist"))


def nation_entities(spark, d):
    n = F.col("n_nationkey")
    return load_table(spark, d, "nation").select(
        F.concat(F.lit("entity-"), n).alias("entity_id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("Alias-"), n)).alias("aliases"),
        F.array(F.concat(F.lit("https://h"), n % 20, F.lit(".test/about"))).alias("evidence_urls"))


BOUND = """src AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 1 THEN 'wl-entity-' || (s_suppkey % 30) ELSE 's.' || s_suppkey END AS source_code FROM supplier),
bound AS (SELECT s_suppkey, source_code, s_name, CASE WHEN s_suppkey % 5 IN (0, 1, 2) AND s_suppkey % 30 < 25 THEN 'entity-' || (s_suppkey % 30)
   WHEN s_suppkey % 25 BETWEEN 5 AND 19 THEN 'entity-' || (s_suppkey % 25) ELSE '' END AS entity_id FROM src)"""


@query("jn4_bind_entities", f"WITH {BOUND} SELECT s_suppkey, entity_id FROM bound")
def bind_entities(spark, d):
    return joins.bind_entities(supplier_sources(spark, d), nation_entities(spark, d)).select("s_suppkey", "entity_id")


@query("jn5_term_table", """WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{7,}')) AS term FROM benchmark)
SELECT doc_id, term FROM documents, terms WHERE contains(text, term)""")
def term_table(spark, d):
    words = load_table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{7,}"), F.lit(0))).alias("term")).distinct()
    return tagging.match_terms(load_table(spark, d, "documents"), words, "doc_id", "text")


@query("jn6_article_regions", k.with_current(f"""SELECT id, region_id FROM (
 SELECT id, 'R' || t AS region_id FROM (SELECT id, array_to_string([title, summary, array_to_string(keywords, ' '), source, array_to_string(region_tags, ' ')], ' ') AS ft FROM cur), (SELECT unnest({k.term_list(bind.REGIONS)}) AS t)
   WHERE contains(ft, t) OR contains(ft, t || 'x')
 UNION SELECT id, 'Rdad' FROM cur WHERE list_contains(entity_ids, 'entity-0'))"""))
def article_regions(spark, d):
    regions = spark.createDataFrame([("R" + t, t, [t + "x"]) for t in bind.REGIONS], "region_id STRING, name STRING, aliases ARRAY<STRING>")
    ents = spark.createDataFrame([("entity-0", ["Rdad"])], "entity_id STRING, region_ids ARRAY<STRING>")
    return joins.article_regions(bind.current(spark, d), regions, ents)


@query("jn7_keep_known", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def keep_known(spark, d):
    dim = load_table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").withColumnRenamed("c_custkey", "o_custkey")
    return joins.keep_known(load_table(spark, d, "orders"), dim, "o_custkey").select("o_orderkey")


def _two(spark, d):
    c = load_table(spark, d, "customer").select("c_custkey", "c_name")
    return c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_name", F.lower("c_name"))


@query("jn8_merge_new", """SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, lower(c_name) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0""")
def merge_new(spark, d):
    return joins.merge_new(*_two(spark, d), "c_custkey")


@query("jn8_replace_by_id", """SELECT c_custkey, lower(c_name) AS c_name FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 <> 0""")
def replace_by_id(spark, d):
    return joins.replace_by_id(*_two(spark, d), "c_custkey")


@query("jn9_upsert_dim", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS name,
 CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 THEN 'a=2,b=1,c=3' WHEN s_suppkey % 3 <> 0 THEN 'a=1,b=1' ELSE 'a=2,c=3' END AS rule
FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0""")
def upsert_dim(spark, d):
    s = load_table(spark, d, "supplier")
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    old = s.filter("s_suppkey % 3 <> 0").select("s_suppkey", F.lit("old").alias("name"), m(a="1", b="1").alias("rule"))
    new = s.filter("s_suppkey % 2 = 0").select("s_suppkey", F.lit("new").alias("name"), m(a="2", c="3").alias("rule"))
    out = joins.upsert_dim(old, new, "s_suppkey", ["rule"])
    entries = F.array_sort(F.transform(F.map_entries("rule"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return out.select("s_suppkey", "name", F.array_join(entries, ",").alias("rule"))


@query("jn10_resolve_edges", f"WITH {bind.GRAPH} SELECT source_id, target_id, a.name AS source_name, b.name AS target_name FROM edges JOIN nodes a ON source_id = a.id JOIN nodes b ON target_id = b.id")
def resolve_edges(spark, d):
    return joins.resolve_edges(*bind.graph(spark, d)).select("source_id", "target_id", "source_name", "target_name")


TEMPLATES = [("dnr", "Bureau", "subject", "organizes"), ("plan", "Plan", "goal", "pursues"), ("map", "Map", "content", "focuses_on"), ("eval", "Review", "evaluation", "assesses")]
_T = " UNION ALL ".join(f"SELECT '{s}' AS slug, '{n}' AS label, '{c}' AS cls, '{r}' AS rel" for s, n, c, r in TEMPLATES)


@query("jn11_star_graph", f"""WITH t AS ({_T}), c AS (SELECT 'n' || n_nationkey AS cid, n_name AS nm FROM nation)
SELECT 'node' AS kind, cid || '-' || slug AS a, nm || ' ' || label AS b, cls AS c FROM c, t UNION ALL SELECT 'node', cid, nm, 'content' FROM c
UNION ALL SELECT 'edge', cid, cid || '-' || slug, rel FROM c, t UNION ALL SELECT 'edge', 'root', cid, 'related' FROM c""")
def star_graph(spark, d):
    cities = load_table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"))
    nodes, edges = joins.expand_star_graph(cities, TEMPLATES, "root")
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("element_class").alias("c")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("relation").alias("c")))


@query("jn12_with_fallback", """SELECT event_id, user_id FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def with_fallback(spark, d):
    ev = load_table(spark, d, "events")
    return joins.with_fallback(ev.filter("event_type = 'purchase'").select("event_id", "user_id"), ev.filter("event_type = 'view'").select("event_id", "user_id"), "user_id")

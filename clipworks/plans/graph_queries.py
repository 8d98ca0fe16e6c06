"""Knowledge graph jobs over documents, nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.operators import graph
from clipworks.plans import sqlkit as k
from clipworks.plans.registry import query
from clipworks.sources import bind
from clipworks.sources.tables import load_table

# Nodes named by words of the documents, and edges between them with keywords.
NODES = [("k0", "thon", ["thonx"], "subject"), ("k1", "leau", [], "goal"), ("k2", "anan", ["heat"], "content"), ("k3", "erin", [], "activity"), ("k4", "nobody", ["zzzz"], "content"), ("root", "rootless", [], "content")]
EDGES = [("k0", "k2", ["onre", "para"]), ("k1", "k3", ["avec"]), ("k2", "k3", []), ("k3", "k4", ["nicht"]), ("k4", "gone", ["erin"])]
RESEARCH = [("k0", "k2", "p1", 0), ("k0", "k2", "p2", 1), ("k1", "k3", "p1", 0), ("k1", "k3", "p1", 1)]
NODE_SQL = " UNION ALL ".join(f"SELECT '{i}' AS id, {k.term_list([n, *a])} AS ts, '{c}' AS cls" for i, n, a, c in NODES)
EDGE_SQL = " UNION ALL ".join(f"SELECT '{s}' AS source_id, '{t}' AS target_id, {k.term_list(w) if w else '[]::VARCHAR[]'} AS ws" for s, t, w in EDGES)
RES_SQL = " UNION ALL ".join(f"SELECT '{s}' AS source_id, '{t}' AS target_id, '{r}' AS ref_id, {p} AS pos" for s, t, r, p in RESEARCH)


def hit(x: str) -> str:
    return f"list_bool_or(list_transform({x}, lambda z: contains(tx, z)))"


EVID = f"""{k.CURRENT}, kn AS ({NODE_SQL}), ke AS ({EDGE_SQL}), res AS ({RES_SQL}),
tx AS (SELECT id AS aid, published_at, is_related, lower(array_to_string([title, summary, array_to_string(keywords, ' '), source, array_to_string(region_tags, ' ')], ' ')) AS tx FROM cur),
x AS (SELECT ke.source_id, ke.target_id, aid, published_at, coalesce({hit('a.ts')}, FALSE) AS h1, coalesce({hit('b.ts')}, FALSE) AS h2, coalesce({hit('ke.ws')}, FALSE) AS h3 FROM ke LEFT JOIN kn a ON a.id = source_id LEFT JOIN kn b ON b.id = target_id, tx),
ev AS (SELECT * FROM (SELECT source_id, target_id, aid AS id, row_number() OVER (PARTITION BY source_id, target_id ORDER BY published_at DESC, aid) AS rank FROM x WHERE h1::INT + h2::INT + h3::INT >= 2) WHERE rank <= 6)"""


# Evidence from all of an article's text; the other graph queries see its summary only.
EVID_WHOLE = EVID.replace(k.CURRENT, k.CURRENT_WHOLE)


def parts(spark, d, whole=False):
    nodes = spark.createDataFrame(NODES, "id STRING, name STRING, aliases ARRAY<STRING>, element_class STRING")
    edges = spark.createDataFrame(EDGES, "source_id STRING, target_id STRING, keywords ARRAY<STRING>")
    research = spark.createDataFrame(RESEARCH, "source_id STRING, target_id STRING, ref_id STRING, pos INT")
    return nodes, edges, research, bind.current(spark, d, whole)


@query("kg1_edge_evidence", f"WITH {EVID_WHOLE} SELECT * FROM ev")
def edge_evidence(spark, d):
    nodes, edges, _, arts = parts(spark, d, whole=True)
    return graph.edge_evidence(edges, nodes, arts)


REFS = f"""{EVID}, allr AS (SELECT source_id, target_id, 0 AS kind, 'article:' || ev.id AS ref, rank AS pos, CASE WHEN cur.is_related THEN 2 ELSE 1 END AS w FROM ev JOIN cur USING (id)
 UNION ALL SELECT source_id, target_id, 1, 'research:' || ref_id, pos, 1 FROM res)"""


@query("kg2_edge_refs", f"""WITH {REFS.replace(EVID, EVID_WHOLE)} SELECT source_id, target_id, ref, rank FROM (SELECT source_id, target_id, ref, row_number() OVER (PARTITION BY source_id, target_id ORDER BY min((kind, pos)), ref) AS rank FROM allr GROUP BY 1, 2, 3) WHERE rank <= 8""")
def edge_refs(spark, d):
    nodes, edges, research, arts = parts(spark, d, whole=True)
    return graph.edge_refs(graph.edge_evidence(edges, nodes, arts), research, arts)[0]


@query("kg2_edge_weights", f"WITH {REFS} SELECT source_id, target_id, CAST(sum(w) AS BIGINT) AS weight FROM allr GROUP BY 1, 2")
def edge_weights(spark, d):
    nodes, edges, research, arts = parts(spark, d)
    return graph.edge_refs(graph.edge_evidence(edges, nodes, arts), research, arts)[1].select("source_id", "target_id", "weight")


GRAPH = f"""{REFS}, ok AS (SELECT source_id, target_id FROM ke WHERE source_id IN (SELECT id FROM kn) AND target_id IN (SELECT id FROM kn)),
kept AS (SELECT source_id, target_id, CAST(sum(w) AS BIGINT) AS weight FROM allr JOIN ok USING (source_id, target_id) GROUP BY 1, 2),
lk AS (SELECT unnest([source_id, target_id]) AS n, id FROM ev JOIN ok USING (source_id, target_id) UNION SELECT unnest(['k' || (id % 7)]), id FROM cur), cn AS (SELECT n, count(DISTINCT id) AS c FROM lk GROUP BY 1)"""


def built(spark, d):
    nodes, edges, research, arts = parts(spark, d)
    arts = arts.withColumn("entity_ids", F.array(F.concat(F.lit("k"), F.col("id") % 7)))
    return graph.build_graph(arts, nodes, edges, research, "root", bind.CLASSES)


@query("kg3_build_graph", f"""WITH {GRAPH}
SELECT kn.id AS node_id, coalesce(c, 0) AS n_articles, list_position(['subject', 'goal', 'content', 'activity', 'evaluation'], cls) AS layer FROM kn LEFT JOIN cn ON cn.n = kn.id
WHERE c IS NOT NULL OR kn.id = 'root' OR kn.id IN (SELECT unnest([source_id, target_id]) FROM kept)""")
def build_graph(spark, d):
    return built(spark, d)[0].select("node_id", "n_articles", "layer")


@query("kg3_edges", f"WITH {GRAPH} SELECT source_id, target_id, weight FROM kept")
def graph_edges(spark, d):
    return built(spark, d)[1].select("source_id", "target_id", "weight")


@query("kg3_links", f"WITH {GRAPH} SELECT n AS node_id, id AS article_id FROM lk WHERE n IN (SELECT id FROM kn)")
def graph_links(spark, d):
    return built(spark, d)[2]


@query("kg4_scope_nodes", f"WITH {bind.GRAPH} SELECT id, name, 'city' AS view FROM nodes WHERE id = 'r2' OR parent_id = 'r2' OR region_id = 'r2' UNION ALL SELECT id, name, 'overview' FROM nodes WHERE id IN ('r0', 'r1', 'r3')")
def scope_nodes(spark, d):
    nodes, _ = bind.graph(spark, d)
    city = graph.scope_nodes(nodes, "r2", "r0").select("id", "name", F.lit("city").alias("view"))
    return city.unionByName(graph.scope_nodes(nodes, "all", "r0", ["r1", "r3"]).select("id", "name", F.lit("overview").alias("view")))


@query("kg5_layer_groups", f"""WITH {bind.GRAPH} SELECT id, element_class, display_order, count(*) OVER (PARTITION BY element_class) AS class_size FROM nodes WHERE id <> 'r2'""")
def layer_groups(spark, d):
    return graph.layer_groups(bind.graph(spark, d)[0], "r2").select("id", "element_class", "display_order", "class_size")


@query("kg6_induced_edges", f"WITH {bind.GRAPH}, v AS (SELECT id FROM nodes WHERE region_id IN ('r1', 'r2')) SELECT source_id, target_id, relation FROM edges WHERE source_id IN (FROM v) AND target_id IN (FROM v)")
def induced_edges(spark, d):
    nodes, edges = bind.graph(spark, d)
    visible = nodes.filter(F.arrays_overlap("region_ids", F.array(F.lit("r1"), F.lit("r2"))))
    return graph.induced_edges(visible, edges).select("source_id", "target_id", "relation")


@query("kg7_node_evidence", f"""WITH {bind.GRAPH}, r AS (SELECT 0 AS kind, 'own:' || n_nationkey AS ref, n_nationkey AS pos FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1, 'research:' || n_refs, row_number() OVER (ORDER BY target_id) FROM edges WHERE source_id = 'r1' OR target_id = 'r1'
 UNION ALL SELECT 2, 'article:' || o_orderkey, o_orderkey FROM orders WHERE o_custkey % 5 = 1), f AS (SELECT ref, min((kind, pos)) AS o, min(kind) AS kind FROM r GROUP BY 1) SELECT ref, kind FROM f ORDER BY o, ref LIMIT 16""")
def node_evidence(spark, d):
    _, edges = bind.graph(spark, d)
    own = load_table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("node_id"), F.concat(F.lit("own:"), "n_nationkey").alias("ref"), F.col("n_nationkey").alias("pos"))
    from pyspark.sql import Window as W
    refs = edges.filter("source_id = 'r1' OR target_id = 'r1'").select("source_id", "target_id", F.concat(F.lit("research:"), "n_refs").alias("ref"),
                                                                      F.row_number().over(W.partitionBy("source_id").orderBy("target_id")).alias("rank"))
    links = load_table(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("node_id"), F.col("o_orderkey").alias("article_id"))
    return graph.node_evidence("r1", own, refs, links)


@query("kg8_hub_graph", f"""WITH {bind.GRAPH}, v AS (SELECT * FROM nodes WHERE region_id = 'r2'), s AS (SELECT * FROM v WHERE id <> 'r2' AND element_class IN ('subject', 'goal', 'content')), h AS (SELECT element_class AS c, count(*) AS n FROM s GROUP BY 1)
SELECT 'center' AS kind, 'r2' AS a, '' AS b, 1 AS size UNION ALL SELECT 'hub', 'hub-' || c, c, n FROM h UNION ALL SELECT 'entity', id, element_class, 1 FROM s
UNION ALL SELECT 'trunk', 'r2', 'hub-' || c, 0 FROM h UNION ALL SELECT 'branch', 'hub-' || element_class, id, 0 FROM s""")
def hub_graph(spark, d):
    nodes, _ = bind.graph(spark, d)
    hub_nodes, hub_edges = graph.hub_graph(graph.scope_nodes(nodes, "r2"), "r2", ["subject", "goal", "content"])
    return hub_nodes.select("kind", F.col("id").alias("a"), F.col("layer").alias("b"), "size").unionByName(
        hub_edges.select("kind", F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(0).cast("bigint").alias("size")))


@query("kg9_search_nodes", f"WITH {bind.GRAPH} SELECT id, name FROM nodes WHERE contains(lower(name || ' ' || CASE WHEN element_class = 'goal' THEN 'Plan tag' ELSE 'x' END), 'plan') OR contains(lower(name), 'plan')")
def search_nodes(spark, d):
    nodes, _ = bind.graph(spark, d)
    tagged = nodes.withColumn("tags", F.array(F.when(F.col("element_class") == "goal", "Plan tag").otherwise("x")))
    return graph.search_nodes(tagged, " PLAN ").select("id", "name")

"""Evidence-backed knowledge graph: edges, evidence, scopes, layers and hub views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from clipworks.functions import groups, ordered, terms, text
from clipworks.operators import tagging
from clipworks.sources.tables import materialize

EDGE = ["source_id", "target_id"]
#: Articles of a bitmap.
BUCKET = 32768


def node_tokens(nodes: DataFrame) -> DataFrame:
    """``(node_id, term)``: normalized names and aliases in lower case."""
    names = F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), lambda t: text.keyword_term(t)))
    return nodes.select(F.col("id").alias("node_id"), F.explode(names).alias("_t")).filter("_t <> ''").select("node_id", F.lower("_t").alias("term"))


@F.arrow_udf(ArrayType(IntegerType()))
def _agreed(source: pa.Array, target: pa.Array, words: pa.Array, k: pa.Array) -> pa.Array:
    """The first ``k`` bits that at least two of three bitmaps hold; a null bitmap holds none."""
    out = []
    for s, t, w, n in zip(source, target, words, k):
        a, b, c = (np.frombuffer(x.as_py(), np.uint8) if x.is_valid else np.zeros(BUCKET // 8, np.uint8) for x in (s, t, w))
        out.append(np.flatnonzero(np.unpackbits(a & b | a & c | b & c, bitorder="little"))[:n.as_py()].astype(np.int32))
    return pa.array(out, pa.list_(pa.int32()))


def edge_evidence(edges: DataFrame, nodes: DataFrame, articles: DataFrame, k: int = 6) -> DataFrame:
    """``(source_id, target_id, id, rank)``: newest ``k`` articles that name both ends, or one end and an edge keyword.

    Articles are numbered from the newest on; who names a node or a word is a bitmap for each run of 32768 articles. An
    edge meets the bitmaps of its ends and words, not their articles, so a hub costs its edges times its runs, and only
    the first ``k`` articles that two of the three bitmaps share leave a run. Ids are unique.
    """
    docs = articles.select("id", "published_at", F.lower(tagging.matching_text()).alias("_text"))
    tokens = node_tokens(nodes)
    words = edges.select(*EDGE, F.explode("keywords").alias("_w")).select(*EDGE, F.lower("_w").alias("term")).filter("term <> ''").distinct()
    wanted = tokens.select("term").unionByName(words.select("term")).distinct()
    order = [F.desc_nulls_last("published_at"), F.asc("id")]
    numbered = ordered.running_sum(articles.select("id", "published_at").withColumn("_one", F.lit(1).cast("bigint")), [], order, "_one", "_nth")
    numbered = materialize(numbered.select("id", (F.col("_nth") - 1).alias("_nth")))
    said = materialize(tagging.match_terms(docs, wanted, "id", "_text").select("id", "term").join(numbered, "id").select("term", "_nth"))
    run, bit = F.floor(F.col("_nth") / BUCKET).alias("run"), F.bitmap_construct_agg(F.col("_nth") % BUCKET).alias("bits")
    named = materialize(said.join(tokens, "term").groupBy("node_id", run).agg(bit))
    spoken = said.join(words.select("term").distinct(), "term").groupBy("term", run).agg(bit)
    pairs = edges.select(*EDGE).distinct()
    side = lambda df, n: df.select(*EDGE, "run", F.lit(n).alias("side"), "bits")
    met = side(pairs.join(named.withColumnRenamed("node_id", "source_id"), "source_id"), 0).unionByName(side(pairs.join(named.withColumnRenamed("node_id", "target_id"), "target_id"), 1))
    met = met.unionByName(words.join(spoken, "term").groupBy(*EDGE, "run").agg(F.bitmap_or_agg("bits").alias("bits")).select(*EDGE, "run", F.lit(2).alias("side"), "bits"))
    three = [F.first(F.when(F.col("side") == n, F.col("bits")), ignorenulls=True).alias(f"_{n}") for n in range(3)]
    sides = met.groupBy(*EDGE, "run").agg(F.count("*").alias("_sides"), *three).filter("_sides > 1")
    found = sides.select(*EDGE, "run", F.explode(_agreed("_0", "_1", "_2", F.lit(k))).alias("_bit")).select(*EDGE, (F.col("run") * BUCKET + F.col("_bit")).alias("_nth"))
    best = groups.top_k(found, EDGE, [F.asc("_nth")], k, rank="rank")
    return best.join(numbered, "_nth").select(*EDGE, "id", "rank")


def edge_refs(evidence: DataFrame, research: DataFrame, articles: DataFrame, k: int = 8):
    """``(refs, weights)``: article then research references of each edge without repeats, first ``k``;
    weight 2 per related article, 1 per other article, 1 per research reference."""
    arts = evidence.join(articles.select("id", "is_related"), "id").select(
        *EDGE, F.lit(0).alias("kind"), F.concat(F.lit("article:"), "id").alias("ref"), F.col("rank").alias("pos"), F.when(F.col("is_related"), 2).otherwise(1).alias("w"))
    papers = research.select(*EDGE, F.lit(1).alias("kind"), F.concat(F.lit("research:"), "ref_id").alias("ref"), F.col("pos"), F.lit(1).alias("w"))
    every = arts.unionByName(papers)
    weights = every.groupBy(*EDGE).agg(F.sum("w").alias("weight"), F.count("*").alias("n_refs"))
    firsts = every.groupBy(*EDGE, "ref").agg(F.min(F.struct("kind", "pos")).alias("o"))
    return groups.top_k(firsts, EDGE, [F.asc("o"), F.asc("ref")], k, rank="rank").select(*EDGE, "ref", "rank"), weights


def build_graph(articles: DataFrame, nodes: DataFrame, edges: DataFrame, research: DataFrame, root: str, order) -> tuple:
    """``(nodes, edges, links)``: edges with evidence and weight; nodes that an edge or article touches (and the
    root) with their article counts and layer; ``links`` is the long ``(node_id, article_id)`` table."""
    ids = nodes.select("id")
    resolved = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    evidence = edge_evidence(resolved, nodes, articles)
    weights = edge_refs(evidence, research, articles)[1]
    kept = resolved.join(weights, EDGE)
    own = articles.select(F.explode("entity_ids").alias("node_id"), F.col("id").alias("article_id")).join(
        ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    via = evidence.select(F.explode(F.array(*EDGE)).alias("node_id"), F.col("id").alias("article_id"))
    links = own.unionByName(via).distinct()
    counts = links.groupBy("node_id").agg(F.count("*").alias("n_articles"))
    ends = kept.select(F.explode(F.array(*EDGE)).alias("node_id")).distinct().withColumn("_edge", F.lit(True))
    joined = nodes.withColumnRenamed("id", "node_id").join(counts, "node_id", "left").join(ends, "node_id", "left")
    shown = joined.filter(F.col("_edge") | F.col("n_articles").isNotNull() | (F.col("node_id") == root)).withColumns({
        "n_articles": F.coalesce("n_articles", F.lit(0)),
        "layer": F.array_position(terms.strings(order), F.coalesce("element_class", F.lit("content"))).cast("int")})
    return shown.drop("_edge"), kept, links


def scope_nodes(nodes: DataFrame, region: str, root: str = "root", members=()) -> DataFrame:
    """Overview (the root and its member nodes), or a region's own node, children and tagged nodes."""
    if region in (root, "all"):
        return nodes.filter(F.col("id").isin([root, *members]))
    return nodes.filter((F.col("id") == region) | (F.col("parent_id") == region) | F.array_contains("region_ids", region))


def layer_groups(nodes: DataFrame, center: str) -> DataFrame:
    """Nodes of each class in display order with the class size; the center itself is left out.

    Class sizes are pre-aggregated counts; the order is one range sort on the full key, so a class that holds
    most nodes is split like any other.
    """
    shown = nodes.filter(F.col("id") != center)
    sizes = shown.groupBy("element_class").agg(F.count("*").alias("class_size"))
    return shown.join(sizes, "element_class").orderBy("element_class", F.coalesce("display_order", F.lit(9999)), "name", "id")


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def direct_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("source_id") == node) | (F.col("target_id") == node))


def node_evidence(node: str, own_refs: DataFrame, edge_refs_: DataFrame, links: DataFrame, k: int = 16) -> DataFrame:
    """First ``k`` distinct references of a node: its own, then its edges', then its articles'."""
    mine = own_refs.filter(F.col("node_id") == node).select(F.lit(0).alias("kind"), "ref", F.col("pos").cast("bigint").alias("pos"))
    edge = direct_edges(edge_refs_, node).select(F.lit(1).alias("kind"), "ref", F.col("rank").cast("bigint").alias("pos"))
    arts = links.filter(F.col("node_id") == node).select(
        F.lit(2).alias("kind"), F.concat(F.lit("article:"), "article_id").alias("ref"), F.col("article_id").cast("bigint").alias("pos"))
    firsts = mine.unionByName(edge).unionByName(arts).groupBy("ref").agg(F.min(F.struct("kind", "pos")).alias("o"))
    return firsts.orderBy("o", "ref").limit(k).select("ref", F.col("o.kind").alias("kind"))


def hub_graph(nodes: DataFrame, center: str, classes):
    """``(nodes, edges)`` of a center, one hub per visible class, and the class's nodes."""
    shown = nodes.filter((F.col("id") != center) & F.col("element_class").isin(list(classes)))
    sizes = shown.groupBy("element_class").agg(F.count("*").alias("n"))
    hub = F.concat(F.lit("hub-"), "element_class")
    hubs = sizes.select(hub.alias("id"), F.lit("hub").alias("kind"), F.col("element_class").alias("layer"), F.col("n").alias("size"))
    middle = nodes.filter(F.col("id") == center).select("id", F.lit("center").alias("kind"), F.lit("").alias("layer"), F.lit(1).cast("bigint").alias("size"))
    leaves = shown.select("id", F.lit("entity").alias("kind"), F.col("element_class").alias("layer"), F.lit(1).cast("bigint").alias("size"))
    known = bool(nodes.filter(F.col("id") == center).limit(1).count())
    trunk = hubs.filter(F.lit(known)).select(F.lit(center).alias("source_id"), F.col("id").alias("target_id"), F.lit("trunk").alias("kind"))
    branch = shown.select(hub.alias("source_id"), F.col("id").alias("target_id"), F.lit("branch").alias("kind"))
    return middle.unionByName(hubs).unionByName(leaves), trunk.unionByName(branch)


def search_nodes(nodes: DataFrame, query: str, cols=("name", "intro", "region")) -> DataFrame:
    """Nodes whose text fields, tags or aliases hold the query; a blank query finds nothing."""
    needle = query.strip().lower()
    fields = [F.col(c) for c in cols if c in nodes.columns] + [F.concat_ws(" ", c) for c in ("tags", "aliases") if c in nodes.columns]
    return nodes.filter(F.lit(needle != "") & F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(needle)))

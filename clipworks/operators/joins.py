"""Star joins, lookups, entity binding, merges and graph joins.

No join here is forced to broadcast: the optimizer does so for sides whose measured size is under
``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution splits skewed partitions of the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks.functions import terms, text, urls
from clipworks.operators import tagging


def current_articles(heads: DataFrame, versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Each head with its current version and its source."""
    current = heads.withColumnRenamed("current_version_id", "version_id").join(versions.drop("news_id"), "version_id")
    return current.join(sources, "source_id")


def versions_of(heads: DataFrame, versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Every version with its head's source, heads in order and their newest version first.

    A range sort on the full key, which also splits a head that holds a large part of the rows.
    """
    all_rows = versions.join(heads.select("news_id", "source_id"), "news_id").join(sources, "source_id")
    return all_rows.orderBy("news_id", F.desc("published_at"), F.desc("version_id"))


def enrich_logs(logs: DataFrame, dim: DataFrame, key: str, col: str, default) -> DataFrame:
    """Left lookup of one column, with a default where the key is unknown."""
    return logs.join(dim.select(key, col), key, "left").withColumn(col, F.coalesce(col, F.lit(default)))


def bind_entities(sources: DataFrame, entities: DataFrame, prefix="wl-", code_prefix="wl-entity-") -> DataFrame:
    """Entity of each source: configured id, then id inside the code, then name or alias, then a host that
    exactly one entity names as evidence. Unbound sources get ''."""
    ids = entities.select(F.col("entity_id").alias("_id")).distinct()
    named = entities.select("entity_id", F.explode(F.concat(F.array("name"), "aliases")).alias("_n"))
    by_name = named.select(text.term_key("_n").alias("_key"), "entity_id").filter("_key <> ''").groupBy("_key").agg(
        F.min("entity_id").alias("_by_name"))
    hosts = entities.select("entity_id", F.explode("evidence_urls").alias("_u")).select("entity_id", urls.host("_u").alias("_host"))
    by_host = hosts.filter("_host <> ''").groupBy("_host").agg(
        F.min("entity_id").alias("_by_host"), F.max("entity_id").alias("_max")).filter("_by_host = _max").drop("_max")
    code = text.clean("source_code")
    inner = F.when(code.startswith(code_prefix), F.substring(code, len(prefix) + 1, 1000))
    src = sources.withColumns({"_conf": text.clean("configured_id"), "_code": inner, "_key": text.term_key("name"), "_host": urls.host("site_url")})
    out = (
        src.join(ids.withColumnRenamed("_id", "_ok1"), F.col("_conf") == F.col("_ok1"), "left")
        .join(ids.withColumnRenamed("_id", "_ok2"), F.col("_code") == F.col("_ok2"), "left")
        .join(by_name, "_key", "left").join(by_host, "_host", "left")
    )
    bound = F.coalesce("_ok1", "_ok2", "_by_name", "_by_host", F.lit(""))
    return out.withColumn("entity_id", bound).drop("_conf", "_code", "_key", "_host", "_ok1", "_ok2", "_by_name", "_by_host")


def article_regions(df: DataFrame, regions: DataFrame, entities: DataFrame, id_col="id") -> DataFrame:
    """``(id, region_id)`` by tag, mention or entity: three ways united, never one join with OR."""
    long = regions.select("region_id", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("term"))
    return tagging.resolve_regions(df, long, long.limit(0), entities, None, id_col)


def keep_known(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return df.join(dim.select(key).distinct(), key, "left_semi")


def merge_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows, plus incoming rows with new keys."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").select(*existing.columns))


def replace_by_id(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows, plus existing rows whose key is not among them."""
    return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def _merged_map(old, fresh):
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def upsert_dim(existing: DataFrame, incoming: DataFrame, key: str, map_cols=()) -> DataFrame:
    """Incoming fields win where given; map columns are merged key by key, incoming keys winning."""
    new = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in incoming.columns if c != key])
    joined = existing.join(new, key, "full_outer")
    cols = [F.col(key)]
    for c in existing.columns:
        if c == key:
            continue
        if f"_{c}" not in new.columns:
            cols.append(F.col(c))
        elif c in map_cols:
            empty = F.create_map().cast(existing.schema[c].dataType)
            old, fresh = F.coalesce(c, empty), F.coalesce(f"_{c}", empty)
            cols.append(_merged_map(old, fresh).alias(c))
        else:
            cols.append(F.coalesce(f"_{c}", c).alias(c))
    return joined.select(*cols)


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both end names; edges with a missing end are dropped."""
    names = nodes.select("id", "name")
    left = names.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    right = names.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return edges.join(left, "source_id").join(right, "target_id")


def expand_star_graph(cities: DataFrame, templates, center: str):
    """Nodes and edges of every city from a fixed template list ``(slug, name, class, relation)``.

    Templates are a constant, so they are exploded from an array literal: no join, no shuffle.
    """
    items = F.array(*[
        F.struct(F.lit(s).alias("slug"), F.lit(n).alias("label"), F.lit(c).alias("element_class"), F.lit(r).alias("relation"), F.lit(i + 1).alias("display_order"))
        for i, (s, n, c, r) in enumerate(templates)])
    made = cities.select("city_id", "city_name", F.explode(items).alias("t"))
    node_id = F.concat_ws("-", "city_id", "t.slug")
    nodes = made.select(node_id.alias("id"), F.concat_ws(" ", "city_name", "t.label").alias("name"), F.col("t.element_class").alias("element_class"),
                        F.col("city_id").alias("parent_id"), F.col("t.display_order").alias("display_order"))
    nodes = nodes.unionByName(cities.select(F.col("city_id").alias("id"), F.col("city_name").alias("name"), F.lit("content").alias("element_class"),
                                            F.lit(center).alias("parent_id"), F.lit(0).alias("display_order")))
    edges = made.select(F.col("city_id").alias("source_id"), node_id.alias("target_id"), F.col("t.relation").alias("relation"))
    edges = edges.unionByName(cities.select(F.lit(center).alias("source_id"), F.col("city_id").alias("target_id"), F.lit("related").alias("relation")))
    return nodes, edges


def with_fallback(live: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Live rows, plus seed rows of the keys that have no live row."""
    return live.unionByName(seed.join(live.select(key).distinct(), key, "left_anti").select(*live.columns))

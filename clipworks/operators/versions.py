"""Versioned articles: upserts, deduplication, source and entity upkeep.

Ids are hashes of their keys, not sequences: a task that is run again after a lost executor makes the
same ids, and two batches never race for a counter. Each job returns new table states or change sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions import groups, terms, text, urls
from clipworks.operators import joins
from clipworks.sources.tables import materialize

KEY = ["source_id", "canonical_url"]


def news_id(source="source_id", url="canonical_url"):
    return F.substring(F.sha2(F.concat_ws("::", source, url), 256), 1, 32)


def version_id(news="news_id", content="content_hash"):
    return F.substring(F.sha2(F.concat_ws("::", news, content), 256), 1, 32)


def keyed(accepted: DataFrame) -> DataFrame:
    """Batch with head and version ids; a repeated content of one head keeps its first row and counts ``copies``."""
    rows = accepted.withColumn("news_id", news_id()).withColumn("version_id", version_id())
    firsts = rows.groupBy("version_id").agg(F.min_by(F.struct(*rows.columns), "seq").alias("r"), F.count("*").alias("copies"))
    return firsts.select("r.*", "copies")


def upsert_versions(heads: DataFrame, versions: DataFrame, accepted: DataFrame, now: str):
    """``(heads, versions, stats)`` after a batch of accepted articles.

    New key: head and version. Known key with known content: only ``last_seen_at`` moves. Known key with
    new content: a version is added and becomes current (the last added one, in ``seq`` order).
    accepted(seq, source_id, canonical_url, slug, content_hash, ...); versions and heads hold a subset. The batch
    is written once, since heads, versions and counts all read it.
    """
    batch = materialize(keyed(accepted))
    fresh = batch.join(versions.select("version_id"), "version_id", "left_anti")
    stamp = F.lit(now).cast("timestamp_ntz")
    touched = batch.groupBy("news_id").agg(F.min_by(F.struct(*KEY), "seq").alias("k"))
    latest = fresh.groupBy("news_id").agg(F.max_by(F.struct("version_id", "slug"), "seq").alias("v"))
    seen = touched.join(latest, "news_id", "left").select(
        "news_id", F.col("k.source_id").alias("_source"), F.col("k.canonical_url").alias("_url"),
        F.col("v.version_id").alias("_version"), F.col("v.slug").alias("_slug"), F.lit(True).alias("_seen"))
    merged = heads.join(seen, "news_id", "full_outer").select(
        "news_id", F.coalesce("source_id", "_source").alias("source_id"), F.coalesce("canonical_url", "_url").alias("canonical_url"),
        F.coalesce("_slug", "slug").alias("slug"), F.coalesce("_version", "current_version_id").alias("current_version_id"),
        F.coalesce("first_seen_at", stamp).alias("first_seen_at"),
        F.when(F.col("_seen"), stamp).otherwise(F.col("last_seen_at")).alias("last_seen_at"))
    new_versions = versions.unionByName(fresh.select(*versions.columns))
    counted = groups.one_row(batch.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("accepted")), fresh.agg(F.count("*").alias("inserted")))
    stats = counted.select(
        "accepted", "inserted", (F.col("accepted") - F.col("inserted")).alias("duplicates"))
    return merged, new_versions, stats


def insert_new(heads: DataFrame, accepted: DataFrame) -> DataFrame:
    """Insert-only change set: the first row of every key that no head has, with ids."""
    rows = accepted.withColumn("news_id", news_id())
    new = rows.join(heads.select("news_id"), "news_id", "left_anti")
    firsts = new.groupBy("news_id").agg(F.min_by(F.struct(*new.columns), "seq").alias("r")).select("r.*")
    return firsts.withColumn("version_id", version_id())


def refresh_if_bad(heads: DataFrame, current_ok: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidates with ``action``: ``inserted`` for new keys, ``refreshed`` where the current version fails
    the rule, else ``duplicate``; of several candidates of one key only the first acts.

    current_ok(news_id, ok) tells whether each head's current version satisfies the rule.
    """
    rows = cands.withColumn("news_id", news_id())
    rows = groups.mark_later(rows, "seq", ["news_id"], [], "_later")
    state = heads.select("news_id", F.lit(True).alias("_known")).join(current_ok, "news_id", "left")
    action = (
        F.when(F.col("_later"), "duplicate").when(F.col("_known").isNull(), "inserted")
        .when(F.coalesce("ok", F.lit(False)), "duplicate").otherwise("refreshed"))
    return rows.join(state, "news_id", "left").withColumn("action", action).drop("_later", "_known", "ok")


def record_candidates(cands: DataFrame, run_id: int) -> DataFrame:
    """Every reviewed candidate as a log row with its verdict."""
    status = F.when(F.col("accepted"), "accepted").otherwise("rejected")
    return cands.select(
        F.col("id").alias("candidate_id"), F.lit(run_id).cast("bigint").alias("run_id"), "source_id", F.col("url").alias("original_url"),
        F.col("original_url").alias("canonical_url"), F.col("title").alias("cleaned_title"), F.col("summary").alias("cleaned_summary"),
        "published_at", status.alias("review_status"), F.col("reason").alias("reject_reason"))


def quality_score(df: DataFrame, url="url", site="site_url", blocked_hosts=()) -> DataFrame:
    """Score: 8 for a page of its own, 3 for an open host, up to 5 for keywords, 1 for a long summary."""
    own_page = urls.is_specific(F.col(url), F.col(site), blocked_hosts) & urls.is_article_page(url)
    blocked = urls.host(url).isin(list(blocked_hosts)) if blocked_hosts else F.lit(False)
    score = (
        F.when(own_page, 8).otherwise(0) + F.when(blocked, 0).otherwise(3) + F.least(F.size("keywords"), F.lit(5))
        + F.when(F.length(F.coalesce("summary", F.lit(""))) >= 80, 1).otherwise(0))
    return df.withColumn("quality", score)


def dedupe_articles(df: DataFrame, url="url", source="source", id_col="id") -> DataFrame:
    """Best article per source and URL, then per source and title; best is quality, date, then smallest id.

    Both passes are pre-aggregated maxima of ids joined back on the unique id, so a URL or title shared by
    a large part of the rows does not fill one task.
    """
    ranked = df.withColumns({
        "_url": F.coalesce(F.nullif(F.col(url), F.lit("")), F.col("title")), "_title": text.title_key("title"),
        "_rank": F.struct(F.col("quality"), F.col("published_at"), (-F.col(id_col)).alias("neg"))})
    keys = ranked.select(id_col, source, "_url", "_title", "_rank")
    best_url = keys.groupBy(source, "_url").agg(F.max_by(F.struct(id_col, "_title"), "_rank").alias("b"), F.max("_rank").alias("_rank"))
    best = best_url.groupBy(source, F.col("b._title")).agg(F.max_by(F.col(f"b.{id_col}"), "_rank").alias(id_col)).select(id_col)
    return df.join(best, id_col, "left_semi")


def first_by_url(cands: DataFrame, order, url="canonical_url") -> DataFrame:
    """First candidate of each URL in the given order."""
    return groups.first_per_key(cands, [url], order)


def sync_sources(existing: DataFrame, configured: DataFrame, entities: DataFrame, required=config.REQUIRED_TERMS,
                 allowed_types=(), retired_codes=(), retired_hosts=()) -> DataFrame:
    """Source dimension after a config sync: bound, gated and with the required terms in its rule.

    Sources missing from the config stay, inactive when they have no entity.
    """
    bound = joins.bind_entities(configured, entities)
    host = urls.host("site_url")
    allowed = (
        F.lower("type").isin(list(allowed_types)) & ~F.lower("source_code").isin(list(retired_codes))
        & ~host.isin(list(retired_hosts)))
    terms_clean = F.filter(F.transform(F.coalesce("whitelist", terms.strings([])), text.clean), lambda t: t != "")
    fresh = bound.select(
        "source_code", "name", "type", "site_url", F.col("entity_id").alias("whitelist_entity_id"),
        (F.coalesce("active", F.lit(True)) & (F.col("entity_id") != "") & allowed).alias("active"),
        F.array_union(terms_clean, terms.strings(required)).alias("whitelist"))
    kept = existing.join(fresh.select("source_code"), "source_code", "left_anti").withColumn(
        "active", F.col("active") & (F.coalesce("whitelist_entity_id", F.lit("")) != ""))
    return kept.select(*fresh.columns).unionByName(fresh)


def derive_entities(bound: DataFrame, entities: DataFrame) -> DataFrame:
    """An entity per unbound source: id ``source-<code>``, with the next free number when taken.

    Codes are unique, so only the few that differ in case or punctuation share an id stem.
    """
    stem = F.lower(F.regexp_replace(F.concat(F.lit("source-"), "source_code"), "[^a-zA-Z0-9_-]", "-"))
    missing = bound.filter("entity_id = ''").withColumn("_stem", stem)
    stems = missing.select("_stem").distinct()
    suffix = F.regexp_extract("entity_id", r"^(.*)-(\d+)$", 2)
    plain = entities.select(F.col("entity_id").alias("_stem"), F.lit(1).alias("_n"))
    numbered = entities.filter(suffix != "").select(
        F.regexp_extract("entity_id", r"^(.*)-(\d+)$", 1).alias("_stem"), suffix.try_cast("int").alias("_n"))
    taken = plain.unionByName(numbered).join(stems, "_stem", "left_semi").groupBy("_stem").agg(F.collect_set("_n").alias("_taken"))
    ranked = missing.withColumn("_k", F.row_number().over(W.partitionBy("_stem").orderBy("source_code")))
    ranked = ranked.join(taken, "_stem", "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.col("_k") + F.size("_taken")), F.col("_taken"))
    ranked = ranked.withColumn("_n", F.get(free, F.col("_k") - 1))
    ident = F.when(F.col("_n") == 1, F.col("_stem")).otherwise(F.concat_ws("-", "_stem", F.col("_n").cast("string")))
    return ranked.select(ident.alias("entity_id"), "name", "type", "source_code")


def clean_entities(entities: DataFrame, drop_category: str, keep_relevance):
    """``(kept, removed_counts)`` of a whitelist: one category dropped, then only allowed relevance kept."""
    off_category = F.coalesce("category", F.lit("")) == drop_category
    off_relevance = ~F.coalesce(F.col("relevance").isin(list(keep_relevance)), F.lit(False))
    kept = entities.filter(~off_category & ~off_relevance)
    removed = entities.filter(off_category | off_relevance).groupBy("category", "relevance").agg(F.count("*").alias("removed"))
    return kept, removed


def merge_entities(seed: DataFrame, research: DataFrame) -> DataFrame:
    """Seed then research entities: later fields win, list fields are united, class and order filled in."""
    fresh = research.select("id", *[F.col(c).alias(f"_{c}") for c in research.columns if c != "id"])
    both = seed.join(fresh, "id", "full_outer")
    lists = ["aliases", "tags", "region_ids"]
    united = {c: F.array_distinct(F.concat(F.coalesce(c, terms.strings([])), F.coalesce(f"_{c}", terms.strings([])))) for c in lists}
    kind = F.coalesce("_type", "type")
    mapped = F.create_map(*[F.lit(x) for kv in config.ELEMENT_CLASS_OF_TYPE.items() for x in kv])
    return both.select(
        "id", F.coalesce("_name", "name").alias("name"), kind.alias("type"),
        F.coalesce("_element_class", "element_class", F.try_element_at(mapped, kind), F.lit("content")).alias("element_class"),
        *[v.alias(c) for c, v in united.items()],
        F.coalesce("_display_order", "display_order").alias("display_order"))

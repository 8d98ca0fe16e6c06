"""Datasets derived from current articles and run logs: summary, cloud, regions, run totals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks.functions import groups, ordered, terms, text

CATEGORIES = ["enterprise", "technology", "policy"]


def summary(articles: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row: articles, sources, related articles, entities (and edges)."""
    one = articles.agg(
        F.count("*").alias("total_articles"), F.countDistinct("source").alias("total_sources"),
        F.count_if("is_related").alias("related_articles"))
    ents = articles.select(F.explode("entity_ids").alias("e")).agg(F.countDistinct("e").alias("total_entities"))
    if edges is None:
        return groups.one_row(one, ents).withColumn("total_edges", F.lit(0).cast("bigint"))
    return groups.one_row(one, ents, edges.agg(F.count("*").alias("total_edges")))


def word_cloud(articles: DataFrame, k: int = 20, categories=CATEGORIES, default="technology") -> DataFrame:
    """Terms with weight (2 per occurrence in a related article, else 1) and article count: the top ``k`` over
    all articles and of each category.

    An article is one row, so its repeated terms are counted inside the row; what is shuffled is one row per
    task, category and term.
    """
    known = F.when(F.col("category").isin(list(categories)), F.col("category")).otherwise(F.lit(default))
    counted = F.transform(F.array_distinct("keywords"), lambda t: F.struct(
        t.alias("term"), F.size(F.filter("keywords", lambda x: x == t)).alias("n")))
    words = articles.select(
        F.explode(counted).alias("c"), known.alias("category"), F.when(F.coalesce("is_related", F.lit(False)), 2).otherwise(1).alias("w")
    ).select("category", F.col("c.term").alias("term"), (F.col("c.n") * F.col("w")).alias("w")).filter(F.trim("term") != "")
    both = words.select(F.explode(F.array("category", F.lit("all"))).alias("category"), "term", "w")
    cloud = both.groupBy("category", "term").agg(F.sum("w").alias("weight"), F.count("*").alias("article_count"))
    return groups.top_k(cloud, ["category"], [F.desc("weight"), F.asc("term")], k, rank="rank")


def chip_levels(cloud: DataFrame, max_items: int = 20) -> DataFrame:
    """Display level of each cloud word by its rank within the category."""
    ranked = groups.top_k(cloud, ["category"], [F.desc("weight"), F.desc("article_count"), F.asc("term")], max_items, rank="place")
    level = (
        F.when(F.col("place") == 1, "featured").when(F.col("place") <= 3, "strong").when(F.col("place") <= 7, "medium")
        .when(F.col("place") <= 14, "normal").otherwise("small"))
    return ranked.withColumn("level", level)


def region_metrics(article_regions: DataFrame, latest: int = 5) -> DataFrame:
    """Per region: articles, articles per category, and the newest few.

    Rows are ``(region_id, id, category, published_at)``, one per article and region. The newest articles
    come from a pruned top-k, never from a list of all articles of a region.
    """
    counts = article_regions.groupBy("region_id").agg(
        F.count("*").alias("article_count"), *[F.count_if(F.col("category") == c).alias(f"{c}_count") for c in CATEGORIES])
    newest = groups.top_k(article_regions, ["region_id"], [F.desc("published_at"), F.asc("id")], latest, rank="r")
    lists = newest.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("l")).select(
        "region_id", F.transform("l", lambda x: x["id"]).alias("latest_ids"))
    return counts.join(lists, "region_id")


def region_lists(members: DataFrame, order, page_size: int = 1000, id_col: str = "id") -> DataFrame:
    """(region_id, page, first, ids): all ids of each region in ``order``, ``page_size`` to a row; ``first`` is the place of the first, from 0.

    members(region_id, id, ...), one row per id and region: articles or entities. A region of any size is spread over range
    partitions, and no list is longer than a page.
    """
    placed = ordered.running_sum(members.withColumn("_one", F.lit(1).cast("bigint")), ["region_id"], order, "_one", "_nth").withColumn("_nth", F.col("_nth") - 1)
    pages = placed.groupBy("region_id", F.floor(F.col("_nth") / page_size).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("_nth", F.col(id_col).alias("id")))).alias("_l"))
    return pages.select("region_id", "page", (F.col("page") * page_size).alias("first"), F.transform("_l", lambda x: x["id"]).alias("ids"))


def region_members(article_entities: DataFrame, graph_entities: DataFrame) -> DataFrame:
    """(region_id, entity_id, element_class): entities of the graph and of the region's articles, once each."""
    known = graph_entities.select("entity_id", "element_class").distinct()
    listed = graph_entities.select(F.explode("region_ids").alias("region_id"), "entity_id")
    return listed.unionByName(article_entities.select("region_id", "entity_id")).distinct().join(known, "entity_id")


def region_entities(article_entities: DataFrame, graph_entities: DataFrame) -> DataFrame:
    """``(region_id, entity_count, subject_count)`` over entities of the graph and of the region's articles."""
    both = region_members(article_entities, graph_entities)
    return both.groupBy("region_id").agg(
        F.count("*").alias("entity_count"), F.count_if(F.col("element_class") == "subject").alias("subject_count"))


def region_keywords(article_regions: DataFrame, blocked: DataFrame, stopwords=(), k: int = 8) -> DataFrame:
    """Top words of each region's articles, without the region's own names. blocked(region_id, term) is lower case."""
    words = article_regions.select("region_id", F.explode("keywords").alias("_w"), F.when(F.col("is_related"), 2).otherwise(1).alias("w"))
    words = words.withColumn("term", F.regexp_replace(text.clean("_w"), r"[：:，,。；;、]+$", ""))
    good = F.length("term").between(2, 24) & ~text.is_template("term")
    if stopwords:
        good = good & ~F.col("term").isin(list(stopwords))
    summed = words.filter(good).groupBy("region_id", "term").agg(F.sum("w").alias("weight"))
    names = blocked.select("region_id", F.col("term").alias("_b"))
    free = summed.join(names, (summed.region_id == names.region_id) & (F.lower(summed.term) == names["_b"]), "left_anti")
    return groups.top_k(free, ["region_id"], [F.desc("weight"), F.asc("term")], k, rank="rank")


def legend_bins(metrics: DataFrame, value: str) -> DataFrame:
    """Bins ``(bin, lo, hi)`` from the largest value: zero, then thirds; one empty bin when all are zero.

    Shares are decimals: as doubles they pass a whole number by a rounding error at some values, and the bound is one too high.
    """
    top = metrics.agg(F.coalesce(F.max(value), F.lit(0)).cast("bigint").alias("m"))
    first = F.greatest(F.lit(1), F.ceil(F.col("m") * F.lit(Decimal("0.34"))))
    second = F.greatest(first + 1, F.ceil(F.col("m") * F.lit(Decimal("0.67"))))
    m = F.col("m")

    def item(lo, hi):
        return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))

    zero = F.lit(0)
    full = F.array(item(zero, zero), item(F.lit(1), first), item(first + 1, F.least(second, m)), item(F.least(second + 1, m), m))
    kept = F.array_distinct(F.filter(full, lambda b: b["lo"] <= b["hi"]))
    bins = F.when(m <= 0, F.array(item(zero, zero))).otherwise(kept)
    return top.select(F.posexplode(bins).alias("bin", "b")).select("bin", "b.lo", "b.hi")


def assign_bin(df: DataFrame, bins: DataFrame, value: str) -> DataFrame:
    """First bin that holds each value. There are at most four bins, so they become plain conditions."""
    rows = sorted(groups.bounded(bins.select("bin", "lo", "hi"), 4) or [])
    hits = [F.when(F.col(value).between(r.lo, r.hi), F.lit(r.bin)) for r in rows]
    return df.withColumn("bin", F.coalesce(*hits, F.lit(None).cast("int")))


def region_opacity(metrics: DataFrame, value: str, base: float = 0.24, emphasized: str | None = None, cap: float = 0.82) -> DataFrame:
    """Fill opacity from each region's share of the largest value."""
    top = F.lit(metrics.agg(F.max(value).alias("m")).first().m or 0)  # one number
    shown = F.col(emphasized) if emphasized else F.lit(False)
    extra = F.when(shown, 0.16).otherwise(0.0)
    shaded = F.greatest(F.lit(base), F.least(F.lit(cap), F.lit(base) + F.least(F.lit(1.0), F.col(value) / F.greatest(top, F.lit(1))) * 0.42 + extra))
    empty = (top <= 0) | (F.col(value) <= 0)
    flat = F.when(shown, F.lit(0.44)).otherwise(F.lit(base))
    return metrics.withColumn("opacity", F.round(F.when(empty, flat).otherwise(shaded), 6))


def boundary_centers(df: DataFrame, key: str, col: str) -> DataFrame:
    """Bounding-box center of ``lng,lat;lng,lat`` boundary strings per key; unreadable points are dropped."""
    points = df.select(key, F.explode(F.split(col, ";")).alias("p")).select(key, F.split(F.trim("p"), ",").alias("xy"))
    parsed = points.select(key, F.get("xy", F.lit(0)).try_cast("double").alias("x"), F.get("xy", F.lit(1)).try_cast("double").alias("y"))
    box = parsed.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(key).agg(
        ((F.min("x") + F.max("x")) / 2).alias("lng"), ((F.min("y") + F.max("y")) / 2).alias("lat"))
    return box.select(key, F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


def run_summary(run_sources: DataFrame) -> DataFrame:
    """Totals, status and coverage of each run from its per-source rows."""
    total = run_sources.groupBy("run_id").agg(
        F.count("*").alias("sources"), F.sum("candidates").alias("candidates"), F.sum("accepted").alias("accepted"),
        F.sum("rejected").alias("rejected"), F.sum("published").alias("inserted"), F.sum("duplicates").alias("duplicates"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("coverage") == "partial").alias("partial"))
    status = (
        F.when(F.col("accepted") > 0, F.when(F.col("failed") > 0, "partial_succeeded").otherwise("succeeded"))
        .when(F.col("failed") == F.col("sources"), "failed").otherwise("succeeded"))
    coverage = F.when((F.col("failed") > 0) | (F.col("partial") > 0), "partial").otherwise("best_effort")
    return total.withColumn("status", status).withColumn("coverage", coverage)


def source_stats(cands: DataFrame) -> DataFrame:
    """Per run and source: counters, first and last date, and reject reasons as ``reason=n`` parts by name."""
    keys = ["run_id", "source_id"]
    base = cands.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"),
        F.min("published_at").alias("earliest"), F.max("published_at").alias("latest"))
    reasons = cands.filter(~F.col("accepted")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    listed = reasons.groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("n").cast("string")))).alias("reasons"))
    return base.join(listed, keys, "left").withColumn("reasons", F.coalesce("reasons", terms.strings([])))


def finalize_logs(sources: DataFrame, results: DataFrame, articles: DataFrame, seed: DataFrame) -> DataFrame:
    """Final log row per source: fetched beats seeded beats the crawl's own status."""
    published = articles.groupBy("source").agg(F.count("*").alias("_published"))
    seeded = seed.groupBy("source").agg(F.count("*").alias("_seeded"))
    rows = sources.join(results, "source", "left").join(published, "source", "left").join(seeded, "source", "left")
    live, pub, fall = F.coalesce("n_articles", F.lit(0)), F.coalesce("_published", F.lit(0)), F.coalesce("_seeded", F.lit(0))
    return rows.select(
        "source",
        F.when(live > 0, "fetched").when(fall > 0, "seeded").otherwise(F.coalesce("status", F.lit("skipped"))).alias("status"),
        F.coalesce("fetched_count", F.lit(0)).alias("fetched_count"), pub.alias("published_count"),
        F.when(live > 0, F.greatest(live - pub, F.lit(0))).when(fall > 0, F.greatest(fall - pub, F.lit(0))).otherwise(F.lit(0)).alias("duplicate_count"))


# What the address of an article page looks like.
ARTICLE_SHAPES = ["/(news|content|detail|info|article|post|story|blog|press|events?)/", "20[0-9]{2}[-/][0-9]{2}", "t20[0-9]{6}", "20[0-9]{6}"]


def candidate_pool(cands: DataFrame, k: int = 50, sources: DataFrame | None = None, url_col: str | None = None) -> DataFrame:
    """Largest groups of rejected candidates by source and reason.

    With ``sources`` only those of active sources that are bound to an entity count; with ``url_col`` only those whose
    address has the shape of an article page.
    """
    rows = cands.filter("review_status = 'rejected'")
    if url_col:
        rows = rows.filter(F.lower(url_col).rlike("|".join(f"(?:{shape})" for shape in ARTICLE_SHAPES)))
    if sources is not None:
        rows = rows.join(sources.filter(F.col("active") & (F.col("whitelist_entity_id") != "")).select("source_id"), "source_id", "left_semi")
    counts = rows.groupBy("source_id", "reject_reason").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "source_id", "reject_reason").limit(k)


def candidate_samples(cands: DataFrame, region_terms, k: int = 50) -> DataFrame:
    """Rejected candidates, home language and region first."""
    regional = terms.any_term(F.col("title"), region_terms)
    return cands.filter("review_status = 'rejected'").orderBy(
        F.when(F.col("language") == "zh", 0).otherwise(1), F.when(regional, 0).otherwise(1), F.desc("candidate_id")).limit(k)


def rows_by_source(current: DataFrame, k: int | None = None) -> DataFrame:
    out = current.groupBy("source").agg(F.count("*").alias("n"), F.min("published_at").alias("earliest"), F.max("published_at").alias("latest"))
    return out.orderBy(F.desc("n"), "source").limit(k) if k else out


def origin_counts(entities: DataFrame, sources: DataFrame, domestic) -> DataFrame:
    """One row: domestic and foreign entities and sources; ``domestic`` is a Column over both tables."""
    ent = entities.agg(F.count_if(domestic).alias("domestic_entities"), F.count("*").alias("entities"))
    src = sources.agg(F.count_if(domestic).alias("domestic_sources"), F.count("*").alias("sources"))
    return groups.one_row(ent, src).select(
        "domestic_entities", F.greatest(F.col("entities") - F.col("domestic_entities"), F.lit(0)).alias("foreign_entities"),
        "domestic_sources", F.greatest(F.col("sources") - F.col("domestic_sources"), F.lit(0)).alias("foreign_sources"))


def qualified_count(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("qualified").alias("qualified"))

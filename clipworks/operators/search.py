"""Article lists, pages, lookups and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions import groups, ordered, terms


def visible(current: DataFrame, now, min_published_at=config.MIN_PUBLISHED_AT, required_terms=None) -> DataFrame:
    """Rows that may be shown: of an active source bound to a whitelist entity, accessible, dated from ``min_published_at``
    to ``now``, and with a required term in the summary, in any case.

    Columns: active, whitelist_entity_id, url_status, published_at, summary. A null closes its gate.
    """
    wanted = config.REQUIRED_TERMS if required_terms is None else required_terms
    dated = (F.col("published_at") >= F.lit(min_published_at).cast("timestamp_ntz")) & (F.col("published_at") <= F.lit(now).cast("timestamp_ntz"))
    shown = F.col("active") & (F.col("whitelist_entity_id") != "") & (F.col("url_status") == "accessible") & dated
    return current.filter(shown).filter(terms.any_term(F.lower("summary"), [t.lower() for t in wanted]))


def matching(current: DataFrame, query="", category="", source="", region="", related_only=False, region_codes=None) -> DataFrame:
    """Rows that meet the filters that are set; unset filters add no predicate, so the rest reach the scan.

    A region is a tag or one of ``region_codes`` (code -> tag), in any case.
    """
    out = current
    if category and category != "all":
        out = out.filter(F.col("category") == category)
    if source and source != "all":
        out = out.filter(F.col("source") == source)
    if region and region != "all":
        codes = config.REGION_CODES if region_codes is None else region_codes
        out = out.filter(F.array_contains("region_tags", codes.get(region.strip().lower(), region)))
    if related_only:
        out = out.filter("is_related")
    needle = query.strip().lower()
    if needle:
        hay = F.lower(F.concat_ws(" ", "title", "summary", "source", F.concat_ws(" ", "keywords"), F.concat_ws(" ", "region_tags")))
        out = out.filter(F.contains(hay, F.lit(needle)))
    return out


def _order(oldest: bool):
    return [F.asc("published_at"), F.asc("id")] if oldest else [F.desc("published_at"), F.desc("id")]


def search_articles(current: DataFrame, limit: int = config.LIST_LIMIT, oldest: bool = False, **filters) -> DataFrame:
    """The ``limit`` newest (or oldest) matching articles."""
    return matching(current, **filters).orderBy(*_order(oldest)).limit(max(1, limit))


def page_index(current: DataFrame, oldest: bool = False, **filters) -> ordered.PageIndex:
    """Matching articles laid out for paging, newest (or oldest) first."""
    return ordered.PageIndex(matching(current, **filters), _order(oldest))


def page_articles(index: ordered.PageIndex, page: int = 1, size: int = 24) -> DataFrame:
    """One page with its position: page, totals, has_previous, has_next. Only the partitions the page lies in are read, and
    totals come from the index; page and size are raised to 1, a page past the end is the last."""
    size, total = max(1, size), index.total
    pages = -(-total // size)
    at = min(max(1, page), pages) if pages else 1
    return index.rows((at - 1) * size, size).orderBy("position").drop("position").withColumns({
        "page": F.lit(at), "page_size": F.lit(size), "total_elements": F.lit(total).cast("bigint"), "total_pages": F.lit(pages).cast("bigint"),
        "has_previous": F.lit(at > 1 and pages > 0), "has_next": F.lit(pages > 0 and at < pages)})


def next_articles(current: DataFrame, after=None, size: int = 24, oldest: bool = False, **filters) -> DataFrame:
    """The ``size`` matching articles that follow the cursor ``after`` (published_at, id); from the start without one.

    No index: each task keeps its best ``size`` rows behind the cursor.
    """
    rows = matching(current, **filters)
    if after is not None:
        place, cursor = F.struct("published_at", "id"), F.struct(F.lit(after[0]).cast("timestamp_ntz").alias("published_at"), F.lit(after[1]).alias("id"))
        rows = rows.where(place > cursor if oldest else place < cursor)
    return rows.orderBy(*_order(oldest)).limit(size)


def page_numbers(totals: DataFrame, page: str = "page", pages: str = "total_pages") -> DataFrame:
    """Page buttons per row: first, last and two on either side of the current one, with gap marks."""
    every = F.sequence(F.lit(1), F.greatest(F.col(pages), F.lit(1)))
    near = F.array(*[F.col(page) + i for i in range(-2, 3)])
    shown = F.array_sort(F.array_distinct(F.filter(
        F.concat(F.array(F.lit(1).cast("bigint"), F.col(pages).cast("bigint")), near.cast("array<bigint>")), lambda p: (p >= 1) & (p <= F.col(pages)))))
    exploded = totals.withColumn("_p", shown).select("*", F.posexplode("_p").alias("position", "number"))
    previous = F.get("_p", F.col("position") - 1)
    return exploded.withColumn("gap_before", F.coalesce((F.col("position") > 0) & (F.col("number") - previous > 1), F.lit(False))).drop("_p")


def find_article(current: DataFrame, value: str) -> DataFrame:
    """Article by id, slug, ``id-slug`` or an ``id-`` prefix; the newest when several match."""
    ident = F.col("id").cast("string")
    wanted = F.lit(value)
    hit = (ident == wanted) | (F.col("slug") == wanted) | (F.concat_ws("-", ident, "slug") == wanted) | F.startswith(wanted, F.concat(ident, F.lit("-")))
    return current.filter(hit).orderBy(F.desc("published_at"), F.desc("id")).limit(1)


def latest_per_category(df: DataFrame, n: int = 4) -> DataFrame:
    return groups.top_k(df, ["category"], [F.desc("published_at"), F.desc("id")], n, rank="rank")


def featured(df: DataFrame, n: int = 3) -> DataFrame:
    return df.orderBy(F.desc("published_at"), F.desc("id")).limit(n)


def latest_per_source(df: DataFrame, key: str = "source") -> DataFrame:
    """Newest row of each source: a pre-aggregated maximum, then one semi-join on the unique id."""
    best = df.groupBy(key).agg(F.max(F.struct("published_at", "id")).getField("id").alias("id")).select("id")
    return df.join(best, "id", "left_semi")


def related_articles(df: DataFrame, article_id, k: int = 3) -> DataFrame:
    """Articles most related to one: shared keywords and entities, category, region, language and nearness in time.

    The article is read first and becomes constants, so the rest is one scan without a join in which each task
    keeps only its best ``k``.
    """
    cols = ["keywords", "entity_ids", "category", "is_related", "language", "published_at"]
    one = df.filter(F.col("id") == article_id).select(*cols).first()
    if one is None:
        return df.limit(0).withColumn("score", F.lit(0.0))
    at = F.lit(one.published_at).cast("timestamp_ntz")
    gap = F.abs(F.timestamp_diff("MICROSECOND", F.col("published_at"), at)) / 86400000000
    score = (
        F.size(F.array_intersect("keywords", terms.strings(one.keywords))) * 2.4
        + F.size(F.array_intersect("entity_ids", terms.strings(one.entity_ids))) * 3
        + F.when(F.col("category") == one.category, 1.5).otherwise(0)
        + F.when(F.col("is_related") & F.lit(bool(one.is_related)), 1.2).otherwise(0)
        + F.when(F.col("language") == one.language, 0.5).otherwise(0)
        + F.greatest(F.lit(0.0), 2 - F.coalesce(gap, F.lit(365.0)) / 45))
    others = df.filter(F.col("id") != article_id)
    scored = groups.keep_computed(others, {"score": F.round(score, 6)}, lambda x: x["score"] > 0)
    return scored.orderBy(F.desc("score"), F.desc("published_at"), F.asc("id")).limit(k)


def rank_regions(metrics: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """Regions by priority, metric, article count and name. The region table is a small dimension."""
    order = [F.desc("is_priority"), F.desc(value), F.desc("article_count"), F.asc("name")]
    if k:
        return metrics.orderBy(*order).limit(k)
    return metrics.orderBy(*order)


def order_sources(sources: DataFrame, priority, region_terms=(), home_language="zh") -> DataFrame:
    """Sources with sort keys: listed codes first, then regional ones, home language, code."""
    listed = terms.strings(priority)
    place = F.array_position(listed, F.col("source_code"))
    regional = terms.any_term(F.concat_ws(" ", "source_code", "name", "site_url"), region_terms)
    keyed = sources.withColumns({
        "priority": F.when(place > 0, place).otherwise(len(priority) + 1000),
        "regional": F.when(regional, 0).otherwise(1), "home": F.when(F.col("language") == home_language, 0).otherwise(1)})
    return keyed.orderBy("priority", "regional", "home", "source_code")


def list_sources(sources: DataFrame, codes=None, language=None, types=None) -> DataFrame:
    out = sources.filter(F.col("active") & (F.coalesce("whitelist_entity_id", F.lit("")) != ""))
    if codes:
        out = out.filter(F.col("source_code").isin(list(codes)))
    if language:
        out = out.filter(F.col("language") == language)
    if types:
        out = out.filter(F.col("type").isin(list(types)))
    return out.orderBy("source_id")


def suggest_terms(cloud: DataFrame, query: str, k: int = 8) -> DataFrame:
    """Heaviest cloud terms other than the query."""
    best = cloud.filter(F.lower("term") != query.strip().lower()).groupBy("term").agg(F.max("weight").alias("weight"))
    return best.orderBy(F.desc("weight"), "term").limit(k)


def latest_run_logs(runs: DataFrame, run_sources: DataFrame, sources: DataFrame) -> DataFrame:
    """Per-source rows of the most recent run, with source names."""
    last = runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return run_sources.join(last, "run_id").join(sources, "source_id", "left")


def cloud_for(cloud: DataFrame, category: str = "all") -> DataFrame:
    return cloud.filter(F.col("category") == category)

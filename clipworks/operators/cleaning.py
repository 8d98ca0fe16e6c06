"""Candidates to clean articles, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions import groups, terms, text, urls
from clipworks.operators import normalize, tagging, urlset


def clean_candidates(
    cands: DataFrame, sources: DataFrame, required=config.REQUIRED_TERMS, domain_terms=config.DOMAIN_TERMS,
    region_terms=config.REGION_TERMS, hints=config.CATEGORY_TERMS, default_tag=config.DEFAULT_REGION_TAG,
    k=config.KEYWORD_LIMIT, with_slug=True,
) -> DataFrame:
    """Clean articles from candidates ``(id, source, title, summary, body, url, published_at, language)``.

    Each stage is one projection, so the document text is lower-cased and searched once.
    Keeps the source's columns that the review needs.
    """
    dim = sources.withColumnRenamed("source_code", "source").drop("name", "language")
    out = cands.join(groups.small_side(dim), "source", "inner").withColumns({
        "title": text.title("title"),
        "body": text.clean("body"),
        "summary": text.summary("summary"),
        "original_url": urls.canonical("url"),
    })
    out = out.withColumn("summary", F.when(F.col("summary") != "", F.col("summary")).otherwise(
        text.summary(terms.natural_summary("body", required))))
    out = out.withColumn("_hay", F.lower(F.concat_ws(" ", "title", "summary", "body")))
    empty = terms.strings([])
    raw = F.coalesce(F.col("raw_keywords"), empty) if "raw_keywords" in out.columns else empty
    out = out.withColumn("keywords", tagging.keyword_list(F.col("_hay"), raw, F.coalesce("whitelist", empty), domain_terms, k))
    out = out.withColumn("_full", F.concat_ws(" ", "title", "summary", "body", F.array_join("keywords", " ")))
    out = out.withColumn("_low", F.lower("_full"))
    out = out.withColumns({
        "region_tags": tagging.region_list(F.col("_full"), region_terms, default_tag),
        "category": tagging.category(F.col("_low"), hints),
    }).drop("_hay", "_full", "_low")
    out = out.withColumn("is_related", F.get("region_tags", F.lit(0)) != default_tag)
    if with_slug:
        out = normalize.add_slug(out, "title", "source", "original_url")
    out = normalize.add_stable_id(out, "source", "original_url")
    stamped = out.withColumn("_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
    return normalize.add_content_hash(
        stamped, ["title", "summary", "body", "original_url", "_at", "category", "keywords", "region_tags"]).drop("_at")


def normalize_articles(df: DataFrame, entities: DataFrame, targets: DataFrame, required=config.REQUIRED_TERMS,
                       hints=config.ARGMAX_HINTS, domain=config.DOMAIN_TERMS, regions=config.REGION_TERMS, default_tag=config.DEFAULT_REGION_TAG) -> DataFrame:
    """Articles ready for the derived datasets: strict title and summary, required term, keyword bag, entities, region tags,
    whether related to a region, category, page URL.

    The bag holds the given keywords, then the domain terms that title and summary name. Region tags are all regions that
    title, summary and keywords name, else the default tag, which makes an article unrelated.
    """
    out = groups.keep_computed(df, {"title": text.title("title")}, lambda x: x["title"] != "")
    lead = F.coalesce(F.nullif(text.strict_summary("summary"), F.lit("")), text.strict_summary("title"))
    out = groups.keep_computed(out, {"summary": lead}, lambda x: (x["summary"] != "") & terms.any_term(x["summary"], required))
    out = out.withColumn("_ts", F.concat_ws(" ", "title", "summary"))
    bag = F.array_distinct(F.concat(F.coalesce("keywords", terms.strings([])), terms.matched(F.lower("_ts"), domain, word_boundary=False)))
    out = groups.keep_computed(out, {"keywords": bag}, lambda x: x["keywords"].isNotNull())
    out = out.withColumn("_text", tagging.matching_text())
    out = tagging.with_entities(out, entities, "_text")
    named = F.concat_ws(" ", "_ts", F.concat_ws(" ", "keywords"))
    out = groups.keep_computed(out, {"region_tags": text.let(named, lambda t: terms.keep((r, F.contains(t, F.lit(r))) for r in regions))}, lambda x: x["region_tags"].isNotNull())
    out = out.withColumn("is_related", F.get("region_tags", F.lit(0)) != default_tag)
    if with_slug:
        out = normalize.add_slug(out, "title", "source", "original_url")
    out = normalize.add_stable_id(out, "source", "original_url")
    stamped = out.withColumn("_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
    return normalize.add_content_hash(
        stamped, ["title", "summary", "body", "original_url", "_at", "category", "keywords", "region_tags"]).drop("_at")


def normalize_articles(df: DataFrame, entities: DataFrame, targets: DataFrame, required=config.REQUIRED_TERMS,
                       hints=config.ARGMAX_HINTS, domain=config.DOMAIN_TERMS, regions=config.REGION_TERMS, default_tag=config.DEFAULT_REGION_TAG) -> DataFrame:
    """Articles ready for the derived datasets: strict title and summary, required term, keyword bag, entities, region tags,
    whether related to a region, category, page URL.

    The bag holds the given keywords, then the domain terms that title and summary name. Region tags are all regions that
    title, summary and keywords name, else the default tag, which makes an article unrelated.
    """
    out = groups.keep_computed(df, {"title": text.title("title")}, lambda x: x["title"] != "")
    lead = F.coalesce(F.nullif(text.strict_summary("summary"), F.lit("")), text.strict_summary("title"))
    out = groups.keep_computed(out, {"summary": lead}, lambda x: (x["summary"] != "") & terms.any_term(x["summary"], required))
    out = out.withColumn("_ts", F.concat_ws(" ", "title", "summary"))
    bag = F.array_distinct(F.concat(F.coalesce("keywords", terms.strings([])), terms.matched(F.lower("_ts"), domain, word_boundary=False)))
    out = groups.keep_computed(out, {"keywords": bag}, lambda x: x["keywords"].isNotNull())
    out = out.withColumn("_text", tagging.matching_text())
    out = tagging.with_entities(out, entities, "_text")
    named = F.concat_ws(" ", "_ts", F.concat_ws(" ", "keywords"))
    out = out.withColumn("region_tags", text.let(named, lambda t: terms.keep((r, F.contains(t, F.lit(r))) for r in regions)))
    out = out.withColumn("is_related", F.size("region_tags") > 0).withColumn("region_tags", F.when(F.col("is_related"), F.col("region_tags")).otherwise(F.array(F.lit(default_tag))))
    out = tagging.classify_argmax(out, hints, "_ts", out="category")
    return urlset.resolve_article_url(out, targets).drop("_text", "_ts")

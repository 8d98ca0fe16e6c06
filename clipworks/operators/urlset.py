"""URL jobs: canonical form, hosts, page kind, source-domain policy, best targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks.functions import groups, urls


def canonical_urls(df: DataFrame, col="url", out="canonical_url") -> DataFrame:
    return df.withColumn(out, urls.canonical(col))


def url_duplicates(df: DataFrame, key="canonical_url") -> DataFrame:
    """Keys held by more than one row (counts are combined before the shuffle)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def add_host(df: DataFrame, col="url", out="host") -> DataFrame:
    return df.withColumn(out, urls.host(col))


def flag_detail_urls(df: DataFrame, col="url", out="is_detail") -> DataFrame:
    return df.withColumn(out, urls.is_detail(col))


def flag_list_urls(df: DataFrame, col="url", blocked_hosts=()) -> DataFrame:
    blocked = urls.host(col).isin(list(blocked_hosts)) if blocked_hosts else F.lit(False)
    return df.withColumns({"is_list": urls.is_list_like(col), "is_noise": urls.is_noise(col), "is_blocked": blocked})


def domain_allowed(url, site_url, allowed_hosts, patterns):
    """Column: host of ``url`` is the site's, an allowed one, a subdomain of one, or matches a pattern."""
    host = urls.host(url)
    hosts = F.concat(F.array(urls.host(site_url)),
                     F.transform(allowed_hosts, lambda h: F.regexp_replace(F.lower(F.trim(h)), r"^www\.", "")))
    listed = F.exists(hosts, lambda h: (h != "") & urls.host_matches(host, h))
    shaped = F.exists(patterns, lambda p: (p != "") & F.regexp_like(host, F.concat(F.lit("(?i)"), p)))
    return (host != "") & (listed | shaped)


def check_source_domain(df: DataFrame, sources: DataFrame, url="url", key="source", out="domain_ok") -> DataFrame:
    """Rows joined with their source; an unknown source fails."""
    policy = sources.select(F.col("source_code").alias(key), F.col("site_url").alias("_site"),
                            F.col("allowed_hosts").alias("_hosts"), F.col("allowed_host_patterns").alias("_patterns"))
    checked = F.coalesce(domain_allowed(F.col(url), F.col("_site"), F.col("_hosts"), F.col("_patterns")), F.lit(False))
    return df.join(groups.small_side(policy), key, "left").withColumn(out, checked).drop("_site", "_hosts", "_patterns")


def best_source_target(sources: DataFrame, blocked_hosts=(), key="source_code") -> DataFrame:
    """Most specific of each source's candidate URLs (array ``targets``, in order of preference)."""
    ranked = sources.select(key, "site_url", F.posexplode("targets").alias("pos", "target")).filter(
        F.coalesce(F.col("target"), F.lit("")) != "")
    scored = ranked.withColumn("score", urls.target_score("target", "site_url", blocked_hosts))
    return scored.groupBy(key, "site_url").agg(
        F.max_by(F.struct("target", "score"), F.struct("score", -F.col("pos"))).alias("best")
    ).select(key, "site_url", F.col("best.target").alias("target"), F.col("best.score").alias("score"))


def resolve_article_url(df: DataFrame, targets: DataFrame, key="source", url="url", blocked_hosts=()) -> DataFrame:
    """The article's own page if it has one, else its source's best target, else the source's site."""
    dim = targets.select(F.col("source_code").alias(key), F.col("site_url").alias("_site"), F.col("target").alias("_target"))
    own = urls.is_specific(F.col(url), F.col("_site"), blocked_hosts) & urls.is_article_page(url)
    via = urls.is_specific(F.col("_target"), F.col("_site"), blocked_hosts) & urls.is_article_page("_target")
    pick = F.when(own, F.col(url)).when(via, F.col("_target")).otherwise(F.coalesce(F.col("_site"), F.col(url)))
    return df.join(groups.small_side(dim), key, "left").withColumn("resolved_url", pick).drop("_site", "_target")


def access_urls(df: DataFrame, mirror_hosts=(), mirror_prefix="https://web.archive.org/web/",
                original="url", source="source_url") -> DataFrame:
    """Primary and backup page address; a mirror stands in for listed hosts or a missing backup."""
    usable = F.array_distinct(F.filter(F.array(F.trim(original), F.trim(source)), lambda u: F.coalesce(urls.is_http(u), F.lit(False))))
    df = df.withColumn("_urls", usable)
    first = F.coalesce(F.get("_urls", F.lit(0)), F.lit(""))
    second = F.coalesce(F.get("_urls", F.lit(1)), F.lit(""))
    full_host = F.lower(F.coalesce(F.try_parse_url(first, F.lit("HOST")), F.lit("")))
    forced = full_host.isin(list(mirror_hosts)) if mirror_hosts else F.lit(False)
    mirrored = (first != "") & (forced | (second == ""))
    return df.withColumns({
        "primary_url": first,
        "backup_url": F.when(mirrored, F.concat(F.lit(mirror_prefix), first)).otherwise(second),
        "used_mirror": mirrored,
    }).drop("_urls")

"""The acceptance gate and the compliance check, over clean articles with their source's fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks.config import ReviewRule
from clipworks.functions import groups, terms, text, urls
from clipworks.operators import relevance, urlset


def assess(df: DataFrame, entities: DataFrame, rule: ReviewRule, entity_terms=None, id_col="id") -> DataFrame:
    """One boolean per rule, each computed once and shared by the gate, the compliance check and the audit.

    Expects the columns of ``clean_candidates``; ``url_ok`` is taken from ``url_status`` when present.
    """
    dim = entities.select(F.col("entity_id").alias("whitelist_entity_id"),
                          F.concat(F.array("name"), "aliases").alias("_own"), F.lit(True).alias("_known"))
    df = df.join(groups.small_side(dim), "whitelist_entity_id", "left")
    if entity_terms is None:
        entity_terms = entities.select(F.explode(F.concat(F.array("name"), "aliases")).alias("term"))
    df = relevance.strict_relevance(df, rule.relevance, entity_terms, id_col, own_terms="_own")
    status = F.lower(F.coalesce("url_status", F.lit(""))) == "accessible" if "url_status" in df.columns else F.lit(True)
    body_present = F.col("body") != ""
    df = df.withColumn("body_present", body_present)
    return df.withColumns({
        "source_whitelisted": F.coalesce("active", F.lit(False)) & F.col("_known").isNotNull(),
        "entity_known": F.col("_known").isNotNull(),
        "detail_url": urls.is_detail("original_url"),
        "source_url_allowed": urlset.domain_allowed(F.col("original_url"), F.col("site_url"), F.col("allowed_hosts"), F.col("allowed_host_patterns")),
        "has_required_term": terms.any_term(F.col("summary"), rule.required_terms),
        "title_only": (F.col("title") != "") & (F.col("title") == text.clean("summary")),
        "summary_from_body": terms.contained("summary", "body"),
        "url_ok": status,
        "date_in_range": F.coalesce(
            (F.col("published_at") >= F.lit(rule.min_published_at).cast("timestamp_ntz"))
            & (F.col("published_at") <= F.lit(rule.now).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(rule.grace_seconds).cast("decimal(18,6)"))),
            F.lit(False)),
    }).drop("_own", "_known")


def review(assessed: DataFrame, rule: ReviewRule, window_start: str, window_end: str) -> DataFrame:
    """Adds ``accepted`` and ``reason``: the first failing rule in gate order, '' when none fails."""
    at = F.col("published_at")

    def stamp(v):
        return F.lit(v).cast("timestamp_ntz")

    grace = F.make_dt_interval(secs=F.lit(rule.grace_seconds).cast("decimal(18,6)"))
    gates = [
        (~F.coalesce("active", F.lit(False)), "source_inactive"),
        (~F.col("entity_known"), "source_not_whitelisted"),
        (at.isNull(), "missing_published_at"),
        (at < stamp(rule.min_published_at), "published_at_before_minimum"),
        (at > stamp(rule.now), "published_at_in_future"),
        ((at < stamp(window_start)) | (at > stamp(window_end) + grace), "published_at_out_of_window"),
        (F.length("title") < rule.min_title, "title_too_short"),
        (F.length("summary") < rule.min_summary, "summary_too_short"),
        (F.col("title_only"), "summary_from_title"),
        (~F.col("has_required_term"), "summary_required_term_missing"),
        (~F.col("body_present"), "body_missing"),
        (~F.col("summary_from_body"), "summary_not_from_body"),
        (~F.col("detail_url"), "not_detail_url"),
        (~F.col("source_url_allowed"), "source_url_domain_mismatch"),
        (~F.col("url_ok"), "original_url_inaccessible"),
        (~F.col("relevant"), "body_relevance_failed"),
    ]
    reason = F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in gates], F.lit(""))
    return assessed.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


def compliance(assessed: DataFrame) -> DataFrame:
    """Adds ``reasons``, every failing rule in order, and ``qualified``."""
    dated = F.col("published_at").isNotNull()
    rules = [
        ("source_not_whitelisted", ~F.col("source_whitelisted")),
        ("missing_published_at", ~dated),
        ("date_out_of_range", dated & ~F.col("date_in_range")),
        ("not_detail_url", ~F.col("detail_url")),
        ("source_url_domain_mismatch", ~F.col("source_url_allowed")),
        ("summary_required_term_missing", ~F.col("has_required_term")),
        ("summary_from_title", F.col("title_only")),
        ("original_url_inaccessible", ~F.col("url_ok")),
        ("body_missing", ~F.col("body_present")),
        ("summary_not_from_body", ~F.col("summary_from_body")),
        ("body_relevance_failed", ~(F.col("body_present") & F.col("relevant"))),
    ]
    return assessed.withColumn("reasons", terms.keep(rules)).withColumn("qualified", F.size("reasons") == 0)

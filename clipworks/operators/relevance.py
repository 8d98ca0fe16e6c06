"""Relevance of documents to the subject: the strict rule and its lighter variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions import terms, text
from clipworks.functions.text import col_of, let
from clipworks.operators import tagging


def evidence(title="title", summary="summary", body="body") -> Column:
    """Cleaned body, or title and summary when there is none."""
    clean = text.clean(body)
    return let(clean, lambda b: F.when(b != "", b).otherwise(F.trim(F.concat_ws(" ", title, summary))))


def _with_hits(df: DataFrame, rule: config.RelevanceRule, entity_terms, id_col, keywords):
    df = df.withColumn("_ev", evidence()).withColumn("_evl", F.lower("_ev"))
    kept = F.filter(F.transform(F.coalesce(F.col(keywords), terms.strings([])), F.trim),
                    lambda w: (w != "") & F.contains(F.col("_evl"), F.lower(w))) if keywords else terms.strings([])
    df = df.withColumn("_text", F.lower(F.concat_ws(" ", "_ev", F.array_join(kept, " "))))
    df = df.withColumn("matched_core", terms.matched(F.col("_text"), rule.core_terms, rule.word_boundary))
    if isinstance(entity_terms, DataFrame):
        hits = tagging.match_terms(df, entity_terms, id_col, "_text", rule.word_boundary, True)
        per_doc = hits.groupBy(id_col).agg(F.array_sort(F.collect_set("term")).alias("matched_entities"))
        return df.join(per_doc, id_col, "left").withColumn(
            "matched_entities", F.coalesce("matched_entities", terms.strings([])))
    return df.withColumn("matched_entities", terms.matched(F.col("_text"), entity_terms, rule.word_boundary))


def strict_relevance(df: DataFrame, rule: config.RelevanceRule | None = None, entity_terms=(), id_col="id",
                     keywords: str | None = None, own_terms: str | None = None) -> DataFrame:
    """Adds ``relevant``, ``relevance_reason``, ``matched_core``, ``matched_entities`` and ``low_context``.

    Passes with ``min_core`` core terms, or with one core term and one entity outside a low-relevance
    context. Keywords count only when they are in the text. ``own_terms`` are the names of the document's
    own source entity: evidence even when absent from the text. Expects columns title, summary, body.
    """
    rule = rule or config.RelevanceRule()
    df = _with_hits(df, rule, entity_terms, id_col, keywords)
    if own_terms:
        lowered = F.transform("matched_entities", F.lower)
        extra = F.filter(F.transform(F.coalesce(F.col(own_terms), terms.strings([])), F.trim),
                         lambda t: (t != "") & ~F.array_contains(lowered, F.lower(t)))
        df = df.withColumn("matched_entities", F.array_distinct(F.concat("matched_entities", extra)))
    n_core, n_entity = F.size("matched_core"), F.size("matched_entities")
    enough = n_core >= rule.min_core
    low = ~enough & terms.any_term(F.col("_ev"), rule.low_terms)
    helped = F.lit(rule.allow_entity) & (n_core >= 1) & (n_entity >= 1) & ~low
    reason = (
        F.when(enough, F.format_string("匹配%d个核心关键词", n_core))
        .when(helped, F.lit("匹配1个核心关键词+1个实体名称"))
        .otherwise(F.format_string("仅匹配%d个核心关键词和%d个实体名称，不满足最低要求", n_core, n_entity))
    )
    return df.withColumns({"relevant": enough | helped, "low_context": low, "relevance_reason": reason}).drop("_ev", "_evl", "_text")


def source_relevance(df: DataFrame, domain_terms, region_terms, source_rules: dict | None = None, key="source") -> DataFrame:
    """Lighter check on title and summary: a domain term, or a region term unless the source is domain-only.

    ``source_rules`` maps a source to its extra pattern; a source in it is accepted on pattern or domain term alone.
    """
    df = df.withColumn("_low", F.lower(F.concat_ws(" ", "title", "summary")))
    own = F.exists(F.coalesce(F.col("whitelist"), terms.strings([])), lambda w: F.contains(F.col("_low"), F.lower(w))) \
        if "whitelist" in df.columns else F.lit(False)
    domain = terms.any_term(F.col("_low"), [t.lower() for t in domain_terms]) | own
    region = terms.any_term(F.col("_low"), [t.lower() for t in region_terms])
    verdict = domain | region
    for source, pattern in (source_rules or {}).items():
        special = domain | F.col("_low").rlike("(?i)" + pattern) if pattern else domain
        verdict = F.when(F.col(key) == source, special).otherwise(verdict)
    return df.withColumn("source_relevant", verdict).drop("_low")


def core_relevance(df: DataFrame, rule: config.RelevanceRule, key="source") -> DataFrame:
    """Variant for replay: two core terms, or one with a named source outside a low-relevance context."""
    df = df.withColumn("_txt", F.concat_ws(" ", "title", "summary")).withColumn("_low", F.lower("_txt"))
    core = F.size(terms.matched(F.col("_low"), rule.core_terms, rule.word_boundary))
    low = terms.any_term(F.col("_txt"), rule.low_terms)
    named = F.coalesce(F.col(key), F.lit("")) != ""
    return df.withColumn("core_relevant", (core >= 2) | ((core >= 1) & ~low & named)).drop("_txt", "_low")


def flag_low_context(df: DataFrame, low_terms=config.LOW_CONTEXT_TERMS, col="body", out="low_context") -> DataFrame:
    return df.withColumn(out, terms.any_term(col_of(col), low_terms))

"""Quality reports over reviewed articles, graphs and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks.functions import groups, terms, text, urls
from clipworks.operators import tagging
from clipworks.sources.tables import materialize


def rate(part, whole):
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), 6)


def with_duplicate_reason(checked: DataFrame, id_col="id", source="source", url="original_url") -> DataFrame:
    """Adds ``duplicate_canonical_url`` to the reasons of every row after the first of its source and URL."""
    marked = groups.mark_later(checked, id_col, [source, url], [], "is_duplicate")
    extra = F.when(F.col("is_duplicate"), F.array(F.lit("duplicate_canonical_url"))).otherwise(terms.strings([]))
    return marked.withColumn("reasons", F.concat("reasons", extra)).withColumn("qualified", F.size("reasons") == 0)


def quality_audit(checked: DataFrame, target: int, language: str = "zh") -> DataFrame:
    """One row of totals, per-rule counters and rates over rows with ``reasons``; one pass, one tiny exchange."""
    counters = [
        "source_not_whitelisted", "date_out_of_range", "not_detail_url", "source_url_domain_mismatch",
        "original_url_inaccessible", "body_missing", "summary_not_from_body", "summary_required_term_missing",
        "body_relevance_failed", "duplicate_canonical_url",
    ]
    out = checked.agg(
        F.count("*").alias("total"),
        F.count_if("qualified").alias("qualified"),
        F.count_if(F.lower("language") == language).alias("in_language"),
        F.count_if("is_related").alias("related"),
        F.count_if("url_ok").alias("accessible"),
        *[F.count_if(F.array_contains("reasons", c)).alias(c) for c in counters],
    )
    return out.withColumns({
        "missing_to_target": F.greatest(F.lit(target) - F.col("qualified"), F.lit(0)),
        "url_rate": rate(F.col("accessible"), F.col("total")),
        "source_coverage": rate(F.col("total") - F.col("source_not_whitelisted"), F.col("total")),
    })


def reason_counts(sets: DataFrame, reasons="reasons") -> DataFrame:
    """(reason, n) from counted sets of reasons. A plain explode would bring a filter on the set, which is pushed below
    the checks and makes all of them twice."""
    each = sets.select(F.explode_outer(reasons).alias("reason"), "n").filter("reason IS NOT NULL")
    return each.groupBy("reason").agg(F.sum("n").alias("n"))


def top_reasons(df: DataFrame, k: int = 10, reasons="reasons") -> DataFrame:
    """Most frequent reasons with counts; ties by name."""
    counts = reason_counts(df.groupBy(reasons).agg(F.count("*").alias("n")), reasons)
    return counts.orderBy(F.desc("n"), "reason").limit(k)


def mark_duplicates(df: DataFrame, id_col: str, keys, order=()) -> DataFrame:
    return groups.mark_later(df, id_col, keys, list(order))


def problems(checked: DataFrame, id_col="id") -> DataFrame:
    return checked.select(id_col, F.explode_outer("reasons").alias("reason")).filter("reason IS NOT NULL")  # the checks are made once


def assert_report(checked: DataFrame) -> DataFrame:
    """Long report ``(metric, n)``: total, qualified, problem count and one row per reason."""
    sets = materialize(checked.groupBy("reasons", "qualified").agg(F.count("*").alias("n")))  # a few sets of reasons, counted in one pass
    sums = {"total": F.col("n"), "qualified": F.when(F.col("qualified"), F.col("n")).otherwise(0), "problems": F.size("reasons") * F.col("n")}
    totals = sets.agg(*[F.sum(c).alias(m) for m, c in sums.items()])
    totals = totals.withColumns({m: F.coalesce(m, F.lit(0)) for m in ("total", "qualified")})
    wide = totals.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in totals.columns]), F.array(*totals.columns))).alias("metric", "n"))
    return wide.unionByName(reason_counts(sets).withColumnRenamed("reason", "metric"))


def problem_samples(checked: DataFrame, k: int = 20, id_col="id") -> DataFrame:
    return problems(checked, id_col).orderBy(id_col, "reason").limit(k)


def keyword_distribution(df: DataFrame, core_terms, col="body", word_boundary=True) -> DataFrame:
    """Long report ``(kind, key, n)``: rows per term, and rows per number of terms."""
    found = df.withColumn("_low", F.lower(col)).select(terms.matched(F.col("_low"), core_terms, word_boundary).alias("hits"))
    entries = F.concat(
        F.transform("hits", lambda t: F.struct(F.lit("term").alias("kind"), t.alias("key"))),
        F.array(F.struct(F.lit("hits_per_row").alias("kind"), F.size("hits").cast("string").alias("key"))))
    return found.select(F.explode(entries).alias("e")).groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


def deletion_preview(heads: DataFrame, versions: DataFrame) -> DataFrame:
    """Failing heads by reason, and how many versions would go with them. ``versions`` carry relevance columns."""
    counts = versions.groupBy("news_id").agg(F.count("*").alias("n_versions"))
    bad = (
        heads.select("news_id", F.col("current_version_id").alias("version_id"))
        .join(versions.select("version_id", "relevant", "relevance_reason"), "version_id")
        .filter(~F.col("relevant"))
    )
    return bad.join(counts, "news_id").groupBy("relevance_reason").agg(
        F.count("*").alias("heads"), F.sum("n_versions").alias("versions"))


def deletion_samples(heads: DataFrame, versions: DataFrame, k: int = 100) -> DataFrame:
    bad = heads.select("news_id", F.col("current_version_id").alias("version_id")).join(
        versions.select("version_id", "relevant", "relevance_reason", "title"), "version_id").filter(~F.col("relevant"))
    return bad.orderBy("news_id").limit(k)


def date_report(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    low, high = F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")
    return df.agg(
        F.count("*").alias("total"), F.min(col).alias("earliest"), F.max(col).alias("latest"),
        F.count_if(F.col(col) < low).alias("before_min"), F.count_if(F.col(col) > high).alias("after_max"),
        F.count_if(F.col(col).isNull()).alias("undated"))


def out_of_range(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    return df.filter((F.col(col) < F.lit(lo).cast("timestamp_ntz")) | (F.col(col) > F.lit(hi).cast("timestamp_ntz")))


def hash_sample(df: DataFrame, key: str, k: int, strata=(), seed: int = 7) -> DataFrame:
    """The ``k`` rows of each stratum whose hashed keys are smallest: the same rows however the table is partitioned.

    Samples of parts merge: the sample of a union is the sample of the parts' samples. Each task forwards at most ``k``
    rows of a stratum. ``key`` is unique; without strata the whole table is one.
    """
    order = [F.asc(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))), F.asc(key)]
    return groups.top_k(df, list(strata), order, k) if strata else df.orderBy(*order).limit(k)


def update_url_status(versions: DataFrame, fetches: DataFrame, url="url") -> DataFrame:
    """URL status and final URL from a fetch-result table (url, status_code; optional final_url); rows not fetched keep theirs.

    A URL that was reached at least once is accessible. Of several final URLs of reached fetches the last in order of
    text is taken.
    """
    ok = F.col("status_code").between(200, 399)
    final = F.max(F.when(ok, F.nullif("final_url", F.lit("")))) if "final_url" in fetches.columns else F.lit(None).cast("string")
    checked = fetches.groupBy(url).agg(F.max(ok).alias("_ok"), final.alias("_final"))
    status = F.when(F.col("_ok"), "accessible").when(~F.col("_ok"), "inaccessible").otherwise(F.col("url_status"))
    out = versions.join(checked, url, "left").withColumn("url_status", status).withColumn("checked", F.col("_ok").isNotNull())
    kept = F.col("final_url") if "final_url" in versions.columns else F.lit(None).cast("string")
    return out.withColumn("final_url", F.coalesce("_final", kept)).drop("_ok", "_final")


def accessibility_report(versions: DataFrame, fetches: DataFrame, url="url", strata=()) -> DataFrame:
    """Totals and the share of checked URLs that are accessible, for each stratum. Pass a ``hash_sample`` to check a sample."""
    updated = update_url_status(versions, fetches, url)
    out = updated.groupBy(*strata).agg(
        F.count("*").alias("total"), F.count_if("checked").alias("checked"),
        F.count_if(F.col("checked") & (F.col("url_status") == "accessible")).alias("accessible"),
        F.count_if(F.col("checked") & (F.col("url_status") != "accessible")).alias("inaccessible"))
    return out.withColumn("rate", rate(F.col("accessible"), F.col("checked")))


def invalid_summaries(verified: DataFrame, versions: DataFrame) -> DataFrame:
    """(news_id, version_id): what a clean-up after ``verify_summaries`` deletes, all versions of each invalid current article."""
    bad = verified.filter(~F.col("valid")).select("news_id").distinct()
    return versions.select("news_id", "version_id").join(bad, "news_id", "left_semi")


def verify_summaries(current: DataFrame, fetches: DataFrame, url="url", body="body", summary="summary") -> DataFrame:
    """Bodies filled from the fetch table where missing, then each summary judged: ``valid`` and ``verdict``."""
    pages = fetches.groupBy(url).agg(F.max("page_text").alias("_page"))
    filled = current.join(pages, url, "left").withColumn(
        body, F.coalesce(F.nullif(text.clean(body), F.lit("")), "_page", F.lit(""))).drop("_page")
    filled = filled.withColumn("_in", terms.contained(summary, body))
    verdict = (
        F.when(F.col(body) == "", "body_missing").when(text.clean(summary) == "", "summary_missing")
        .when(F.col("_in"), "ok").otherwise("summary_not_from_body"))
    return filled.withColumn("verdict", verdict).withColumn("valid", F.col("verdict") == "ok").drop("_in")


def audit_graph(nodes: DataFrame, edges: DataFrame, scopes: DataFrame, min_nodes: int, min_scope_nodes: int,
                min_scope_classes: int, root: str) -> DataFrame:
    """Violations ``(rule, item)`` of a graph: size, duplicates, blanks, dangling, isolated, evidence, scope coverage."""
    def rows(df, rule, item):
        return df.select(F.lit(rule).alias("rule"), item.cast("string").alias("item"))

    ids = nodes.select("id").distinct()
    small = nodes.agg(F.count("*").alias("n")).filter(F.col("n") < min_nodes)
    duplicate = nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    blank = nodes.filter(F.trim(F.coalesce("name", F.lit(""))) == "")
    ends = edges.select("source_id", "target_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    dangling = ends.join(ids, "id", "left_anti").select("source_id", "target_id").distinct()
    isolated = ids.filter(F.col("id") != root).join(ends.select("id"), "id", "left_anti")
    bare = edges.filter(F.coalesce("n_refs", F.lit(0)) == 0)
    member = nodes.select("id", "element_class", F.explode(F.array_distinct(F.concat(
        F.array("id", "parent_id"), "region_ids"))).alias("scope_id"))
    cover = scopes.select("scope_id").join(member, "scope_id", "left").groupBy("scope_id").agg(
        F.countDistinct("id").alias("total"), F.countDistinct("element_class").alias("classes"))
    thin = cover.filter((F.col("total") < min_scope_nodes) | (F.col("classes") < min_scope_classes))
    pair = F.concat_ws(">", "source_id", "target_id")
    parts = [
        rows(small, "too_few_nodes", F.col("n")), rows(duplicate, "duplicate_id", F.col("id")), rows(blank, "blank_name", F.col("id")),
        rows(dangling, "dangling_edge", pair), rows(isolated, "isolated_node", F.col("id")), rows(bare, "edge_without_evidence", pair),
        rows(thin, "thin_scope", F.concat_ws(":", "scope_id", F.col("total").cast("string"), F.col("classes").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts)


# Contract rules: each returns violations (rule, id).
def _violations(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))


def unique_key(df, key, rule) -> DataFrame:
    return _violations(df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), rule, key)


def required_fields(df, key, cols, rule) -> DataFrame:
    blank = reduce(lambda a, b: a | b, [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in cols])
    return _violations(df.filter(blank), rule, key)


def enum_member(df, key, col, allowed, rule) -> DataFrame:
    return _violations(df.filter(~F.coalesce(F.col(col).isin(list(allowed)), F.lit(False))), rule, key)


def foreign_key(df, key, col, parent, parent_col, rule) -> DataFrame:
    known = parent.select(F.col(parent_col).alias(col))
    return _violations(df.join(known, col, "left_anti"), rule, key)


def size_between(df, key, size, lo, hi, rule) -> DataFrame:
    return _violations(df.filter(~size.between(lo, hi)), rule, key)


def recount(stored, key, stored_col, detail, rule) -> DataFrame:
    """Stored counts that differ from the counted detail rows (groups without detail count as zero)."""
    counted = detail.groupBy(key).agg(F.count("*").alias("_n"))
    wrong = stored.join(counted, key, "left").filter(F.coalesce("_n", F.lit(0)) != F.col(stored_col))
    return _violations(wrong, rule, key)


def check_contracts(rules) -> DataFrame:
    """Union of rule results; an empty result means that every contract holds."""
    return reduce(DataFrame.unionByName, list(rules))


def missing_terms(df: DataFrame, wanted, scope_col: str, col="body") -> DataFrame:
    """``(scope, term)`` for every wanted term that no text of the scope contains."""
    found = df.select(scope_col, *[F.contains(F.col(col), F.lit(t)).alias(f"t{i}") for i, t in enumerate(wanted)])
    seen = found.groupBy(scope_col).agg(*[F.max(f"t{i}").alias(f"t{i}") for i in range(len(wanted))])
    gaps = terms.keep((t, ~F.coalesce(F.col(f"t{i}"), F.lit(False))) for i, t in enumerate(wanted))
    return seen.select(scope_col, F.explode(gaps).alias("term"))


def outage_guard(decisions: DataFrame, min_rows=20, min_fail=0.5, min_flip=0.8) -> DataFrame:
    """One row: whether a mass delete looks like a verifier outage. decisions(failed, url_status, reasons)."""
    only_down = (F.col("url_status") == "accessible") & (F.size("reasons") == 1) & F.array_contains("reasons", "original_url_inaccessible")
    out = decisions.agg(
        F.count("*").alias("scanned"), F.count_if("failed").alias("failing"),
        F.count_if(F.col("failed") & only_down).alias("flipped"))
    guard = (F.col("scanned") >= min_rows) & (F.col("failing") / F.greatest("scanned", F.lit(1)) >= min_fail) & (
        F.col("failing") > 0) & (F.col("flipped") / F.greatest("failing", F.lit(1)) >= min_flip)
    return out.withColumn("abort", guard)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])

"""Second chances: replay of rejected candidates, restore from audits, backfill, month windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks import config
from clipworks.functions import groups, ordered, text, urls
from clipworks.operators import extract, normalize, review, urlset, versions


def retitled(cands: DataFrame, raw="raw_title", cleaned="cleaned_title", source="source_name", min_title: int = 6) -> DataFrame:
    """Candidates with the ``title`` that a replay judges: the cleaned one if long enough, else what the raw one still holds."""
    return normalize.recover_title(cands, raw, cleaned, source, min_title)


def replay(assessed: DataFrame, reasons, rule: config.ReviewRule, start: str, end: str, min_title: int = 6) -> DataFrame:
    """Candidates rejected for one of ``reasons``, reviewed again: ``outcome`` skipped or accepted, with the new status.

    Expects assessed candidates with ``review_status`` and ``reject_reason``; ``retitled`` ones for titles that were too short.
    """
    wanted = [reasons] if isinstance(reasons, str) else list(reasons)
    rows = assessed.filter((F.col("review_status") == "rejected") & F.col("reject_reason").isin(wanted))
    judged = review.review(rows, rule, start, end)
    ok = F.col("accepted") & F.col("detail_url") & (F.length("title") >= min_title)
    return judged.withColumns({
        "outcome": F.when(ok, "accepted").otherwise("skipped"),
        "review_status": F.when(ok, "accepted").otherwise(F.col("review_status")),
        "reject_reason": F.when(ok, F.concat(F.lit("replayed_from_"), "reject_reason")).otherwise(F.col("reject_reason")),
    })


def replay_counts(replayed: DataFrame, heads: DataFrame, vers: DataFrame, now: str) -> DataFrame:
    """One row: scanned, accepted, skipped, and inserted or duplicate versions."""
    taken = replayed.filter("outcome = 'accepted'").select(
        F.col("id").alias("seq"), "source_id", F.col("original_url").alias("canonical_url"), F.lit("").alias("slug"), "content_hash")
    stats = versions.upsert_versions(heads, vers, taken, now)[2]
    total = replayed.agg(F.count("*").alias("scanned"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))
    return groups.one_row(total, stats)


def replay_strict(cands: DataFrame, reasons, order, judge, need: int, languages=None, codes=None, without_codes=(), with_accepted=False,
                  scan_limit: int | None = None) -> tuple[DataFrame, int]:
    """(rows, judged): candidates of many reasons in priority order that comply when read again, until ``need`` are found.

    cands(id, source_code, language, review_status, reject_reason and what ``order`` names). ``judge`` rebuilds the given
    candidates from their pages and keeps those that comply, see ``rebuild``; it sees no more of them than it must.
    ``scan_limit`` bounds how many are looked at.
    """
    status = (F.col("review_status") == "rejected") & F.col("reject_reason").isin(list(reasons)) | (F.lit(with_accepted) & (F.col("review_status") == "accepted"))
    rows = cands.filter(status & ~F.col("source_code").isin(list(without_codes)))
    if languages:
        rows = rows.filter(F.col("language").isin(list(languages)))
    if codes:
        rows = rows.filter(F.col("source_code").isin(list(codes)))
    if scan_limit is not None:
        rows = ordered.PageIndex(rows, order).rows(0, scan_limit).drop("position")
    return ordered.first_passing(rows, order, judge, need)


def rebuild(cands: DataFrame, pages: DataFrame, sources: DataFrame, required=config.REQUIRED_TERMS) -> DataFrame:
    """Candidates (id, source_id, url, ...) made anew from their fetched pages (url, html, final_url if there is one), with
    their sources' fields: detail pages of an allowed domain only, before and after a redirect.

    The candidate's own date, if any, wins over the page's. Cheap tests come before the page is joined and read.
    """
    own = cands.drop(*[c for c in sources.columns if c != "source_id"])
    given = own.withColumn("canonical_url", urls.canonical("url")).filter(urls.is_detail("canonical_url")).join(sources, "source_id")
    allowed = lambda url: urlset.domain_allowed(F.col(url), F.col("site_url"), F.col("allowed_hosts"), F.col("allowed_host_patterns"))
    fetched = pages.select(urls.canonical("url").alias("canonical_url"), "html", (F.col("final_url") if "final_url" in pages.columns else F.lit(None).cast("string")).alias("_final"))
    met = given.filter(allowed("canonical_url")).drop("url").join(fetched, "canonical_url")
    met = met.withColumn("original_url", F.coalesce(F.nullif(urls.canonical("_final"), F.lit("")), "canonical_url")).filter(allowed("original_url")).withColumn("url", F.col("original_url"))
    known = F.col("published_at") if "published_at" in cands.columns else None
    if known is not None:
        met = met.withColumnRenamed("published_at", "_given")
    rebuilt = extract.pages_to_candidates(met, required, F.col("_given") if known is not None else None)
    return rebuilt.filter((F.length("title") >= 6) & (F.length("summary") >= 12)).drop("_given", "_final")


def restore_from_audit(audit: DataFrame, pages: DataFrame, heads: DataFrame, required=config.REQUIRED_TERMS, judge=None) -> DataFrame:
    """Articles to insert again: audit rows marked for deletion, one per source and URL, rebuilt from their fetched pages.

    audit(source_id, original_url, published_at, action); pages(url, html). The audited date wins over the page's.
    ``judge`` adds ``qualified`` to the rebuilt rows, as ``review.compliance`` does over assessed ones; without it all
    rebuilt rows with a title, a summary and a detail URL qualify.
    """
    wanted = audit.filter("action = 'will_delete'").withColumn("canonical_url", urls.canonical("original_url")).groupBy("source_id", "canonical_url").agg(
        F.max("published_at").alias("audited_at"))
    fetched = pages.withColumn("canonical_url", urls.canonical("url")).join(wanted, "canonical_url")
    rebuilt = extract.pages_to_candidates(fetched, required, F.col("audited_at")).drop("audited_at").filter(
        (F.length("title") >= 6) & (F.col("summary") != "") & urls.is_detail("canonical_url"))
    if judge is not None:
        rebuilt = judge(rebuilt).filter("qualified")
    rows = rebuilt.withColumns({
        "content_hash": F.sha2(F.concat_ws("\n", "title", "summary", "canonical_url"), 256), "seq": F.col("page_id"),
        "slug": text.slug("title", "source_id", "canonical_url")})
    return versions.insert_new(heads, rows)


def backfill_to_target(n_qualified: int, cands: DataFrame, target: int, order, judge) -> tuple[DataFrame, int]:
    """(rows, judged): the first candidates that qualify by ``judge``, as many as are missing to the target."""
    return ordered.first_passing(cands, order, judge, max(0, target - n_qualified))


def month_windows(df: DataFrame, start: str, end: str, months: int, max_windows: int | None = None) -> DataFrame:
    """Consecutive windows ``(window, starts, ends)`` from ``start`` to ``end``; the last one is cut at the end.

    ``start`` and ``end`` are columns of ``df``; every row is expanded to its own windows.
    """
    begins = F.sequence(F.col(start), F.col(end), F.make_ym_interval(months=F.lit(months)))
    if max_windows:
        begins = F.slice(begins, 1, max_windows)
    rows = df.withColumn("_b", F.filter(begins, lambda b: b < F.col(end))).select("*", F.posexplode("_b").alias("window", "starts"))
    stop = F.least(F.col("starts") + F.make_ym_interval(months=F.lit(months)), F.col(end))
    return rows.withColumn("ends", stop).drop("_b")

"""Cleanup plans and their application. A plan is a table of actions; a dry run is the plan alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks.sources.tables import materialize


def _plan(heads: DataFrame, versions: DataFrame, ok: str, best) -> DataFrame:
    """Actions ``(action, news_id, version_id)`` for heads whose current version fails.

    The verdicts are computed once and written as a narrow table, since two branches read them. One grouped pass
    per head (combined before the shuffle) decides; one join brings the decision to the versions.
    """
    flagged = materialize(versions.select("news_id", "version_id", F.col(ok).alias("_ok"), best.alias("_order")))
    state = heads.select("news_id", "current_version_id").join(flagged, "news_id").groupBy("news_id").agg(
        F.max(F.when(F.col("version_id") == F.col("current_version_id"), F.col("_ok"))).alias("_current_ok"),
        F.max_by("version_id", F.when(F.col("_ok"), F.col("_order"))).alias("_any"),
        F.max(F.when(F.col("_ok"), F.col("_order"))).alias("_best"))
    bad = state.filter("NOT _current_ok").select("news_id", F.when(F.col("_best").isNotNull(), F.col("_any")).alias("_pick"))
    moved = bad.filter("_pick IS NOT NULL").select(F.lit("set_current").alias("action"), "news_id", F.col("_pick").alias("version_id"))
    gone = bad.filter("_pick IS NULL").select(F.lit("delete_head").alias("action"), "news_id", F.lit(None).cast("bigint").alias("version_id"))
    drop = flagged.filter("NOT _ok").join(bad.select("news_id"), "news_id").select(F.lit("delete_version").alias("action"), "news_id", "version_id")
    return moved.unionByName(gone).unionByName(drop)


def plan_relevance_cleanup(heads: DataFrame, versions: DataFrame, ok="relevant") -> DataFrame:
    """Failing current version: the first passing version takes over; without one the head and all versions go."""
    return _plan(heads, versions, ok, -F.col("version_id"))


def plan_noncompliant_cleanup(heads: DataFrame, versions: DataFrame, ok="qualified") -> DataFrame:
    """As the relevance plan, but the newest qualified version takes over."""
    return _plan(heads, versions, ok, F.struct(F.col("published_at"), -F.col("version_id")))


def latest_fetches(heads: DataFrame, empty: DataFrame, fetches: DataFrame, url="original_url") -> DataFrame:
    """``(version_id, url, fetch_id)``: the latest fetch for each current version among ``empty`` (version_id, url), those without a body.

    fetches(url, fetch_id) lists the fetches that brought a text. No text is read here.
    """
    lacking = empty.select("version_id", url).join(heads.select(F.col("current_version_id").alias("version_id")), "version_id", "left_semi")
    return fetches.groupBy(url).agg(F.max("fetch_id").alias("fetch_id")).join(lacking, url).select("version_id", url, "fetch_id")


def body_backfill(heads: DataFrame, versions: DataFrame, fetches: DataFrame, url="original_url") -> DataFrame:
    """``(version_id, body)`` for current versions without a body whose page was fetched: the text of the latest fetch.

    fetches(url, page_text, fetch_id).
    """
    some = fetches.filter("page_text <> ''")
    latest = latest_fetches(heads, versions.filter(F.coalesce("body", F.lit("")) == ""), some.select(url, "fetch_id"), url)
    return latest.join(some, [url, "fetch_id"]).groupBy("version_id").agg(F.max("page_text").alias("body"))


def fill_bodies(versions: DataFrame, found: DataFrame) -> DataFrame:
    """``versions`` with the bodies of ``found`` (version_id, body) in the place of missing ones."""
    made = F.when(F.coalesce("body", F.lit("")) == "", F.coalesce("_found", "body")).otherwise(F.col("body"))
    return versions.join(found.select("version_id", F.col("body").alias("_found")), "version_id", "left").withColumn("body", made).drop("_found")


def plan_date_cleanup(heads: DataFrame, versions: DataFrame, lo: str, hi: str) -> DataFrame:
    """Versions outside the range go; their heads point to the newest version inside it or go too.

    Heads and versions meet in one grouped pass that is combined before the shuffle. Its marks are plain columns, so where
    only the actions are read (a count of them) the pick and the sort it needs are left out.
    """
    low, high = F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")
    at = F.col("published_at")
    dated = versions.select("news_id", "version_id", at.alias("_at"), ((at < low) | (at > high)).alias("_out"))
    marks = dated.withColumn("_head", F.lit(False)).unionByName(heads.select("news_id", F.lit(True).alias("_head")), allowMissingColumns=True)
    state = marks.filter("news_id IS NOT NULL").groupBy("news_id").agg(
        F.max("_head").alias("_known"), F.max("_out").alias("_hit"),
        F.max(F.when(~F.col("_out"), F.col("_at"))).alias("_last"), F.max(F.when(~F.col("_out") & F.col("version_id").isNotNull(), F.col("_at"))).alias("_named"),
        F.max(F.when(~F.col("_out"), F.struct("_at", "version_id"))).getField("version_id").alias("_pick")).filter("_known AND _hit")
    done = state.select(F.when(F.col("_last") == F.col("_named"), "set_current").otherwise("delete_head").alias("action"), "news_id", F.col("_pick").alias("version_id"))
    parts = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # ids compress well: partitions joined by bytes sort too many rows in one task
    drop = dated.filter("_out").repartition(parts, "news_id").join(heads.select("news_id").repartition(parts, "news_id"), "news_id", "left_semi")
    return done.unionByName(drop.select(F.lit("delete_version").alias("action"), "news_id", "version_id"))


def plan_source_delete(sources: DataFrame, heads: DataFrame, versions: DataFrame) -> DataFrame:
    """Everything of the given sources (rows of ``sources``): versions, heads, and the sources set inactive."""
    gone = heads.join(sources.select("source_id"), "source_id", "left_semi")
    drop = versions.join(gone.select("news_id"), "news_id", "left_semi")
    none = F.lit(None).cast("bigint")
    return (
        drop.select(F.lit("delete_version").alias("action"), "news_id", "version_id")
        .unionByName(gone.select(F.lit("delete_head").alias("action"), "news_id", none.alias("version_id")))
        .unionByName(sources.select(F.lit("deactivate_source").alias("action"), F.col("source_id").alias("news_id"), none.alias("version_id")))
    )


def apply_cleanup(heads: DataFrame, versions: DataFrame, plan: DataFrame):
    """``(heads, versions)`` after a plan; heads left pointing at a deleted version move to their newest one.

    The plan and the keys of what is left are written once as narrow tables, since several branches read them; the newest
    version is looked up only for heads whose own is gone.
    """
    plan = materialize(plan.select("action", "news_id", "version_id"))
    drop = plan.filter("action = 'delete_version'").select("version_id")
    gone = plan.filter("action = 'delete_head'").select("news_id")
    moved = plan.filter("action = 'set_current'").select("news_id", F.col("version_id").alias("_to"))
    left = versions.join(drop, "version_id", "left_anti").join(gone, "news_id", "left_anti")
    keys = materialize(left.select("news_id", "version_id", "published_at"))
    kept = heads.join(gone, "news_id", "left_anti").join(moved, "news_id", "left").withColumn(
        "current_version_id", F.coalesce("_to", "current_version_id")).drop("_to")
    live = keys.select("version_id", F.lit(True).alias("_live"))
    checked = kept.join(live, kept.current_version_id == live.version_id, "left").drop("version_id")
    lost = kept.join(keys.select(F.col("version_id").alias("current_version_id")), "current_version_id", "left_anti").select("news_id")
    newest = keys.join(lost, "news_id", "left_semi").groupBy("news_id").agg(F.max(F.struct("published_at", "version_id")).getField("version_id").alias("_newest"))
    fixed = checked.join(newest, "news_id", "left").filter(F.col("_live") | F.col("_newest").isNotNull())
    fixed = fixed.withColumn("current_version_id", F.when(F.col("_live"), F.col("current_version_id")).otherwise(F.col("_newest")))
    return fixed.drop("_live", "_newest"), left


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))


def cleanup_log_row(plan: DataFrame, cleanup_type: str, criteria: dict, dry_run: bool) -> DataFrame:
    """One log row: type, criteria as JSON, counts and status."""
    counts = plan.agg(
        F.count_if(F.col("action") == "delete_head").alias("deleted_heads"),
        F.count_if(F.col("action") == "delete_version").alias("deleted_versions"),
        F.count_if(F.col("action") == "set_current").alias("updated_heads"))
    return counts.select(
        F.lit(cleanup_type).alias("cleanup_type"), F.lit(json.dumps(criteria, ensure_ascii=False, sort_keys=True)).alias("criteria"),
        F.lit(dry_run).alias("dry_run"), "deleted_heads", "deleted_versions", "updated_heads",
        F.lit("preview" if dry_run else "completed").alias("status"))

"""Faults found in the fifth round's review."""

import datetime as dt

from clipworks.operators import cleanup
from clipworks.plans import version_queries
from clipworks.sources import bind


def dated(spark):
    """Heads and versions of news with all, some and no dates in range, without a date or a head, and with ties."""
    rows = [(1, 11, 2), (1, 12, 1), (2, 21, 9), (2, 22, 2), (2, 23, 3), (2, 24, 3), (3, 31, 9), (3, 32, 9), (4, 41, None), (4, 42, 9), (5, 51, 9), (None, 61, 9), (2, 21, 9), (7, 71, 9), (7, None, 3), (7, 72, 2), (8, 81, 3), (8, 82, 9)]
    versions = spark.createDataFrame([(n, v, d and dt.datetime(2024, 1, d)) for n, v, d in rows], "news_id BIGINT, version_id BIGINT, published_at TIMESTAMP_NTZ")
    return spark.createDataFrame([(1, 11), (2, 21), (3, 31), (4, 41), (6, 1), (None, 61), (7, 71), (8, 99)], "news_id BIGINT, current_version_id BIGINT"), versions


def test_date_plan_meets_heads_once_for_both_verdicts(spark):
    """F16: each of the three kinds of action joined and sorted heads and versions of its own."""
    heads, versions = dated(spark)
    plan = cleanup.plan_date_cleanup(heads, versions, "2024-01-01", "2024-01-05")
    want = [("delete_head", 3, -1), ("delete_head", 4, -1), ("delete_head", 7, -1), ("delete_version", 2, 21), ("delete_version", 2, 21), ("delete_version", 3, 31), ("delete_version", 3, 32), ("delete_version", 4, 42),
            ("delete_version", 7, 71), ("delete_version", 8, 82), ("set_current", 2, 24), ("set_current", 8, 81)]
    assert sorted(tuple(r) for r in plan.fillna(-1).collect()) == sorted(want)
    log = cleanup.cleanup_log_row(plan, "date_range", {}, True)
    assert log.select("deleted_heads", "deleted_versions", "updated_heads").collect() == [(3, 7, 2)]
    logical = log._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Join LeftSemi") == 1 and "named_struct" not in logical  # no pick, so no sort, where actions are only counted


def test_cleanup_reads_its_plan_once(spark):
    """every branch of the application made the plan again."""
    heads, versions = dated(spark)
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    plan = cleanup.plan_date_cleanup(heads, versions, "2024-01-01", "2024-01-05").persist()
    n = plan.count()
    kept, left = cleanup.apply_cleanup(heads, versions, plan.mapInArrow(counted, plan.schema))
    assert sorted(tuple(r) for r in kept.where("news_id IS NOT NULL").collect()) == [(1, 11), (2, 24), (8, 81)] and calls.value == n
    assert sorted(r.version_id for r in left.where("version_id IS NOT NULL").collect()) == [11, 12, 22, 23, 24, 51, 61, 81]
    plan.unpersist()


def test_fetches_are_found_without_texts(spark, monkeypatch):
    """all pages were cleaned again to fill the bodies of a few, and once more to find which."""
    heads = spark.createDataFrame([(1, 11), (2, 21), (3, 31)], "news_id BIGINT, current_version_id BIGINT")
    empty = spark.createDataFrame([(11, "a"), (12, "a"), (21, "b"), (31, None)], "version_id BIGINT, original_url STRING")
    fetches = spark.createDataFrame([("a", 5), ("a", 7), ("c", 8), (None, 9)], "original_url STRING, fetch_id BIGINT")
    assert [tuple(r) for r in cleanup.latest_fetches(heads, empty, fetches).collect()] == [(11, "a", 7)]
    asked, versions = [], bind.versions
    monkeypatch.setattr(bind, "versions", lambda spark, d, only=None: asked.append(only is not None) or versions(spark, d, only))
    version_queries.noncompliant_cleanup(spark, "/root/testdata/sf0.001")
    assert sorted(asked) == [False, True]

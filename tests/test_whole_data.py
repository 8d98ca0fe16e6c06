"""Nothing is lost to late arrival, term lists of any size, or odd dates."""

import pytest
from pyspark.sql import functions as F

from clipworks.functions import dates
from clipworks.operators import replay, tagging
from clipworks.streaming import ingest


def test_late_batches_are_stored_once(spark, tmp_path):
    schema = "event_id BIGINT, ts TIMESTAMP, v INT"
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    batches = [[(1, "2024-01-20 00:00:00", 1)], [(2, "2024-01-21 00:00:00", 1), (1, "2024-01-20 00:00:00", 1)], [(3, "2024-01-02 00:00:00", 1), (3, "2024-01-02 00:00:00", 1), (4, None, 1)], [(4, None, 1), (2, "2024-01-21 00:00:00", 1)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id BIGINT, ts STRING, v INT").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "v").write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        ingest.ingest_stream(stream, store, state, "event_id", "ts").awaitTermination()
    assert sorted(r.event_id for r in ingest.read_store(spark, store, schema).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("size", [3, tagging.MAX_LITERAL_TERMS + 50])
def test_null_and_blank_terms_match_nothing(spark, size):
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "a slow dog")], "id INT, body STRING")
    terms = [("quick",), (None,), ("",), ("  ",)] + [(f"unseen{k}",) for k in range(size)]
    found = tagging.match_terms(docs, spark.createDataFrame(terms, "term STRING"))
    assert [tuple(r) for r in found.collect()] == [(1, "quick")]
    entities = spark.createDataFrame([(f"e{k:04}", f"name{k}x", ["", None]) for k in range(size)] + [("zz", "quick", [None, " "])], "entity_id STRING, name STRING, aliases ARRAY<STRING>")
    got = {r.id: r.entity_ids for r in tagging.with_entities(docs, entities).collect()}
    assert got == {1: ["zz"], 2: []}


def test_month_names_are_whole(spark):
    rows = spark.createDataFrame([(t,) for t in ("Mary 4, 2024 10:00", "Marember 3, 2024", "March 3, 2024", "Sept 3, 2024", "3 Dec 2024")], "t STRING")
    hit = rows.select(F.col("t").rlike(dates.MONTH_FIRST) | F.col("t").rlike(dates.DAY_FIRST))
    assert [r[0] for r in hit.collect()] == [False, False, True, True, True]


def test_restore_uses_audited_date_and_keeps_sources_apart(spark):
    html = "<html><head><title>遥感测绘平台发布新版本</title></head><body><p>平台面向地理信息和自然资源数字化业务提供遥感测绘能力，服务多个行业用户。</p></body></html>"
    pages = spark.createDataFrame([(1, "https://a.example.com/news/1.html", html)], "page_id BIGINT, url STRING, html STRING")
    audit = spark.createDataFrame([(5, "https://a.example.com/news/1.html#x", "2024-05-01 10:00:00", "will_delete"), (6, "https://a.example.com/news/1.html", "2024-05-02 10:00:00", "will_delete"), (7, "https://a.example.com/news/1.html", None, "keep")],
                                  "source_id BIGINT, original_url STRING, published_at STRING, action STRING").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    heads = spark.createDataFrame([], "news_id STRING")
    rows = replay.restore_from_audit(audit, pages, heads).select("source_id", F.date_format("published_at", "dd").alias("day")).collect()
    assert sorted(map(tuple, rows)) == [(5, "01"), (6, "02")]

"""Properties of the versioned model, cleanup, files and streams."""

import datetime as dt
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipworks.functions import groups
from clipworks.operators import cleanup, versions
from clipworks.session import checkpoint_dir
from clipworks.sources import files
from clipworks.streaming import ingest

BATCH = "seq BIGINT, source_id BIGINT, canonical_url STRING, slug STRING, content_hash STRING"


def empty(spark):
    heads = spark.createDataFrame([], "news_id STRING, source_id BIGINT, canonical_url STRING, slug STRING, current_version_id STRING, "
                                      "first_seen_at TIMESTAMP_NTZ, last_seen_at TIMESTAMP_NTZ")
    return heads, spark.createDataFrame([], "version_id STRING, news_id STRING, content_hash STRING")


def test_upsert_is_idempotent(spark):
    batch = spark.createDataFrame([(1, 1, "a", "s1", "h1"), (2, 1, "a", "s2", "h2"), (3, 1, "b", "s3", "h1"), (4, 1, "a", "s4", "h1")], BATCH)
    heads, vers, stats = versions.upsert_versions(*empty(spark), batch, "2024-01-01")
    assert tuple(stats.collect()[0]) == (4, 3, 1)
    again, vers2, stats2 = versions.upsert_versions(heads, vers, batch, "2024-01-02")
    assert tuple(stats2.collect()[0]) == (4, 0, 4) and vers2.count() == 3
    first = {r.canonical_url: r for r in heads.collect()}
    second = {r.canonical_url: r for r in again.collect()}
    assert {u: r.current_version_id for u, r in first.items()} == {u: r.current_version_id for u, r in second.items()}
    assert second["a"].last_seen_at == dt.datetime(2024, 1, 2) and second["a"].first_seen_at == dt.datetime(2024, 1, 1)
    assert first["a"].slug == "s2"
    changed = spark.createDataFrame([(9, 1, "a", "s9", "h9")], BATCH)
    _, vers3, _ = versions.upsert_versions(again, vers2, changed, "2024-01-03")
    assert vers3.count() == 4


def test_cleanup_leaves_no_violation(spark):
    heads = spark.createDataFrame([(1, 11), (2, 21), (3, 31), (4, 41)], "news_id BIGINT, current_version_id BIGINT")
    rows = [(1, 11, True), (1, 12, False), (2, 21, False), (2, 22, True), (2, 23, False), (3, 31, False), (3, 32, False), (4, 41, False), (4, 40, True), (4, 42, True)]
    vers = spark.createDataFrame([(n, v, ok, dt.datetime(2024, 1, v % 10 + 1)) for n, v, ok in rows], "news_id BIGINT, version_id BIGINT, relevant BOOLEAN, published_at TIMESTAMP_NTZ")
    plan = cleanup.plan_relevance_cleanup(heads, vers)
    assert sorted(tuple(r) for r in plan.fillna(0).collect()) == [
        ("delete_head", 3, 0), ("delete_version", 2, 21), ("delete_version", 2, 23), ("delete_version", 3, 31), ("delete_version", 3, 32),
        ("delete_version", 4, 41), ("set_current", 2, 22), ("set_current", 4, 40)]
    newest = cleanup.plan_noncompliant_cleanup(heads, vers, "relevant").filter("action = 'set_current' AND news_id = 4").collect()
    assert [r.version_id for r in newest] == [42]
    h, v = cleanup.apply_cleanup(heads, vers, plan)
    bad = h.join(v, h.current_version_id == v.version_id).filter(~F.col("relevant"))
    assert bad.count() == 0 and h.count() == 3
    assert cleanup.plan_relevance_cleanup(h, v).count() == 0


def test_hot_key_duplicates(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    marked = groups.mark_later(df, "id", ["k"], [])
    assert marked.filter("is_duplicate").count() == 999 and marked.count() == 3000


def test_json_array_with_bom(spark):
    folder = f"{checkpoint_dir(spark)}/bom-{os.getpid()}"
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w", encoding="utf-8-sig") as f:
        f.write('[\n{"id": 1, "name": "遥感"},\n{"id": 2}\n]')
    got = files.read_json_array(spark, folder, "id INT, name STRING").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "遥感"), (2, None)]


def test_audit_csv(spark):
    folder = f"{checkpoint_dir(spark)}/csv-{os.getpid()}"
    df = spark.createDataFrame([("1", 'say "hi", you\nthere'), ("2", "")], "id STRING, text STRING")
    files.write_audit_csv(df, folder)
    with open(f"{folder}/extra.csv", "w") as f:
        f.write('"3"\n"4","x","too wide"\n"5","fine"\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    got = files.read_audit_csv(spark, folder, schema)
    assert got.count() == 3
    assert sorted((r.id, r.text or "") for r in got.collect()) == [("1", 'say "hi", you there'), ("2", ""), ("5", "fine")]
    assert files.audit_lines(df).orderBy("value").collect()[0].value == '"1","say ""hi"", you there"'


def test_streamed_versions_equal_batch(spark):
    base = f"{checkpoint_dir(spark)}/stream-{os.getpid()}"
    rows = [(i, i % 3, f"u{i % 20}", f"s{i}", f"h{i % 7}") for i in range(200)]
    spark.createDataFrame(rows[:120], BATCH).coalesce(1).write.parquet(f"{base}/in/a")
    spark.createDataFrame(rows[80:], BATCH).coalesce(1).write.parquet(f"{base}/in/b")
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/in")
    ingest.ingest_versions(stream, f"{base}/store", f"{base}/state").awaitTermination()
    stored = spark.read.parquet(f"{base}/store/b=*")
    want = versions.keyed(spark.createDataFrame(rows, BATCH))
    assert sorted(r.version_id for r in stored.collect()) == sorted(r.version_id for r in want.collect())
    assert ingest.heads_of_store(stored).count() == want.select("news_id").distinct().count()

"""Streamed ingest: every key once, in any order, over restarts, at a cost that does not follow the store."""

import datetime
import random

from clipworks.streaming import ingest

SCHEMA = "key long, at timestamp, v int"


def files(spark, folder, parts, seed):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    for n, keys in enumerate(parts):
        rows = [(k, None if k % 50 == 7 else start + datetime.timedelta(days=rng.randrange(40)), n) for k in keys]
        rng.shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, base):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = ingest.ingest_stream(stream, f"{base}/store", f"{base}/state", "key", "at")
    query.awaitTermination()
    return query.recentProgress


def test_keys_are_stored_once_whatever_their_time(spark, tmp_path):
    base = f"file://{tmp_path}"
    parts = [range(100 * n - (30 if n else 0), 100 * n + 100) for n in range(6)]  # windows overlap, times differ at every arrival
    files(spark, f"{base}/in", parts, 1)
    progress = run(spark, base)
    assert len(progress) >= 6
    files(spark, f"{base}/in", [range(0, 600, 3), range(590, 650)], 2)
    again = run(spark, base)
    stored = ingest.read_store(spark, f"{base}/store", SCHEMA).collect()
    assert sorted(r.key for r in stored) == list(range(650))
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in [*progress, *again] if p["stateOperators"]) == 650
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ingest.ROCKSDB


def test_versions_are_stored_once_and_heads_follow(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "seq long, source_id long, canonical_url string, content_hash string"
    rows = [[(n * 10 + i, i % 3, f"u{i}", f"c{(i * n) % 4}") for i in range(8)] for n in range(4)]
    for part in [*rows, rows[1]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    ingest.ingest_versions(stream, f"{base}/store", f"{base}/state").awaitTermination()
    stored = spark.read.parquet(f"{base}/store/b=*")
    want = {(r[1], r[2], r[3]) for part in rows for r in part}
    assert stored.count() == len(want) and {(r.source_id, r.canonical_url, r.content_hash) for r in stored.collect()} == want
    assert ingest.heads_of_store(stored).count() == 8

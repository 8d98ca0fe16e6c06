"""Incremental windows and idempotent ingest on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipworks.operators import versions


def next_window(runs: DataFrame, end: str, first_start: str, overlap_minutes: int, requested_start: str | None = None,
                good=("succeeded", "partial_succeeded")) -> DataFrame:
    """One row ``(start_at, end_at, first_run)``: a requested start, else the last good run's end minus the overlap
    (the end minus the overlap when that lies ahead), else the first start; never before the first start."""
    def at(v):
        return F.lit(v).cast("timestamp_ntz")

    gap = F.make_dt_interval(mins=F.lit(overlap_minutes))
    last = runs.filter(F.col("status").isin(list(good)) & F.col("window_end_at").isNotNull()).agg(F.max("window_end_at").alias("_last"))
    stop, first = at(end), at(first_start)
    if requested_start is not None:
        start, is_first = at(requested_start), F.lit(False)
    else:
        start = F.when(F.col("_last").isNull(), first).when(F.col("_last") >= stop, stop - gap).otherwise(F.col("_last") - gap)
        is_first = F.col("_last").isNull()
    clamped = F.greatest(start, first)
    valid = F.when(clamped > stop, F.greatest(stop - gap, first)).otherwise(clamped)
    return last.select(valid.alias("start_at"), stop.alias("end_at"), is_first.alias("first_run"))


def _bounds(start: str, end: str, grace_seconds: int):
    grace = F.make_dt_interval(secs=F.lit(grace_seconds).cast("decimal(18,6)"))
    return F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") + grace


def in_window(df: DataFrame, col: str, start: str, end: str, grace_seconds: int = 60) -> DataFrame:
    """Rows inside the window; both bounds are constants, so the filter reaches the scan."""
    lo, hi = _bounds(start, end, grace_seconds)
    return df.filter((F.col(col) >= lo) & (F.col(col) <= hi))


def late_report(df: DataFrame, col: str, start: str, end: str, keys=(), grace_seconds: int = 60) -> DataFrame:
    """Rows by arrival: late (before the window), early (after it), missing or in window. Works on streams too,
    as long as it comes before any watermark."""
    lo, hi = _bounds(start, end, grace_seconds)
    arrival = F.when(F.col(col).isNull(), "missing").when(F.col(col) < lo, "late").when(F.col(col) > hi, "early").otherwise("in_window")
    return df.withColumn("arrival", arrival).groupBy(*keys, "arrival").agg(F.count("*").alias("n"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(stream: DataFrame, write, checkpoint: str):
    """Starts the query with its keys in RocksDB: hash partitions with Bloom filters, kept by the checkpoint folder."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKSDB)
    try:
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)


def ingest_stream(source: DataFrame, store: str, checkpoint: str, key: str, time_col: str):
    """Start an ingest that stores each key once although windows overlap and batches may be retried.

    Rows may come at any time and in any order: nothing is dropped as late, and a key whose time has changed is still
    the same key. Known keys are state of the query, looked up by hash, so a batch costs what it brings, however much is
    stored. Each micro-batch writes its own folder, named by the batch id and overwritten on retry, by day of
    ``time_col`` (rows without a time share a day of their own): exactly once. Store and state lie in shared folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("day", F.coalesce(F.date_format(time_col, "yyyy-MM-dd"), F.lit("none"))).write.mode("overwrite").partitionBy("day").parquet(f"{store}/batch={batch_id}")

    return _start(source.withColumn(time_col, F.col(time_col).cast("timestamp")).dropDuplicates([key]), write, checkpoint)


def read_store(spark: SparkSession, store: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", store).parquet(f"{store}/batch=*")


def ingest_versions(source: DataFrame, store: str, checkpoint: str):
    """Streamed upsert of accepted articles: every batch adds the versions that no earlier batch has.

    Version ids are hashes of source, URL and content, and known ones are state of the query, so a replayed window adds
    nothing and no batch reads the store. Of equal versions in one batch any may be kept; they differ in ``seq`` at most
    in what the ids don't cover. Heads are a view over the stored versions (``heads_of_store``); each batch is an append.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{store}/b={batch_id}")

    named = source.withColumn("news_id", versions.news_id()).withColumn("version_id", versions.version_id())
    return _start(named.dropDuplicates(["version_id"]), write, checkpoint)


def heads_of_store(stored: DataFrame) -> DataFrame:
    """Current version of each head: the last one added."""
    return stored.groupBy("news_id").agg(
        F.max_by("version_id", F.struct("batch", "seq")).alias("current_version_id"), F.count("*").alias("n_versions"))

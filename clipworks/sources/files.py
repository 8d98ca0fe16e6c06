"""JSON, CSV and snapshot files, and imports into the versioned model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipworks.functions import groups
from clipworks.operators import versions


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array each; a byte-order mark is skipped."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def audit_lines(df: DataFrame) -> DataFrame:
    """Every field quoted, quotes doubled, line breaks turned into spaces."""
    flat = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ").alias(c) for c in df.columns]
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    return df.select(*flat).select(F.concat_ws(",", *quoted).alias("value"))


def write_audit_csv(df: DataFrame, path: str) -> None:
    flat = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " ").alias(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"').csv(path)


def parse_audit_lines(lines: DataFrame, schema: T.StructType, col="value") -> DataFrame:
    """Audit lines back to columns; rows of another width are dropped by every later query alike."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_csv(col, wide.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("r")).filter("r._bad IS NULL").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def read_audit_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Audit files (one row per line, header first); rows of another width are dropped."""
    header = ",".join(f'"{f.name}"' for f in schema.fields)
    plain = ",".join(f.name for f in schema.fields)
    lines = spark.read.text(path).filter(~F.col("value").isin(header, plain) & (F.trim("value") != ""))
    return parse_audit_lines(lines, schema)


def append_snapshot(snapshots: DataFrame, dataset_type: str, payload: DataFrame, run_id: int, created_at: str) -> DataFrame:
    """Snapshots plus one new payload row per payload record; the newest row of a type is its active one."""
    new = payload.select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(dataset_type).alias("dataset_type"),
        F.to_json(F.struct(*payload.columns)).alias("payload"), F.lit(created_at).cast("timestamp_ntz").alias("created_at"))
    new = new.withColumn("snapshot_id", F.xxhash64("run_id", "dataset_type", "payload"))
    return snapshots.unionByName(new.select(*snapshots.columns))


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    """Append-only store, one folder per type, so reading one type opens only its files."""
    snapshot.write.mode("append").partitionBy("dataset_type").parquet(path)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Active row of each type: a pre-aggregated maximum, so one busy type does not fill a task."""
    cols = [c for c in snapshots.columns if c != "dataset_type"]
    best = snapshots.groupBy("dataset_type").agg(F.max_by(F.struct(*cols), F.struct("created_at", "snapshot_id")).alias("s"))
    return best.select("dataset_type", "s.*")


def resolve_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with a source id by name; unknown names get an inactive stub id made from the name."""
    dim = sources.select(F.col("name").alias("source"), "source_id", F.col("active").alias("source_active"))
    stub = -F.abs(F.xxhash64("source"))
    return articles.join(groups.small_side(dim), "source", "left").withColumn("is_stub", F.col("source_id").isNull()).withColumns({
        "source_id": F.coalesce("source_id", stub), "source_active": F.coalesce("source_active", F.lit(False))})


def stub_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, name, active): an inactive source for every name of the articles that no source has."""
    known = sources.select(F.col("name").alias("source"))
    names = articles.select("source").distinct().join(known, "source", "left_anti")
    return names.select((-F.abs(F.xxhash64("source"))).alias("source_id"), F.col("source").alias("name"), F.lit(False).alias("active"))


def import_articles(articles: DataFrame, sources: DataFrame, heads: DataFrame, vers: DataFrame, now: str):
    """``(heads, versions, stats)`` after importing articles(seq, source, canonical_url, slug, content_hash, ...)."""
    return versions.upsert_versions(heads, vers, resolve_sources(articles, sources).drop("source", "is_stub", "source_active"), now)


def import_logs(logs: DataFrame, sources: DataFrame) -> DataFrame:
    """Run logs of known sources; the rest are dropped."""
    return logs.join(sources.select(F.col("name").alias("source"), "source_id"), "source")



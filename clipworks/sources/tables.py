"""Table readers: parquet with explicit schemas, and partitioned JDBC reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clipworks.session import checkpoint_dir
from clipworks.sources import schemas


# Tables whose rows are long texts, with their unique keys.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}
SMALL_SPLITS = 64


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; the schema is given, so no file is opened to infer it."""
    schema = schemas.DRIVER.get(name) or schemas.MODEL[name]
    df = spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def spread(df: DataFrame, key: str, small_splits: int = SMALL_SPLITS) -> DataFrame:
    """Small text inputs only: rows spread over all cores by their unique key.

    A file of one row group is one task however many cores are free. Inputs with more splits than cores, or than
    ``small_splits`` (about 8 GB), are left as they are laid out: no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores, key) if cores > 1 and splits <= min(cores, small_splits) else df


def load_tables(spark: SparkSession, folder: str, names) -> dict[str, DataFrame]:
    return {name: load_table(spark, folder, name) for name in names}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, rows_per_partition: int = 1_000_000, where: str | None = None,
              properties: dict | None = None) -> DataFrame:
    """Relational table read in parallel ranges of ``key`` (a whole-number column) that hold about equally many rows.

    Bounds come from the store: it counts the rows of equal slices of the key range and slices that hold too many are cut
    again, so that skewed keys do not make one long range; counts, ``where`` and later filters and columns are pushed down.
    Rows without a key are a range of their own. One row for each slice is read to plan.
    """
    given = properties or {}
    ask = lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **given).load()
    source = f"(SELECT * FROM {table} WHERE {where}) t" if where else f"{table} t"
    low, high, total, keyed = ask(f"SELECT MIN({key}) a, MAX({key}) b, COUNT(*) n, COUNT({key}) k FROM {source}").first()
    if not total:
        return spark.read.format("jdbc").options(url=url, dbtable=source, **given).load()
    ranges = _ranges(ask, source, key, int(low), int(high), rows_per_partition) if keyed else []
    parts = [f"{key} >= {a} AND {key} <= {b}" for a, b in ranges] + ([f"{key} IS NULL"] if keyed < total else [])
    return spark.read.jdbc(url, source, predicates=parts, properties={str(k): str(v) for k, v in given.items()})


def _ranges(ask, source: str, key: str, low: int, high: int, most: int, slices: int = 64) -> list[tuple[int, int]]:
    """Ranges of ``key`` with about ``most`` rows: slices of the key range, counted by the store, cut again or joined."""
    width = max(1, -(-(high - low + 1) // slices))
    counted = ask(f"SELECT s, COUNT(*) n FROM (SELECT ({key} - ({low})) / {width} s FROM {source} WHERE {key} >= {low} AND {key} <= {high}) u GROUP BY s").collect()
    out, start, held = [], low, 0
    for s, n in sorted((int(r[0]), int(r[1])) for r in counted):
        first, last = low + s * width, min(high, low + (s + 1) * width - 1)
        if n > most and width > 1:
            if held:
                out.append((start, first - 1))
            out += _ranges(ask, source, key, first, last, most, slices)
            start, held = last + 1, 0
            continue
        if held and held + n > most:
            out.append((start, first - 1))
            start, held = first, 0
        held += n
    if held:
        out.append((start, high))
    return out


def materialize(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """A result that several branches read, written once as a table in the shared checkpoint folder.

    Used for narrow tables behind costly text work; the written table survives lost executors. ``group_rows`` bounds the
    rows of a row group, and so those that are held at once, where a row is megabytes.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

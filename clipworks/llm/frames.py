"""Small DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) with one row per id; null ids and labels are left out, of contrary labels the larger one holds."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    return rows.dropna().groupBy("id").agg(F.max("label").alias("label"))


def bounded_batches(df: DataFrame, rows: int = 1000) -> None:
    """Hands texts to Python in batches of ``rows`` at most, so that memory doesn't follow Spark's default of 10 000 whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = int(df.sparkSession.conf.get(key))
    if size <= 0 or size > rows:
        df.sparkSession.conf.set(key, rows)


#: A key is hot with at least so many rows and a thousandth of all rows; then there are at most a thousand such keys.
HOT_ROWS, HOT_SHARE, SALTS = 10_000, 1000, 32


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The hot keys of ``counts`` (keys, n): at most ``HOT_SHARE`` rows, whatever the input."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) >= max(HOT_ROWS, -(-total // HOT_SHARE))).select(*keys, F.lit(True).alias("_hot"))


def salted(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``_salt``: rows of a hot key are dealt over ``SALTS`` numbers by their hash, other rows have 0."""
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)).cast("int")
    return df.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), deal).otherwise(0)).drop("_hot")


def replicated(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, one row per key, with ``_salt``: a hot key once for every number, other keys with 0."""
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return df.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")

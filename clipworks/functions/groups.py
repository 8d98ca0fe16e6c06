"""Grouped top-k, first-per-key and bounded reads, written so that a hot key cannot fill one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipworks.functions.text import col_of


def top_k(df: DataFrame, keys, order, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. The rank filter lets Spark prune each map task to k rows per key
    before the shuffle, so at most tasks x k rows of one key meet."""
    rn = rank or "_rank"
    out = df.withColumn(rn, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rn) <= k)
    return out if rank else out.drop(rn)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    return top_k(df, keys, order, 1)


def mark_later(df: DataFrame, id_col: str, keys, order_cols, out: str = "is_duplicate") -> DataFrame:
    """Flag every row but the first of its key.

    The first row of each key is found by a pre-aggregated minimum and joined back on the unique id,
    so the rows of a hot key stay spread over all tasks.
    """
    first = (
        df.groupBy(*[F.col(k) for k in keys])
        .agg(F.min(F.struct(*[F.col(c) for c in order_cols], F.col(id_col))).getField(id_col).alias(id_col))
        .select(id_col, F.lit(True).alias("_first"))
    )
    return df.join(first, id_col, "left").withColumn(out, F.col("_first").isNull()).drop("_first")


def keep_computed(df: DataFrame, computed: dict, condition) -> DataFrame:
    """Adds computed columns and keeps the rows where ``condition(struct)`` holds, computing each value once.

    A plain filter on a computed column is pushed below the projection, which repeats the whole expression;
    rows that leave a generator are not.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in computed.items()]))
    rest = [c for c in df.columns if c not in computed]
    return df.select(*rest, F.explode(F.filter(made, condition)).alias("_made")).select(*rest, "_made.*")


SMALL_SIDE = 50_000


def small_side(df: DataFrame, max_rows: int = SMALL_SIDE) -> DataFrame:
    """A dimension that proves to have at most ``max_rows`` rows is broadcast, so the texts it meets are not shuffled
    by a skewed key; a larger one is left to the optimizer. Needed where the optimizer has no size to go by."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row numeric results side by side: a union of a few rows and a maximum, no join."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def bounded(df: DataFrame, max_rows: int):
    """All rows when there are at most ``max_rows``, else None. Never reads more than one row past the bound."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def desc(c) -> Column:
    return col_of(c).desc()


def asc(c) -> Column:
    return col_of(c).asc()

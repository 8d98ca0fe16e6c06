"""Order statistics without a single task: running sums, positions and pages over range partitions.

Rows are range-partitioned by their order once and written; what each partition holds is counted, and a short table of
partition totals turns places inside a partition into places in the whole order.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipworks.session import checkpoint_dir
from clipworks.sources.tables import materialize


def running_sum(df: DataFrame, group: list[str], order: list, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row, in ``order`` within ``group`` (ties in no set order).

    A group of any size is spread over as many range partitions as it needs.
    """
    parted = materialize(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    sums = parted.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*group, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return parted.withColumn("_inside", inside).join(sums, [*group, "_part"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


class PageIndex:
    """Rows laid out by ``order``, with the number of rows of each partition: a page reads only the partitions it lies in.

    The layout costs one shuffle and serves any number of pages; totals come from it, too. One number for each partition
    is held on the driver.
    """

    def __init__(self, df: DataFrame, order: list):
        self.spark, self.order = df.sparkSession, order
        self.path = f"{checkpoint_dir(self.spark)}/pages-{uuid.uuid4().hex}"
        self.schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(self.path)
        counts = self._read().groupBy("_part").count().orderBy("_part").collect()
        self.counts = [(r["_part"], r["count"]) for r in counts]
        self.total = sum(n for _, n in self.counts)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def rows(self, start: int, count: int, position: str = "position") -> DataFrame:
        """The rows from place ``start`` (0 is the first) on, with their places; at most ``count``. Each task numbers one partition."""
        before, wanted = 0, {}
        for part, n in self.counts:
            if before < start + count and before + n > start:
                wanted[part] = before
            before += n
        if not wanted:
            return self._read().limit(0).drop("_part").withColumn(position, F.lit(0).cast("bigint"))
        offset = F.create_map(*[F.lit(x).cast("bigint") for pair in wanted.items() for x in pair])
        rows = self._read().where(F.col("_part").isin(list(wanted)))
        place = F.row_number().over(W.partitionBy("_part").orderBy(*self.order)) + offset[F.col("_part").cast("bigint")] - 1
        return rows.withColumn(position, place).where(F.col(position).between(start, start + count - 1)).drop("_part")


def first_passing(df: DataFrame, order: list, judge, need: int, first: int | None = None) -> tuple[DataFrame, int]:
    """(rows, judged): the first ``need`` rows in ``order`` that pass, and how many rows were judged for them.

    ``judge(rows)`` keeps the rows that pass (with the column ``position``) and may be costly: join pages, read texts. It
    gets ranges of the order, each as long as the share that passed so far lets expect to need, so that it sees little
    more than it must when many pass, and everything when few do. The cut is exact at any share. Keep ``df`` narrow.
    """
    index, parts, found, start = PageIndex(df, order), [], 0, 0
    size = max(1, first or need)
    while found < need and start < index.total:
        passed = materialize(judge(index.rows(start, size)))
        parts.append(passed)
        found += passed.count()
        start = min(start + size, index.total)
        rate = max(found / start, 1 / (4 * start))  # no more than four times as far in one step
        size = max(1, math.ceil(1.05 * (need - found) / rate))
    if not parts:
        return judge(index.rows(0, 0)), 0
    rows = reduce(DataFrame.unionByName, parts)
    if found > need:
        counted = running_sum(rows.select("position", F.lit(1).cast("bigint").alias("one")), [], ["position"], "one", "nth")
        last = counted.where(F.col("nth") == need).first()["position"] if need > 0 else -1
        rows = rows.where(F.col("position") <= last)
    return rows, start

"""Mixing sources to target weights by Poisson replication, then a global shuffle. SQL functions only.

A source with n documents and target share w has the rate w * total / n. Each document's number of copies is the
inverse of the Poisson distribution of that rate at a point hashed from seed and id, so any task finds the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.functions.groups import small_side
from clipworks.llm.frames import fresh
from clipworks.sources.tables import materialize

#: Rates above this are split into equal parts whose counts are added, since e^-rate would vanish.
MAX_RATE = 500.0


def point(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) hashed from the seed and the parts: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate, parts, cdf), one row per source; a null source is one source of its own.

    ``weights`` gives each source its share, and sources it leaves out get none; without it a source weighs its number
    of documents to the power ``alpha``. ``epochs`` is the wanted number of rows over the number of documents.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0))
    counts = materialize(counts.withColumn("weight", weight))
    docs_total, weights_total = counts.agg(F.sum("n"), F.sum("weight")).first()
    rate = F.col("weight") / float(weights_total) * float(docs_total) * epochs / F.col("n") if weights_total else F.lit(0.0)
    rates = counts.select("source", rate.alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("int"))
    part = F.col("rate") / F.col("parts")
    last = (F.ceil(part + 12 * F.sqrt(part)) + 30).cast("int")
    start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("c"), F.array(F.exp(-part)).alias("all"))

    def step(acc, k):
        p = acc["p"] * part / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return rates.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"]))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 11) -> DataFrame:
    """``docs`` with each row repeated as often as its source's rate says, in a global random order.

    Columns added (renamed with underscores on a clash): copy (from 0), n_copies, shuffle_key, the place in the order.
    Rows with the same id get the same number of copies; a null id hashes as the empty text. Texts are not looked at.
    An empty table gives an empty table.
    """
    rates = small_side(materialize(source_rates(docs, source_col, weights, alpha, epochs)))
    names = {n: fresh(docs, n) for n in ("copy", "n_copies", "shuffle_key", "mix_source", "mix_cdf", "mix_parts")}
    rates = rates.select(F.col("source").alias(names["mix_source"]), F.col("cdf").alias(names["mix_cdf"]), F.col("parts").alias(names["mix_parts"]))
    joined = docs.join(rates, docs[source_col].eqNullSafe(F.col(names["mix_source"])))
    one = lambda i: F.size(F.filter(F.col(names["mix_cdf"]), lambda c: c <= point(seed, docs[id_col], i)))
    count = F.aggregate(F.sequence(F.lit(0), F.col(names["mix_parts"]) - 1), F.lit(0), lambda acc, i: acc + one(i))
    counted = joined.select(*[docs[c] for c in docs.columns], count.alias(names["n_copies"])).where(F.col(names["n_copies"]) > 0)
    copies = counted.withColumn(names["copy"], F.explode(F.sequence(F.lit(0), F.col(names["n_copies"]) - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(names["copy"]).cast("string")))
    shuffled = copies.withColumn(names["shuffle_key"], key).repartition(F.col(names["shuffle_key"])).sortWithinPartitions(names["shuffle_key"])
    return shuffled.select(*docs.columns, names["copy"], names["n_copies"], names["shuffle_key"])

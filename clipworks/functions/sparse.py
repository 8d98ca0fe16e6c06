"""Sparse top-k: the items that score best for each question, without a shuffle of the pairs that meet.

A question wants features with weights, an item offers features with strengths, and a score sums weight x strength over
the features both have. Questions and items are dealt into blocks by hash, and every block of questions meets every block
of items in a task, which adds up whole scores from posting lists, many questions at once, and lets only the best few items of each question out.
So what is shuffled is features and a few results, while the pairs that meet, which grow with questions times items, stay
numbers in an array of one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.functions import groups
from clipworks.sources.tables import materialize

#: Rows of wanted features and of offers that a block holds, on average, at most; small tables are dealt over all cores.
WANTED_ROWS, OFFER_ROWS = 1_000_000, 4_000_000
#: Cells of questions and items, and pairs that meet, that are added up at once.
CELLS = 1 << 18


def best_matches(wanted: DataFrame, offers: DataFrame, limits: dict[str, int], constants: DataFrame, first_items: DataFrame,
                 key: str = "key", champions: int | None = None, wanted_rows: int = WANTED_ROWS, offer_rows: int = OFFER_ROWS) -> DataFrame:
    """(key, kind, item, base, boost, score, rank): the best items of each kind for each question, ties to the smaller item.

    wanted(key, kind, feature, main, weight): ``main`` features make the base score, others only boost it; main weights
    are positive. offers(kind, item, feature, strength): one row per item and feature, strengths positive; boosts may be
    negative if only a few items offer them. constants(key, kind, base, bias): ``base`` counts for every item of the kind,
    ``bias`` for items with a base score. first_items(kind, item): the ``limits`` smallest items of each kind, which fill up
    when a constant reaches every item. Scores of zero and below are no match. Weights and strengths are whole numbers.
    ``champions`` has no effect.
    """
    common = constants.select(
        key, "kind", F.when(F.col("base") > 0, F.col("base") + F.col("bias")).otherwise(0).alias("everywhere"), F.col("base").alias("const"),
        F.when(F.col("base") > 0, 0).otherwise(F.col("bias")).alias("bias"))
    limit = _by_kind(limits)
    with_bias = F.col("base") + F.col("boost") + F.when(F.col("base") > 0, F.col("bias")).otherwise(0)

    features = offers.select("kind", "feature").distinct().join(wanted.select("kind", "feature").distinct(), ["kind", "feature"])
    features = materialize(features.withColumn("no", F.monotonically_increasing_id()))  # numbers of a kind's features are its own
    asked = materialize(wanted.join(features, ["kind", "feature"]).join(common.select(key, "kind", "bias"), [key, "kind"])
                        .select(key, "kind", "no", "main", F.col("weight").cast("bigint").alias("weight"), F.col("bias").cast("bigint").alias("bias")))
    given = materialize(offers.join(features, ["kind", "feature"]).select("item", "no", F.col("strength").cast("bigint").alias("strength")))
    rows, columns = (max(1, -(-df.count() // most)) for df, most in ((asked, wanted_rows), (given, offer_rows)))
    cores = wanted.sparkSession.sparkContext.defaultParallelism
    columns = max(columns, min(-(-cores // rows), -(-given.count() // max(1, offer_rows // 16))))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("row", deal(key, rows)).withColumn("column", every(columns)).groupBy("row", "column")
    right = given.withColumn("column", deal("item", columns)).withColumn("row", every(rows)).groupBy("row", "column")
    kind_of = dict(asked.dtypes)[key]
    found = left.cogroup(right).applyInArrow(_block(key, limits), f"`{key}` {kind_of}, kind string, item string, base bigint, boost bigint")
    filled = common.where("everywhere > 0").join(first_items, "kind").select(key, "kind", "item", F.lit(0).alias("base"), F.lit(0).alias("boost"))
    total = found.unionByName(filled).groupBy(key, "kind", "item").agg(F.sum("base").alias("base"), F.sum("boost").alias("boost"))
    scored = total.join(common, [key, "kind"]).withColumn("score", with_bias + F.col("everywhere")).withColumn("base", F.col("base") + F.col("const"))
    best = groups.top_k(scored.where("score > 0"), [key, "kind"], [F.desc("score"), F.asc("item")], max(limits.values()), rank="rank")
    return best.where(F.col("rank") <= limit).select(key, "kind", "item", "base", "boost", "score", "rank")


def _block(key: str, limits: dict[str, int]):
    """Cogroup function: of some questions' features and some items' offers, the questions' best of these items, and all items below zero.

    Items below zero go out because one of them may be a first item, which would else count as zero.
    """

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([left.schema.field(key), ("kind", pa.string()), ("item", pa.string()), ("base", pa.int64()), ("boost", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        names = pc.unique(right.column("item").cast(pa.string()))
        names = names.take(pc.sort_indices(names))  # smaller items have smaller numbers
        item = pc.index_in(right.column("item").cast(pa.string()), names).to_numpy()
        no, strength = right.column("no").to_numpy(), right.column("strength").to_numpy()
        order = np.argsort(no, kind="stable")
        no, item, strength = no[order], item[order], strength[order].astype(np.float64)
        left = left.sort_by([("kind", "ascending"), (key, "ascending")])
        question = pa.StructArray.from_arrays([left.column(c).combine_chunks() for c in (key, "kind")], ["key", "kind"])
        change = np.zeros(left.num_rows, bool)
        for c in question.flatten():
            change[1:] |= ~pc.equal(c[1:], c[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        change[0] = True
        bound = np.append(np.flatnonzero(change), left.num_rows)
        start, end = np.searchsorted(no, left.column("no").to_numpy()), np.searchsorted(no, left.column("no").to_numpy(), "right")
        main, weight, bias = left.column("main").to_numpy(zero_copy_only=False).astype(bool), left.column("weight").to_numpy(), left.column("bias").to_numpy()
        kinds = np.array(left.column("kind").take(pa.array(bound[:-1])).to_pylist(), object)
        edge = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(kinds)]])
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for first, last in zip(edge[:-1], edge[1:]):  # the questions of a kind
            some = slice(bound[first], bound[last])
            met = np.zeros(len(no) + 1, np.int64)
            np.add.at(met, start[some], 1)
            np.subtract.at(met, end[some], 1)
            there = np.zeros(len(names), bool)
            there[item[np.cumsum(met[:-1]) > 0]] = True
            here = np.flatnonzero(there)
            if not len(here):
                continue
            place = np.cumsum(there) - 1
            for row, which, base, boost in _scored(bound[first:last + 1], start, end, main, weight, bias, place[item], strength, len(here), limits.get(kinds[first], 0)):
                for c, values in zip(out, (bound[first + row], here[which], base, boost)):
                    c.append(values.astype(np.int64))
        at, which, base, boost = (np.concatenate(c) for c in out)
        return pa.Table.from_arrays([left.column(key).take(pa.array(at)), left.column("kind").take(pa.array(at)), names.take(pa.array(which)), pa.array(base), pa.array(boost)], schema=schema)

    return block


def _scored(bound, start, end, main, weight, bias, item, strength, items: int, most: int):
    """(question, item, base, boost) of the best ``most`` items, and of all below zero, of questions of one kind.

    ``bound``: first feature of each question and the end. Many questions are added up at once, in a table of questions
    and items of about ``CELLS`` cells.
    """
    count = end - start
    adds = np.concatenate([[0], np.cumsum(count[bound[0]:bound[-1]])])[bound - bound[0]]
    cost = adds + items * np.arange(len(bound))
    lo = 0
    while lo < len(bound) - 1:
        hi = max(lo + 1, int(np.searchsorted(cost, cost[lo] + CELLS, "right")) - 1)
        f, rows = slice(bound[lo], bound[hi]), hi - lo
        n = count[f]
        at = np.arange(n.sum()) + np.repeat(start[f] - (np.cumsum(n) - n), n)
        cell = np.repeat(np.repeat(np.arange(rows) * items, np.diff(bound[lo:hi + 1])), n) + item[at]
        value = np.repeat(weight[f], n) * strength[at]
        add = lambda own: np.bincount(cell[own], value[own], rows * items).reshape(rows, items)
        if main[f].all():
            base, boost = np.bincount(cell, value, rows * items).reshape(rows, items), None
            score, met = base, base > 0
        else:
            own = np.repeat(main[f], n)
            base, boost = add(own), add(~own)
            score, met = base + boost, (base > 0) | (boost != 0)
        score = np.where(met, score + np.where(base > 0, bias[bound[lo:hi]][:, None], 0), -np.inf)
        least = np.full(rows, np.inf if most <= 0 else -np.inf)
        if items > most > 0:
            least = np.partition(score, items - most, axis=1)[:, items - most]
        row, which = np.nonzero(met & ((score >= least[:, None]) | (score < 0)))
        worth = score[row, which]
        order = np.lexsort((which, -worth, row))
        row, which, worth = row[order], which[order], worth[order]
        keep = (np.arange(len(row)) - np.searchsorted(row, row) < most) | (worth < 0)
        row, which = row[keep], which[keep]
        yield row + lo, which, base[row, which], np.zeros(len(row)) if boost is None else boost[row, which]
        lo = hi


def _by_kind(limits: dict[str, int]) -> Column:
    out = F.lit(0)
    for kind, k in limits.items():
        out = F.when(F.col("kind") == kind, k).otherwise(out)
    return out

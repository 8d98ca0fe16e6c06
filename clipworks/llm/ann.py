"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries search it greedily.

The graph starts from random hyperplane buckets. In each round of NN-descent every vector gathers its neighbours and the
vectors it is a neighbour of by joins; these are neighbours of neighbours of each other, are compared with each other,
and better ones replace worse. Graph and search both rank by inner product, whatever the norms.
A search keeps the best vectors found so far and opens the neighbours of the best ones until all it keeps are opened. How
many it keeps follows from the recall of some queries, measured against all vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.functions.groups import top_k
from clipworks.llm.frames import bounded_batches
from clipworks.sources.tables import materialize

#: Neighbours kept of a vector, reverse ones looked at, rounds of NN-descent, bucketings to start from and rows of a bucket.
DEGREE, REVERSE, ROUNDS, BUCKETINGS, BUCKET = 40, 40, 4, 6, 512
#: Candidates each comparison hands on per vector; vectors a search keeps at least, and the share of them it opens at a time.
HANDED, BEAM, OPENED = 12, 224, 4
#: Vectors of neighbour lists that are unpacked at a time, and lists handed to Python at a time.
SCORED, LISTS = 4096, 500
#: Queries whose recall is measured, and the recall below which a search keeps twice as many.
MEASURED, RECALL = 64, 0.95


def usable(v: str) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(dim: int):
    """UDF: the vector as bytes, a scale of its own and 8-bit numbers."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        x = matrix(v, dim)
        scale = np.abs(x).max(axis=1) / 127 if len(x) else np.zeros(0)
        scale[scale == 0] = np.finfo(float).tiny  # the quotient of a tiny number can be 0
        code = np.rint(np.clip(x / scale[:, None], -127, 127)).astype(np.int8)
        return pa.array([a.tobytes() + c.tobytes() for a, c in zip(scale, code)], pa.binary())

    return pack


def matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def codes(column) -> np.ndarray:
    """The vectors of packed codes, in double precision: norms may lie far apart."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(len(column), -1)
    return raw[:, 8:].view(np.int8) * np.ascontiguousarray(raw[:, :8]).view(np.float64)


def best_pairs(ids: np.ndarray, x: np.ndarray, floor: np.ndarray | None, known: dict | None, k: int):
    """For each of some vectors the ``k`` likest others among them that are above its floor: (u, v, s)."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    if floor is not None:
        s[s <= floor[:, None]] = -np.inf
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], np.zeros(0)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(s, near, axis=1)
    u, c = np.nonzero(np.isfinite(got))
    return ids[u], ids[near[u, c]], got[u, c].astype(np.float64)


def start_graph(nodes: DataFrame, dim: int, n: int, degree: int) -> DataFrame:
    """(u, v, s): neighbours within buckets of like signs of random projections; a bucket of many rows is dealt into parts."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / (BUCKET / 2))))))
    planes = np.random.default_rng(9).standard_normal((BUCKETINGS, max(1, bits), dim))

    @F.arrow_udf("array<long>")
    def keys(code: pa.Array) -> pa.Array:
        x = codes(code)
        key = [((x @ p.T > 0) @ (1 << np.arange(len(p)))) if bits else np.zeros(len(x), int) for p in planes]
        return pa.array(list(np.stack(key, axis=1)), pa.list_(pa.int64())) if len(x) else pa.array([], pa.list_(pa.int64()))

    rows = nodes.select("id", "code", F.posexplode(keys("code")).alias("turn", "key"))
    sizes = rows.groupBy("turn", "key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(sizes) if (1 << bits) * BUCKETINGS <= 100_000 else sizes, ["turn", "key"])  # a row for each bucket
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "turn"), F.col("parts")))

    def compare(table: pa.Table) -> pa.Table:
        u, v, s = best_pairs(table.column("id").to_numpy(), codes(table.column("code")), None, None, min(degree, HANDED))
        return pa.table({"u": u, "v": v, "s": s})

    return rows.groupBy("turn", "key", "part").applyInArrow(compare, "u long, v long, s double")


def descend(graph: DataFrame, nodes: DataFrame, degree: int, turn: int) -> DataFrame:
    """One round of NN-descent: (u, v, s) with better neighbours where neighbours of neighbours are nearer."""
    out = graph.select(F.col("u").alias("hub"), F.col("v").alias("id"))
    back = graph.select(F.col("v").alias("hub"), F.col("u").alias("id"))
    back = top_k(back, ["hub"], [F.xxhash64("id", "hub", F.lit(turn))], REVERSE)
    floor = graph.groupBy("u").agg(F.when(F.count("*") >= degree, F.min("s")).otherwise(float("-inf")).alias("floor"))
    about = nodes.join(floor, nodes["id"] == floor["u"], "left").select("id", "code", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    met = out.union(back).distinct().join(about, "id")
    met = met.groupBy("hub").agg(F.collect_list(F.struct("id", "floor", "code")).alias("m"))  # degree + REVERSE at most

    @F.arrow_udf("array<struct<u:long,v:long,s:double>>")
    def join(m: pa.Array) -> pa.Array:
        flat, size = m.flatten(), m.value_lengths().to_numpy(zero_copy_only=False)
        ids, floors, code = flat.field("id").to_numpy(), flat.field("floor").to_numpy(), flat.field("code")
        us, vs, ss, n, at = [], [], [], [0], 0
        for k in size:
            u, v, s = best_pairs(ids[at:at + k], codes(code.slice(at, k)), floors[at:at + k], None, HANDED)
            us.append(u); vs.append(v); ss.append(s)  # noqa: E702
            n.append(n[-1] + len(u))
            at += k
        cat = lambda a, t: np.concatenate(a).astype(t) if a else np.zeros(0, t)
        rows = pa.StructArray.from_arrays([pa.array(cat(us, np.int64)), pa.array(cat(vs, np.int64)), pa.array(cat(ss, np.float64))], ["u", "v", "s"])
        return pa.ListArray.from_arrays(pa.array(np.array(n, np.int32)), rows)

    found = met.select(F.explode(join("m")).alias("e")).select("e.*")
    return keep_best(graph.union(found), degree)


def keep_best(edges: DataFrame, degree: int) -> DataFrame:
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    return top_k(once, ["u"], [F.desc("s"), "v"], degree)


def build_graph(nodes: DataFrame, dim: int, n: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    graph = materialize(keep_best(start_graph(nodes, dim, n, degree), degree))
    for turn in range(rounds):
        graph = materialize(descend(graph, nodes, degree, turn))
    return graph


def neighbour_lists(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, m): the neighbours of each vector and some it is a neighbour of, with their codes."""
    both = graph.select("u", "v").union(top_k(graph.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u"], [F.xxhash64("u", "v")], REVERSE)).distinct()
    lists = both.join(nodes.select(F.col("id").alias("v"), "code"), "v").groupBy("u").agg(F.collect_list(F.struct(F.col("v").alias("id"), "code")).alias("m"))
    return materialize(lists)


def search(lists: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, id): the ``beam`` likest vectors that a greedy search from ``queries`` (query, code, start) finds.

    The opened vector's neighbours come with their codes, so a step is one join of opened vectors with neighbour lists.
    It ends when all vectors kept are opened; a vector that fell out can't come back, so none is opened again and again.
    """

    @F.arrow_udf("array<struct<id:long,s:double>>")
    def near(code: pa.Array, floor: pa.Array, m: pa.Array) -> pa.Array:
        flat, size = m.flatten(), m.value_lengths().to_numpy(zero_copy_only=False)
        held, q, row = flat.field("code"), codes(code), np.repeat(np.arange(len(size)), size)
        cut = range(0, len(row), SCORED)
        s = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", codes(held.slice(a, SCORED)), q[row[a:a + SCORED]]) for a in cut]])
        hit = s > floor.to_numpy(zero_copy_only=False)[row]
        n = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(size)))]).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(flat.field("id").to_numpy()[hit]), pa.array(s[hit].astype(np.float64))], ["id", "s"])
        return pa.ListArray.from_arrays(pa.array(n), rows)

    state = queries.select("query", F.col("start").alias("id"), F.lit(float("-inf")).alias("s"), F.lit(False).alias("opened"))
    while state.where("NOT opened").limit(1).count():
        floor = state.groupBy("query").agg(F.when(F.count("*") >= beam, F.min("s")).otherwise(float("-inf")).alias("floor"))
        front = top_k(state.where("NOT opened"), ["query"], [F.desc("s"), "id"], max(1, beam // OPENED)).select("query", "id")
        asked = front.join(queries.select("query", "code"), "query").join(floor, "query")
        found = asked.join(lists, asked["id"] == lists["u"]).select("query", F.explode(near("code", "floor", "m")).alias("e")).select("query", "e.id", "e.s", F.lit(False).alias("opened"))
        done = front.withColumn("now", F.lit(True))
        state = state.join(done, ["query", "id"], "left").select("query", "id", "s", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened"))
        state = state.union(found).groupBy("query", "id").agg(F.max("s").alias("s"), F.max("opened").alias("opened"))
        state = materialize(top_k(state, ["query"], [F.desc("s"), "id"], beam))
    return state.select("query", "id")


def sure_beam(lists: DataFrame, queries: DataFrame, classes: DataFrame, dim: int, n: int, k: int, beam: int = BEAM) -> int:
    """``beam``, doubled until ``MEASURED`` of the queries find ``RECALL`` of their ``k`` nearest, or all that can be reached."""
    some = materialize(queries.orderBy(F.xxhash64("query"), "query").limit(MEASURED))
    asked = some.join(classes.select(F.col("rep").alias("query"), "v"), "query").select("query", "v").collect()
    ids, q = np.array([r["query"] for r in asked], np.int64), np.array([r["v"] for r in asked]).reshape(-1, dim)

    def scores(batches):
        for batch in batches:
            s = q @ matrix(batch.column(1), dim).T
            near = np.argsort(-s, axis=1, kind="stable")[:, :k]
            rep = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, near.shape[1])), pa.array(rep[near].ravel()), pa.array(np.take_along_axis(s, near, axis=1).ravel())], ["query", "id", "s"])

    true = materialize(top_k(classes.select("rep", "v").mapInArrow(scores, "query long, id long, s double"), ["query"], [F.desc("s"), "id"], k).select("query", "id"))
    wanted = true.count()
    while beam < n:
        found = materialize(search(lists, some, beam))
        if found.join(true, ["query", "id"]).count() >= RECALL * wanted or not found.groupBy("query").count().where(F.col("count") >= beam).count():
            break
        beam *= 2
    return beam


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``is_query`` holds the ``k`` vectors of largest inner product found, itself left out.

    score is the inner product of the original vectors in double precision; ties go to the smaller id, and with fewer
    than ``k`` candidates all come. Null, empty and zero vectors, vectors with null or non-finite components, rows
    without an id and vectors of another length than most take no part. Rows that repeat an id count once, with the
    smallest vector. Equal vectors are one place in the graph, which stands for the k + 1 smallest of their ids; more
    could not be among the nearest. Other columns are not read.
    """
    bounded_batches(vectors, LISTS)
    rows = vectors.withColumn("_q", is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), "_q") if "_q" not in vectors.columns else vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("_q"))
    once = rows.where("id IS NOT NULL").where(usable("v")).groupBy("id").agg(F.min("v").alias("v"), F.max(F.coalesce("_q", F.lit(False))).alias("q"))
    once = materialize(once)
    shape = once.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = "query_id long, rank int, id long, score double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = shape["dim"]
    once = once.where(F.size("v") == dim)
    classes = materialize(once.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    n = classes.count()
    nodes = materialize(classes.select(F.col("rep").alias("id"), packed(dim)("v").alias("code")))
    member = once.join(classes.select("v", "rep"), "v")  # equal vectors meet by value
    members = materialize(top_k(member.select("rep", "id"), ["rep"], ["id"], k + 1))
    asking = member.where("q").select(F.col("id").alias("query"), "rep", F.col("v").alias("qv"))
    asking = materialize(asking)
    starts = asking.select("rep").distinct().join(nodes, F.col("rep") == F.col("id")).select(F.col("rep").alias("query"), "code", F.col("rep").alias("start"))
    starts, lists = materialize(starts), neighbour_lists(build_graph(nodes, dim, n), nodes)
    found = search(lists, starts, sure_beam(lists, starts, classes, dim, n, k + 1)).union(starts.select("query", F.col("start").alias("id"))).distinct()

    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = asking.join(found.withColumnRenamed("query", "rep"), "rep").join(classes.select(F.col("rep").alias("id"), "v"), "id")
    scored = scored.select("query", F.col("id").alias("near"), exact.alias("score"))
    scored = top_k(scored, ["query"], [F.desc("score"), "near"], k + 1)
    each = scored.join(members, scored["near"] == members["rep"]).where(F.col("query") != F.col("id")).select(F.col("query").alias("query_id"), "id", "score")
    return top_k(each, ["query_id"], [F.desc("score"), "id"], k, rank="rank").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")

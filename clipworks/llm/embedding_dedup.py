"""Embedding near-duplicates by randomised-rotation binary codes (RaBitQ).

Each unit vector o is rotated and replaced by its nearest corner o' of the cube, one bit per dimension, with the factor
<o', o> stored beside it. Popcounts over a query's four bit planes give <o', q>, and <o', q> / <o', o> is an unbiased
estimate of <o, q>. A pair is recomputed exactly when the estimate's confidence bound reaches the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipworks.functions.groups import small_side
from clipworks.llm.components import components
from clipworks.sources.tables import materialize

#: Vectors of one label are compared in blocks of about this many.
BLOCK = 1024
PLANES, STRIPE = 4, 32


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x 64-bit words) and factors <o', o> of unit vectors that are already rotated."""
    rows, dim = unit.shape
    bits = np.zeros((rows, -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = unit > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.abs(unit).sum(axis=1) / np.sqrt(dim)


def planes(unit: np.ndarray):
    """Rotated queries as ``PLANES``-bit numbers low + step * u: bit planes of u, low, step and the sums of the queries."""
    low = unit.min(axis=1)
    step = np.maximum((unit.max(axis=1) - low) / (2 ** PLANES - 1), 1e-300)
    u = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
    rows, dim = unit.shape
    out = np.zeros((PLANES, rows, -(-dim // 64)), np.uint64)
    for p in range(PLANES):
        bits = np.zeros((rows, -(-dim // 64) * 64), np.uint8)
        bits[:, :dim] = (u >> p) & 1
        out[p] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out, low, step, (low[:, None] + step[:, None] * u).sum(axis=1)


def candidates(q_planes, low, step, total, codes: np.ndarray, factors: np.ndarray, threshold: float, dim: int) -> np.ndarray:
    """Matrix queries x codes: whether the confidence bound of the estimated cosine reaches ``threshold``.

    The bound is one that can't fail: <o', q> differs from <o', o><o, q> by at most the product of the sines of the two
    angles, and from its value over the bit planes by half a step in each dimension.
    """
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
    both = np.zeros((len(low), len(codes)))
    for p in range(PLANES):
        count = np.zeros(both.shape, np.uint16)
        for w in range(codes.shape[1]):
            count += np.bitwise_count(q_planes[p][:, w, None] & codes[None, :, w])
        both += (1 << p) * count.astype(np.float64)
    near = (2 * (low[:, None] * ones[None, :] + step[:, None] * both) - total[:, None]) / np.sqrt(dim)  # <o', q>
    slack = np.sqrt(max(0.0, 1 - threshold ** 2)) * np.sqrt(np.maximum(0, 1 - factors ** 2))[None, :] + step[:, None] / 2 * np.sqrt(dim)
    return (near + slack) / factors[None, :] >= threshold - 1e-9


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component is between a half and 1: no square is lost or too large."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def compare(ids: np.ndarray, vectors: np.ndarray, side: np.ndarray | None, threshold: float):
    """Links within one block (``side`` None) or between the two sides: per linked vector its id, number of links, and the smallest id it reaches here."""
    dim = vectors.shape[1]
    norms = np.sqrt((vectors ** 2).sum(axis=1))
    turned = (vectors / norms[:, None]) @ rotation(dim).T
    own = side is None
    a, b = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    codes, factors = encode(turned[b])
    count, left, right = np.zeros(len(ids), np.int64), [np.zeros(0, int)], [np.zeros(0, int)]
    for k in range(0, len(a), STRIPE):
        some = a[k:k + STRIPE]
        i, j = np.nonzero(candidates(*planes(turned[some]), codes, factors, threshold, dim))
        i, j = some[i], b[j]
        if own:
            i, j = i[i < j], j[i < j]
        cos = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norms[i] * norms[j])
        i, j = i[cos >= threshold], j[cos >= threshold]
        np.add.at(count, i, 1)
        np.add.at(count, j, 1)
        left.append(i)
        right.append(j)
    left, right = np.concatenate(left), np.concatenate(right)
    root = ids.copy()
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        if (root == before).all():
            break
    hit = np.flatnonzero(count)
    return ids[hit], count[hit], root[hit]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept), one row per id; cosine >= ``threshold`` links vectors of equal label and length.

    Null, empty and zero vectors, vectors with null or non-finite components and vectors without a label link with
    nothing; cosines are those of doubles of any size. A null id gets a row of its own without component and is kept. Of rows that repeat an id the one with the
    smallest label and vector counts. Ties don't arise: links depend on the pair alone. Other columns are not read.

    The vectors of a label are dealt into blocks by hashed id, so that a label of any size is many tasks of at most two
    blocks; each emits counts and the smallest id reached, never the pairs themselves.
    """
    kind = vectors.schema[vector_col].dataType
    as_given = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # floats stay short until they are compared
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if as_given else "array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    once = materialize(rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*"))
    usable = once.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    sizes = usable.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = usable.join(small_side(sizes), ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "v")

    def pair(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flat = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)
        ids, links, root = compare(table.column("id").to_numpy(), scaled(flat.reshape(table.num_rows, -1)), None if key[2].as_py() == key[3].as_py() else table.column("side").to_numpy(), threshold)
        return pa.table({"id": ids, "links": links, "root": root})

    found = materialize(dealt.groupBy("label", "dim", "lo", "hi").applyInArrow(pair, "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    comp = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    out = once.select("id").join(counts, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    nameless = rows.where("id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.union(nameless)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))

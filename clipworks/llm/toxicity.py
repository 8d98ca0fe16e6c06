"""Toxicity scores from the nearest labelled examples under exact TF-IDF cosine.

A bounded set of labelled examples is drawn by hashed id. Of their terms, those that mark the positive class by
chi-square become the vocabulary, and the examples an inverted index in blocks; each (term, block) holds its largest
weight, so blocks that can't reach the k-th best cosine are skipped and the neighbours found are exactly the nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.llm import textbytes as tb
from clipworks.llm.frames import bounded_batches, fresh, one_label, remainder
from clipworks.sources.tables import materialize

#: Bounds of the fitted model: examples per class and terms. Everything else sees all rows.
EXAMPLES_PER_CLASS, TERMS = 2048, 1024
LEAST_CHI = 40.0
NEIGHBOURS, BLOCK, POWER, PRIOR_WEIGHT = 15, 64, 4.0, 0.02
PREFIXES = (4, 5, 6, 7)
APART = tb.SPACE.copy()
APART[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


def among(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in the sorted vocabulary, and whether it is there."""
    if not len(vocabulary):
        return np.zeros(len(h), int), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return at, vocabulary[at] == h


def terms(column, vocabulary: np.ndarray | None = None):
    """For runs of rows: distinct terms (of ``vocabulary`` only, if given) with their counts, by row, and the first one of each row (rows + 1).

    Terms are words in lower case without ASCII punctuation, and the starts of words of 4 to 7 bytes.
    """
    for data, offsets in tb.chunks(column):
        data = tb.LOWER[data]
        starts, ends, first = tb.words(data, offsets, APART)
        row = tb.owner(first)
        h, r = [tb.span_hash(data, starts, ends)], [row]
        for size in PREFIXES:
            long = ends - starts > size
            h.append(tb.mix(tb.span_hash(data, starts[long], starts[long] + size) + np.uint64(size)))
            r.append(row[long])
        h, r = np.concatenate(h), np.concatenate(r)
        if vocabulary is not None:
            known = among(vocabulary, h)[1]
            h, r = h[known], r[known]
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, int)
        yield h[new], np.diff(np.append(new, len(h))), np.searchsorted(r[new], np.arange(len(offsets)))


def term_counts(column, vocabulary: np.ndarray | None = None) -> Column:
    """Hashes and counts of a text's distinct terms, of ``vocabulary`` only if given."""
    kind = pa.struct([("h", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32()))])

    @F.arrow_udf("struct<h:array<bigint>,tf:array<int>>")
    def counted(text: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays([tb.lists(h.view(np.int64), first), tb.lists(c.astype(np.int32), first)], fields=list(kind)) for h, c, first in terms(text, vocabulary)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return counted(column)


@dataclass
class Index:
    """Terms (sorted hashes) with idf; per (term, block) the row of ``weights``, or -1, and the largest weight there."""

    vocabulary: np.ndarray
    idf: np.ndarray
    slot: np.ndarray
    most: np.ndarray
    weights: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    share: np.ndarray
    prior: float

    def nearest(self, at: np.ndarray, q: np.ndarray, k: int = NEIGHBOURS):
        """Positions and cosines of the k examples nearest to the unit vector ``q`` over terms ``at``; no zero cosines; ties to the smaller position."""
        bound = q @ self.most[at]
        best_pos, best = np.zeros(0, int), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1] - 1e-9):
                break
            rows = self.slot[at, b]
            has = rows >= 0
            s = q[has] @ self.weights[rows[has]]
            hit = np.flatnonzero(s > 0)
            pos, s = np.concatenate([best_pos, b * BLOCK + hit]), np.concatenate([best, s[hit]])
            order = np.lexsort((pos, -s))[:k]
            best_pos, best = pos[order], s[order]
        return best_pos, best

    def vector(self, h: np.ndarray, tf: np.ndarray):
        at, known = among(self.vocabulary, h)
        at = at[known]
        q = (1 + np.log(tf[known])) * self.idf[at]
        return at, q / max(np.sqrt((q * q).sum()), 1e-300)

    def score(self, pos: np.ndarray, cos: np.ndarray) -> float:
        """Share of the positive class among the neighbours, weighted by closeness and by what an example stands for."""
        w = cos ** POWER * self.share[self.label[pos]]
        return float((w @ self.label[pos] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))


def build(examples: list, vocabulary: np.ndarray, idf: np.ndarray, counts: tuple[int, int]) -> Index:
    """Index of ``examples`` (id, label, term hashes, counts) by blocks of ``BLOCK``, likely neighbours side by side."""
    empty = Index(vocabulary, idf, None, None, None, np.zeros(0, int), np.zeros(0, object), np.ones(2), 0.0)
    vectors = [(r[0], r[1], *empty.vector(np.asarray(r[2], np.int64).view(np.uint64), np.asarray(r[3]))) for r in examples]
    vectors.sort(key=lambda v: (v[1], int(v[2][np.argmax(v[3])]) if len(v[2]) else -1, str(v[0])))
    blocks = max(1, -(-len(vectors) // BLOCK))
    slot = np.full((len(vocabulary), blocks), -1, np.int32)
    used = sorted({(int(t), i // BLOCK) for i, v in enumerate(vectors) for t in v[2]})
    weights = np.zeros((len(used) + 1, BLOCK))
    for n, (t, b) in enumerate(used):
        slot[t, b] = n
    for i, v in enumerate(vectors):
        weights[slot[v[2], i // BLOCK], i % BLOCK] = v[3]
    most = np.where(slot >= 0, weights.max(axis=1)[slot], 0.0)
    label = np.array([v[1] for v in vectors], int)
    there = np.bincount(label, minlength=2)
    share = np.array([counts[c] / there[c] if there[c] else 1.0 for c in (0, 1)])
    return Index(vocabulary, idf, slot, most, weights, label, np.array([v[0] for v in vectors], object), share / max(share.max(), 1e-9), counts[1] / max(1, sum(counts)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: Column | None = None, examples_per_class: int = EXAMPLES_PER_CLASS, max_terms: int = TERMS) -> Index:
    """The index over labelled texts; ``keep`` says which labels may be learnt from.

    The examples are the ``examples_per_class`` of each class with the smallest hashed ids. The driver gets those at
    most, each with no more than ``max_terms`` terms, which makes the bound of the model that the executors share.
    """
    bounded_batches(docs)
    lab = one_label(labels if keep is None else labels.where(keep), id_col, label_col).where("label IN (0, 1)")
    n = {r[0]: r[1] for r in lab.groupBy("label").count().collect()}
    few = [lab.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(examples_per_class) for value in (0, 1)]
    few = F.broadcast(few[0].union(few[1]))  # ids only, 2 * examples_per_class rows
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(few, "id").dropDuplicates(["id"])
    texts = materialize(texts)
    drawn = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    n0, n1 = drawn.get(0, 0), drawn.get(1, 0)
    vectors = texts.select("id", "label", term_counts("text").alias("t"))
    seen = vectors.select("label", F.explode("t.h").alias("h")).groupBy("h").agg(F.count("*").alias("df"), F.sum("label").alias("a"))
    a, b = F.col("a").cast("double"), (F.col("df") - F.col("a")).cast("double")
    c, d = n1 - a, n0 - b
    chi = (n0 + n1) * (a * d - b * c) ** 2 / F.greatest(F.lit(1.0), (a + b) * (c + d) * (a + c) * (b + d))
    marks = seen.select("h", "df", chi.alias("chi"), (a * n0 > b * n1).alias("positive")).where(F.col("positive") & (F.col("df") > 1) & (F.col("chi") >= LEAST_CHI))
    pairs = sorted((np.int64(r["h"]).view(np.uint64).item(), r["df"]) for r in marks.orderBy(F.desc("chi"), "h").limit(max_terms).collect())
    vocabulary = np.array([p[0] for p in pairs], np.uint64)
    idf = np.log((n0 + n1 + 1) / np.array([p[1] + 0.5 for p in pairs])) if pairs else np.zeros(0)
    rows = [(r["id"], r["label"], r["t"]["h"], r["t"]["tf"]) for r in texts.select("id", "label", term_counts("text", vocabulary).alias("t")).collect()]
    return build(rows, vocabulary, idf, (n.get(0, 0), n.get(1, 0)))


def scorer(index, k: int = NEIGHBOURS):
    """UDF over texts: score, and the ids (as text) and cosines of the neighbours that voted. ``index`` is a broadcast Index."""
    kind = pa.struct([("score", pa.float64()), ("neighbours", pa.list_(pa.string())), ("cosines", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<score:double,neighbours:array<string>,cosines:array<double>>")
    def score(text: pa.Array) -> pa.Array:
        model, out = index.value, []
        for h, tf, first in terms(text, model.vocabulary):
            for lo, hi in zip(first[:-1], first[1:]):
                pos, cos = model.nearest(*model.vector(h[lo:hi], tf[lo:hi]), k) if hi > lo else (np.zeros(0, int), np.zeros(0))
                out.append({"score": model.score(pos, cos), "neighbours": [str(x) for x in model.ids[pos]], "cosines": cos.tolist()})
        return pa.array(out, kind)

    return score.asNondeterministic()  # costly: not to be run twice


def score_texts(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``: score (0 to 1), neighbours, cosines (the column is renamed on a clash).

    Null and empty texts, and texts without known terms, have no neighbours and get the share of the positive class.
    Repeated rows get equal scores. An index without examples gives every text that share, 0 if nothing was labelled.
    """
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return docs.withColumn(fresh(docs, "toxicity"), scorer(shared)(F.coalesce(F.col(text_col), F.lit(""))))


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 5) == 0


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without those whose score reaches ``threshold``; learnt from all labelled rows of ``docs`` outside the held-out fold."""
    index = fit(docs, labels, id_col, text_col, keep=~held_out(id_col))
    made = fresh(docs, "toxicity")
    return score_texts(docs, index, text_col).where(F.col(f"{made}.score") < threshold).select(*docs.columns)

"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each class is a Gaussian over transformed statistics of a text, its covariance shrunk towards the pooled one and then
towards its own diagonal. The score is the posterior from the difference of the log densities, which come from the
Mahalanobis distances under the Cholesky factors made once when the model is fitted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.llm import textbytes as tb
from clipworks.llm.frames import bounded_batches, one_label, remainder
from clipworks.sources.tables import materialize

STATISTICS = ["log_words", "word_bytes", "word_spread", "distinct_words", "repeats", "upper", "digits", "marks", "marked_words", "lone_marks", "line_words", "line_ends", "distinct_lines"]
TO_POOLED, TO_DIAGONAL, FLOOR = 0.1, 0.1, 1e-3
UPPER, DIGIT, LETTER, MARK, STOP = (np.zeros(256, bool) for _ in range(5))
UPPER[0x41:0x5B] = True
DIGIT[0x30:0x3A] = True
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?()"]] = True
STOP[[ord(c) for c in ".?!:;\"')"]] = True


def _share(a, b):
    return np.log((a + 0.5) / (b - a + 1.0))  # a logit that is finite at both ends


def statistics(column) -> np.ndarray:
    """Rows x statistics. Shares are logits and sizes logarithms, so that classes come nearer to Gaussians; an empty text has all counts 0."""
    out = []
    for data, offsets in tb.chunks(column):
        total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)
        starts, ends, first = tb.words(data, offsets)
        n, row = np.diff(first).astype(float), tb.owner(first)
        rows = len(n)
        size = (ends - starts).astype(float)
        mean = np.bincount(row, size, rows) / np.maximum(n, 1)
        spread = np.sqrt(np.maximum(0, np.bincount(row, size ** 2, rows) / np.maximum(n, 1) - mean ** 2))
        h = tb.span_hash(tb.LOWER[data], starts, ends)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((h, row))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][new], minlength=rows)
        marks = np.concatenate([[0], np.cumsum(MARK[data])])
        in_word = marks[ends] - marks[starts]
        feeds = np.flatnonzero(data == 0x0A)
        lines = np.diff(np.searchsorted(feeds, offsets)) + 1.0
        last = np.concatenate([feeds, offsets[1:][offsets[1:] > offsets[:-1]]])  # ends of lines; the byte before may close a sentence
        last = np.sort(last[last > 0])
        stops = np.bincount(np.minimum(np.searchsorted(offsets, last - 1, "right") - 1, rows - 1), STOP[data[last - 1]], rows) if len(last) else np.zeros(rows)
        l_start = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
        l_start = l_start[l_start < len(data)]
        l_end = np.append(l_start[1:], len(data)) if len(l_start) else l_start
        l_row = np.searchsorted(offsets, l_start, "right") - 1
        lh = tb.span_hash(data, l_start, np.where(data[l_end - 1] == 0x0A, l_end - 1, l_end)) if len(l_start) else np.zeros(0, np.uint64)
        order = np.lexsort((lh, l_row))
        new = np.ones(len(lh), bool)
        new[1:] = (lh[order][1:] != lh[order][:-1]) | (l_row[order][1:] != l_row[order][:-1])
        distinct_lines = np.bincount(l_row[order][new], minlength=rows)
        letters, upper, digits, mark = total(LETTER[data]), total(UPPER[data]), total(DIGIT[data]), total(MARK[data])
        length = np.diff(offsets).astype(float)
        out.append(np.stack([
            np.log1p(n), np.log1p(mean), np.log1p(spread), _share(distinct, n), _share(np.bincount(row, same, rows), n), _share(upper, letters), _share(digits, length), _share(mark, length),
            _share(np.bincount(row, (in_word > 0) & (in_word < size), rows), n), _share(np.bincount(row, in_word == size, rows), n), np.log1p(n / lines), _share(np.minimum(stops, lines), lines), _share(np.minimum(distinct_lines, lines), lines)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


@dataclass
class Model:
    """Per class: mean, inverse of the Cholesky factor of its covariance, log determinant and log prior; scale brings the statistics to one size."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [self.log_prior[c] - 0.5 * self.log_det[c] - 0.5 * (((z - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def model(count: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Model:
    """From per-class counts, sums and sums of products. A class without rows takes the other's shape at prior 1 in n + 2."""
    d = sums.shape[1]
    n = max(1.0, count.sum())
    centre = sums.sum(axis=0) / n
    scale = np.sqrt(np.maximum(FLOOR, np.diag(products.sum(axis=0)) / n - centre ** 2))
    mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        if count[c]:
            m = sums[c] / count[c]
            mean[c], cov[c] = (m - centre) / scale, (products[c] / count[c] - np.outer(m, m)) / np.outer(scale, scale)
    pooled = (count[0] * cov[0] + count[1] * cov[1]) / n + FLOOR * np.eye(d)
    factor, log_det = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        own = (1 - TO_POOLED) * cov[c] + TO_POOLED * pooled if count[c] > d else pooled
        own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * np.diag(np.diag(own)) + FLOOR * np.eye(d)
        chol = np.linalg.cholesky(own)
        factor[c], log_det[c] = np.linalg.inv(chol), 2 * np.log(np.diag(chol)).sum()
    return Model(centre, scale, mean, factor, log_det, np.log((count + 1) / (count.sum() + 2)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) for every row: the statistics of its text, written once so that fitting and scoring read each text once and move none."""

    @F.arrow_udf("array<double>")
    def taken(text: pa.Array) -> pa.Array:
        x = statistics(text)
        return tb.lists(x.ravel(), np.arange(len(x) + 1) * len(STATISTICS))

    bounded_batches(docs)
    return materialize(docs.select(F.col(id_col).alias("id"), taken(F.coalesce(F.col(text_col), F.lit(""))).alias("x")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", keep: Column | None = None) -> Model:
    """The model over all labelled rows of ``measured`` (``keep`` says which labels may be learnt from): every task adds up its own sums, the driver gets two rows."""
    lab = one_label(labels if keep is None else labels.where(keep), id_col, label_col).where("label IN (0, 1)")
    rows = measured.join(lab, "id").select("label", "x")
    d = len(STATISTICS)

    def add(batches):
        count, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x, y = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for c in (0, 1):
                own = x[y == c]
                count[c] += len(own)
                sums[c] += own.sum(axis=0)
                products[c] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([np.concatenate([[count[c]], sums[c], products[c].ravel()]).tolist() for c in (0, 1)], pa.list_(pa.float64()))], ["label", "sums"])

    parts = rows.mapInArrow(add, "label int, sums array<double>").select("label", F.posexplode("sums").alias("i", "x"))
    total = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("label", "i").agg(F.sum("x").alias("x")).collect():  # 2 * (1 + d + d * d) numbers
        total[r["label"], r["i"]] = r["x"]
    return model(total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d))


def score(measured: DataFrame, fitted: Model) -> DataFrame:
    """(id, quality_score), the probability of class 1, for every row of ``measured``. Null texts were measured as empty; repeats score alike."""

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(fitted.score(_matrix(x)))

    return measured.select("id", scored.asNondeterministic()("x").alias("quality_score"))


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 3) == 1

"""Spelling variant grouping: PartEnum signatures over letter multisets, equi-joined and verified.

A word is a binary vector with one place for each (letter, how many of it came before). One edit moves at most two places:
a replaced letter two, an added one exactly one. Places are dealt over parts by a hash; vectors within Hamming distance
k agree on all but k of the parts, so each word lists the sums of its parts without every choice of k of them. Words
that list a common sum are compared letter by letter. As one edit leaves the first or the last half of a word alone, a
signature also names a half, which keeps words of the same letters in other orders apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.llm import textbytes as tb
from clipworks.sources.tables import materialize

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Parts for words of equal length (two places differ) and of lengths one apart (one place differs).
EQUAL_PARTS, ADDED_PARTS = 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(run: Column, key: Column, every: int) -> Column:
    """``run`` without one letter where the crc32 of ``key:run`` is divisible by ``every``; the letter at that number modulo the length."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all whole texts, A-Z in lower case, with ``min_letters`` letters and ``min_count``
    occurrences at least. ``every`` plants misspellings (see ``damaged``); a null id then counts as the empty text."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_letters).withColumn("run", F.translate("run", UPPER, LOWER))
    words = runs.select((damaged(F.col("run"), F.col("key"), every) if every else F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def part_sums(column, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the places of each word by part (words x parts), the code points of all words, and their starts and lengths."""
    texts = [x or "" for x in column.to_pylist()]
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    order = np.lexsort((points, row))
    row, letter = row[order], points[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (letter[1:] != letter[:-1])
    heads = np.flatnonzero(new)
    before = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
    place = tb.mix(letter.astype(np.uint64) * tb.U(0x9E3779B97F4A7C15) + before.astype(np.uint64))
    sums = np.zeros((len(texts), parts), np.uint64)
    np.add.at(sums, (row, ((place >> tb.U(33)) % tb.U(parts)).astype(np.int64)), tb.mix(place))
    return sums, points, start, size


def _halves(points: np.ndarray, start: np.ndarray, size: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first ``count // 2`` and of the last ``count - count // 2`` letters of each word."""
    data = np.ascontiguousarray(points.astype(np.uint32)).view(np.uint8)
    first = tb.span_hash(data, 4 * start, 4 * (start + count // 2))
    last = tb.span_hash(data, 4 * (start + size - (count - count // 2)), 4 * (start + size))
    return [tb.mix(first + tb.U(1)), tb.mix(last + tb.U(2))]


def signatures(column, equal_parts: int = EQUAL_PARTS, added_parts: int = ADDED_PARTS) -> Iterator[tuple[np.ndarray, int]]:
    """Arrays with one signature a word, each with its role: 0 meets 0 (equal lengths), 1 meets 2 (one letter shorter and longer)."""
    for parts, k, roles in ((equal_parts, 2, (0,)), (added_parts, 1, (1, 2))):
        sums, points, start, size = part_sums(column, parts)
        total = sums.sum(axis=1, dtype=np.uint64)
        for role in roles:
            shorter = size - 1 if role == 2 else size  # the length of the shorter word of a pair
            for half in _halves(points, start, size, shorter):
                for number, left_out in enumerate(combinations(range(parts), k)):
                    kept = total - sums[:, list(left_out)].sum(axis=1, dtype=np.uint64)
                    yield tb.fold([kept, shorter.astype(np.uint64), half], seed=k * 1000 + number), role


def near_pairs(words: DataFrame, equal_parts: int = EQUAL_PARTS, added_parts: int = ADDED_PARTS) -> DataFrame:
    """(word, n, near, near_n), both ways: the words of ``words`` (word, n) that differ by one added, left out or replaced code point."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            for sign, role in signatures(batch.column(0), equal_parts, added_parts):
                yield pa.RecordBatch.from_arrays([pa.array(sign.view(np.int64)), pa.array(np.full(rows, role, np.int8)), batch.column(0), batch.column(1)], ["sign", "role", "word", "n"])

    signed = words.select("word", "n").mapInArrow(listed, "sign long, role byte, word string, n long")
    a, b = signed.alias("a"), signed.alias("b")  # Spark takes these to be as small as ``words``, so it must not broadcast them
    meet = (F.col("a.sign") == F.col("b.sign")) & (F.col("a.role") * 3 + F.col("b.role")).isin(0, 5) & ((F.col("a.role") > 0) | (F.col("a.word") < F.col("b.word")))
    found = a.join(b.hint("merge"), meet & (F.levenshtein("a.word", "b.word", 1) == 1))
    pairs = found.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last. Each form has several times its word's count, so that no
    chain is longer than 27 links while counts fit a long; five doublings reach over 32."""
    links = materialize(links.select("word", F.col("form").alias("root")))
    for _ in range(5):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(on, "root", "left_semi").isEmpty():
            break
        links = materialize(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return links


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct ``words`` (word, n).

    The form is the near word of largest n (of ties, the first in code-point order) if that is ``ratio`` (5 at least) times
    the word's own; else null. The root is the last form reached, or the word itself. An empty table gives no rows.
    """
    if ratio < 5:
        raise ValueError("chains of forms are bounded for ratios of 5 and more")
    words = materialize(words.select("word", "n"))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    enough = F.col("near_n") >= ratio * F.col("n")
    known = materialize(known.select("word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")))
    out = known.join(roots(known.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``group_variants`` of the ``word_counts`` of all whole texts. Null and empty texts have no words; rows that repeat count
    each; other columns aren't read."""
    return group_variants(word_counts(docs, id_col, text_col, every, min_letters, min_count))

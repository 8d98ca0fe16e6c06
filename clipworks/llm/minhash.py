"""MinHash near-duplicate detection with odd sketches.

A document is the set of its distinct word shingles. MinHash bands propose pairs, odd sketches (parity bitmaps of the
MinHash samples, compared by XOR and population count) drop unlike ones, and the full shingle sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.functions.groups import small_side
from clipworks.llm import textbytes as tb
from clipworks.llm.components import components
from clipworks.llm.frames import bounded_batches, fresh
from clipworks.sources.tables import materialize

BANDS, ROWS, SKETCH_WORDS = 32, 4, 8
#: Least similarity of a set of 128 samples that may still be 0.8 in truth: five standard errors of 0.035 below it.
SLACK = 0.18
#: A finer sketch of as many samples and 64-bit words, made only for what the first rounds leave open; five standard errors of 0.01.
FINE_SAMPLES, FINE_WORDS, FINE_SLACK = 2048, 128, 0.05
STAR_ROUNDS = 2
#: Ids to confirm up to this number are sent to the texts; more meet them in a shuffle.
SENT_IDS = 500_000


def shingles(column, width: int):
    """For runs of rows: distinct shingle hashes, ordered by row and hash, and the first one of each row (rows + 1)."""
    for words, first in tb.word_hashes(column):
        n = np.diff(first)
        row = tb.owner(first)
        at = np.flatnonzero(np.arange(len(words)) + width <= first[1:][row]) if len(words) else np.zeros(0, int)
        hashes, rows = [tb.fold([words[at + k] for k in range(width)], width)], [row[at]]
        for k in range(1, width):
            short = np.flatnonzero(n == k)
            hashes.append(tb.fold([words[first[short] + j] for j in range(k)], k))
            rows.append(short)
        h, r = np.concatenate(hashes), np.concatenate(rows)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        yield h[new], np.searchsorted(r[new], np.arange(len(n) + 1))


def signatures(width: int, bands: int = BANDS, rows: int = ROWS, sketch_words: int = SKETCH_WORDS):
    """UDF: set size, two digests of the set, odd sketch and band keys of a text."""
    k = bands * rows
    scale, shift = samplers(k)

    @F.arrow_udf("struct<n:bigint,d1:bigint,d2:bigint,odd:array<bigint>,bands:array<bigint>>")
    def signature(text: pa.Array) -> pa.Array:
        parts = []
        for h, first in shingles(text, width):
            n = np.diff(first)
            full = np.flatnonzero(n)
            starts = first[:-1][full]
            d = np.zeros((2, len(n)), np.uint64)
            least = np.zeros((k, len(n)), np.uint64)
            if len(full):
                d[0, full] = np.add.reduceat(tb.mix(h), starts)
                d[1, full] = np.add.reduceat(tb.mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                for i in range(k):
                    least[i, full] = np.minimum.reduceat(h * scale[i] + shift[i], starts)
            keys = np.stack([tb.fold(list(least[b * rows:(b + 1) * rows]), b) for b in range(bands)], axis=1)
            odd = parities(least, sketch_words)
            parts.append((n, d[0], d[1], odd, keys))
        if not parts:
            return pa.array([], signature_type)
        n, d1, d2, odd, keys = (np.concatenate(x) for x in zip(*parts))
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), grid(odd), grid(keys)], ["n", "d1", "d2", "odd", "bands"])

    signature_type = pa.struct([("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("odd", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
    return signature


def parities(samples: np.ndarray, sketch_words: int) -> np.ndarray:
    """Odd sketches (rows x words): sample i of value v flips bit hash(i, v)."""
    odd = np.zeros((samples.shape[1], sketch_words), np.uint64)
    who = np.arange(samples.shape[1])
    for i, least in enumerate(samples):
        bit = tb.mix(least + np.uint64(i) * np.uint64(0xA24BAED4963EE407)) % np.uint64(64 * sketch_words)
        odd[who, (bit >> np.uint64(6)).astype(int)] ^= np.uint64(1) << (bit & np.uint64(63))
    return odd


def samplers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def grid(a: np.ndarray) -> pa.ListArray:
    return tb.lists(a.reshape(-1).view(np.int64), np.arange(len(a) + 1) * a.shape[1])


def fine_sketch(width: int, samples: int = FINE_SAMPLES, sketch_words: int = FINE_WORDS):
    """UDF: the odd sketch of ``samples`` MinHash samples of a text."""
    scale, shift = samplers(samples)

    @F.arrow_udf("array<bigint>")
    def sketch(text: pa.Array) -> pa.Array:
        parts = []
        for h, first in shingles(text, width):
            full = np.flatnonzero(np.diff(first))
            least = np.zeros((samples, len(first) - 1), np.uint64)
            for i in range(samples if len(full) else 0):
                least[i, full] = np.minimum.reduceat(h * scale[i] + shift[i], first[:-1][full])
            parts.append(grid(parities(least, sketch_words)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return sketch


def shingle_sets(width: int):
    """UDF: the distinct shingle hashes of a text."""

    @F.arrow_udf("array<bigint>")
    def sets(text: pa.Array) -> pa.Array:
        parts = [tb.lists(h.view(np.int64), first) for h, first in shingles(text, width)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return sets


def estimate(a: str, b: str, samples: int, sketch_words: int = SKETCH_WORDS) -> Column:
    """Similarity of two sets from the odd sketches ``a`` and ``b`` of as many samples.

    Each differing sample flips one bit of either bitmap, so the share of odd bits in the XOR is (1 - e^(-4k(1-J)/bits)) / 2.
    """
    bits = 64 * sketch_words
    if sketch_words > 16:  # too long to write out
        flips = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        odd = F.aggregate(flips, F.lit(0), lambda acc, x: acc + x)
    else:
        odd = sum((F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(1, sketch_words)),
                  F.bit_count(F.get(F.col(a), F.lit(0)).bitwiseXOR(F.get(F.col(b), F.lit(0)))))
    rest = F.greatest(F.lit(1e-9), 1 - 2 * odd / bits)
    return 1 + bits * F.log(rest) / (4 * samples)


def similar(a: str, b: str, percent: int, samples: int) -> Column:
    """Pairs worth a full comparison: set sizes that allow the similarity, and sketches near enough."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (estimate(f"{a}.odd", f"{b}.odd", samples) >= percent / 100 - SLACK)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets; a text of fewer words
    than ``width`` is one shingle. A component's id is its smallest id, and ``kept`` marks that document.
    Null and empty texts have no shingles and link with nothing. A row with a null id has the component of its equals,
    or null, and is kept only if it has none. Repeated rows get the same answer each. Other columns are not read.

    Equal sets are one class from the start, so a group of copies is one row in all that follows. Classes that share a
    band meet in rounds: each class is compared with the likeliest of its bands' leaders, which leaves few components
    in any group; then bands that still hold more than one compare across components, whatever their number.
    No list of a band's members is built and nothing is left out.
    """
    bounded_batches(docs)
    samples = BANDS * ROWS
    made = docs.select(F.col(id_col).alias("id"), signatures(width)(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    sig = materialize(made.select("id", "s.*"))
    classes = sig.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("odd").alias("odd"), F.first("bands").alias("bands"))
    classes = materialize(classes)
    sketch = classes.select("rep", "n", "odd")
    banded = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = materialize(banded.join(shared, "key"))

    links, comp, tested, pending = None, None, None, members.withColumn("comp", F.col("rep"))
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:  # first the same order in all bands, so that stars meet; then one of each band's own
            order = F.xxhash64("rep", F.lit(0)) if turn == 0 else F.xxhash64("rep", "key", F.lit(turn))
            lead = F.min_by(F.struct(F.col("rep").alias("lead"), F.col("comp").alias("lead_comp")), order)
            leads = pending.groupBy("key").agg(lead.alias("l")).select("key", "l.*")
            tried = pending.join(leads, "key").where("comp <> lead_comp").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
            if tested is not None:
                tried = tried.join(tested, ["a", "b"], "left_anti")
            a, b = sketch.alias("x"), sketch.alias("y")
            pairs = tried.join(a, F.col("x.rep") == F.col("a")).join(b, F.col("y.rep") == F.col("b")).where(similar("x", "y", percent, samples))
            best = F.max_by("b", F.struct(estimate("x.odd", "y.odd", samples), F.col("b")))
            pairs = pairs.groupBy("a").agg(best.alias("b"))
        else:  # whatever is still apart: every pair of different components that shares a band, at the first band it shares
            fine = _texts_of(docs, id_col, text_col, pending.select(F.col("rep").alias("id")).distinct())
            fine = materialize(fine.select(F.col("id").alias("rep"), fine_sketch(width)("text").alias("fine")).dropDuplicates(["rep"]))
            full = materialize(pending.join(classes.select("rep", "n", "odd", "bands"), "rep").join(fine, "rep"))
            a, b = full.alias("a"), full.alias("b")
            first = F.array_min(F.array_intersect(F.col("a.bands"), F.col("b.bands"))) == F.col("a.key")
            near = estimate("a.fine", "b.fine", FINE_SAMPLES, FINE_WORDS) >= percent / 100 - FINE_SLACK
            pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.comp") != F.col("b.comp")) & similar("a", "b", percent, samples) & first & near)
            pairs = pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
            pairs = pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs
        pairs = materialize(pairs)
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.union(pairs)
            found = _confirm(docs, id_col, text_col, pairs, width, percent)
            links = found if links is None else links.union(found)
            comp = components(links)
        if turn < STAR_ROUNDS:
            pending = materialize(_open(members, comp))
            if pending.isEmpty():
                break

    if comp is None:
        comp = members.where("false").select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    by_class = classes.join(comp, classes["rep"] == comp["node"], "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(by_class, ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _open(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(key, rep, comp) of the bands that hold more than one component."""
    if comp is None:
        return members.withColumn("comp", F.col("rep"))
    now = members.join(comp, members["rep"] == comp["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    more = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return now.join(more, "key")


def _texts_of(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """(id, text) of the wanted ids; few ids go to the texts, many meet them in a shuffle."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(small_side(ids, SENT_IDS), "id", "left_semi")


def _confirm(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) among ``pairs`` (a, b) whose full shingle sets are similar enough."""
    texts = _texts_of(docs, id_col, text_col, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = texts.withColumn("set", shingle_sets(width)("text")).select("id", "set").dropDuplicates(["id"])
    sets = materialize(sets)
    a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    full = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    return materialize(full.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select(F.col("a").alias("u"), F.col("b").alias("v")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id.

    Rows with a null id or without words stay. Columns are unchanged, whatever their names.
    """
    gone = near_duplicates(docs, id_col, text_col, width, percent).where("NOT kept AND id IS NOT NULL").select("id").distinct()
    key = fresh(docs, "gone_id")
    return docs.join(gone.withColumnRenamed("id", key), docs[id_col] == F.col(key), "left_anti")

"""Line dedup: repeated passages of several lines are removed wherever they stand.

A hash rolls over the hashes of neighbouring lines and closes a chunk where it hits a residue, so the boundaries inside a
passage depend on its own lines only and come out alike after any insertion before it. Chunks of equal hash are
compared byte by byte.

``dedup_runs`` works on two scales. Neighbouring chunks share their boundary line, so each shortest passage lies in one
chunk. Chunks that repeat go whole; of what they leave, every shortest passage is compared too, so every repeated run of
lines goes whole: a run is the union of the shortest passages in it, which are all repeated too.

``dedup_lines`` is coarser and looks at chunks only; lines before the first and after the last boundary inside a passage
stay.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks.llm import textbytes as tb
from clipworks.llm.frames import bounded_batches, fresh
from clipworks.sources.tables import materialize

WINDOW, DIVISOR, MIN_LINES = 2, 4, 2


def split(data: np.ndarray, offsets: np.ndarray):
    """Of runs of rows: line starts and ends and the first line of each row (rows + 1).

    Every row has at least one line, if empty. The line feed that ends a line is no part of it.
    """
    feeds = np.flatnonzero(data == 0x0A)
    n = np.diff(np.searchsorted(feeds, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[first[:-1]], starts[inner] = offsets[:-1], feeds + 1
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    ends[first[1:] - 1], ends[inner] = offsets[1:], feeds
    return starts, ends, first


def cut(data: np.ndarray, offsets: np.ndarray, window: int, divisor: int):
    """Line starts and ends, the first line of each row, chunk ends (as line numbers) and the first chunk of each row."""
    starts, ends, first = split(data, offsets)
    h = tb.span_hash(data, starts, ends)
    rolled, row_start = h.copy(), first[:-1][tb.owner(first)]
    for k in range(1, window):
        has = np.arange(len(h)) - k >= row_start
        rolled[has] += h[np.flatnonzero(has) - k] * tb.powers(window, 0x9E3779B97F4A7C15)[k]
    close = tb.mix(rolled) % np.uint64(divisor) == 0
    close[first[1:] - 1] = True
    last = np.flatnonzero(close) + 1
    return starts, ends, first, last, np.searchsorted(last, first[1:], "right")


def chunk_rows(window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES):
    """mapInArrow function over (id, text): (id, idx, h1, h2, chunk) of the chunks with ``min_lines`` lines that aren't blank."""

    def rows(batches):
        for batch in batches:
            at = 0
            for data, offsets in tb.chunks(batch.column(1)):
                starts, ends, first, last, row_end = cut(data, offsets, window, divisor)
                begin = np.concatenate([[0], last[:-1]])
                solid = np.concatenate([[0], np.cumsum(~tb.SPACE[data])])
                filled = np.concatenate([[0], np.cumsum(solid[ends] > solid[starts])])
                row = np.searchsorted(row_end, np.arange(len(last)), "right")
                idx = np.arange(len(last)) - np.concatenate([[0], row_end[:-1]])[row]
                keep = np.flatnonzero(filled[last] - filled[begin] >= min_lines)
                if len(keep):
                    lo, hi = starts[begin[keep]], ends[last[keep] - 1]
                    h1 = tb.span_hash(data, lo, hi)
                    h2 = tb.span_hash(data ^ np.uint8(0xFF), lo, hi)
                    raw = data.tobytes()
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + row[keep])), pa.array(idx[keep].astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                                                      pa.array([raw[a:b] for a, b in zip(lo, hi)], pa.binary())], ["id", "idx", "h1", "h2", "chunk"])
                at += len(offsets) - 1

    return rows


def without(window: int = WINDOW, divisor: int = DIVISOR):
    """UDF: the text without the listed chunks (number and hash), and how many lines went. A null text stays null."""

    @F.arrow_udf("struct<text:string,removed:int>")
    def rest(text: pa.Array, gone: pa.Array) -> pa.Array:
        texts, removed = text.to_pylist(), [0] * len(text)
        for i, listed in enumerate(gone.to_pylist()):
            if not listed or not texts[i]:
                continue
            data, offsets = tb.flat(pa.array([texts[i]]))
            starts, ends, _, last, _ = cut(data, offsets, window, divisor)
            begin, raw, drop = np.concatenate([[0], last[:-1]]), data.tobytes(), {(g["idx"], g["h1"]) for g in listed}
            lines = []
            h1 = tb.span_hash(data, starts[begin], ends[last - 1]).view(np.int64)
            for c in range(len(last)):
                if (c, int(h1[c])) in drop:
                    removed[i] += int(last[c] - begin[c])
                else:
                    lines += [raw[starts[k]:ends[k]] for k in range(begin[c], last[c])]
            texts[i] = b"\n".join(lines).decode()
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["text", "removed"])

    return rest


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str, window: int, divisor: int, min_lines: int) -> DataFrame:
    """(id, idx, h1) of every chunk whose bytes stand earlier: at a smaller id, or before in the same text."""
    narrow = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    chunks = narrow.mapInArrow(chunk_rows(window, divisor, min_lines), f"id {kind}, idx int, h1 bigint, h2 bigint, chunk binary")
    same = chunks.groupBy("h1", "h2", "chunk").agg(F.min(F.struct("id", "idx")).alias("keep"), F.count("*").alias("c"))  # equal bytes, not just equal hashes
    one = same.groupBy("h1", "h2").agg(F.min("keep").alias("keep"), F.sum("c").alias("c"), F.count("*").alias("kinds")).where("c > 1 AND kinds = 1").select("h1", "h2", "keep")
    spots = chunks.select("id", "idx", "h1", "h2")
    return spots.join(one, ["h1", "h2"]).where("struct(id, idx) <> keep").select("id", "idx", "h1")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without repeated chunks of several lines; of equal chunks the one of the smallest id and place stays.

    Adds removed_lines (renamed on a clash). A chunk is removed only after its bytes are compared; chunks with fewer
    than ``min_lines`` lines that aren't blank stay. Texts that had lines and lost all go, with ``drop_emptied``.
    Null and empty texts, and rows with a null id, are returned as they are. Rows that repeat an id count as one document.
    """
    bounded_batches(docs)
    gone = repeated_chunks(docs, id_col, text_col, window, divisor, min_lines)
    key, made, count = fresh(docs, "gone_id"), fresh(docs, "made"), fresh(docs, "removed_lines")
    gone = gone.distinct().groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("idx", "h1")).alias(made))
    joined = docs.join(gone, docs[id_col] == F.col(key), "left")
    listed = F.coalesce(F.col(made), F.array().cast("array<struct<idx:int,h1:bigint>>"))
    out = joined.withColumn(made, without(window, divisor).asNondeterministic()(docs[text_col], listed))
    out = out.select(*[F.col(f"{made}.text").alias(c) if c == text_col else docs[c] for c in docs.columns], F.col(f"{made}.removed").alias(count))
    return out.where(f"NOT (`{count}` > 0 AND `{text_col}` = '')") if drop_emptied else out


def filled_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of the lines that aren't blank."""
    solid = np.concatenate([[0], np.cumsum(~tb.SPACE[data])])
    return np.flatnonzero(solid[ends] > solid[starts])


def digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, strong: bool = False, size: int = 16) -> pa.Array:
    """A hash of each span of bytes: two polynomial hashes from running sums, or SHA-256 (``strong``)."""
    if strong:
        raw = data.tobytes()
        return pa.array([sha256(raw[a:b]).digest() for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())
    both = np.stack([tb.span_hash(data, lo, hi), tb.span_hash(data ^ np.uint8(0xFF), lo, hi)], 1).view(np.uint8).reshape(len(lo), 16)
    held = np.ascontiguousarray(both[:, :size])
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.arange(len(lo) + 1, dtype=np.int32) * size), pa.py_buffer(held)])


def passage_rows(min_lines: int = MIN_LINES, window: int = WINDOW, divisor: int = DIVISOR, strong: bool = False, size: int = 16):
    """mapInArrow function over (id, text): the passage of ``min_lines`` lines that aren't blank from each such line on, blank ones between included, with the chunk that it lies in.

    (id, no, last, h, chunk_no, chunk_last, chunk_h): first and last line and hash of both. A chunk goes from boundary to
    boundary, both included, where the rolling hash of ``window`` lines that aren't blank hits a residue of ``divisor``.
    """

    def rows(batches):
        for batch in batches:
            at = 0
            for data, offsets in tb.chunks(batch.column(1)):
                starts, ends, first = split(data, offsets)
                filled = filled_lines(data, starts, ends)
                row = tb.owner(first)[filled]
                from_line = np.flatnonzero(row[:max(0, len(row) - min_lines + 1)] == row[min_lines - 1:])
                if len(from_line):
                    h = tb.span_hash(data, starts[filled], ends[filled])
                    rolled = h.copy()
                    for k in range(1, window):
                        has = np.flatnonzero(row[k:] == row[:-k]) + k
                        rolled[has] += h[has - k] * tb.powers(window, 0x9E3779B97F4A7C15)[k]
                    begins = (tb.mix(rolled) % np.uint64(divisor) == 0)[from_line]
                    mine = row[from_line]
                    begins[0] = True
                    begins[1:] |= mine[1:] != mine[:-1]
                    chunk = np.cumsum(begins) - 1
                    head = np.flatnonzero(begins)
                    tail = np.append(head[1:], len(begins)) - 1
                    lo, hi = filled[from_line], filled[from_line + min_lines - 1]
                    from_chunk, to_chunk = lo[head], hi[tail]
                    found = digests(data, starts[np.concatenate([lo, from_chunk])], ends[np.concatenate([hi, to_chunk])], strong, size)
                    number = lambda line: pa.array((line - first[mine]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + mine)), number(lo), number(hi), found[:len(lo)], number(from_chunk[chunk]), number(to_chunk[chunk]),
                                                      found[len(lo):].take(pa.array(chunk))], ["id", "no", "last", "h", "chunk_no", "chunk_last", "chunk_h"])
                at += len(offsets) - 1

    return rows


def listed_passages(strong: bool = False, size: int = 16):
    """mapInArrow function over (id, text, list of (no, last, h)): (id, no, h, passage), the bytes of the listed passages that the text holds."""

    def rows(batches):
        for batch in batches:
            at = 0
            for data, offsets in tb.chunks(batch.column(1)):
                listed = batch.column(2).slice(at, len(offsets) - 1)
                no, last, h = listed.flatten().flatten()
                row = pc.list_parent_indices(listed).to_numpy()
                starts, ends, first = split(data, offsets)
                lo, hi = first[row] + no.to_numpy(), first[row] + last.to_numpy()
                there = hi < first[row + 1]  # another row of the same id may be shorter
                lo, hi, row, no, h = lo[there], hi[there], row[there], no.filter(pa.array(there)), h.filter(pa.array(there))
                if len(lo):
                    same = pc.equal(digests(data, starts[lo], ends[hi], strong, size), h)
                    raw, some = data.tobytes(), same.to_numpy(zero_copy_only=False)
                    held = [raw[a:b] for a, b in zip(starts[lo[some]].tolist(), ends[hi[some]].tolist())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + row[some])), no.filter(same), h.filter(same), pa.array(held, pa.binary())], ["id", "no", "h", "passage"])
                at += len(offsets) - 1

    return rows


def without_passages(strong: bool = False, size: int = 16):
    """UDF: the text without the listed passages (first and last line, hash), and how many lines went. A null text stays null."""

    @F.arrow_udf("struct<text:string,removed:int>")
    def rest(text: pa.Array, gone: pa.Array) -> pa.Array:
        texts, removed = text.to_pylist(), [0] * len(text)
        for i, listed in enumerate(gone.to_pylist()):
            if not listed or not texts[i]:
                continue
            data, offsets = tb.flat(pa.array([texts[i]]))
            starts, ends, _ = split(data, offsets)
            filled, raw, stays = filled_lines(data, starts, ends), data.tobytes(), np.ones(len(starts), bool)
            listed = [g for g in listed if g["last"] < len(starts)]
            lo, hi = (np.array([g[k] for g in listed], np.int64) for k in ("no", "last"))
            for g, h in zip(listed, digests(data, starts[lo], ends[hi], strong, size).to_pylist()):
                if h == g["h"]:
                    stays[g["no"]:g["last"] + 1] = False
            if not stays[filled].any():  # blank lines don't stay alone
                stays[:] = False
            removed[i] = int((~stays).sum())
            texts[i] = b"\n".join(raw[starts[k]:ends[k]] for k in np.flatnonzero(stays)).decode()
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["text", "removed"])

    return rest


def repeated_passages(narrow: DataFrame, min_lines: int, window: int, divisor: int, strong: bool, size: int) -> tuple[DataFrame, bool]:
    """(id, no, last, h) of chunks and shortest passages of ``narrow`` (id, text) whose bytes stand earlier, and whether every hash stands for the same bytes everywhere.

    A chunk that stands earlier too needs no look at its passages: the earlier chunk holds them all, so the first place
    of a passage is never in such a chunk.
    """
    kind = narrow.schema["id"].dataType.simpleString()
    spots = materialize(narrow.mapInArrow(passage_rows(min_lines, window, divisor, strong, size), f"id {kind}, no int, last int, h binary, chunk_no int, chunk_last int, chunk_h binary"))
    chunks = spots.where("no = chunk_no").select("id", "no", F.col("chunk_last").alias("last"), F.col("chunk_h").alias("h"))
    firsts = materialize(chunks.groupBy("h").agg(F.min(F.struct("id", "no")).alias("keep"), F.count("*").alias("c")).where("c > 1").select("h", "keep"))
    left = spots.join(firsts.select(F.col("h").alias("chunk_h"), "keep"), "chunk_h", "left").where("keep IS NULL OR struct(id, chunk_no) = keep").select("id", "no", "last", "h")
    again = left.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    alike = materialize(chunks.join(firsts.select("h"), "h", "left_semi").unionByName(left.join(again, "h", "left_semi")).distinct())
    lists = alike.groupBy("id").agg(F.collect_list(F.struct("no", "last", "h")).alias("listed"))
    seen = narrow.join(lists, "id").select("id", "text", "listed").mapInArrow(listed_passages(strong, size), f"id {kind}, no int, h binary, passage binary")
    same = seen.groupBy("h", "passage").agg(F.min(F.struct("id", "no")).alias("keep"))  # equal bytes, not just equal hashes
    met = materialize(same.groupBy("h").agg(F.min("keep").alias("keep"), F.count("*").alias("kinds")))
    return alike.join(met, "h").where("struct(id, no) <> keep").select("id", "no", "last", "h"), met.where("kinds > 1").isEmpty()


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, drop_emptied: bool = True, window: int = WINDOW, divisor: int = DIVISOR, size: int = 16) -> DataFrame:
    """``docs`` without the lines of every run, of ``min_lines`` or more lines that aren't blank, whose bytes stand earlier: at a smaller id, or before in the same text.

    A run begins and ends with a line that isn't blank, so blank lines around it stay, but not alone in a text. A removed
    line stays where it stood first, also where runs overlap. Adds removed_lines (renamed on a clash). Passages of equal
    hash (``size`` bytes) are removed only after their bytes are compared; if different ones meet under one hash, all is
    done again with SHA-256 in its place. Texts that had lines and lost all go, with ``drop_emptied``. Null and empty texts,
    and rows with a null id, are returned as they are. Rows that repeat an id count as one document.
    """
    bounded_batches(docs)
    narrow = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    strong = False
    gone, certain = repeated_passages(narrow, min_lines, window, divisor, strong, size)
    if not certain:
        strong = True
        gone, certain = repeated_passages(narrow, min_lines, window, divisor, strong, size)
        if not certain:
            raise ValueError("two different passages have the same SHA-256")
    key, made, count = fresh(docs, "gone_id"), fresh(docs, "made"), fresh(docs, "removed_lines")
    gone = gone.groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("no", "last", "h")).alias(made))
    joined = docs.join(gone, docs[id_col] == F.col(key), "left")
    listed = F.coalesce(F.col(made), F.array().cast("array<struct<no:int,last:int,h:binary>>"))
    out = joined.withColumn(made, without_passages(strong, size).asNondeterministic()(docs[text_col], listed))
    out = out.select(*[F.col(f"{made}.text").alias(c) if c == text_col else docs[c] for c in docs.columns], F.col(f"{made}.removed").alias(count))
    return out.where(f"NOT (`{count}` > 0 AND `{text_col}` = '')") if drop_emptied else out

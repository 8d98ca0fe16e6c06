"""Cross-tokenizer alignment: pandas merge_asof per batch, keyed by document, in both directions.

Both tokenizers spell the same bytes, so every token is a byte range. Each token start is looked up among the starts of
the other side: the token that starts there or last before covers it. An overlap has its later start inside the other
token, so the union of both directions holds every overlapping pair; byte offsets at which both sides end cut groups.

How often an id pair is linked is counted over the corpus by blocks of texts: a block lists its distinct pairs once, so
what is shuffled follows the distinct pairs of blocks, not the links of documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipworks.llm import textbytes as tb
from clipworks.llm.frames import bounded_batches, fresh
from clipworks.sources.tables import materialize

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed value: the split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a block at least, in a run of rows, and of distinct words solved at once; the longest word for the quadratic merger.
BLOCK, ROWS, RUN, LONG_WORD = 1 << 19, 1 << 20, 1 << 14, 1 << 11
#: Blocks in a row group: Spark reads and writes thousands of rows at once, and a block is a row of a few MB.
GROUP_ROWS = 4
#: Distinct words, and ids of theirs, that a worker remembers at most.
KNOWN_WORDS, KNOWN_IDS = 1 << 18, 1 << 21
#: An id pair as one number: a shifted by so many bits, plus b.
SHIFT = 20


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary spells bytes: printable Latin-1 as it is, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@dataclass
class Spelling:
    """The bytes of every id, joined, where each begins and how many it has."""

    joined: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(table: list[bytes]) -> Spelling:
        size = np.array([len(t) for t in table], np.int64)
        return Spelling(np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids`` one after the other, and where each id ends."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.joined[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.begin[ids], size)], ends


class Tokenizers:
    """A byte-level BPE (side A) and a SentencePiece model (side B), applied to text with one space before it, word by word.

    A word is its spaces and what follows, cut where a space follows a character that is no white space. The split
    pattern of A never reaches over such a place and no piece of B does (checked), so the distinct words of a run of rows
    are solved once each.
    """

    def __init__(self, byte_bpe: bytes, piece_model: bytes):
        import sentencepiece
        import tiktoken
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_str(byte_bpe.decode())
        self.slow.encode_special_tokens = True
        model = json.loads(byte_bpe)["model"]
        letters = byte_letters()
        table = [b""] * (max(model["vocab"].values()) + 1)
        special = set(self.slow.get_added_tokens_decoder())
        for token, i in model["vocab"].items():
            if i not in special:
                table[i] = bytes(letters[c] for c in token)
        self.a = Spelling.of(table)
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.fast = None
        if merged == sorted(merged):  # ranks are then ids
            self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(table) if t}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any(MARK in n.lstrip(MARK) for n in names):
            raise ValueError("a piece reaches over the end of a word")
        self.b = Spelling.of([bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)])
        if len(self.b.size) > 1 << SHIFT:
            raise ValueError("too many pieces for the numbering of pairs")
        self.mark = self.pieces.piece_to_id(MARK)
        self.forget()

    def forget(self) -> None:
        """No word is known: hashes in order, and for each side the ids of all words, where those of each begin, and how many."""
        self.known = np.zeros(0, np.uint64)
        self.solved = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(2)]

    def first_side(self, text: bytes) -> np.ndarray:
        quick = self.fast is not None and (len(text) <= LONG_WORD or text.count(b" ", 1) > 0)
        return np.array(self.fast.encode_ordinary(text.decode()) if quick else self.slow.encode(text.decode(), add_special_tokens=False).ids, np.int64)

    def second_side(self, text: bytes) -> np.ndarray:
        return np.array(self.pieces.encode(text[1:].decode()) or [self.mark], np.int64)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side: the ids of the words, one after the other, and how many each word has. Distinct words are solved once."""
        if len(self.known) > KNOWN_WORDS or any(len(ids) > KNOWN_IDS for ids, _, _ in self.solved):
            self.forget()
        words, at, back = np.unique(tb.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, words)
        fresh = np.ones(len(words), bool)
        inside = spot < len(self.known)
        fresh[inside] = self.known[spot[inside]] != words[inside]
        if fresh.any():
            self._learn(data, starts[at[fresh]], ends[at[fresh]], words[fresh], spot[fresh])
            spot = np.searchsorted(self.known, words)
        out = []
        for ids, begin, count in self.solved:
            begun, n = begin[spot][back], count[spot][back]
            before = np.cumsum(n) - n
            out.append((ids[np.arange(n.sum()) + np.repeat(begun - before, n)], n))
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, spot: np.ndarray) -> None:
        """Solves distinct words in runs of about ``RUN`` bytes; very long ones, and those with a space at the end that
        would join the next one's, by themselves. A run that isn't spelt as it stands is solved word by word."""
        size = ends - starts
        alone = (size > LONG_WORD) | (data[ends - 1] == 0x20)
        order = np.argsort(alone, kind="stable")
        size, begin = size[order], starts[order]
        edge = np.concatenate([[0], np.cumsum(size)])
        joined = data[np.arange(edge[-1]) + np.repeat(begin - edge[:-1], size)]
        raw, plain = joined.tobytes(), int(len(size) - alone.sum())
        runs = np.unique(np.concatenate([np.searchsorted(edge[:plain + 1], np.arange(0, edge[plain], RUN)), np.arange(plain, len(size) + 1)]))
        for side, (solve, spelling) in enumerate(((self.first_side, self.a), (self.second_side, self.b))):
            pool, counts = [self.solved[side][0]], [np.zeros(0, np.int64)]
            for first, last in zip(runs[:-1], runs[1:]):
                ids = solve(raw[edge[first]:edge[last]])
                spelt, token_end = spelling.spell(ids)
                before = np.searchsorted(token_end, edge[first:last + 1] - edge[first], "right")
                whole = len(spelt) == edge[last] - edge[first] and np.array_equal(spelt, joined[edge[first]:edge[last]]) and (token_end[before[1:] - 1] == edge[first + 1:last + 1] - edge[first]).all()
                if whole or last - first == 1:
                    parts, n = [ids], np.diff(before) if whole else np.array([len(ids)])
                else:
                    parts = [solve(raw[s:e]) for s, e in zip(edge[first:last], edge[first + 1:last + 1])]
                    n = np.array([len(p) for p in parts])
                pool += parts
                counts.append(n)
            count = np.concatenate(counts)
            of_word = np.argsort(order)
            begun = (len(pool[0]) + np.cumsum(count) - count)[of_word]
            _, begin, n = self.solved[side]
            self.solved[side] = np.concatenate(pool), np.insert(begin, spot, begun), np.insert(n, spot, count[of_word])
        self.known = np.insert(self.known, spot, words)


@lru_cache(maxsize=2)
def _tokenizers(key: str, load) -> Tokenizers:
    return Tokenizers(*load())


_SPACE3 = np.zeros(256, bool)
_SPACE3[[0xE1, 0xE2, 0xE3]] = True  # first bytes of all three-byte white space


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the words of rows that each begin with a space: rows, and spaces after what surely is no white space."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        before = data[:-1]
        solid = ~tb.SPACE[before] & ~((before >= 0x1C) & (before <= 0x1F))
        second, third = np.concatenate([[0], data[:-2]]), np.concatenate([[0, 0], data[:-3]])[:len(before)]
        solid &= ~((second == 0xC2) & ((before == 0x85) | (before == 0xA0))) & ~((before >= 0x80) & _SPACE3[third])
        cut[1:] = (data[1:] == 0x20) & solid
    cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(cut)


@dataclass
class Side:
    """Tokens of a run of texts: ids, starts and ends in the run's bytes, and the first token of each text (texts + 1)."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens of one text whose byte ranges overlap, as positions in ``a`` and ``b``."""
    left = pd.DataFrame({"doc": tb.owner(a.first), "start": a.start, "a": np.arange(len(a.ids))})
    right = pd.DataFrame({"doc": tb.owner(b.first), "start": b.start, "b": np.arange(len(b.ids))})
    covering_a = pd.merge_asof(left, right, on="start", by="doc")
    covering_b = pd.merge_asof(right, left, on="start", by="doc")
    both = np.concatenate([covering_a["a"], covering_b["a"]]), np.concatenate([covering_a["b"], covering_b["b"]])
    again = np.zeros(len(both[0]), bool)  # equal starts are found in both directions
    again[len(left):] = a.start[covering_b["a"].to_numpy()] == b.start
    return both[0][~again], both[1][~again]


def common_ends(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each side end where one of the other side ends."""
    out, size = [], max([0, *a.end[-1:], *b.end[-1:]]) + 1
    for one, other in ((a, b), (b, a)):
        ends = np.zeros(size, bool)
        ends[other.end] = True
        out.append(ends[one.end])
    return out[0], out[1]


@dataclass
class Aligned:
    """A run of texts: both sides, the overlapping pairs, and the byte offsets at which both sides end."""

    a: Side
    b: Side
    link_a: np.ndarray
    link_b: np.ndarray
    cuts: np.ndarray

    def rows(self) -> np.ndarray:
        return tb.owner(self.a.first)[self.link_a]

    def digests(self) -> tuple[list[str], np.ndarray]:
        """The sha256 of each text's groups, spelt ``a1,a2|b1;a3|b2`` ('' without tokens), and how many groups it has."""
        last_a, last_b = common_ends(self.a, self.b)
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # of each group on both sides
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ids, mark = np.empty(len(group_a) + len(group_b), np.int64), np.full(len(group_a) + len(group_b), ord(","), np.uint8)
        at_a, at_b = np.arange(len(group_a)) + np.append(0, stop_b)[group_a], np.arange(len(group_b)) + stop_a[group_b]
        ids[at_a], ids[at_b] = self.a.ids, self.b.ids
        mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
        size = _decimals().size[ids]
        ends = np.cumsum(size + 1)
        text = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        digit = np.ones(len(text), bool)
        digit[ends - 1] = False
        text[ends - 1], text[digit] = mark, _decimals().spell(ids)[0]
        edge, raw = np.concatenate([[0], ends])[self.a.first + self.b.first], text.tobytes()
        shown = ["" if s == e else hashlib.sha256(raw[s:e - 1]).hexdigest() for s, e in zip(edge[:-1], edge[1:])]
        return shown, np.diff(np.concatenate([[0], np.cumsum(last_a)])[self.a.first])


@lru_cache(maxsize=1)
def _decimals(most: int = 1 << 18) -> Spelling:
    return Spelling.of([str(i).encode() for i in range(most)])


def align(column, machine: Tokenizers) -> Iterator[Aligned]:
    """Runs of rows of a text column, aligned. A text that is null, empty, or not given back by both sides has no tokens."""
    for data, offsets in tb.chunks(column, ROWS):
        full = offsets[1:] > offsets[:-1]
        data = np.insert(data, offsets[:-1][full], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        starts = word_starts(data, offsets)
        word = np.searchsorted(starts, offsets)
        sides, sound = [], full.copy()
        for (ids, n), spelling in zip(machine.encode(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts), (machine.a, machine.b)):
            first = np.concatenate([[0], np.cumsum(n)])[word]
            spelt, ends = spelling.spell(ids)
            edge = np.concatenate([[0], ends])[first]
            same = np.diff(edge) == np.diff(offsets)
            if len(spelt) == len(data) and same.all():
                wrong = np.concatenate([[0], np.cumsum(spelt != data)])
                same &= wrong[offsets[1:]] == wrong[offsets[:-1]]
            else:
                same &= np.array([np.array_equal(spelt[s:e], data[o:p]) for s, e, o, p in zip(edge[:-1], edge[1:], offsets[:-1], offsets[1:])], bool)
            sound &= same
            sides.append((ids, spelling.size[ids], first))
        out = []
        for ids, size, first in sides:
            kept = np.repeat(sound, np.diff(first))
            count = np.where(sound, np.diff(first), 0)
            ends = np.cumsum(size[kept])
            out.append(Side(ids[kept], ends - size[kept], ends, np.concatenate([[0], np.cumsum(count)])))
        yield Aligned(*out, *overlaps(*out), out[0].end[common_ends(*out)[0]])


def _loader(docs: DataFrame, byte_bpe: str, piece_model: str):
    """A function for workers that gives the tokenizers; the two vocabulary files, of a few MB, are read here and broadcast."""
    files = []
    for path in (byte_bpe, piece_model):
        with open(path, "rb") as file:
            files.append(file.read())
    key = hashlib.sha256(b"".join(files)).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(files)
    return lambda: _tokenizers(key, lambda: sent.value)


def align_texts(docs: DataFrame, text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_model: str = PIECE_BPE) -> DataFrame:
    """``docs`` with ``alignment`` (renamed on a clash): the tokens of both sides as (id, start, end) in bytes of space and
    text, ``groups`` (places one after the last token of each group on both sides) and ``links`` (overlapping places).

    Null and empty texts, and texts that one side doesn't give back byte for byte, have empty lists. Rows are
    independent, so nulls, repeated rows and other columns pass through.
    """
    load = _loader(docs, byte_bpe, piece_model)
    token, spot = "array<struct<id:int,start:int,end:int>>", "array<struct<a:int,b:int>>"

    @F.arrow_udf(f"struct<a:{token},b:{token},groups:{spot},links:{spot}>")
    def aligned(column: pa.Array) -> pa.Array:
        parts = []
        for run in align(column, load()):
            base = np.concatenate([[0], run.a.end])[run.a.first]
            sides = [_structs(s.first, id=s.ids, start=s.start - np.repeat(base[:-1], np.diff(s.first)), end=s.end - np.repeat(base[:-1], np.diff(s.first))) for s in (run.a, run.b)]
            row = np.searchsorted(base[1:], run.cuts)
            stop = [np.searchsorted(s.end, run.cuts, "right") - s.first[row] for s in (run.a, run.b)]
            order = np.lexsort((run.link_b, run.link_a))
            link_row = run.rows()[order]
            rows = len(run.a.first) - 1
            parts.append(pa.StructArray.from_arrays([
                *sides, _structs(np.searchsorted(row, np.arange(rows + 1)), a=stop[0], b=stop[1]),
                _structs(np.searchsorted(link_row, np.arange(rows + 1)), a=run.link_a[order] - run.a.first[link_row], b=run.link_b[order] - run.b.first[link_row]),
            ], ["a", "b", "groups", "links"]))
        return pa.concat_arrays(parts)

    bounded_batches(docs)
    return docs.withColumn(fresh(docs, "alignment"), aligned.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))


def _structs(first: np.ndarray, **columns: np.ndarray) -> pa.ListArray:
    rows = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), rows)


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_model: str = PIECE_BPE) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    A pair of ids counts the documents that hold it linked; n_best are links whose pair has the highest count of its A
    id (ties included), count_sum adds the counts of all links. Rows that repeat an id, null ids too, are documents of
    their own. Texts without tokens (null, empty, not given back) have zeros and an empty digest; an empty table has no
    rows. Other columns aren't read.
    """
    load, kind = _loader(docs, byte_bpe, piece_model), docs.schema[id_col].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, digest array<string>, pairs array<long>, n_docs array<int>, first array<int>, step array<int>, times array<int>"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            for run in align(batch.column(1), load()):
                rows = len(run.a.first) - 1
                held.append((batch.column(0).slice(at, rows), run))
                at, size = at + rows, size + 16 * rows + int(run.a.end[-1] if len(run.a.end) else 0)
                if size >= BLOCK:
                    yield _block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _block(number, held)

    bounded_batches(docs)
    made = materialize(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(blocks, schema), GROUP_ROWS)
    listed = made.select("block", F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), "p.n_docs")
    counts = materialize(listed.groupBy("pair").agg(F.sum("n_docs").alias("count")).withColumn("a", F.shiftright("pair", SHIFT)))
    judged = counts.join(counts.groupBy("a").agg(F.max("count").alias("top")), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    found = listed.select(F.col("block").alias("of"), "pair").join(judged, "pair")
    out = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return made.drop("n_docs").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_totals, out)


def _block(number: int, held: list[tuple[pa.Array, Aligned]]) -> pa.RecordBatch:
    """One row: the rows of a block of texts, its distinct id pairs, and which rows hold each pair how often (places in
    the pair list as steps from one to the next, which pack well)."""
    rows = np.array([len(run.a.first) - 1 for _, run in held])
    base = np.cumsum(rows) - rows
    row = np.concatenate([run.rows() + b for (_, run), b in zip(held, base)])
    pair = np.concatenate([(run.a.ids[run.link_a].astype(np.int64) << SHIFT) + run.b.ids[run.link_b] for _, run in held])
    pairs, at = np.unique(pair, return_inverse=True)
    spot, times = np.unique(row * max(len(pairs), 1) + at, return_counts=True)
    owner, place = np.divmod(spot, max(len(pairs), 1))
    first = np.searchsorted(owner, np.arange(rows.sum() + 1))
    step = np.diff(place, prepend=0)
    head = first[:-1][first[:-1] < first[1:]]
    step[head] = place[head]
    digests = [run.digests() for _, run in held]
    each = {
        "ids": pa.concat_arrays([ids for ids, _ in held]), "n_a": np.concatenate([np.diff(run.a.first) for _, run in held]),
        "n_b": np.concatenate([np.diff(run.b.first) for _, run in held]), "n_groups": np.concatenate([n for _, n in digests]),
        "n_links": np.bincount(row, minlength=rows.sum()), "digest": pa.array([d for shown, _ in digests for d in shown], pa.string()),
        "pairs": pairs, "n_docs": np.bincount(place, minlength=len(pairs)), "first": first, "step": step, "times": times,
    }
    wide = {"ids", "digest", "pairs"}
    arrays = {name: v if isinstance(v, pa.Array) else pa.array(v if name in wide else v.astype(np.int32)) for name, v in each.items()}
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in arrays.values()]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["block", *arrays])


def _totals(block: pa.Table, found: pa.Table) -> pa.Table:
    """The rows of one block, with the corpus counts of its pairs summed over their links."""
    part = {name: block.column(name).combine_chunks().flatten() for name in block.column_names if name != "block"}
    pairs, first, step, times = (part[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("pairs", "first", "step", "times"))
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = np.searchsorted(pairs, found.column("pair").to_numpy())
    count[at], best[at] = found.column("count").to_numpy(), found.column("best").to_numpy()
    ran = np.concatenate([[0], np.cumsum(step)])
    place = ran[1:] - np.repeat(ran[first[:-1]], np.diff(first))
    total = lambda values: np.diff(np.concatenate([[0], np.cumsum(times * values[place])])[first])
    counted = [part[n].cast(pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.Table.from_arrays([part["ids"], *counted, pa.array(total(best)), pa.array(total(count)), part["digest"]], names)

"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

Text is bytes, with the space in the place of the vocabulary's word mark. The automaton reads each byte once; at every
place the output links lead through all pieces that end there, and each relaxes the best score of that place. No piece
holds a word mark after another character, so a text falls apart into words; the distinct ones of a run of rows are
solved together, all a byte at a time.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipworks.llm import textbytes as tb
from clipworks.llm.frames import bounded_batches, fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Scores are held as whole numbers of this fraction, so that sums are exact and equal sums are ties.
FRACTION = 1 << 20
#: A byte that no piece covers costs this much more than the worst piece.
UNKNOWN_PENALTY = 10 * FRACTION
#: Spans of more bytes are solved one by one; cells of the table in which the others are solved together.
LONG_SPAN, TABLE = 512, 1 << 19


@dataclass
class Vocabulary:
    pieces: list[bytes | None]
    scores: list[int]
    byte_ids: list[int]
    separable: bool
    prefix: bytes = b" "


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Pieces as bytes (None for control, unknown and byte pieces), their scores, and the ids of the 256 byte pieces.

    A model of merge ranks (all scores whole numbers from 0 down) holds no log probabilities, and sums of ranks would
    favour strings of short pieces; each piece then gets log(1 / (rank + 2)), Zipf's law. Other scores are used as they are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)]
    pieces = [model.id_to_piece(i).replace(MARK, " ").encode() if plain[i] else None for i in range(size)]
    scores = [model.get_score(i) for i in range(size)]
    if all(s <= 0 and s == int(s) for s, p in zip(scores, plain) if p):
        order = sorted((i for i in range(size) if plain[i]), key=lambda i: (-scores[i], i))
        for rank, i in enumerate(order):
            scores[i] = -float(np.log(rank + 2))
    scores = [round(s * FRACTION) if p else 0 for s, p in zip(scores, plain)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(model.id_to_piece(i) != f"<0x{b:02X}>" for b, i in enumerate(byte_ids)):
        raise ValueError(f"{path}: no byte pieces, so texts could not be given back")
    return Vocabulary(pieces, scores, byte_ids, all(b" " not in p.lstrip(b" ") for p in pieces if p))


class Automaton:
    """States are prefixes of pieces. ``ends[s]``: (length, score, id) of all pieces that end at state s, longest first."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        step: list[dict[int, int]] = [{}]
        own: list[tuple | None] = [None]
        for i, piece in enumerate(vocabulary.pieces):
            if not piece:
                continue
            s = 0
            for b in piece:
                if b not in step[s]:
                    step[s][b] = len(step)
                    step.append({})
                    own.append(None)
                s = step[s][b]
            if own[s] is None or vocabulary.scores[i] > own[s][1]:
                own[s] = (len(piece), vocabulary.scores[i], i)
        fail, link = [0] * len(step), [0] * len(step)  # link: the nearest shorter suffix that is a piece
        queue = deque(step[0].values())
        while queue:
            s = queue.popleft()
            for b, t in step[s].items():
                f = fail[s]
                while f and b not in step[f]:
                    f = fail[f]
                fail[t] = step[f].get(b, 0) if step[f].get(b, 0) != t else 0
                queue.append(t)
            link[s] = fail[s] if own[fail[s]] else link[fail[s]]
        self.step, self.fail, self.own, self.link = step, fail, own, link
        self.worst = min(own_[1] for own_ in own if own_) - UNKNOWN_PENALTY
        self._lay_out()

    def _lay_out(self) -> None:
        """The automaton as flat arrays: where each byte leads from each state, and the output links with their pieces."""
        edges = np.array([(s, b, t) for s, d in enumerate(self.step) for b, t in d.items()] or [(0, 0, 0)], np.int64)
        used = np.unique(edges[:, 1])
        self.kind = np.full(256, len(used), np.int64)  # bytes of no piece lead to the start
        self.kind[used] = np.arange(len(used))
        states, fail = len(self.step), np.array(self.fail)
        self.goto = np.zeros((states, len(used) + 1), np.uint16 if states <= 1 << 16 else np.uint32)
        level = np.zeros(1, np.int64)
        while len(level):
            if level[0]:
                self.goto[level] = self.goto[fail[level]]
            lead = edges[np.isin(edges[:, 0], level) & (edges[:, 2] > 0)]
            self.goto[lead[:, 0], self.kind[lead[:, 1]]] = lead[:, 2]
            level = lead[:, 2]
        self.next_out = np.array(self.link)
        self.first_out = np.where([o is not None for o in self.own], np.arange(states), self.next_out)
        self.out_size, self.out_score, self.out_id = (np.array([o[k] if o else 0 for o in self.own], np.int64) for k in range(3))
        self.byte_ids = np.array(self.vocabulary.byte_ids, np.int64)

    def encode_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many spans, one after the other, and how many each has: as ``encode`` gives them, all spans a byte at a time."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        ids, count = [np.zeros(0, np.int32)] * len(order), np.zeros(len(order), np.int64)
        first = int((size > LONG_SPAN).sum())
        raw = data.tobytes() if first else b""
        for i in order[:first]:
            ids[i] = np.array(self.encode(raw[starts[i]:ends[i]]), np.int32)
            count[i] = len(ids[i])
        flat, owner, rank = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while first < len(order) and size[order[first]]:
            last = first + max(1, TABLE // (int(size[order[first]]) + 1))
            some = order[first:last]
            first = last
            for k, (at, piece) in enumerate(self._solve(data, starts[some], size[some])):
                flat.append(piece)
                owner.append(some[at])
                rank.append(np.full(len(at), k))
        flat, owner, rank = np.concatenate(flat), np.concatenate(owner), np.concatenate(rank)
        count += np.bincount(owner, minlength=len(order))
        before = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int32)
        out[before[owner] + count[owner] - 1 - rank] = flat
        for i in np.flatnonzero(size > LONG_SPAN):
            out[before[i]:before[i] + count[i]] = ids[i]
        return out, count

    def _solve(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray):
        """Spans of falling length in lockstep; then (spans, their last piece), (spans, the piece before) and so on."""
        n, longest = len(starts), int(size[0])
        best, piece, step = np.zeros((longest + 1, n), np.int64), np.zeros((longest + 1, n), np.int32), np.zeros((longest + 1, n), np.int32)
        state = np.zeros(n, np.int64)
        active = np.searchsorted(-size, -np.arange(longest), "left")  # spans longer than p
        for p in range(longest):
            m = int(active[p])
            b = data[starts[:m] + p]
            state = self.goto[state[:m], self.kind[b]].astype(np.int64)
            top, chosen, length = best[p, :m] + self.worst, self.byte_ids[b], np.ones(m, np.int64)
            at = np.flatnonzero(self.first_out[state])
            out = self.first_out[state[at]]
            while len(at):
                score = best[p + 1 - self.out_size[out], at] + self.out_score[out]
                better = score > top[at]
                won, by = at[better], out[better]
                top[won], chosen[won], length[won] = score[better], self.out_id[by], self.out_size[by]
                out = self.next_out[out]
                left = out > 0
                at, out = at[left], out[left]
            best[p + 1, :m], piece[p + 1, :m], step[p + 1, :m] = top, chosen, length
        at, end = np.flatnonzero(size), size.copy()
        while len(at):
            here = end[at]
            yield at, piece[here, at].astype(np.int64)
            end[at] -= step[here, at]
            at = at[end[at] > 0]

    def encode(self, data: bytes) -> list[int]:
        """Ids of the segmentation with the largest sum of scores; of equal sums, the one whose last piece is longest, and so on to the left."""
        step, fail, own, link, worst, byte_ids = self.step, self.fail, self.own, self.link, self.worst, self.vocabulary.byte_ids
        best, piece, size = [0] * (len(data) + 1), [0] * (len(data) + 1), [0] * (len(data) + 1)
        s = 0
        for at, b in enumerate(data, 1):
            while s and b not in step[s]:
                s = fail[s]
            s = step[s].get(b, 0)
            top, chosen, length = best[at - 1] + worst, byte_ids[b], 1
            out = s if own[s] else link[s]
            while out:
                n, score, i = own[out]
                score += best[at - n]
                if score > top:
                    top, chosen, length = score, i, n
                out = link[out]
            best[at], piece[at], size[at] = top, chosen, length
        ids, at = [], len(data)
        while at:
            ids.append(piece[at])
            at -= size[at]
        return ids[::-1]


@lru_cache(maxsize=2)
def automaton(path: str = MODEL) -> Automaton:
    return Automaton(read_vocabulary(path))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words (their spaces, then what follows; a row starts one) and the first word of each row (rows + 1)."""
    start = np.zeros(len(data), bool)
    space = data == 0x20
    start[1:] = space[1:] & ~space[:-1]
    start[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


def encode_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, path: str = MODEL) -> tuple[np.ndarray, np.ndarray]:
    """The ids of spans of bytes, one after the other, and how many each has. Every distinct span is solved once."""
    machine = automaton(path)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    _, at, back = np.unique(tb.span_hash(data, starts, ends), return_index=True, return_inverse=True)
    pool, size = machine.encode_many(data, starts[at], ends[at])
    begin, n = np.cumsum(size) - size, size[back]
    before = np.cumsum(n) - n
    return pool[np.arange(n.sum()) - np.repeat(before, n) + np.repeat(begin[back], n)], n


def encode(column, path: str = MODEL) -> pa.ListArray:
    """The ids of each text; null and empty texts have none."""
    separable, parts = automaton(path).vocabulary.separable, []
    for data, offsets in tb.chunks(column):
        # the word mark before each text that isn't empty
        full = offsets[1:] > offsets[:-1]
        data = np.insert(data, offsets[:-1][full], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        starts, first = word_spans(data, offsets) if separable else (offsets[:-1][full], np.concatenate([[0], np.cumsum(full)]))
        ids, n = encode_spans(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts, path)
        parts.append(tb.lists(ids, np.concatenate([[0], np.cumsum(n)])[first]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def decode(column, path: str = MODEL) -> pa.Array:
    """The text of each list of ids: pieces and bytes joined, without the first word mark. Unknown and control ids give nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    count = np.array(column.value_lengths().fill_null(0))
    first, parts, row = np.concatenate([[0], np.cumsum(count)]), [], 0
    while row < len(count):  # runs of rows, so that memory follows the longest list
        last = max(row + 1, int(np.searchsorted(first, first[row] + tb.CHUNK // 4, "right")) - 1)
        parts.append(_decoded(column.slice(row, last - row), count[row:last], path))
        row = last
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _decoded(column: pa.ListArray, count: np.ndarray, path: str) -> pa.Array:
    joined, begin, size = _table(path)
    ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    before = np.concatenate([[0], np.cumsum(size[ids])])
    starts, ends = before[first[:-1]], before[first[1:]]
    data = joined[np.arange(before[-1]) - np.repeat(before[:-1], size[ids]) + np.repeat(begin[ids], size[ids])]
    full = np.flatnonzero(ends > starts)
    marked = full[data[starts[full]] == 0x20]
    data = np.delete(data, starts[marked])
    gone = np.zeros(len(starts), np.int64)
    gone[marked] = 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts - gone)])
    valid = pa.array(~np.array(column.is_null()))
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [valid.buffers()[1], pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # ids that are no encoded text may cut a character in two
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids, where each begins, and its length."""
    vocabulary = automaton(path).vocabulary
    table = [p or b"" for p in vocabulary.pieces]
    for b, i in enumerate(vocabulary.byte_ids):
        table[i] = bytes([b])
    size = np.array([len(p) for p in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1], size


def encode_column(text: Column, path: str = MODEL) -> Column:
    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return encode(column, path)

    return ids.asNondeterministic()(text)  # costly: not to be run twice


def decode_column(ids: Column, path: str = MODEL) -> Column:
    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return decode(column, path)

    return text.asNondeterministic()(ids)


def encode_texts(docs: DataFrame, text_col: str = "text", path: str = MODEL) -> DataFrame:
    """``docs`` with ``piece_ids`` (renamed on a clash): the ids of each whole text; null and empty texts have an empty list.

    Every text comes back by ``decode_column``, byte for byte: characters without a piece, a literal word mark among
    them, are spelt in byte pieces. Rows are independent, so nulls, repeats and other columns pass through.
    """
    bounded_batches(docs)
    return docs.withColumn(fresh(docs, "piece_ids"), encode_column(F.coalesce(F.col(text_col), F.lit("")), path))

"""Packing: documents' ids into sequences of one window's length, by best-fit decreasing.

Texts longer than a window are first cut into full windows, which are sequences of their own. What is
left of each text goes, longest first, to the open window with the least room that still takes it. A
segment tree over the room left finds that window.

Every partition first packs its own rows, so nothing is shuffled; it packs in rounds of at most ROUND
remainders, so that memory stays bounded. Windows that are then less than 99 % full are opened again, and
their pieces are packed once more over all partitions, in rounds as large, so the padding doesn't depend
on how the rows were dealt. Sequence ids are made of the pass, the partition and a counter.

Null text is the empty text (one id, the end id). Rows that repeat are packed one by one. A null doc_id
stays null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import texts, written
from tracelake.llm.tokens import encoder, slices

ROUND, FULL = 30_000, 0.99
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Room:
    """Open windows by the room left in them: leaf r of a segment tree counts those with room r."""

    def __init__(self, window: int):
        self.width = 1 << window.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(self.width)]

    def put(self, which: int, room: int) -> None:
        self.open[room].append(which)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room >= need."""
        node = need + self.width
        while not self.count[node]:  # up, until a subtree to the right has a window
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.width
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each piece its window and offset there, and the number of windows."""
    room, n = Room(window), 0
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = room.tightest(need)
        if found is None:
            found, n = (n, window), n + 1
        which[i], offset[i] = found[0], window - found[1]
        if found[1] > need:
            room.put(found[0], found[1] - need)
    return which, offset, n


def _rows(doc_id, start, length, total, seq, offset, ids, open_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, total, seq, offset)), pa.array(ids, pa.binary()), pa.array(open_, pa.bool_())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open"])


def _packed(pieces: list[tuple], window: int, sequence: int) -> Iterator[pa.RecordBatch | int]:
    """The pieces (doc_id, start, doc_tokens, ids) in windows; at last how many windows there are."""
    lengths = np.array([len(x[3]) // 4 for x in pieces], np.int64)
    which, offset, n = best_fit_decreasing(lengths, window)
    open_ = (np.bincount(which, lengths, n) < FULL * window)[which]
    for a in range(0, len(pieces), 2000):
        part = pieces[a : a + 2000]
        yield _rows([x[0] for x in part], [x[1] for x in part], lengths[a : a + 2000], [x[2] for x in part], sequence + which[a : a + 2000], offset[a : a + 2000], [x[3] for x in part], open_[a : a + 2000])
    yield n


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, added: bool = False) -> DataFrame:
    """A row a piece: doc_id, start (its document's ids before it), length, doc_tokens, sequence_id,
    offset in the sequence, and ids as little-endian unsigned 32-bit integers. added: see WordIds.encode()."""

    def rounds(pieces: Iterator[tuple | pa.RecordBatch], sequence: int) -> Iterator[pa.RecordBatch]:
        """Packs pieces; batches of full windows pass through and take sequence ids."""
        rest: list[tuple] = []
        for piece in pieces:
            if isinstance(piece, tuple):
                rest.append(piece)
            else:
                k = piece.num_rows
                yield piece.set_column(4, "sequence_id", pa.array(sequence + np.arange(k)))
                sequence += k
            if len(rest) >= ROUND:
                *out, n = _packed(rest, window, sequence)
                yield from out
                sequence, rest = sequence + n, []
        if rest:
            yield from (x for x in _packed(rest, window, sequence) if not isinstance(x, int))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)

        def pieces() -> Iterator[tuple | pa.RecordBatch]:
            for batch in slices(batches):
                ids, lengths = codec.encode(batch.column("text").to_pylist(), end_id, added)
                full = [[] for _ in range(4)]
                for doc_id, n, end in zip(batch.column("doc_id").to_pylist(), lengths.tolist(), np.cumsum(lengths).tolist()):
                    begin, whole = end - n, n // window * window
                    for at in range(0, whole, window):
                        for x, y in zip(full, (doc_id, at, n, ids[begin + at : begin + at + window].tobytes())):
                            x.append(y)
                    if n > whole:
                        yield doc_id, whole, n, ids[begin + whole : end].tobytes()
                if k := len(full[0]):
                    yield _rows(full[0], full[1], np.full(k, window), full[2], np.zeros(k, np.int64), np.zeros(k, np.int64), full[3], np.zeros(k, bool))

        return rounds(pieces(), TaskContext.get().partitionId() << 33)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("doc_id", "start", "doc_tokens", "ids")
        pieces = (piece for batch in batches for piece in zip(*(batch.column(c).to_pylist() for c in columns)))
        return rounds(pieces, (1 << 62) + (TaskContext.get().partitionId() << 33))

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    once = written(texts(docs).mapInArrow(first, f"{SCHEMA}, open boolean"), "packed")
    left = once.where("open")
    n = left.count()
    if not n:
        return once.select(*names)
    twice = left.coalesce(-(-n // ROUND)).mapInArrow(again, f"{SCHEMA}, open boolean")
    return once.where("not open").select(*names).unionByName(twice.select(*names))

"""Token-id output: packed id matrices, cumulative segment lengths, position resets.

Each task packs what it reads, a few million tokens at a time: documents are
tokenised, split without loss into pieces of at most ``width`` ids, sorted from
long to short and placed best fit, the smallest sufficient room being found in
a segment tree over the capacities.  Nothing is shuffled, so neither copies nor
hot sources gather anywhere, and a lost executor only repeats its own tasks.

A sequence is a row of a matrix: ``ids`` (unsigned 32-bit little-endian, padded
to ``width``), ``positions`` (16-bit, restarting at 0 with every segment) and
``cu_seqlens`` (0, then the end of every segment).

Defined results: null and empty texts are one segment of the end id alone;
repeated rows and null ids are packed like others; pieces of one length are
placed in the order they are read, and of sequences with equal room the one that
got it last is filled; long texts are read whole; columns of other names are no
input; an empty table gives no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer

WIDTH = 4096
END_ID = 49407
PAD_ID = 0
#: Tokens packed together, and sequences handed on at a time.
TOGETHER = 1 << 22
HANDED = 128

SEQUENCES = "sequence_id long, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"


class CapacityTree:
    """Counts of open sequences by room, in a segment tree: smallest room of at least so much in O(log)."""

    def __init__(self, width: int):
        self.leaves = 1 << (width + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def smallest(self, room: int) -> int | None:
        """Smallest room >= ``room`` with an open sequence."""
        i = room + self.leaves
        if self.count[i]:
            return room
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Indexes of ``lengths`` by sequence."""
    tree = CapacityTree(width)
    rooms: dict[int, list[int]] = {}
    sequences: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.smallest(need)
        if room is None:
            which, room = len(sequences), width
            sequences.append([])
        else:
            which = rooms[room].pop()
            tree.add(room, -1)
        sequences[which].append(i)
        rooms.setdefault(room - need, []).append(which)
        tree.add(room - need, 1)
    return sequences


def pack_sequences(docs: DataFrame, path: str | None = None, width: int = WIDTH, end_id: int = END_ID, pad_id: int = PAD_ID, id_col="doc_id", text_col="text") -> DataFrame:
    """Packed sequences of all documents, columns as in ``SEQUENCES``."""
    path = path or tokenizer.default_path()

    def flush(held: list, first: int) -> Iterator[pa.RecordBatch]:
        """``held``: (doc id, piece, start, ids)."""
        lengths = np.array([len(h[3]) for h in held])
        made = best_fit_decreasing(lengths, width)
        for at in range(0, len(made), HANDED):
            rows = []
            for k, own in enumerate(made[at : at + HANDED]):
                ids = np.full(width, pad_id, "<u4")
                positions = np.zeros(width, "<u2")
                ends = np.concatenate([[0], np.cumsum(lengths[own])])
                for i, a, b in zip(own, ends[:-1], ends[1:], strict=True):
                    ids[a:b] = held[i][3]
                    positions[a:b] = np.arange(b - a)
                rows.append((first + at + k, [held[i][0] for i in own], [held[i][1] for i in own], [held[i][2] for i in own], ends.tolist(), int(ends[-1]), ids.tobytes(), positions.tobytes()))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
            names = ("sequence_id", "doc_ids", "pieces", "starts", "cu_seqlens", "n_tokens", "ids", "positions")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer.load(path)
        first = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        held, size = [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for k, own_ids in enumerate(words.ids_many(x.as_py() for x in batch.column(1))):
                coded = np.concatenate([own_ids, end])
                for piece, at in enumerate(range(0, len(coded), width)):
                    own = coded[at : at + width]
                    held.append((doc_ids[k], piece, at, own))
                    size += len(own)
                    if size >= TOGETHER:
                        for out in flush(held, first):
                            first += out.num_rows
                            yield out
                        held, size = [], 0
        if held:
            for out in flush(held, first):
                first += out.num_rows
                yield out

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return source.mapInArrow(run, SEQUENCES)


def write_matrices(sequences: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet: one row of fixed-width binary a sequence, ready to be stacked."""
    sequences.write.parquet(path)


def read_matrix(rows, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Stack collected rows to an id matrix and a position matrix."""
    ids = np.stack([np.frombuffer(bytes(r["ids"]), "<u4", width) for r in rows])
    return ids, np.stack([np.frombuffer(bytes(r["positions"]), "<u2", width) for r in rows])

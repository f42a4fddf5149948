"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
What the driver sees is the histogram of piece lengths, at most ``capacity``
numbers whatever the corpus.  Over it stands the configuration program

    minimise  sum x_c   with   sum_c a_cl x_c >= n_l  for every length l,

where a configuration c says how many pieces of each length one sequence
holds.  Multiplicative weights solve it: every length has a weight that falls
as it gets covered, a knapsack dynamic program over the capacity prices the
best configuration through each length, and steps of a fixed share of the
demand add up to a fractional x.  Each pricing's weights are a dual solution,
so the program also says how few sequences there can be at all.

x is rounded: whole parts stay, fractions become sequences from the largest on
while their pieces last, and what stays uncovered is packed best fit
decreasing, again on the histogram.  If plain best fit decreasing needs fewer
sequences than that, it is taken; so the result never needs more.

Pieces then find their places without meeting: a piece is the r-th of its
length (counted by partition, then offset by a small window), and r alone
tells configuration, sequence and offset.

Defined results: null and empty texts are one piece of the end id alone;
texts of any length are cut, nothing is dropped; pieces of one length are
alike, so ties do not matter; repeated rows are packed each; null ids are
packed like others; an empty table gives no row; columns of other names are no
input.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenizer
from .common import materialize, tidy


CAPACITY = 4096
END_ID = 1
#: Lengths that one pricing serves; least and most sweeps over the demand; about how many pricings to spend on them.
SERVED = 128
SWEEPS = (6, 60)
PRICINGS = 64
#: How fast a length loses weight as it gets covered.
RATES = (0.3, 4.0)
#: Room, as a share of the capacity, up to which a configuration is kept when x is rounded: each is tried.
ROOMS = (1.0, 0.01, 0.0)
#: Demand that counts as covered.
COVERED = 1e-9


class Plan:
    """Groups of equal sequences: how many, and the lengths in each with their multiplicities."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.groups: list[tuple[int, tuple[tuple[int, int], ...]]] = []
        #: No plan has fewer sequences; of this one's, so many are rounded configurations.
        self.bound = 0
        self.rounded = 0

    def add(self, count: int, content: dict[int, int]) -> None:
        if count > 0:
            self.groups.append((int(count), tuple(sorted(content.items(), reverse=True))))

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.groups)

    def places(self):
        """Sorted arrays: (length << 44 | first rank), multiplicity, first sequence, offset in the sequence."""
        next_rank: dict[int, int] = {}
        rows, base = [], 0
        for count, content in self.groups:
            offset = 0
            for length, times in content:
                first = next_rank.get(length, 0)
                rows.append(((length << 44) | first, times, base, offset))
                next_rank[length] = first + count * times
                offset += length * times
            base += count
        rows.sort()
        return tuple(np.array([r[k] for r in rows], np.int64) for k in range(4))


def price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value and last length chosen (0: one unit left empty), for every capacity."""
    best = np.zeros(capacity + 1, np.float32)
    last = np.zeros(capacity + 1, np.int64)
    value = value.astype(np.float32)
    got = np.empty(capacity, np.float32)
    for c in range(1, capacity + 1):
        np.add(best[c - 1 :: -1], value[1 : c + 1], out=got[:c])
        length = int(got[:c].argmax()) + 1
        best[c] = got[length - 1]
        if value[length] > 0:
            last[c] = length
    return best, last


def content_of(last: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while room > 0:
        length = int(last[room])
        if length:
            out[length] = out.get(length, 0) + 1
        room -= length or 1
    return out


def best_fit(left: np.ndarray, plan: Plan) -> None:
    """Best fit decreasing of ``left`` (pieces of each length) on groups of equal sequences."""
    cap = plan.capacity
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}
    some = np.zeros(cap + 1, bool)

    def put(room: int, count: int, content: dict[int, int]) -> None:
        if count:
            open_.setdefault(room, []).append((count, content))
            some[room] = True

    for length in range(cap, 0, -1):
        rest = int(left[length])
        while rest:
            at = int(some[length:].argmax()) + length
            if some[at]:
                count, content = open_[at].pop()
                if not open_[at]:
                    some[at] = False
            else:
                at, count, content = cap, rest, {}  # new sequences
            each = at // length
            full = min(count, rest // each)
            put(at - each * length, full, content | {length: content.get(length, 0) + each})
            rest -= full * each
            count -= full
            if count and rest and rest < each:
                put(at - rest * length, 1, content | {length: content.get(length, 0) + rest})
                count, rest = count - 1, 0
            if content:
                put(at, count, content)
    for rows in open_.values():
        for count, content in rows:
            plan.add(count, content)


Configuration = tuple[tuple[int, int], ...]


def cover(demand: np.ndarray, capacity: int, rate: float) -> tuple[dict[Configuration, float], float]:
    """Fractional x by multiplicative weights, and the best dual bound on the way."""
    start = demand.astype(float)
    left = start.copy()
    size = np.arange(capacity + 1)
    lengths = np.flatnonzero(start)
    x: dict[Configuration, float] = {}
    bound = float(start @ size) / capacity  # weights by length are a dual solution
    sweeps = max(SWEEPS[0], min(SWEEPS[1], PRICINGS * SERVED // max(1, len(lengths))))
    for sweep in range(2 * sweeps):  # half of them are enough unless others used a length up
        order = lengths[np.argsort((lengths * 2654435761 + sweep * 40503) % 65537)]
        order = order[left[order] > COVERED]
        if not len(order):
            break
        for at in range(0, len(order), SERVED):
            share = np.divide(left, start, out=np.zeros(capacity + 1), where=start > 0)
            weight = np.where(left > COVERED, size / capacity * np.exp(rate * (share - 1)), 0.0)
            best, last = price(weight, capacity)
            if best[capacity] > 0:
                bound = max(bound, float((start * weight).sum() / best[capacity]) * (1 - 1e-5))  # single precision
            for length in map(int, order[at : at + SERVED]):
                if left[length] <= COVERED:
                    continue
                content = content_of(last, capacity - length)
                content[length] = content.get(length, 0) + 1
                step = min(min(left[k] / a for k, a in content.items()), start[length] / sweeps / content[length])
                if step > 0:
                    key = tuple(sorted(content.items(), reverse=True))
                    x[key] = x.get(key, 0.0) + step
                    for k, a in content.items():
                        left[k] = max(0.0, left[k] - a * step)
    return x, bound


def rounded(x: dict[Configuration, float], demand: np.ndarray, capacity: int, room: float) -> Plan:
    """Whole sequences of the configurations with little enough room, the rest best fit."""
    plan, rest = Plan(capacity), demand.copy()
    kept = [(c, n) for c, n in x.items() if capacity - sum(k * a for k, a in c) <= room * capacity]

    def take(c: Configuration, most: int) -> None:
        count = min(most, *(int(rest[k]) // a for k, a in c))
        if count > 0:
            plan.add(count, dict(c))
            for k, a in c:
                rest[k] -= a * count

    for c, n in kept:
        take(c, int(n + COVERED))
    for c, _ in sorted(kept, key=lambda e: (-(e[1] % 1.0), e[0])):
        take(c, 1)
    plan.rounded = plan.sequences
    best_fit(rest, plan)
    return plan


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack a histogram of lengths exactly: every piece gets one place."""
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        demand[length] = n
    whole = int(demand[capacity])  # nothing fits beside these
    demand[capacity] = 0
    plain = Plan(capacity)
    best_fit(demand.copy(), plain)
    plans, bound = [], 0.0
    for rate in RATES:
        x, least = cover(demand, capacity, rate)
        bound = max(bound, least)
        plans += [rounded(x, demand, capacity, room) for room in ROOMS]
        plan = min(plans, key=lambda p: p.sequences)
        if plan.sequences <= np.ceil(bound - 1e-6):  # proven: no plan has fewer
            break
    if plain.sequences < plan.sequences:
        plan = plain
    plan.add(whole, {capacity: 1})
    plan.bound = int(np.ceil(bound - 1e-6)) + whole
    return plan


# ------------------------------------------------------------------- DataFrames

PIECES = "id long, piece int, start long, length long, crc long, part int, nth long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col="doc_id", text_col="text") -> DataFrame:
    """Every piece with its place among the pieces of its length in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(cut_up(batches))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer.load(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for k, own_ids in enumerate(words.ids_many(x.as_py() for x in batch.column(1))):
                coded = np.concatenate([own_ids, end])
                for piece, at in enumerate(range(0, len(coded), capacity)):
                    own = coded[at : at + capacity]
                    rows.append((ids[k], piece, at, len(own), crc32(own.tobytes()), part, int(seen[len(own)])))
                    seen[len(own)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("id", "piece", "start", "length", "crc", "part", "nth")
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    held = materialize(pieces(docs, path or tokenizer.default_path(), capacity, end_id, id_col, text_col), "pieces")
    counts = held.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = held.sparkSession.sparkContext.broadcast(solve(histogram, capacity).places())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, times, base, offset = plan.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
        own = rank - (key[at] & ((1 << 44) - 1))
        return pd.DataFrame({"sequence_id": base[at] + own // times[at], "offset": offset[at] + own % times[at] * length})

    placed = held.join(offsets, ["part", "length"]).withColumn("_at", place(F.col("length"), F.col("base") + F.col("nth")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "_at.sequence_id", "_at.offset")

"""Approximate nearest neighbours by collision counting over single projections.

Every vector is projected on a few random directions, and every direction has
its own sorted array.  A query opens a window around its own projection in each
array; a vector collides where it lies inside.  While too few vectors collide
often enough, the windows widen, each by a fixed factor (virtual rehashing: the
arrays stay as they are).  Vectors that reach the collision threshold are
verified by their exact inner product.  The k-th best of those says how far the
windows have to reach: a vector at that distance from the query falls into a
window of ``REACH`` distances with a probability that exceeds the threshold by
0.9 deviations of the count, so that nearer ones are hardly missed.  The windows
widen to that and what collides then is verified: as much as the data need, no
fixed share.

The largest inner product becomes the smallest distance by one more coordinate,
sqrt(M^2 - |x|^2), for vectors and none for queries.

Vectors are dealt into blocks by a hash of the row, whatever their key; each
block is an index of its own, so memory is bounded and blocks work in parallel.
Every block is sent and indexed once (a few times if there are fewer blocks
than tasks); the queries, in blocks too, are what travels.  A visit sends back
the best k rows of a query, and a ranking that is bounded in each task before
the shuffle keeps k of them all.  Vectors of each length are an index of their
own.

Defined results: vectors that are null, empty, all zero, or hold null or
non-finite components take no part; vectors of different lengths are not
compared, and each length is searched; ties go to the smaller id; rows with the query's own id are no candidates; fewer candidates
than ``k`` are all returned; an empty table gives no row.  Rows of equal id and
vector are one row, dropped before the blocks are built; different vectors of
one id are different rows, and as queries they ask together: a row counts once,
with its best score.  Columns of other names are no input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard
from .common import empty_like, materialize, shuffle_width

K = 20
#: Vectors of a block and queries of a block.
BLOCK = 16_384
QUERIES = 1_024
#: Directions, share of them that must collide, least half-width in deviations, widening, cells of a sorted array.
DIRECTIONS = 160
THRESHOLD = 0.65
FIRST = 0.7
WIDEN = 1.1
CELLS = 128
#: Half-width of the last windows in distances of the k-th best: a normal value lies within it with a probability of
#: THRESHOLD + 0.9 * sqrt(THRESHOLD * (1 - THRESHOLD) / DIRECTIONS).
REACH = 1.0
#: Queries that are counted together.
TOGETHER = 64

RESULT = "query_id long, rank int, vec_id long, score double"


def counted(planes: list[np.ndarray]) -> list[np.ndarray]:
    """Column sums of bit vectors, as bit planes from the lowest: full adders until one plane a weight is left."""
    levels, out = [list(planes)], []
    while levels:
        level, above = levels.pop(), []
        while len(level) > 1:
            if len(level) == 2:
                x, y = level.pop(), level.pop()
                above.append(x & y)
                level.append(x ^ y)
            else:
                x, y, z = level.pop(), level.pop(), level.pop()
                half = x ^ y
                above.append((x & y) | (half & z))
                level.insert(0, half ^ z)
        out.append(level[0])
        if above:
            levels.append(above)
    return out


def at_least(planes: list[np.ndarray], bound: int) -> np.ndarray:
    """Where the number in the bit planes is ``bound`` or more."""
    more, same = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for k in reversed(range(max(len(planes), bound.bit_length()))):
        p = planes[k] if k < len(planes) else np.zeros_like(more)
        if bound >> k & 1:
            same = same & p
        else:
            more = more | (same & p)
            same = same & ~p
    return more | same


class CollisionIndex:
    """Sorted single projections of one block of vectors.

    Each sorted array is cut into ``CELLS`` cells; which vectors lie before a
    cell is kept as a bit vector, so those inside a window are the difference of
    two, and all collisions of a query are counted bitwise at once.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, directions: int = DIRECTIONS, seed: int = 7):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        n, dim = vectors.shape
        self.axes = np.random.default_rng(seed).standard_normal((directions, dim + 1)).astype(np.float32)
        x = (vectors / longest).astype(np.float32)
        rest = np.sqrt(np.maximum(0, 1 - (x.astype(np.float64) ** 2).sum(axis=1))).astype(np.float32)
        spots = self.axes @ np.hstack([x, rest[:, None]]).T
        order = np.argsort(spots, axis=1)
        self.sorted = np.take_along_axis(spots, order, axis=1)
        words = (n + 63) // 64
        self.before = np.zeros((directions, CELLS + 1, words), np.uint64)
        edges = np.arange(CELLS + 1)[:, None]
        cell = np.empty(n, np.int64)
        for j in range(directions):
            cell[order[j]] = np.arange(n) * CELLS // n
            packed = np.packbits(cell[None, :] < edges, axis=1, bitorder="little")
            self.before[j].view(np.uint8)[:, : packed.shape[1]] = packed

    def inside(self, spots: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Bit vectors, one a query, of the vectors that collide often enough within the half-widths."""
        n, m = len(self.ids), len(self.axes)
        planes = []
        for j in range(m):
            lo = np.searchsorted(self.sorted[j], spots[:, j] - half) * CELLS // n
            hi = -(-np.searchsorted(self.sorted[j], spots[:, j] + half, side="right") * CELLS // n)
            planes.append(self.before[j, hi] ^ self.before[j, lo])
        return at_least(counted(planes), int(np.ceil(THRESHOLD * m)))

    def collided(self, spots: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Boolean (query, vector): inside the windows often enough."""
        found = self.inside(spots, half)
        return np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : len(self.ids)].astype(bool)

    def candidates(self, spots: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The first vectors to verify, and the half-widths they took: windows widen until ``wanted`` collide, or all."""
        n = len(self.ids)
        out = np.zeros((len(spots), n), bool)
        open_, half = np.arange(len(spots)), np.full(len(spots), FIRST, np.float32)
        while len(open_):
            found = self.collided(spots[open_], half[open_])
            out[open_] = found
            open_ = open_[found.sum(axis=1) < min(wanted, n)]
            half[open_] *= WIDEN
        return out, half

    def best(self, hit: np.ndarray, q: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best ``k`` of ``hit``, the query's own id left out."""
        found = np.flatnonzero(hit)
        found = found[self.ids[found] != q]
        score = self.vectors[found] @ vector
        if len(found) > 4 * k:  # all that may reach rank k, ties included
            least = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= least
            found, score = found[keep], score[keep]
        order = np.lexsort((self.ids[found], -score))[:k]
        return found[order], score[order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each query: its id, and ids, scores and places in the block of its best."""
        length = np.linalg.norm(queries, axis=1)
        spots = np.hstack([queries / length[:, None], np.zeros((len(queries), 1))]).astype(np.float32) @ self.axes.T
        for at in range(0, len(queries), TOGETHER):
            own = slice(at, at + TOGETHER)
            some, half = self.candidates(spots[own], 5 * k)
            reach = np.zeros(len(half), np.float32)
            for i, (q, vector) in enumerate(zip(query_ids[own], queries[own], strict=True)):
                _, score = self.best(some[i], q, vector, k)
                if len(score):  # in units of the longest vector the query has length one, like all
                    reach[i] = REACH * np.sqrt(max(0.0, 2 - 2 * score[-1] / (length[at + i] * self.longest)))
            wide = np.flatnonzero(reach > half)
            if len(wide):
                some[wide] = self.collided(spots[own][wide], reach[wide])
            for i, (q, vector) in enumerate(zip(query_ids[own], queries[own], strict=True)):
                found, score = self.best(some[i], q, vector, k)
                yield int(q), self.ids[found], score, found


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``v`` (array of doubles) of the vectors that take part, and how long they are."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def search(vectors: DataFrame, every: int = 20, k: int = K, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Neighbours of the rows whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    known = materialize(usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"]), "ann-rows")
    asks = F.pmod("id", F.lit(every)) == 0
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    found = known.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(asks, 1)).alias("asking"), F.sqrt(F.max(square)).alias("most")).filter("asking > 0")
    # Blocks of vectors and of queries; each block in copies enough to fill the tasks, each copy for its share of the queries.
    width = shuffle_width(vectors.sparkSession)
    counted = found.withColumns({"blocks": F.ceil(F.col("n") / BLOCK).cast("int"), "groups": (F.ceil(F.col("asking") / QUERIES) + 1).cast("int")})
    counted = counted.withColumn("copies", F.greatest(F.lit(1), F.least("groups", (F.lit(width) / F.col("blocks")).cast("int"))))
    before = F.sum(F.col("blocks") * F.col("copies")).over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialize(counted.withColumn("base", F.coalesce(before, F.lit(0)).cast("int")), "ann-sizes")  # one row a vector length
    places = sizes.agg(F.sum(F.col("blocks") * F.col("copies"))).first()[0]
    if not places:
        return empty_like(vectors, RESULT)
    small = F.broadcast(sizes)
    row = F.xxhash64(F.monotonically_increasing_id())

    def packed(df: DataFrame, name: str, by: str) -> DataFrame:
        """Rows of ``df`` as a few rows of binary columns, so many as ``by`` says: a hash deals them, so none can grow."""

        def gather(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], name: [int(pdf["b"].iloc[0])], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vs": [np.stack(pdf["v"].to_numpy()).astype(np.float64).tobytes()]})

        dealt = df.withColumn("dim", F.size("v")).join(small.select("dim", by), "dim").withColumn("b", F.pmod(row, F.col(by)).cast("int"))
        return dealt.groupBy("dim", "b").applyInPandas(gather, f"dim int, {name} int, ids binary, vs binary").join(small, "dim")

    data = materialize(packed(known, "block", "blocks"), "ann-blocks")
    queries = packed(known.filter(asks), "qblock", "groups")
    # The stated queries against all rows, in blocks: each block waits in its task, and the query blocks come by.
    place = F.col("base") + F.col("block") * F.col("copies")
    waiting = data.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select((place + F.col("copy")).alias("place"), "dim", "block", F.lit(0).alias("turn"), "most", "ids", "vs")
    coming = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select((place + F.pmod("qblock", F.col("copies"))).alias("place"), "dim", F.col("qblock").alias("block"), F.lit(1).alias("turn"), "most", "ids", "vs")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                ids, vs = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vs"], np.float64).reshape(-1, r["dim"])
                if not r["turn"]:
                    index, at = CollisionIndex(ids, vs, r["most"] * (1 + 1e-9)), r["block"] << 32
                    continue
                if index is None or not len(ids):
                    continue
                out = list(index.search(ids, vs, k))
                each = np.array([len(i) for _, i, _, _ in out])
                flat = [np.repeat(ids, each), np.repeat((r["block"] << 32) + np.arange(len(ids)), each), *(np.concatenate([o[c] for o in out]) for c in (1, 2)), at + np.concatenate([o[3] for o in out])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["query_id", "q", "vec_id", "score", "row"])

    met = waiting.unionAll(coming).repartitionById(int(places), F.col("place")).sortWithinPartitions("place", "turn")
    best = met.select("dim", "block", "turn", "most", "ids", "vs").mapInArrow(visit, "query_id long, q long, vec_id long, score double, row long")

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        """The best ``k`` of each key; no task holds or sends more than it takes for that."""
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row"))).filter(F.col("rank") <= k)

    # Of each query vector first; where several have one id, a row that they both found counts once.
    own = first(best, "query_id", "q").groupBy("query_id", "row").agg(F.max("score").alias("score"), F.first("vec_id").alias("vec_id"))
    out = materialize(first(own, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "ann-found")
    discard(known, sizes, data)
    return out

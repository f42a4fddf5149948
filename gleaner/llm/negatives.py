"""Hard-negative mining by norm-bucketed search.

Rows become whole numbers (each component x is floor(256 x)), so scores are
exact.  Candidates are sorted by norm, in range partitions of (norm, id), and
cut into buckets; a bucket knows its greatest norm.  By Cauchy-Schwarz no score
of a bucket exceeds that norm times the anchor's, so a bucket is passed over
where this stays below what is asked for: in the search for positives the
anchor's running fifth score, in that for negatives the lower limit of each of
its windows and the running third score within it.

Buckets are dealt to lanes in turn, so every lane has long and short vectors
and its running scores rise early; a lane waits in its task, longest vectors
first, and the anchors come by in blocks.  A lane is bounded in bytes, whatever
the number of vectors or their length, and sends back k rows for an anchor, or
an anchor's window, at most; of these k are kept by a ranking that Spark bounds
before the shuffle as well.

Defined results: rows with a null id, label or vector, an empty vector, or any
null or non-finite component take no part; ties go to the smaller id; rows with
the anchor's own id are not other rows; only vectors of one length are compared;
rows of equal id, label and vector are one row, different rows of one id are
anchors each; fewer than asked for are all returned; windows below a positive
score of zero are empty; an empty table gives no row; inner products beyond 62
bits are an error; columns of other names are no input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard
from .common import materialize, shuffle_width, tidy

SCALE = 256
LABELS = 10
#: Windows of negatives: 50 to 95 hundredths of the positive's score.
LOWEST, HIGHEST, WHOLE = 50, 95, 100
POSITIVES, NEGATIVES = 5, 3
#: Vectors of a bucket, bytes of a lane, bytes and rows of a block of anchors.
BUCKET = 4_096
LANE_BYTES = 48 << 20
BLOCK_BYTES = 128 << 10
BLOCK_ROWS = 512
#: Slack of norms, which are rounded.
SLACK = 1 + 1e-9


def prepared(vectors: DataFrame, shifted_every: int = 7, labels: int = LABELS, id_col="vec_id", vec_col="embedding", label_col="label") -> DataFrame:
    """id, label, v (whole numbers), norm: the rows that take part; labels of ids divisible by ``shifted_every`` move on by one."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.pmod("id", F.lit(shifted_every)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    out = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))).select("id", moved.alias("label"), whole.alias("v")).dropDuplicates(["id", "label", "v"])
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def narrowest(v: np.ndarray) -> np.ndarray:
    """``v`` in the narrowest signed type that holds it."""
    most = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1)
    return v.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


class Bucket:
    """Vectors of about one norm."""

    def __init__(self, most: float, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.most, self.ids, self.labels, self.whole = most, ids, labels, v
        self.peak = float(max(int(v.max(initial=0)), -int(v.min(initial=0))))
        self.real: np.ndarray | None = None

    def scores(self, anchors: np.ndarray, peak: float) -> np.ndarray:
        """Exact inner products: sums below 2^53 are exact in floating point, larger ones are made in whole numbers."""
        bound = peak * self.peak * anchors.shape[1]
        if bound < 2**53:
            if self.real is None:
                self.real = self.whole.astype(np.float64)
            return np.rint(anchors.astype(np.float64) @ self.real.T).astype(np.int64)
        if bound >= 2**62:
            raise ValueError("inner products beyond 62 bits")
        return anchors.astype(np.int64) @ self.whole.astype(np.int64).T


class Best:
    """The first ``k`` rows found so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def beats(self, bound: float) -> bool:
        """Whether a score of ``bound`` could still be among the first."""
        return len(self.scores) < self.k or bound >= self.scores[-1]

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            fine = scores >= self.scores[-1]
            scores, ids = scores[fine], ids[fine]
        if not len(scores):
            return
        if len(scores) > 4 * self.k:
            fine = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[fine], ids[fine]
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def limits(positive: int) -> tuple[int, int]:
    """Least and greatest score of a window."""
    return -(-LOWEST * positive // WHOLE), HIGHEST * positive // WHOLE


def visit(buckets: list[Bucket], ids: np.ndarray, labels: np.ndarray, v: np.ndarray, windows: list[list[int]] | None) -> Iterator[tuple[int, int, int, int]]:
    """Of a lane's buckets (longest vectors first), the best of each anchor: place of the anchor, number of its window, found id, score.

    Without windows these are positives: other rows of the anchor's label.
    """
    norms = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) * SLACK
    peak = float(max(int(v.max(initial=0)), -int(v.min(initial=0))))
    found = [[Best(POSITIVES)] if windows is None else [Best(NEGATIVES) for _ in windows[a]] for a in range(len(ids))]
    spans = [[] if windows is None else [limits(p) for p in windows[a]] for a in range(len(ids))]
    for bucket in buckets:
        # Windows that this bucket can still serve, by anchor; the others are passed over.
        open_ = []
        for a in range(len(ids)):
            bound = norms[a] * bucket.most
            own = [w for w, b in enumerate(found[a]) if b.beats(bound) and (windows is None or (spans[a][w][0] <= spans[a][w][1] and bound >= spans[a][w][0]))]
            if own:
                open_.append((a, own))
        for at in range(0, len(open_), 64):
            few = open_[at : at + 64]
            for (a, own), score in zip(few, bucket.scores(v[[a for a, _ in few]], peak), strict=True):
                if windows is None:
                    fit = np.flatnonzero((bucket.labels == labels[a]) & (bucket.ids != ids[a]))
                    found[a][0].add(score[fit], bucket.ids[fit])
                    continue
                least = min(spans[a][w][0] for w in own)
                fit = np.flatnonzero((score >= least) & (bucket.labels != labels[a]) & (bucket.ids != ids[a]))
                score, there = score[fit], bucket.ids[fit]
                for w in own:
                    lo, hi = spans[a][w]
                    inside = (score >= lo) & (score <= hi)
                    found[a][w].add(score[inside], there[inside])
    for a, every in enumerate(found):
        for w, best in enumerate(every):
            for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True):
                yield a, w, i, s


BUCKETS = "dim int, spot long, most double, ids binary, labels binary, vs binary, width int"


def buckets(rows: DataFrame, n: int) -> DataFrame:
    """The rows as buckets, longest vectors first within a length; ``spot`` counts them by norm within a range partition."""
    parts = max(1, -(-n // BUCKET))
    ranged = rows.withColumn("dim", F.size("v")).repartitionByRange(parts, "dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        spot = 0
        for batch in batches:  # sorted by length, so a batch is cut where the length changes
            dims = batch.column("dim").to_numpy()
            edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column("dim")[0].as_py() != int(dims[a]):
                    yield made(held, spot)
                    held, spot = [], spot + 1
                held.append(batch.slice(a, b - a))
                if sum(h.num_rows for h in held) >= BUCKET:
                    yield made(held, spot)
                    held, spot = [], spot + 1
        if held:
            yield made(held, spot)

    def made(held: list[pa.RecordBatch], spot: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        v = narrowest(t.column("v").combine_chunks().flatten().to_numpy())
        n = t.num_rows
        values = [len(v) // n, int(t.column("part")[0].as_py()) + spot, float(t.column("norm").to_numpy().max()) * SLACK, t.column("id").to_numpy().tobytes(), t.column("label").to_numpy().tobytes(), v.tobytes(), v.itemsize]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in BUCKETS.split(", ")])

    return ranged.withColumn("part", F.spark_partition_id()).select("dim", "part", "norm", "id", "label", "v").mapInArrow(lambda b: tidy(gather(b)), BUCKETS)


def _searched(waiting: DataFrame, anchors: DataFrame, lanes: DataFrame, tasks: int, windows: bool) -> DataFrame:
    """anchor (number), window, hit and score of every lane's best for the anchors (anchor, id, label, v, dim, windows)."""
    own = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), (F.lit(BLOCK_BYTES) / (8 * F.col("dim"))).cast("int")))
    sized = anchors.join(F.broadcast(lanes), "dim")  # one row a vector length
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("anchor"), F.greatest(F.lit(1), F.ceil(F.col("asking") / own))).cast("int"))
    # Each lane in as many copies as fill the tasks, each for its share of the blocks.
    copies = F.greatest(F.lit(1), F.least(F.ceil(F.col("asking") / own), F.lit(tasks) / F.col("lanes"))).cast("int")
    parts = lanes.agg(F.sum(F.col("lanes") * copies.cast("long"))).first()[0]
    base = F.sum(F.col("lanes") * copies.cast("long")).over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1))
    based = F.broadcast(lanes.select("dim", copies.alias("copies"), F.coalesce(base, F.lit(0)).cast("long").alias("base")))  # one row a vector length
    none = F.lit(None)
    stay = waiting.join(based, "dim").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    stay = stay.select((F.col("base") + F.col("lane") * F.col("copies") + F.col("copy")).cast("int").alias("place"), F.lit(0).alias("turn"), (-F.col("most")).alias("order"), "dim", "width", "ids", "labels", "vs", none.cast("array<long>").alias("anchors"), none.cast("array<array<long>>").alias("windows"))
    packed = dealt.groupBy("dim", "block", "lanes").agg(F.collect_list(F.struct("anchor", "id", "label", "v", "windows")).alias("rows"))  # a block is bounded
    come = packed.join(based, "dim").withColumn("lane", F.explode(F.sequence(F.lit(0), (F.col("lanes") - 1).cast("int"))))
    pick = lambda c: F.transform("rows", lambda r: r[c])
    come = come.select(
        (F.col("base") + F.col("lane") * F.col("copies") + F.pmod("block", F.col("copies"))).cast("int").alias("place"), F.lit(1).alias("turn"), F.lit(0.0).alias("order"), "dim", F.lit(8).alias("width"),
        none.cast("binary").alias("ids"), none.cast("binary").alias("labels"), none.cast("binary").alias("vs"), pick("anchor").alias("anchors"), pick("windows").alias("windows"), pick("id").alias("own_ids"), pick("label").alias("own_labels"), F.flatten(pick("v")).alias("own_vs"),
    )
    long = none.cast("array<long>")
    met = stay.withColumns({"own_ids": long, "own_labels": long, "own_vs": long}).unionByName(come).repartitionById(int(parts or 1), F.col("place")).sortWithinPartitions("place", "turn", "order")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lane = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if row["place"].as_py() != place:
                    place, lane = row["place"].as_py(), []
                dim = row["dim"].as_py()
                if not row["turn"].as_py():
                    ids, labels = (np.frombuffer(row[c].as_buffer(), np.int64).copy() for c in ("ids", "labels"))
                    v = np.frombuffer(row["vs"].as_buffer(), f"<i{row['width'].as_py()}").reshape(-1, dim).copy()
                    lane.append(Bucket(-row["order"].as_py(), ids, labels, v))
                    continue
                ids, labels, v, numbers = (row[c].values.to_numpy() for c in ("own_ids", "own_labels", "own_vs", "anchors"))
                out = list(visit(lane, ids, labels, v.reshape(-1, dim), row["windows"].as_py() if windows else None))
                a, w, hit, score = (np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ((), (), (), ())))
                yield pa.RecordBatch.from_arrays([pa.array(numbers[a]), pa.array(w.astype(np.int32)), pa.array(hit), pa.array(score)], names=["anchor", "window", "hit", "score"])

    return met.mapInArrow(lambda b: tidy(search(b)), "anchor long, window int, hit long, score long")


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` of each key; Spark drops what ranks lower in a task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "hit"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, shifted_every: int = 7, id_col="vec_id", vec_col="embedding", label_col="label") -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = materialize(prepared(vectors, shifted_every, LABELS, id_col, vec_col, label_col), "negatives-rows")
    asked = F.pmod("id", F.lit(every)) == 0
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(asked, 1)).alias("asking")).filter("asking > 0")
    # Lanes bounded in bytes (8 a component, as they lie in memory at most): one row a vector length.
    sizes = materialize(sizes.withColumn("lanes", F.ceil(F.col("n") * F.col("dim") * 8 / LANE_BYTES)), "negatives-sizes")
    n = rows.count()
    anchors = materialize(rows.filter(asked).withColumn("anchor", F.monotonically_increasing_id()).select("anchor", "id", "label", "v", F.size("v").alias("dim")), "negatives-anchors")
    dealt = buckets(rows, n).join(F.broadcast(sizes.select("dim", "lanes")), "dim").withColumn("lane", F.pmod("spot", F.col("lanes")))
    waiting = materialize(dealt, "negatives-buckets")
    tasks = shuffle_width(vectors.sparkSession)
    no_window = F.lit(None).cast("array<long>")
    positives = materialize(_first(_searched(waiting, anchors.withColumn("windows", no_window), sizes, tasks, False), POSITIVES, "anchor"), "negatives-positives")
    # At most five windows an anchor.
    windows = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "hit", "score"))).alias("p"))
    with_windows = materialize(anchors.join(windows, "anchor").withColumn("windows", F.col("p.score")), "negatives-windows")
    found = _first(_searched(waiting, with_windows.drop("p"), sizes, tasks, True), NEGATIVES, "anchor", "window")
    p = F.element_at("p", F.col("window") + 1)
    named = found.join(with_windows.select("anchor", "id", "p"), "anchor")
    out = materialize(named.select(F.col("id").alias("anchor_id"), p["hit"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("hit").alias("negative_id"), p["score"].alias("positive_score"), F.col("score").alias("negative_score")), "negatives")
    discard(rows, sizes, anchors, waiting, positives, with_windows)
    return out


#: DuckDB SQL with the query's rows.
MINE_SQL = f"""
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
u AS (SELECT DISTINCT * FROM r),
s AS (SELECT a.id AS anchor_id, a.label = c.label AS same, c.id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM u a JOIN u c ON len(a.v) = len(c.v) AND a.id <> c.id WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}"""

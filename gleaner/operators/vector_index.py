"""An approximate index of vectors: inverted lists with product codes, persisted beside the rows.

Vectors are scaled to length one.  Coarse centroids, trained by Spark's own
k-means on a bounded sample, cut the space into lists; what a vector differs
from its centroid is cut into short parts, and each part is replaced by the
number of the nearest of 256 code vectors, one byte.  On disk a list is a
folder, so a search reads the lists nearest to the query by partition pruning,
and of them only ids and codes.  The codes give rough distances; the best
``refine`` rows a query are read whole and compared exactly.

How many lists a search has to open depends on the data.  It is measured when
the index is made: a bounded sample of rows asks for its exact neighbours, and
``probes`` is the least number of lists that hold the wanted share of them.

Rows come in segments, each coded with the same model.  A segment is never
changed; a search says which segments are live, and which of their rows.

Defined results: vectors that are null, all zero, of another length than the
model's, or hold null or non-finite components are not in the index (they have
no distance to a query of that length either); a query of such a kind finds
nothing; ties go to the smaller id; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, settled
from . import corpus

#: Rows that centroids and code vectors are trained on, and rows that measure how many lists to open.
SAMPLE_ROWS = 40_000
SAMPLE_QUERIES = 200
#: Lists: about four times the square root of the rows, within bounds; the centroids are held by every task.
MAX_LISTS = 16_384
#: Components of a coded part, code vectors of a part, rounds of their training.
PART = 4
CODES = 256
ROUNDS = 12
#: Rows of a list that one task scores about, rows that are worth a task of their own, and scored rows that are handed on at a time.
SLICE_ROWS = 200_000
SHELF_ROWS = 5_000
HANDED = 100_000
#: Rows that are measured against all centroids at a time, so that no batch holds more than this many rows of distances.
MEASURED = 64
#: Rows that a search compares exactly, at least and a wanted neighbour.
REFINE_LEAST, REFINE_EACH = 200, 20


def unit(column: Column) -> Column:
    """A vector of doubles scaled to length one; null where it cannot be."""
    v = column.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0) & (size < float("inf"))
    return F.when(fine, F.transform(v, lambda x: x / size))


def _nearest(v: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Numbers of the ``k`` nearest centres of each row, nearest first."""
    far = (centres**2).sum(axis=1) - 2 * (v @ centres.T)
    if k == 1:
        return far.argmin(axis=1)[:, None]
    k = min(k, far.shape[1])
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.take_along_axis(far, near, axis=1).argsort(axis=1, kind="stable"), axis=1)


def _code_vectors(v: np.ndarray, seed: int) -> np.ndarray:
    """Up to 256 code vectors of the rows of one part, by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(v, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:CODES]]
    for _ in range(ROUNDS if len(distinct) > CODES else 0):
        near = _nearest(v, centres)[:, 0]
        count = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, v[:, j], len(centres)) for j in range(v.shape[1])], axis=1)
        empty = count == 0
        centres = np.where(empty[:, None], distinct[rng.integers(0, len(distinct), len(centres))], total / np.maximum(count, 1)[:, None])
    return centres


@dataclass
class Model:
    """Centroids, code vectors of each part of the residuals, and lists to open for the wanted recall."""

    centroids: np.ndarray
    parts: list[np.ndarray] = field(repr=False)
    probes: int = 1

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def cuts(self) -> list[slice]:
        return [slice(a, min(a + PART, self.width)) for a in range(0, self.width, PART)]

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each row of unit vectors."""
        lists = _nearest(v, self.centroids)[:, 0]
        rest = v - self.centroids[lists]
        return lists, np.stack([_nearest(rest[:, c], p)[:, 0] for c, p in zip(self.cuts(), self.parts, strict=True)], axis=1).astype(np.uint8)

    def rough(self, query: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Rough products of the query and rows of the lists ``at``: larger is nearer."""
        tables = [p @ query[c] for c, p in zip(self.cuts(), self.parts, strict=True)]
        return (self.centroids @ query)[at] + sum(t[codes[:, j]] for j, t in enumerate(tables))


def train(vectors: DataFrame, lists: int | None = None, rows: int | None = None, seed: int = 7) -> Model:
    """A model of unit vectors (id, v) of one length; ``rows``: how many there are, counted if not given."""
    rows = vectors.count() if rows is None else rows
    lists = min(MAX_LISTS, max(1, lists or round(4 * rows**0.5)), max(1, rows))
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    key = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("gleaner-index")), F.lit(1 << 30))
    sample = settled(vectors.filter(key < int(share * (1 << 30))).select("v"), "index-sample")
    found = KMeans(k=max(2, min(lists, sample.count())), seed=seed, maxIter=10, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    centroids = np.array(found.clusterCenters())
    width = centroids.shape[1]
    cuts = [(a, min(a + PART, width)) for a in range(0, width, PART)]

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                rest = v - centroids[_nearest(v, centroids)[:, 0]]
                yield pd.concat([pd.DataFrame({"part": np.int32(j), "r": list(rest[:, a:b])}) for j, (a, b) in enumerate(cuts)])

    def codes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "codes": [_code_vectors(np.stack(pdf["r"].to_numpy()), seed + key[0]).ravel()]})

    # One task a part, of a sample that is bounded.
    made = sample.mapInPandas(residuals, "part int, r array<double>").groupBy("part").applyInPandas(codes, "part int, codes array<double>").collect()
    discard(sample)
    parts = [np.array(r["codes"]).reshape(-1, b - a) for r, (a, b) in zip(sorted(made, key=lambda r: r["part"]), cuts, strict=True)]
    return Model(centroids, parts)


class VectorIndex:
    """An index under ``path``: a model, and segments of coded rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._model: Model | None = None

    # ------------------------------------------------------------- building

    @classmethod
    def create(cls, rows: DataFrame, path: str, id_col: str, vector_col: str, lists: int | None = None, recall: float = 0.95, k: int = 5) -> VectorIndex:
        """Train on ``rows`` and write the model; the vectors' length is that of most of them.

        The index has no rows yet: see :meth:`add`.  ValueError where no row
        has a vector.
        """
        self = cls(rows.sparkSession, path)
        units = settled(rows.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v")).filter("v is not null"), "index-units")
        sizes = units.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
        if sizes is None:
            raise ValueError("no vector to make an index of")
        own = units.filter(F.size("v") == sizes["width"])
        model = train(own, lists, sizes["n"])
        model.probes = self._measured(model, own, sizes["n"], recall, k)
        discard(units)
        kinds = [("probes", 0, [float(model.probes)]), *(("centroid", i, c.tolist()) for i, c in enumerate(model.centroids)), *(("part", i, p.ravel().tolist()) for i, p in enumerate(model.parts))]
        self.spark.createDataFrame(kinds, "kind string, n int, v array<double>").coalesce(1).write.parquet(f"{self.path}/model")
        self._model = model
        return self

    @staticmethod
    def _measured(model: Model, own: DataFrame, rows: int, recall: float, k: int) -> int:
        """Lists that a bounded sample of rows has to open for a share ``recall`` of its exact neighbours."""
        key = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("gleaner-probes")), F.lit(1 << 30))
        asked = settled(own.filter(key < int(min(1.0, SAMPLE_QUERIES / rows) * (1 << 30))).select(F.col("id").alias("query_id"), F.col("v").alias("query_vector")), "index-asked")
        hits = corpus.query_many(own.select("id", "v"), asked, k, "id", "v")
        joined = hits.join(asked, "query_id").join(own.select(F.col("id").alias("hit_id"), "v"), "hit_id").select("query_vector", "v")

        def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    q, v = (np.stack(pdf[c].to_numpy()) for c in ("query_vector", "v"))
                    order = _nearest(q, model.centroids, len(model.centroids))
                    yield pd.DataFrame({"place": (order == _nearest(v, model.centroids)).argmax(axis=1)})

        found = joined.mapInPandas(places, "place int").agg(F.percentile("place", recall)).first()[0]
        discard(asked)
        return min(len(model.centroids), int(np.ceil(found or 0)) + 1)

    def model(self) -> Model:
        """The model, read once."""
        if self._model is None:
            rows = self.spark.read.parquet(f"{self.path}/model").orderBy("kind", "n").collect()  # bounded by MAX_LISTS
            of = lambda kind: [np.array(r["v"]) for r in rows if r["kind"] == kind]
            centroids = np.stack(of("centroid"))
            width = centroids.shape[1]
            cuts = [min(PART, width - a) for a in range(0, width, PART)]
            self._model = Model(centroids, [p.reshape(-1, n) for p, n in zip(of("part"), cuts, strict=True)], int(of("probes")[0][0]))
        return self._model

    def add(self, rows: DataFrame, segment: str, id_col: str, vector_col: str, keep: tuple[str, ...] = ()) -> None:
        """Code ``rows`` as a new segment; ``keep`` names columns that searches may filter by."""
        model = self.model()

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                    lists, codes = model.encode(v)
                    flat = pa.array([c.tobytes() for c in codes], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "v"), pa.array(lists.astype(np.int32)), flat], names=[*(c for c in batch.schema.names if c != "v"), "list", "code"])

        own = rows.select(F.col(id_col).alias("id"), *keep, F.col(vector_col).alias("vector"), unit(F.col(vector_col)).alias("v")).filter(F.size("v") == model.width)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("v").schema)
        done = own.mapInArrow(coded, f"{fields}, list int, code binary")
        # A list goes to one task, unless it is large: a salt that grows with the rows deals it out.
        size = settled(done, "index-coded")
        each = size.groupBy("list").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("_s"))
        salted = size.join(F.broadcast(each), "list").withColumn("_s", F.pmod(F.xxhash64("id"), F.col("_s")))  # one row a list, MAX_LISTS at most
        salted.repartition("list", "_s").drop("_s").sortWithinPartitions("list", *keep).write.partitionBy("list").parquet(f"{self.path}/rows/segment={segment}")
        discard(size)

    def rows(self, segments: list[str] | None = None) -> DataFrame | None:
        """The coded rows, with ``segment`` and ``list``; None where there are none."""
        root = f"{self.path}/rows"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = sorted(f.getPath().getName().partition("=")[2] for f in fs.listStatus(folder)) if fs.exists(folder) else []
        live = [s for s in there if segments is None or s in segments]
        full = [s for s in live if any(f.isDirectory() for f in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/segment={s}")))]
        if not full:
            return None
        return self.spark.read.option("basePath", root).parquet(*(f"{root}/segment={s}" for s in full)).withColumn("segment", F.col("segment").cast("string"))

    # ------------------------------------------------------------ searching

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, refine: int | None = None, where: Column | None = None, segments: list[str] | None = None, only=None) -> DataFrame:
        """The ``k`` nearest rows found for each query (query_id, query_vector): query_id, rank, hit_id, distance.

        ``probes``: lists to open, the measured number if not given; with all
        lists and a ``refine`` of all rows the search is exact.  ``where`` and
        ``only`` (a function of the coded rows) say which rows count.
        """
        model = self.model()
        probes = min(len(model.centroids), probes or model.probes)
        refine = refine or max(REFINE_LEAST, REFINE_EACH * k)
        rows = self.rows(segments)
        query_type = queries.schema["query_id"].dataType.simpleString()
        if rows is None:
            return self.spark.createDataFrame([], f"query_id {query_type}, rank int, hit_id string, distance double")
        id_type = rows.schema["id"].dataType.simpleString()

        def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), MEASURED):
                    some = pdf.iloc[at : at + MEASURED]
                    near = _nearest(np.stack(some["q"].to_numpy()), model.centroids, probes)
                    yield some.assign(opens=list(np.sort(near, axis=1).astype(np.int32)))

        asked = queries.select("query_id", unit(F.col("query_vector")).alias("q")).filter(F.size("q") == model.width)
        visits = settled(asked.mapInPandas(opened, f"query_id {query_type}, q array<double>, opens array<int>"), "index-visits")  # one row a query
        wanted = [r[0] for r in visits.select(F.explode("opens").alias("list")).distinct().collect()]  # MAX_LISTS at most
        opened_rows = rows.filter(F.col("list").isin(wanted))
        opened_rows = opened_rows if where is None else opened_rows.filter(where)
        pruned = opened_rows if only is None else only(opened_rows)
        sizes = opened_rows.groupBy("list").agg(F.count("*").alias("n"))  # reads no column
        sizes = settled(sizes.withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS).cast("int")), "index-sizes")  # one row a list, MAX_LISTS at most
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # Slices of lists are dealt to shelves, one a task: as many as keep a shelf small, and as fill the tasks.
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        shelves = max(1, -(-total // SLICE_ROWS), min(width, total // SHELF_ROWS))
        shelf = F.pmod(F.xxhash64("list", "slice"), F.lit(shelves)).cast("int").alias("shelf")
        sliced = pruned.select("list", "id", "code").join(F.broadcast(sizes), "list").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        # Which lists each shelf has a slice of: a pair a slice, MAX_LISTS and one for each SLICE_ROWS rows at most.
        pairs = sizes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(shelf, "list").distinct().collect()
        lists_on: dict[int, list[int]] = {}
        for pair in pairs:
            lists_on.setdefault(pair["shelf"], []).append(pair["list"])
        on_shelf = {number: np.array(sorted(held), np.int32) for number, held in lists_on.items()}

        def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for query, q, opens in zip(pdf["query_id"], pdf["q"], pdf["opens"], strict=True):
                    own = [(number, np.intersect1d(opens, held, assume_unique=True)) for number, held in on_shelf.items()]
                    own = [(number, both) for number, both in own if len(both)]
                    if own:
                        yield pd.DataFrame({"shelf": np.array([number for number, _ in own], np.int32), "query_id": [query] * len(own), "q": [q] * len(own), "lists": [both for _, both in own]})

        lists_of = visits.mapInPandas(dealt, f"shelf int, query_id {query_type}, q array<double>, lists array<int>")
        none = F.lit(None)
        waiting = sliced.select(shelf, F.lit(0).alias("turn"), "list", "id", "code", none.cast(query_type).alias("query_id"), none.cast("array<double>").alias("q"), none.cast("array<int>").alias("lists"))
        coming = lists_of.select("shelf", F.lit(1).alias("turn"), none.cast("int").alias("list"), none.cast(id_type).alias("id"), none.cast("binary").alias("code"), "query_id", "q", "lists")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, lists, ids, codes, ready, out, size = None, [], [], [], False, [], 0
            for batch in batches:
                at, turn = batch.column("shelf").to_numpy(), batch.column("turn").to_numpy()
                edges = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (turn[1:] != turn[:-1])) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    if at[a] != key:
                        key, lists, ids, codes, ready = at[a], [], [], [], False
                    part = batch.slice(a, b - a)
                    if not turn[a]:  # the shelf waits: numbers of lists, ids and codes only
                        lists.append(part.column("list").to_numpy())
                        ids.append(part.column("id"))
                        codes.append(np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(b - a, -1))
                        continue
                    if not ids:
                        continue
                    if not ready:  # once a shelf: sorted by list
                        ready = True
                        flat = np.concatenate(lists)
                        order = np.argsort(flat, kind="stable")
                        lists, ids, codes = [flat[order]], [pa.concat_arrays(ids).take(pa.array(order))], [np.concatenate(codes)[order]]
                    for query, q, own in zip(part.column("query_id"), part.column("q"), part.column("lists"), strict=True):
                        names = own.values.to_numpy()
                        lo, hi = (np.searchsorted(lists[0], names, side) for side in ("left", "right"))
                        rows_ = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
                        near = model.rough(q.values.to_numpy(), lists[0][rows_], codes[0][rows_])
                        best = np.argpartition(-near, refine - 1)[:refine] if len(near) > refine else np.arange(len(near))
                        out.append((query.as_py(), rows_[best], near[best]))
                        size += len(best)
                        if size >= HANDED:
                            yield handed(out, ids[0], lists[0], batch.schema.field("query_id").type)
                            out, size = [], 0
                    if out:  # before another shelf comes
                        yield handed(out, ids[0], lists[0], batch.schema.field("query_id").type)
                        out, size = [], 0

        def handed(out: list, ids: pa.Array, lists: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
            rows_ = np.concatenate([r for _, r, _ in out])
            names = pa.array([q for q, _, _ in out], kind).take(pa.array(np.repeat(np.arange(len(out)), [len(r) for _, r, _ in out])))
            return pa.RecordBatch.from_arrays([names, ids.take(pa.array(rows_)), pa.array(lists[rows_].astype(np.int32)), pa.array(np.concatenate([n for _, _, n in out]))], names=["query_id", "id", "list", "near"])

        met = waiting.unionByName(coming).repartition(shelves, "shelf").sortWithinPartitions("shelf", "turn")
        rough = met.mapInArrow(score, f"query_id {query_type}, id {id_type}, list int, near double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))  # bounded before the shuffle
        few = rough.withColumn("r", rank).filter(F.col("r") <= refine).select("query_id", "id", "list")
        exact = few.join(pruned.select("list", "id", "vector"), ["list", "id"]).join(queries.select("query_id", "query_vector"), "query_id")
        far = exact.select("query_id", F.col("id").alias("hit_id"), corpus.cosine_distance(F.col("vector"), F.col("query_vector")).alias("distance"))
        final = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "hit_id"))
        out = settled(far.withColumn("rank", final).filter(F.col("rank") <= k).select("query_id", "rank", "hit_id", "distance"), "index-found")
        discard(visits, sizes)
        return out

    def nearest(self, embedding: list[float], k: int = 5, probes: int | None = None, refine: int | None = None, where: Column | None = None, segments: list[str] | None = None) -> DataFrame:
        """The ``k`` nearest rows found for one vector: hit_id, distance."""
        one = self.spark.createDataFrame([(0, [float(x) for x in embedding])], "query_id int, query_vector array<double>")
        return self.search(one, k, probes, refine, where, segments).orderBy("rank").select("hit_id", "distance")

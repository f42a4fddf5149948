"""The vector corpus: immutable versions of a collection, replaced by URL, searched exactly or by an index.

A collection is a folder of rows laid out by ``url_bucket``, a hash of the URL,
and of numbered manifests.  A manifest lists the layers of each bucket: folders
with rows, and folders with URLs that are gone from all layers before.  A store
adds a layer of the new rows and one of their URLs, a delete just one of URLs,
so neither reads or writes the rows that were there; readers merge.  A bucket
of many layers is rewritten as one by :meth:`Corpus.compact`, and split in two,
four or more where it has grown too large.  The next manifest is published
under a name that did not exist before.  A reader takes the greatest one, so it
sees the old version or the new one, never a half of either and never none.  A
lookup by URL reads one bucket.

A collection may have an index (:mod:`.vector_index`): each folder of rows is a
segment of it, made before the manifest names the folder, so index and rows
always agree, in old versions too.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import iso_utc, provenance
from ..schemas import CORPUS
from ..session import discard, settled
from .versions import Versions

BUCKETS = 32
#: Rows of a bucket above which a rewrite splits it, and layers of one above which a write asks for a rewrite.
BUCKET_ROWS = 1_000_000
LAYERS = 24
#: Rows that one task writes, about; large buckets are written by several.
TASK_ROWS = 100_000
#: New URLs up to which the side of a replace is broadcast; counted first.
BROADCAST_URLS = 100_000
#: Vectors of a block and queries of a block.
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 1_024


def url_bucket(url: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


# ------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null, all zero or of another length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), 1 - dot(a, b) / size)


def query(collection: DataFrame, embedding: list[float], k: int = 5, where: Column | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by cosine distance, ties to the smaller id; ``where`` filters first."""
    rows = collection if where is None else collection.filter(where)
    given = F.lit([float(v) for v in embedding])
    return rows.withColumn("distance", cosine_distance(F.col(vector_col), given)).filter("distance is not null").orderBy("distance", id_col).limit(k)


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, v) dealt into blocks of about ``size`` a vector length (width, ``name``, ids, flat), and the blocks of each length."""
    v = F.col("v").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull()) & F.exists(v, lambda x: x != 0)
    rows = rows.select("id", v.alias("v"), F.size("v").alias("width")).filter(fine)
    sizes = rows.groupBy("width").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "width").withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("blocks")).cast("int"))
    held = dealt.groupBy("width", name).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return held.select("width", name, F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("flat")), sizes


def _ordered_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the rows from left to right, so that equal vectors have equal distances wherever they lie."""
    return np.cumsum(x, axis=1)[:, -1]


def query_many(collection: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "chunk_id", vector_col: str = "embedding", max_queries: int | None = None) -> DataFrame:
    """The ``k`` nearest rows for each query (query_id, query_vector) among the vectors of its length: query_id, rank, hit_id, distance.

    Blocks of queries visit every block of the collection, and a visit sends
    back ``k`` rows a query.  Any number of queries is searched; a caller that
    wants a bound names it as ``max_queries``, and more are an error.  Vectors
    that are null, all zero or hold nulls take no part, nor do pairs without a
    distance.
    """
    if max_queries is not None and queries.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"more than {max_queries} queries; search them in parts")
    id_type = collection.schema[id_col].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    data, sizes = _blocks(collection.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), BLOCK_ROWS, "block")
    asked, _ = _blocks(queries.select(F.col("query_id").alias("id"), F.col("query_vector").alias("v")), BLOCK_QUERIES, "qblock")
    # Each block waits in its task, once; the blocks of queries come by.
    waiting = data.select("width", "block", F.lit(0).alias("turn"), "ids", F.lit(None).cast(f"array<{query_type}>").alias("qids"), "flat")
    coming = asked.join(F.broadcast(sizes), "width").select("width", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("turn"), F.lit(None).cast(f"array<{id_type}>").alias("ids"), F.col("ids").alias("qids"), "flat")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, v, size = None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in ("width", "block", "turn", "ids", "qids", "flat")}
                width, at = row["width"].as_py(), (row["width"].as_py(), row["block"].as_py())
                given = row["flat"].values.to_numpy().reshape(-1, width)
                if not row["turn"].as_py():
                    key, ids, v, size = at, row["ids"].values, given, np.sqrt(_ordered_sum(given * given))
                elif key == at:
                    yield nearest(ids, v, size, row["qids"].values, given)

    def nearest(ids: pa.Array, v: np.ndarray, size: np.ndarray, qids: pa.Array, q: np.ndarray) -> pa.RecordBatch:
        qsize, hits = np.sqrt(_ordered_sum(q * q)), []
        names = ids.to_pylist()
        with np.errstate(all="ignore"):
            rough = 1 - (q / qsize[:, None]) @ (v / size[:, None]).T
        for j, own in enumerate(rough):
            own = np.where(np.isnan(own), np.inf, own)
            near = np.flatnonzero(own <= np.partition(own, k - 1)[k - 1] + 1e-9 if len(own) > k else own < np.inf)
            exact = 1 - _ordered_sum(v[near] * q[j]) / (size[near] * qsize[j])
            hits += [(j, i, d) for d, _, i in sorted((float(d), names[i], i) for d, i in zip(exact, near.tolist(), strict=True) if np.isfinite(d))[:k]]
        of, at, far = (list(x) for x in zip(*hits, strict=True)) if hits else ([], [], [])
        return pa.RecordBatch.from_arrays([qids.take(pa.array(of, pa.int64())), ids.take(pa.array(at, pa.int64())), pa.array(far, pa.float64())], names=["query_id", "hit_id", "distance"])

    met = waiting.unionAll(coming).repartition("width", "block").sortWithinPartitions("width", "block", "turn")
    best = met.mapInArrow(visit, f"query_id {query_type}, hit_id {id_type}, distance double")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "hit_id"))
    return best.withColumn("rank", final).filter(F.col("rank") <= k).select("query_id", "rank", "hit_id", "distance")


def get(collection: DataFrame, where: Column | None) -> DataFrame:
    """All matching rows, uncapped; asking for everything is an error."""
    if where is None:
        raise ValueError("get needs a condition")
    return collection.filter(where)


def count(collection: DataFrame, where: Column | None = None) -> int:
    return (collection if where is None else collection.filter(where)).count()


def counts_by_url(collection: DataFrame) -> DataFrame:
    return collection.groupBy("source_url").agg(F.count("*").alias("chunks"))


# ---------------------------------------------------------- replace, delete


def replace_by_url(collection: DataFrame, new: DataFrame, url_col: str = "source_url") -> DataFrame:
    """Old rows of other URLs, and all new rows: one chunk set for each URL."""
    urls = new.select(url_col).distinct()
    side = F.broadcast(urls) if urls.limit(BROADCAST_URLS + 1).count() <= BROADCAST_URLS else urls
    return collection.join(side, url_col, "left_anti").unionByName(new.select(*collection.columns))


def delete_urls(collection: DataFrame, urls: list[str], url_col: str = "source_url") -> DataFrame:
    return collection.filter(~F.coalesce(F.col(url_col).isin(urls), F.lit(False)))


def with_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with their vectors by chunk id; a chunk without exactly one vector is an error when the rows are read."""
    counted = embeddings.groupBy("chunk_id").agg(F.first("embedding").alias("embedding"), F.count("*").alias("_n"))
    joined = chunks.join(counted, "chunk_id", "left")
    fine = F.coalesce(F.col("_n") == 1, F.lit(False))
    return joined.filter(F.coalesce(F.assert_true(fine, F.lit("chunk and embedding counts differ")).isNull(), F.lit(True))).drop("_n")


def row_provenance(stamp: str = "scrape_timestamp") -> Column:
    """Provenance map of a chunk row."""
    return provenance(F.col("source_url"), iso_utc(F.col(stamp)), F.col("page_title"), F.col("section_heading"))


# ------------------------------------------------------------- versions


class Layer(NamedTuple):
    """A folder of rows, or of URLs that are gone from all layers before, and how many it has in this bucket."""

    folder: str
    rows: int
    gone: bool = False


class Manifest(dict):
    """Layers, in order, by bucket (``number.modulus``); ``index`` names the folder of the index, if there is one."""

    def __init__(self, buckets: dict[str, list[Layer]], index: str | None = None):
        super().__init__(buckets)
        self.index = index

    def dumped(self) -> dict:
        return {"buckets": self, "index": self.index}

    @classmethod
    def loaded(cls, held: dict) -> Manifest:
        return cls({b: [Layer(*x) for x in layers] for b, layers in held["buckets"].items()}, held["index"])


class Corpus(Versions):
    """A collection under ``path``, written by one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = BUCKETS):
        super().__init__(spark, f"{path.rstrip('/')}/{name}", name)
        self.buckets = buckets

    def manifest(self, version: int) -> Manifest:
        """Layers of each bucket that has rows, or had."""
        return Manifest.loaded(self._read_version(version))

    def _held(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        return Manifest({}) if version is None else self.manifest(version)

    # -------------------------------------------------------------- buckets

    def _keys(self, manifest: Manifest) -> dict[int, set[int]]:
        """Numbers of the buckets by modulus; what was never written has the first modulus."""
        found: dict[int, set[int]] = {self.buckets: set(range(self.buckets))}
        for key in manifest:
            number, modulus = map(int, key.split("."))
            found.setdefault(modulus, set()).add(number)
            while modulus > self.buckets:  # its parents are split
                modulus //= 2
                found.setdefault(modulus, set()).discard(number % modulus)
        return found

    def _bucket(self, manifest: Manifest, url: Column) -> Column:
        """The bucket of a URL: at each modulus those numbers that are not split."""
        out, keys = F.lit(None).cast("string"), self._keys(manifest)
        for modulus in sorted(keys, reverse=True):
            if keys[modulus]:
                number = url_bucket(url, modulus)
                hit = F.lit(True) if len(keys[modulus]) == modulus else number.isin(sorted(keys[modulus]))
                out = F.when(hit, F.concat(number.cast("string"), F.lit(f".{modulus}"))).otherwise(out)
        return out

    def _rows(self, manifest: Manifest) -> DataFrame:
        """Live rows of the buckets of ``manifest``, with ``url_bucket`` and ``v`` (number and mark of the folder)."""
        fields = self.spark.createDataFrame([], CORPUS).schema.add("url_bucket", "string").add("v", "string")
        paths = [f"{self.root}/{x.folder}/url_bucket={b}" for b, layers in sorted(manifest.items()) for x in layers if not x.gone]
        if not paths:
            return self.spark.createDataFrame([], fields)
        return self._alive(self.spark.read.schema(fields).option("basePath", self.root).parquet(*paths), manifest)

    def _alive(self, rows: DataFrame, manifest: Manifest) -> DataFrame:
        """``rows`` without those whose URL a later layer of their bucket calls gone."""
        layers = [(b, x) for b, layers in sorted(manifest.items()) for x in layers if x.gone]
        if not layers:
            return rows
        gone = self.spark.read.schema("source_url string, url_bucket string, v string").option("basePath", f"{self.root}/gone").parquet(*(f"{self.root}/{x.folder}/url_bucket={b}" for b, x in layers))
        number = F.split("v", "-")[0].cast("long")
        last = gone.groupBy(F.col("source_url").alias("_url")).agg(F.max(number).alias("_gone"))
        last = F.broadcast(last) if sum(x.rows for _, x in layers) <= BROADCAST_URLS else last  # the manifest counts them
        return rows.join(last, (F.col("source_url") == F.col("_url")) & (number < F.col("_gone")), "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, the newest by default; none yet: no rows."""
        return self._rows(self._held(version)).drop("v")

    def at_url(self, url: str, version: int | None = None) -> DataFrame:
        """Rows of one URL; only its bucket is read."""
        held = self._held(version)
        bucket = self.spark.range(1).select(self._bucket(held, F.lit(url))).first()[0]
        return self._rows(Manifest({b: layers for b, layers in held.items() if b == bucket})).drop("v").filter(F.col("source_url") == url)

    # --------------------------------------------------------------- writing

    def _written(self, rows: DataFrame, folder: str, size: int) -> dict[str, int]:
        """Write ``rows`` (with ``url_bucket``), about ``size``, to ``folder`` by bucket; returns the rows of each."""
        counts = {r["url_bucket"]: r["n"] for r in rows.groupBy("url_bucket").agg(F.count("*").alias("n")).collect()}  # the manifest lists them anyway
        if counts:
            each = -(-size // (TASK_ROWS * len(counts)))  # tasks a bucket
            salted = rows.withColumn("_salt", F.pmod(F.xxhash64("source_url", F.lit("salt")), F.lit(max(1, each))))
            salted.repartition(max(1, each * len(counts)), "url_bucket", "_salt").drop("_salt").write.partitionBy("url_bucket").parquet(f"{self.root}/{folder}")
        return counts

    def _layered(self, held: Manifest, new: DataFrame | None, gone: DataFrame, number: int) -> Manifest:
        """``held`` with a layer of the URLs ``gone`` in buckets that have older rows, and one of the rows ``new`` (settled, with ``url_bucket``)."""
        mark = f"v={number}-{uuid.uuid4().hex}"
        layers: dict[str, list[Layer]] = {b: list(own) for b, own in held.items()}
        urls = settled(gone.select("source_url").distinct().withColumn("url_bucket", self._bucket(held, F.col("source_url"))).filter(F.col("url_bucket").isin(sorted(held))), "gone")
        for b, n in self._written(urls, f"gone/{mark}", urls.count()).items():
            layers[b].append(Layer(f"gone/{mark}", n, True))
        discard(urls)
        if new is not None:
            for b, n in self._written(new, mark, new.count()).items():
                layers.setdefault(b, []).append(Layer(mark, n))
            if held.index:
                self._indexed(held.index, mark, [b for b, own in layers.items() if Layer(mark, own[-1].rows) == own[-1]])
        return Manifest(layers, held.index)

    def store(self, chunks: DataFrame) -> int:
        """Replace all chunks of the URLs in ``chunks``, which is evaluated once; returns how many were stored. None is an error."""
        columns = [f.name for f in self.spark.createDataFrame([], CORPUS).schema]
        version = self.version()
        held = Manifest({}) if version is None else self.manifest(version)
        new = settled(chunks.select(*columns).withColumn("url_bucket", self._bucket(held, F.col("source_url"))), "stored")
        stored, bare = new.agg(F.count("*"), F.count(F.when(F.col("embedding").isNull(), 1))).first()
        if not stored:
            raise ValueError("no chunks to store")
        if bare:
            raise ValueError("chunk and embedding counts differ")
        number = (version or 0) + 1
        after = self._layered(held, new, new, number)
        discard(new)
        self._publish(number, after.dumped())
        self._tidied(after)
        return stored

    def delete(self, urls: list[str]) -> int:
        """Delete by URL; returns the deleted rows.  What is written grows with the URLs, not with the rows."""
        version = self.version()
        held = self._held(version)
        given = self.spark.createDataFrame([(u,) for u in urls], "source_url string")
        touched = {r[0] for r in given.select(self._bucket(held, F.col("source_url"))).distinct().collect()}
        there = self._rows(Manifest({b: x for b, x in held.items() if b in touched})).filter(F.col("source_url").isin(urls)).groupBy("source_url").agg(F.count("*").alias("n")).collect()  # URLs that were given
        if there:
            found = self.spark.createDataFrame([(r["source_url"],) for r in there], "source_url string")
            after = self._layered(held, None, found, version + 1)
            self._publish(version + 1, after.dumped())
            self._tidied(after)
        return sum(r["n"] for r in there)

    def _tidied(self, after: Manifest) -> None:
        """Rewrite what has gathered too many layers."""
        if any(len(own) > LAYERS for own in after.values()):
            self.compact(LAYERS)

    def compact(self, layers: int = 1) -> int | None:
        """Rewrite the buckets of more than ``layers`` layers, or of too many rows, as one layer each; the new version, if there is one.

        A bucket of more than ``BUCKET_ROWS`` live rows is split by as many bits of the hash as it takes.
        """
        version = self.version()
        if version is None:
            return None
        held = self.manifest(version)
        chosen = {b: x for b, x in held.items() if len(x) > layers or sum(y.rows for y in x if not y.gone) > BUCKET_ROWS}
        if not chosen:
            return None
        live = self._rows(Manifest(chosen)).drop("v")  # of folders that never change, so counting reads URLs only, and the rows are written once
        counts = {r["url_bucket"]: r["n"] for r in live.groupBy("url_bucket").agg(F.count("*").alias("n")).collect()}
        many, splits = {b: n for b, n in counts.items() if n > BUCKET_ROWS}, {}
        if many:  # one URL is never split, so count what the halves would be no further than the URLs allow
            urls = live.filter(F.col("url_bucket").isin(list(many))).groupBy("url_bucket").agg(F.approx_count_distinct("source_url").alias("u")).collect()
            splits = {r["url_bucket"]: 1 << min(math.ceil(math.log2(many[r["url_bucket"]] / BUCKET_ROWS)), max(0, int(r["u"]).bit_length() - 1)) for r in urls}
        if all(len(x) == 1 and splits.get(b, 1) == 1 for b, x in chosen.items()):
            return None
        place = F.col("url_bucket")
        for times in sorted({t for t in splits.values() if t > 1}):
            for b in sorted(b for b, t in splits.items() if t == times):
                modulus = int(b.split(".")[1]) * times
                place = F.when(F.col("url_bucket") == b, F.concat(url_bucket(F.col("source_url"), modulus).cast("string"), F.lit(f".{modulus}"))).otherwise(place)
        mark = f"v={version + 1}-{uuid.uuid4().hex}"
        written = self._written(live.withColumn("url_bucket", place), mark, sum(counts.values()))
        after = Manifest({b: x for b, x in held.items() if b not in chosen} | {b: [Layer(mark, n)] for b, n in written.items()}, held.index)
        if held.index:
            self._indexed(held.index, mark, list(written))
        return self._publish(version + 1, after.dumped())

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions and the folders that only those used; returns how many folders went."""
        kept = [self.manifest(v) for v in self._forget(keep)]
        used = {x.folder for m in kept for own in m.values() for x in own} | {m.index for m in kept}
        return self._sweep([n for n in self._names() if n.startswith(("v=", "index-"))] + [f"gone/{n}" for n in self._names("gone")], used)

    # --------------------------------------------------------------- the index

    def _index(self, name: str):
        from .vector_index import VectorIndex

        return VectorIndex(self.spark, f"{self.root}/{name}")

    def _indexed(self, name: str, folder: str, buckets: list[str]) -> None:
        """Code the rows of a folder as a segment of the index."""
        rows = self._rows(Manifest({b: [Layer(folder, 0)] for b in buckets}))
        self._index(name).add(rows, folder.partition("=")[2], "chunk_id", "embedding", ("source_url", "url_bucket"))

    def build_index(self, lists: int | None = None, recall: float = 0.95, k: int = 5) -> int:
        """Train an index on the newest version and code its rows; stores and deletes keep it from then on.  Returns the new version."""
        from .vector_index import VectorIndex

        version = self.version()
        held = self._held(version)
        name = f"index-{uuid.uuid4().hex}"
        VectorIndex.create(self._rows(held), f"{self.root}/{name}", "chunk_id", "embedding", lists, recall, k)
        folders: dict[str, list[str]] = {}
        for b, own in held.items():
            for x in own:
                if not x.gone:
                    folders.setdefault(x.folder, []).append(b)
        for folder, buckets in folders.items():
            self._indexed(name, folder, buckets)
        return self._publish(version + 1, Manifest(held, name).dumped())

    def search(self, queries: DataFrame, k: int = 5, version: int | None = None, **options) -> DataFrame:
        """The ``k`` nearest chunks for each query (query_id, query_vector): query_id, rank, hit_id, distance.

        With an index its lists are searched (``probes``, ``refine``), else all rows are.
        """
        held = self._held(version)
        if not held.index:
            return query_many(self._rows(held), queries, k)
        live = sorted({(x.folder.partition("=")[2], b) for b, own in held.items() for x in own if not x.gone})
        pairs = F.broadcast(self.spark.createDataFrame(live, "segment string, url_bucket string"))  # as many as the manifest lists

        def alive(rows: DataFrame) -> DataFrame:
            return self._alive(rows.join(pairs, ["segment", "url_bucket"], "left_semi").withColumn("v", F.col("segment")), held)

        return self._index(held.index).search(queries, k, segments=sorted({s for s, _ in live}), only=alive, **options)

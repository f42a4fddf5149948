"""The vector index: recall, pruning, exactness, and how it follows a corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import corpus, vector_index
from gleaner.schemas import CORPUS

from .test_corpus import chunk_row


def cloud(n, width=12, seed=1):
    """Vectors around some centres."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, width))
    return centres[rng.integers(0, 20, n)] + 0.4 * rng.standard_normal((n, width))


@pytest.fixture(scope="module")
def table(spark):
    made = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(cloud(1500))]
    odd = [(5000, None, 0), (5001, [0.0] * 12, 0), (5002, [1.0] * 5, 0), (5003, [float("nan")] * 12, 1), (5004, [1.0, None] + [0.0] * 10, 1), (5005, made[7][1], 1)]
    return spark.createDataFrame(made + odd, "vec_id long, embedding array<double>, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    made = vector_index.VectorIndex.create(table, str(tmp_path_factory.mktemp("index")), "vec_id", "embedding", lists=40)
    made.add(table.filter("vec_id < 900"), "first", "vec_id", "embedding", ("label",))
    made.add(table.filter("vec_id >= 900"), "second", "vec_id", "embedding", ("label",))
    return vector_index.VectorIndex(spark, made.path)  # read back


def asked(table):
    return table.filter("vec_id % 25 = 0 or vec_id > 4999").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def found(df):
    return {(r["query_id"], r["rank"]): (r["hit_id"], round(r["distance"], 9)) for r in df.collect()}


def test_recall(table, index):
    want = {(q, h) for (q, _), (h, _) in found(corpus.query_many(table, asked(table).filter("query_id < 5000"), 5, "vec_id")).items()}
    got = {(q, h) for (q, _), (h, _) in found(index.search(asked(table).filter("query_id < 5000"), 5)).items()}
    assert len(got & want) >= 0.9 * len(want) and 1 <= index.model().probes < 40


def test_all_lists_and_rows_are_exact(table, index):
    got = found(index.search(asked(table), 5, probes=40, refine=10_000))
    want = found(corpus.query_many(table.filter(F.size("embedding") == 12), asked(table), 5, "vec_id"))
    assert {k: v for k, v in want.items() if k[0] not in (5002, 5003)} == got


def test_filters_segments_and_lists_are_pruned(table, index):
    v = [float(x) for x in cloud(1, seed=3)[0]]
    exact = [r["vec_id"] for r in corpus.query(table, v, 4, F.col("label") == 1, "vec_id").collect()]
    assert [r["hit_id"] for r in index.nearest(v, 4, 40, 10_000, F.col("label") == 1).collect()] == exact
    assert {r["hit_id"] < 900 for r in index.nearest(v, 9, segments=["first"]).collect()} == {True}
    assert index.nearest([1.0, 2.0], 3).count() == 0 and index.nearest([0.0] * 12, 3).count() == 0
    plan = index.rows().filter(F.col("list").isin([1, 2])).select("id", "code")._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list#", "list#") or "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "vector" not in plan.split("ReadSchema")[1]


def test_a_hot_list_is_searched_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 50)
    rows = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0, -1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    made = vector_index.VectorIndex.create(rows, str(tmp_path), "vec_id", "embedding", lists=8)
    made.add(rows, "all", "vec_id", "embedding")
    assert [r["hit_id"] for r in made.nearest([1.0, 2.0, 3.0], 6, refine=500).collect()] == list(range(6))  # ties to the smaller id
    with pytest.raises(ValueError):
        vector_index.VectorIndex.create(rows.limit(0), str(tmp_path / "none"), "vec_id", "embedding")


def test_the_index_follows_a_corpus(spark, tmp_path):
    vectors = cloud(240, 6, 5)
    rows = spark.createDataFrame([chunk_row(f"https://{i // 4}/", i % 4, v) for i, v in enumerate(vectors)], CORPUS)
    c = corpus.Corpus(spark, str(tmp_path), "corpus_x_6", buckets=4)
    c.store(rows)
    q = spark.createDataFrame([(k, [float(x) for x in vectors[k]]) for k in (0, 50, 101)], "query_id int, query_vector array<double>")
    assert found(c.search(q, 4)) == found(corpus.query_many(c.read(), q, 4))  # no index yet
    assert c.build_index(lists=10) == 2

    def same(version=None):
        got = found(c.search(q, 4, version, probes=10, refine=10_000))
        assert got == found(corpus.query_many(c.read(version), q, 4))
        return {h for h, _ in got.values()}

    assert "https://0/0" in same()
    c.store(spark.createDataFrame([chunk_row("https://0/", 9, vectors[0]), chunk_row("https://new/", 1, vectors[50])], CORPUS))
    hits = same()
    assert "https://0/9" in hits and "https://0/0" not in hits and "https://new/1" in hits
    c.delete(["https://new/", "https://25/"])
    assert not {"https://new/1"} & same() and "https://new/1" in same(3) and "https://0/0" in same(2)
    assert c.compact() == 5 and not {"https://new/1"} & same()
    assert c.vacuum() > 0 and same()


def test_a_query_waits_once_however_many_lists_it_opens(table, index, monkeypatch):
    sizes, settled = {}, vector_index.settled

    def counting(df, name, *args):
        out = settled(df, name, *args)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(vector_index, "settled", counting)
    queries = asked(table).filter("query_id < 5000")
    index.search(queries, 5, probes=40)
    assert sizes["index-visits"] == queries.count()

"""Embedding, the corpus, live queries and answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.config import CorpusSettings
from gleaner.operators import cascade, corpus, embed, events, frontier, live
from gleaner.schemas import CORPUS, EVENTS, FRONTIER

T = dt.datetime(2026, 1, 1)


def chunk_row(url, i, vector, heading="H", content=None):
    return (f"{url}{i}", url, T, "Title", "html", 0.9, heading, 2, i, 3, content or f"text {i} of {url}", False, None, T, [float(v) for v in vector])


def rows(spark, url="https://a/", n=3, seed=0.0):
    return spark.createDataFrame([chunk_row(url, i, [seed + i, 1, 0, 0]) for i in range(1, n + 1)], CORPUS)


def test_replace_not_duplicate(spark, tmp_path):
    c = corpus.Corpus(spark, str(tmp_path), "corpus_x_4", buckets=4)
    assert c.read().count() == 0 and c.version() is None
    assert c.store(rows(spark)) == 3
    assert c.store(rows(spark, "https://b/", 2)) == 2
    assert c.store(rows(spark, n=2)) == 2
    assert {(r["source_url"], r["chunks"]) for r in corpus.counts_by_url(c.read()).collect()} == {("https://a/", 2), ("https://b/", 2)}
    assert c.version() == 3 and c.read(1).count() == 3
    assert c.at_url("https://b/").count() == 2
    assert c.delete(["https://a/"]) == 2 and c.delete(["https://none/"]) == 0
    assert corpus.count(c.read()) == 2


def test_a_reader_always_finds_a_whole_version(spark, tmp_path):
    c = corpus.Corpus(spark, str(tmp_path), "corpus_x_4", buckets=8)
    c.store(rows(spark))
    before = c.read()
    seen = []

    class Watched(corpus.Corpus):
        def manifest(self, version):  # called between the new folder and the new manifest
            seen.append(c.read().count())
            return super().manifest(version)

    w = Watched(spark, str(tmp_path), "corpus_x_4", buckets=8)
    w.store(rows(spark, "https://b/", 2))
    assert set(seen) == {3} and before.count() == 3 and c.read().count() == 5 and c.versions() == [1, 2]
    kept = {b: f for b, f in c.manifest(1).items()}
    moved = {b: f for b, f in c.manifest(2).items() if kept.get(b) != f}
    assert len(moved) == 1  # one bucket was touched, the others are the same folders
    assert [len(r["embedding"]) for r in c.at_url("https://b/").collect()] == [4, 4] and c.at_url("https://none/").count() == 0
    with pytest.raises(RuntimeError, match="another writer"):
        stale = corpus.Corpus(spark, str(tmp_path), "corpus_x_4", buckets=8)
        stale.version = lambda: 1
        stale.store(rows(spark, "https://c/", 1))
    assert c.read().count() == 5


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_ROWS", 20)
    c = corpus.Corpus(spark, str(tmp_path), "corpus_x_4", buckets=1)
    many = spark.createDataFrame([chunk_row(f"https://{i}/", 1, [i, 1, 0, 0]) for i in range(200)], CORPUS)
    assert c.store(many) == 200 and c.read().count() == 200 and len(c.read().inputFiles()) > 3


def bytes_under(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


def test_a_delete_writes_urls_and_no_rows(spark, tmp_path):
    c = corpus.Corpus(spark, str(tmp_path), "corpus_x_4", buckets=4)
    text = "long words of a chunk " * 200
    c.store(spark.createDataFrame([chunk_row(f"https://{i}/", j, [i, j, 0, 1], content=f"{text}{i}{j}") for i in range(60) for j in range(3)], CORPUS).repartition(3))
    before, size = c.read(), bytes_under(tmp_path)
    assert c.delete(["https://7/", "https://none/"]) == 3
    assert bytes_under(tmp_path) - size < 8192 < size
    assert before.count() == 180 and c.read(1).count() == 180 and c.read().count() == 177 and c.at_url("https://7/").count() == 0 and c.at_url("https://7/", 1).count() == 3
    assert c.delete(["https://7/"]) == 0 and c.version() == 2
    c.store(spark.createDataFrame([chunk_row("https://7/", 1, [1, 1, 1, 1])], CORPUS))  # a URL that was gone comes back
    assert c.at_url("https://7/").count() == 1 and c.read().count() == 178 and c.read(2).count() == 177


def test_rewrites_keep_the_rows_and_split_large_buckets(spark, tmp_path, monkeypatch):
    c = corpus.Corpus(spark, str(tmp_path), "corpus_x_4", buckets=2)
    for k in range(3):
        c.store(spark.createDataFrame([chunk_row(f"https://{i}/", j, [i, j, k, 1]) for i in range(k, 30) for j in range(2)], CORPUS))
    c.delete(["https://29/"])
    want = sorted(map(str, c.read().drop("url_bucket").collect()))
    assert len(want) == 58 and max(map(len, c.manifest(4).values())) >= 5
    monkeypatch.setattr(corpus, "BUCKET_ROWS", 10)
    assert c.compact() == 5
    held = c.manifest(5)
    assert len(held) > 4 and all(len(x) == 1 and x[0].rows <= 20 for x in held.values()) and sum(x[0].rows for x in held.values()) == 58
    assert sorted(map(str, c.read().drop("url_bucket").collect())) == want == sorted(map(str, c.read(4).drop("url_bucket").collect()))
    assert all(c.at_url(f"https://{i}/").count() == 2 for i in (0, 13, 28))
    c.store(spark.createDataFrame([chunk_row("https://13/", 9, [1, 1, 1, 1])], CORPUS))  # into a split bucket
    assert c.at_url("https://13/").count() == 1 and c.read().count() == 57 and c.delete(["https://28/"]) == 2
    assert c.vacuum() > 0 and c.versions() == [7] and c.read().count() == 55


def test_many_layers_ask_for_a_rewrite(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "LAYERS", 2)
    c = corpus.Corpus(spark, str(tmp_path), "corpus_x_4", buckets=1)
    c.store(rows(spark))
    c.store(rows(spark, n=2))
    assert c.versions() == [1, 2, 3] and [len(x) for x in c.manifest(3).values()] == [1] and c.read().count() == 2


def test_store_evaluates_its_chunks_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    c = corpus.Corpus(spark, str(tmp_path), "corpus_x_4", buckets=4)
    c.store(rows(spark))
    c.store(rows(spark, "https://b/", 7).withColumn("confidence", counted.asNondeterministic()("confidence")))
    assert seen.value == 7 and c.read().count() == 10


def test_store_refuses_nothing_and_missing_vectors(spark, tmp_path):
    c = corpus.Corpus(spark, str(tmp_path), "corpus_x_4")
    with pytest.raises(ValueError):
        c.store(rows(spark).limit(0))
    with pytest.raises(ValueError):
        c.store(rows(spark).withColumn("embedding", F.lit(None).cast("array<float>")))


def test_query_ties_and_filters(spark):
    df = spark.createDataFrame([chunk_row("https://a/", i, v) for i, v in enumerate(([1, 0, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0]))], CORPUS)
    got = [(r["chunk_id"], round(r["distance"], 6)) for r in corpus.query(df, [2, 0, 0, 0], 3).collect()]
    assert got == [("https://a/0", 0.0), ("https://a/1", 0.0), ("https://a/2", 1.0)]
    assert corpus.query(df, [2, 0, 0, 0], 3, F.col("chunk_index") > 1).count() == 1
    assert corpus.query(df.limit(0), [1, 0, 0, 0]).count() == 0
    with pytest.raises(ValueError):
        corpus.get(df, None)
    assert corpus.get(df, F.col("source_url") == "https://a/").count() == 4


def test_query_many_is_query(spark):
    df = spark.createDataFrame([chunk_row("https://a/", i, [i % 7, i % 5, i % 3, 1]) for i in range(60)], CORPUS)
    qs = spark.createDataFrame([(1, [1.0, 2.0, 0.5, 1.0]), (2, [3.0, 0.0, 1.0, 1.0]), (3, None)], "query_id long, query_vector array<double>")
    many = corpus.query_many(df, qs, 4)
    for q in qs.filter("query_id < 3").collect():
        one = [r["chunk_id"] for r in corpus.query(df, list(q["query_vector"]), 4).collect()]
        assert [r["hit_id"] for r in many.filter(F.col("query_id") == q["query_id"]).orderBy("rank").collect()] == one
    assert many.filter("query_id = 3").count() == 0
    with pytest.raises(ValueError):
        corpus.query_many(df, qs, 4, max_queries=2)


def test_query_many_takes_any_number_and_length(spark, monkeypatch):
    many = spark.range(10_050).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("query_vector"))
    df = spark.createDataFrame([chunk_row("https://a/", i, [1, i]) for i in range(5)] + [chunk_row("https://b/", i, [1, i, i]) for i in range(5)], CORPUS)
    got = corpus.query_many(df, many, 2)
    assert got.count() == 20_100 and got.select("query_id").distinct().count() == 10_050
    monkeypatch.setattr(corpus, "BLOCK_ROWS", 2)
    monkeypatch.setattr(corpus, "BLOCK_QUERIES", 3)
    mixed = many.limit(7).unionByName(spark.createDataFrame([(100, [1.0, 2.0, 2.0]), (101, [1.0])], "query_id long, query_vector array<double>"))
    got = corpus.query_many(df, mixed, 3).collect()
    for q in mixed.collect():
        one = [(r["chunk_id"], r["distance"]) for r in corpus.query(df, list(q["query_vector"]), 3).collect()]
        assert [(r["hit_id"], r["distance"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q["query_id"]] == one


def test_vectors_join_one_to_one(spark):
    chunks = rows(spark).drop("embedding")
    vectors = spark.createDataFrame([(f"https://a/{i}", [1.0]) for i in (1, 2, 3)], "chunk_id string, embedding array<float>")
    assert corpus.with_embeddings(chunks, vectors).count() == 3
    with pytest.raises(Exception, match="counts differ"):
        corpus.with_embeddings(chunks, vectors.limit(2)).collect()


def test_embedders(spark):
    e = embed.HashingEmbedder()
    assert e.embed([]) == [] and len(e.embed(["a b", ""])[0]) == 64
    got = spark.createDataFrame([("a b",), ("c",)], "t string").select(embed.embed(F.col("t"), e, 1).alias("v")).collect()
    assert [list(r["v"]) for r in got] == e.embed(["a b", "c"])
    assert embed.collection_of(e) == "corpus_hashing_64"


def test_embedder_fallback():
    seen = []

    def factory(name):
        if name == "hashing":
            raise OSError("no file")
        return embed.make(name)

    assert embed.load_embedder(CorpusSettings(), factory, lambda *a: seen.append(a)).model_name == "hashing-small" and seen == [("hashing", "hashing-small")]
    with pytest.raises(RuntimeError):
        embed.load_embedder(CorpusSettings(auto_fallback_on_load_failure=False), factory)
    with pytest.raises(RuntimeError, match="both"):
        embed.load_embedder(CorpusSettings(model="x", fallback_model="y"))


# ------------------------------------------------------------------ live queries


def test_live_hits_and_misses(spark):
    have = rows(spark)
    asked = spark.createDataFrame([(1, "https://a/", None), (2, "https://a/", [3.0, 1.0, 0.0, 0.0]), (3, "https://new/", None), (4, "https://bad/", None)], "request_id long, url string, query_vector array<double>")

    def single(urls):
        from gleaner.schemas import SECTION

        status = F.when(F.col("url") == "https://new/", "stored").otherwise("blocked")
        sections = F.when(F.col("url") == "https://new/", F.array(F.struct(F.lit("S").alias("heading"), F.lit("body").alias("content"), F.lit(1).alias("level")))).cast(f"array<{SECTION}>")
        return urls.select("url", status.alias("status"), F.lit("why").alias("reason"), F.col("url").alias("source_url"), F.lit(T).alias("scrape_timestamp"), F.lit("P").alias("page_title"), sections.alias("sections"))

    got = {r["request_id"]: r for r in live.live_query(asked, have, single, k=2).collect()}
    assert got[1]["status"] == "ok" and len(got[1]["evidence"]) == 3 and got[1]["event_outcome"] == "corpus_hit"
    assert [e["text"] for e in got[2]["evidence"]] == ["text 3 of https://a/", "text 2 of https://a/"]
    assert got[3]["status"] == "single_shot_ok" and got[3]["evidence"][0]["provenance"]["section_heading"] == "S" and got[3]["provenance"]["page_title"] == "P"
    assert (got[4]["status"], got[4]["reason"], got[4]["event_outcome"], got[4]["evidence"]) == ("blocked", "why", "corpus_miss_single_shot_blocked", [])


def test_a_corpus_that_cannot_be_read_is_an_error_result(spark, tmp_path):
    asked = spark.createDataFrame([(1, "https://a/", None)], "request_id long, url string, query_vector array<double>")

    def never(urls):
        raise AssertionError("no scrape without a corpus")

    got = live.live_query(asked, lambda: spark.read.parquet(str(tmp_path / "none")), never)
    r = got.first()
    assert (r["status"], r["source_used"], r["found_in_corpus"], r["event_outcome"], r["evidence"]) == ("error", "error", False, "corpus_error", []) and r["reason"]
    e = live.live_events(got, F.lit(T)).first()
    assert (e["event_type"], e["outcome"], e["url"]) == ("live_query", "corpus_error", "https://a/") and '"error"' in e["details_json"]


def test_answers_ask_once(spark, tmp_path):
    path = str(tmp_path / "asked")

    def model(question, evidence):
        with open(path, "a") as f:
            f.write(question + "\n")
        return "**Answer**\nmaybe"

    df = spark.createDataFrame([(f"q{i}", [("proof", {"source_url": "u"})]) for i in range(5)], "query string, evidence array<struct<text: string, provenance: map<string, string>>>")
    out = live.answers(df, model)
    out.collect(), out.count(), out.filter("answer_outcome = 'fallback_rescue'").collect()
    assert sorted(open(path).read().split()) == [f"q{i}" for i in range(5)]


def test_answers(spark):
    df = spark.createDataFrame([("q1", [("proof", {"source_url": "u"})]), ("q2", [("proof", {"source_url": "u"})]), ("q3", []), ("q4", [("p", {"source_url": "u"})])], "query string, evidence array<struct<text: string, provenance: map<string, string>>>")

    def model(question, evidence):
        if question == "q4":
            raise RuntimeError("down")
        return {"q1": '```json\n{"answer": "yes", "citations": [{"source_url": "u", "quote": "proof"}]}\n```', "q2": "**Answer**\nmaybe", "q3": "prose"}[question]

    got = {r["query"]: (r["answer_outcome"], r["answer"]["answer"] if r["answer"] else None) for r in live.answers(df, model).collect()}
    assert got == {"q1": ("answered", "yes"), "q2": ("fallback_rescue", "maybe"), "q3": ("failed", None), "q4": ("failed", None)}


def test_delete_everywhere(spark):
    f = spark.createDataFrame([("https://a/", "done", 1, None, None, T, T), ("https://b/", "done", 1, None, None, T, T)], FRONTIER)
    e = spark.createDataFrame([(1, T, "x", "https://a/", None, None, None), (2, T, "x", None, None, None, None)], EVENTS)
    left = cascade.delete_everywhere(f, e, rows(spark), "https://a/")
    assert (left.frontier.count(), left.events.count(), left.corpus.count(), left.deleted) == (1, 1, 0, {"frontier": 1, "events": 1, "corpus": 3})
    assert cascade.clear(e)[1] == 2 and frontier.reset(f).count() == 0
    assert events.delete_url(e, "https://a/").count() == 1


def test_rows_are_set_aside_once_a_store_and_not_at_all_to_compact(spark, tmp_path, monkeypatch):
    names, settled = [], corpus.settled
    monkeypatch.setattr(corpus, "settled", lambda df, name, *args: names.append(name) or settled(df, name, *args))
    store = corpus.Corpus(spark, str(tmp_path), "once", 2)
    for text in ("old", "new"):
        store.store(spark.createDataFrame([chunk_row(f"https://h{i}.example.com/", 1, [1, 0], content=text) for i in range(6)], CORPUS))
    store.compact(1)
    assert sorted(r["content"] for r in store.read().collect()) == ["new"] * 6
    assert [n for n in names if n != "gone"] == ["stored", "stored"]

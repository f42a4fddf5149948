"""URL filter, language identification and quality model."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import language_id, quality, url_filter
from gleaner.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def glob_regex(glob):
    return "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(t) or re.escape(t) for t in url_filter.tokens(glob))


def test_automaton_is_the_regular_expressions():
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    urls = ["".join(rng.choice("ab/.é") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + ["", "a" * 5000]
    hits = url_filter.ShiftAnd(globs).matches(urls)
    for i, u in enumerate(urls):
        assert hits[i].tolist() == [re.fullmatch(glob_regex(g), u) is not None for g in globs], u


def test_rules(spark):
    rows = [
        (1, "HTTPS://WWW.Example.COM/en/x?q#f"), (2, "http://a.example.com/en/x"), (3, "http://com/"), (4, "http://com"), (5, "http://b.net/es/1"), (6, "http://net/fr/"),
        (7, "http://notexample.com/en/"), (8, None), (9, "no scheme"), (10, "http://x.org/a.exe"), (11, "http://é.com/é"), (12, "http://x.net/y.com/z"), (13, ""), (13, ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit("clash")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3][2:] == ("com/", "allow") and got[4] == ("com", "", None, "allow")
    assert got[5][2:] == ("net/es/", "block") and got[6][2:] == ("net/fr/", "block")
    assert got[7][2] == "com/" and got[8] == ("", "", None, "allow") == got[9] == got[13]
    assert got[10][2:] == (None, "block") and got[11][:3] == ("é.com", "/é", "com/") and got[12][2] is None
    assert url_filter.filter_urls(df).count() == 14 and url_filter.filter_urls(df.limit(0)).count() == 0


def test_rules_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = sorted(tuple(r) for r in url_filter.filter_urls(spark.read.parquet(f"{sf}/pages.parquet")).collect())
    assert got == sorted(con.execute(url_filter.filter_sql()).fetchall())


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, language_id.fit(docs, per_language=200)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right, all_ = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert all_ > 200 and right / all_ > 0.97
    assert out.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    train = [(i, t, l, None, 0) for i, (t, l) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), ("le chat et le chien " * 5, "fr")] * 20)]
    model = language_id.fit(spark.createDataFrame(train, DOCS))
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0), (3, "123 !?", "en", None, 0), (None, "der hund und die katze", None, None, 0), (5, "the cat and the dog " * 50_000, None, None, 0)], DOCS)
    got = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in language_id.identify(odd.withColumn("lang_pred", F.lit("clash")), model).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == "und" and got[None] == ("de", False) and got[5][0] == "en"
    none = language_id.fit(spark.createDataFrame([], DOCS))
    assert [r["lang_pred"] for r in language_id.identify(odd, none).collect()] == ["und"] * 5
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_every_language_is_learned(spark):
    names = [f"x{i:02d}" for i in range(70)]
    rows = [(100 * i + k, f"{n} word{n} of{n} " * 8, n, None, 0) for i, n in enumerate(names) for k in range(6)]
    rows += [(7, "x00 wordx00 ofx00 " * 8, "x00", None, 0)] * 400  # one row many times over
    model = language_id.fit(spark.createDataFrame(rows, DOCS), per_language=3, max_rows=280)
    assert sorted(sum(model.members.values(), [])) == names
    got = language_id.identify(spark.createDataFrame(rows, DOCS).filter("doc_id % 100 = 5"), model).collect()
    assert np.mean([r["lang_pred"] == names[r["doc_id"] // 100] for r in got]) > 0.95


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    emit, trans = rng.normal(size=(2, 4)), rng.normal(size=(2, 2))
    size = np.array([4, 3])
    good, _, _, log_z, _ = quality.forward_backward(emit, size, trans)
    for row in range(2):
        total, on = 0.0, np.zeros(size[row])
        for path in itertools.product((0, 1), repeat=int(size[row])):
            w = np.exp(sum(emit[row, t] * s for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            on += w * np.array(path)
        assert np.allclose(good[row, : size[row]], on / total) and np.isclose(log_z[row], np.log(total))


def test_line_shapes_count_lines():
    f, size = quality.line_shapes("ab\n\nÉ|!\n")
    assert len(f) == 4 and size.tolist() == [2, 0, 4, 0]
    assert len(quality.line_shapes("")[0]) == 1


def test_lines_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["", "\n", "a\n", "no break at all " * 9] + ["".join(rng.choice(list("ab Z!|\n"), size=200)) for _ in range(20)]
    weights = rng.normal(size=3 * quality.SHAPE)
    want = [quality.line_shapes(t) for t in texts]
    for block in (1 << 20, 7):
        monkeypatch.setattr(quality, "BLOCK", block)
        for t, (f, size) in zip(texts, want, strict=True):
            assert len(f) == t.count("\n") + 1 and all((x == y).all() for x, y in zip(quality.line_shapes(t), (f, size), strict=True))
            emit, own = quality.emissions(t, weights)
            assert np.allclose(emit, quality.with_neighbours(f) @ weights) and (own == size).all()
    assert quality.spread(5, 9).tolist() == [0, 1, 2, 3, 4] and quality.spread(1001, 3).tolist() == [0, 500, 1000]


def test_training_lowers_the_loss_by_differences():
    """The trained chain is where the plain likelihood, by enumeration, has no slope left to speak of."""
    rng = np.random.default_rng(5)
    docs = [rng.normal(size=(n, quality.SHAPE)) + y for n, y in [(2, 0), (3, 1), (1, 0), (3, 1), (2, 1), (2, 0)]]
    labels = [0, 1, 0, 1, 1, 0]

    def loss(w, trans):
        total = 1e-3 / 2 * (w @ w) + 1e-2 / 2 * (trans * trans).sum()
        for d, y in zip(docs, labels, strict=True):
            emit, paths = quality.with_neighbours(d) @ w, list(itertools.product((0, 1), repeat=len(d)))
            score = lambda p: sum(e * s for e, s in zip(emit, p, strict=True)) + sum(trans[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            total += (np.log(sum(np.exp(score(p)) for p in paths)) - score([y] * len(d))) / 6 / len(d)
        return total

    model = quality.train(docs, [np.ones(len(d)) for d in docs], labels, rounds=2000)
    best = loss(model.weights, model.trans)
    assert best < 0.25 * loss(np.zeros(3 * quality.SHAPE), np.zeros((2, 2)))
    for _ in range(20):
        assert loss(model.weights + 0.05 * rng.normal(size=len(model.weights)), model.trans) > best - 1e-3


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.classify(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in out]) > 0.97 and len(out) > 80
    assert all(0 <= r["score"] <= 1 for r in out)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "x\n" * 20_000, "en", "s", 0), (3, "again", "en", "s", 0), (None, "y", "en", "s", 0)], DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, quality.fit(docs, labels))
    assert out.count() == 5 and {r["predicted"] for r in out.collect()} <= {0, 1}
    bare = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.classify(docs, bare).collect()} == {0.5}
    assert quality.keep_good(docs, bare).columns == docs.columns and quality.classify(docs.limit(0), bare).count() == 0


@pytest.mark.parametrize("fold", [0, 1, 2])
def test_fold_is_crc32_of_the_text_form(spark, fold):
    import zlib

    df = spark.range(60).filter(F.lit(True))
    got = {r["id"] for r in df.filter(held_out(F.col("id"))).collect()}
    assert got == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1}

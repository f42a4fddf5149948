"""Operators beside plain loops, and odd rows through all stages of the pipeline."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import language_id, token_output
from gleaner.llm.common import materialize


def plain_best_fit(lengths, width):
    """Longest first, each into the fullest sequence that still holds it."""
    sequences = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        open_ = [(width - sum(lengths[j] for j in s), k) for k, s in enumerate(sequences)]
        fits = [(room, k) for room, k in open_ if room >= lengths[i]]
        if fits:
            sequences[min(fits)[1]].append(i)
        else:
            sequences.append([i])
    return sequences


@pytest.mark.parametrize("seed", range(5))
def test_placement_is_plain_best_fit(seed):
    rng = random.Random(seed)
    width = rng.choice([10, 37, 100])
    lengths = np.array([rng.randrange(1, width + 1) for _ in range(rng.randrange(0, 120))], np.int64)
    got = token_output.best_fit_decreasing(lengths, width)
    want = plain_best_fit(lengths.tolist(), width)
    fill = lambda made: sorted(sum(int(lengths[i]) for i in s) for s in made)  # noqa: E731  of equal rooms any may be taken
    assert fill(got) == fill(want) and sorted(i for s in got for i in s) == list(range(len(lengths)))


def plain_prediction(model, text):
    """Both layers written out: the family of the largest margin, then one vote a pair."""
    v = language_id.features(text)
    margins = {}
    for f, w in zip(model.families, model.top, strict=True):
        margins[f] = sum(float(a) * float(b) for a, b in zip(w[:-1], v, strict=True)) + float(w[-1])
    family = max(sorted(margins), key=lambda f: margins[f])
    total = sum(np.exp(3 * (m - margins[family])) for m in margins.values())
    votes, sure = dict.fromkeys(model.members[family], 0), dict.fromkeys(model.members[family], 1.0)
    for a, b in combinations(sorted(model.members[family]), 2):
        w = model.pairs[a, b]
        p = 1 / (1 + np.exp(-3 * (sum(float(x) * float(y) for x, y in zip(w[:-1], v, strict=True)) + float(w[-1]))))
        votes[a if p >= 0.5 else b] += 1
        sure[a], sure[b] = sure[a] * p, sure[b] * (1 - p)
    best = sorted(votes, key=lambda a: (-votes[a], -sure[a], a))[0]
    return best, sure[best] / total


def test_languages_by_plain_layers(spark):
    words = {"en": "the of and to in house", "de": "der die und das ist haus", "nl": "de het een van huis niet", "fr": "le la les et une maison", "es": "el los las y una casa", "xx": "qq ww zz kk"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(3, 30))), lang) for i in range(400) for lang in [rng.choice(sorted(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert set(model.members) == {"germanic", "romance", "xx"} and len(model.pairs) == 4
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for i, text, _ in rows[:120]:
        best, score = plain_prediction(model, text)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - score) < 1e-5


def test_odd_rows_go_through_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    long = " ".join(f"word{i % 977} of a very long text number {i}." for i in range(30_000))
    odd = [(None, "no id", "en", None, 5), (None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", None, "s", 0), (900_003, " \n\t", "en", None, 3), (900_004, long, "en", "s", len(long)), (900_005, long, "en", "s", len(long)), (900_006, "short", "xx", "s", 5), (900_006, "short", "xx", "s", 5)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"words": F.lit("clash"), "removed": F.lit(1), "root": F.lit("clash"), "id": F.col("doc_id"), "score": F.lit(0.5), "h": F.lit(7), "node": F.lit(None).cast("string")})
    for start in (both, both.limit(0)):
        before = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = materialize(stage(spark, before, sf), "odd")
            if k < 4:
                assert sorted(out.columns) == sorted(start.columns)
                assert out.count() <= before.count()
                before = out
        kept = {(r["doc_id"], r["text"] is None) for r in before.collect()}
        packed = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.min("piece").alias("first")).collect()
        assert {r["doc_id"] for r in packed} == {d for d, _ in kept} and all(r["n"] > 0 and r["first"] == 0 for r in packed)
    assert not kept

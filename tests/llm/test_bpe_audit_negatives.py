"""Byte-pair codec, filter interaction audit and hard negatives against brute force."""

import hashlib
import math
import random
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest

from gleaner.llm import audit, bpe, negatives, tokenizer
from gleaner.llm.queries import QUERIES, SQL

# ------------------------------------------------------------------ codec


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer.default_path())


@pytest.fixture(scope="module")
def own():
    return bpe.load(tokenizer.default_path())


def made_texts(seed=3, n=300):
    rng = random.Random(seed)
    words = ["the", "Beta's", "ΣΑΣ", "don't", "x1y22", "<|endoftext|>", "a<|startoftext|>b", "***", "日本語", "café", "ab|cd", "İx", "½", "a b", "é", "\x1c", "\x85", "ﬁ", "aaaaaaaaaaaaa", "ththththe", "''re", "𝔘nicode"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    letters = ["".join(rng.choice("aabbeeinthorslg'") for _ in range(rng.randrange(1, 90))) for _ in range(3 * n)]
    return texts + letters + ["", " \n\t", "a" * 5000, "the" * 3000]


def test_codec_is_the_tokenizer(whole, own, monkeypatch):
    texts = made_texts()
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.ids_many(texts)] == want
    assert 0 < own.failed < own.proposed
    monkeypatch.setattr(tokenizer, "BLOCK", 64)
    monkeypatch.setattr(tokenizer, "PIECES", 3)
    monkeypatch.setattr(bpe, "RUNS_KEPT", 3)
    monkeypatch.setattr(bpe, "WORDS", 7)
    monkeypatch.setattr(bpe, "SHORT", 4)  # nearly all by the heap
    fresh = bpe.SpeculativeTokenizer(tokenizer.default_path())
    assert [x.tolist() for x in fresh.ids_many(texts)] == want


def test_pairs_are_compatible_exactly_if_merging_keeps_them(own):
    rng = np.random.default_rng(4)
    table = own.table
    inner = np.setdiff1d(np.arange(table.size), np.append(table.base[256:], np.flatnonzero(table.rank < 0)))
    a, b = rng.choice(inner, 4000), rng.choice(inner, 4000)
    spelled: dict[int, list[int]] = {}

    def bytes_of(t):
        if table.rank[t] < 0:
            return [int(t)]
        if t not in spelled:
            spelled[t] = bytes_of(int(table.left[t])) + bytes_of(int(table.right[t]))
        return spelled[t]

    fine = table.compatible(a, b)
    ends = np.isin([bytes_of(int(t))[-1] for t in a], table.base[256:])
    for x, y, ok, end in zip(a.tolist(), b.tolist(), fine.tolist(), ends.tolist(), strict=True):
        if not end:
            assert (table.merge(bytes_of(x) + bytes_of(y)) == [x, y]) == ok
    assert 0 < fine.sum() < len(fine) and table.reachable().sum() == 49406


def test_another_vocabulary_is_refused(tmp_path):
    import json

    with open(tokenizer.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["dropout"] = 0.1
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.SpeculativeTokenizer(str(tmp_path / "t.json"))


def test_codec_columns_rows_and_digests(spark, whole):
    texts = [(i, t, 1, "x") for i, t in enumerate(made_texts(n=40))] + [(None, "no id", 2, "y"), (3, None, 3, None), (3, None, 3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, _ids int, ids string").repartition(3)
    coded = bpe.decode(bpe.encode(docs, ids_col="tokens"), ids_col="tokens")
    assert coded.columns == [*docs.columns, "tokens", "decoded"]
    for r in coded.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["tokens"]) == ids and r["decoded"] == whole.decode(ids, skip_special_tokens=False)
    got = sorted(map(tuple, bpe.digest(docs).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in texts:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str) and bpe.digest(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([([1, None, -4, 10**6, 49407],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd).collect()] == [whole.decode([1, 49407], skip_special_tokens=False), "", ""]


def test_codec_query(spark, sf, whole):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_bpe_speculate"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = whole.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


# ------------------------------------------------------------------ audit


@pytest.mark.parametrize("seed", range(4))
def test_polynomials(seed):
    rng = random.Random(seed)
    counts = [rng.randrange(0, 40) for _ in range(32)]
    poly = audit.RemovalPolynomial(counts)
    removed = lambda t: sum(c for s, c in enumerate(counts) if s & t)
    assert poly.corners == [removed(t) for t in range(32)]
    for i in range(5):
        share = sum(Fraction(removed(b | 1 << i) - removed(b)) for p in permutations(range(5)) for b in [sum(1 << j for j in p[: p.index(i)])]) / 120
        assert poly.shapley(i) == share == sum(Fraction(c, s.bit_count()) for s, c in enumerate(counts) if s >> i & 1)
    assert sum(poly.shapley(i) for i in range(5)) == removed(31)


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    seen = []
    for doc, text, source in docs:
        t = text or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = doc is not None and any(o is not None and o < doc and (u or "") == t for o, u, _ in docs)
        seen.append((source or "", fails, doc in good, doc in toxic))
    rows = []
    for part in {p for p, *_ in seen}:
        own = [s for s in seen if s[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        walked = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                out = [s for s in left if s[1][f]]
                gone = [s for s in own if s not in left]
                left = [s for s in left if not s[1][f]]
                total[f] += len(out)
                redundant = sum(s[1][f] for s in own) - len(out)
                alone = sum(s[1][f] and sum(s[1].values()) == 1 for s in own)
                assert redundant == sum(s[1][f] for s in gone)
                walked.append((part, "".join(order), step, len(left), len(out), redundant, alone, sum(s[2] for s in out), sum(s[3] for s in out), f))
        rows += [(*w[:-1], total[w[-1]]) for w in walked]
    return sorted(rows)


def test_audit_is_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "a"), (2, long, "a"), (3, long + " #", None), (4, "", "a"), (5, None, ""), (6, "A B C", "b"), (7, "x " * 300, "b"), (8, long + "\tUP" * 40, "b"), (None, long, "a"), (2, long, "a"), (9, "A B C", "a"), (10, "é" * 10 + "Z", "b"), (11, "a b " * 210, "a")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, None), (9, 1, 1), (9, 1, 1)]
    for parts in (1, 5):
        df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, source string, good int").repartition(parts)
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        # Unequal rows of one content are told apart by their place in the brute force.
        got = sorted(tuple(r) for r in audit.audit(df, lab).collect())
        assert len(got) == 3 * 600
        want = brute_audit(docs, labels)
        assert [g[:5] + g[6:] for g in got] == [w[:5] + w[6:] for w in want] and [g[5] for g in got] == [w[5] for w in want]
    assert audit.audit(df.limit(0), lab).count() == 0


def run_sql(sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = con.execute(SQL[name])
    return [d[0] for d in out.description], out.fetchall()


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_hard_negatives"])
def test_query_is_its_sql(spark, sf, name):
    columns, want = run_sql(sf, name)
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


# -------------------------------------------------------------- negatives


def brute_negatives(rows):
    known = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, label, v in known:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in known if i != a and len(w) == len(v))
        for score, p, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(i, -s) for s, i, other in scored if other != label and 50 * -score <= 100 * -s <= 95 * -score][:3]
            out += [(a, p, k, i, -score, s) for k, (i, s) in enumerate(inside, 1)]
    return sorted(out)


def vectors(seed, n, width, scale=1.0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, width)) + 0.5
    v *= scale * np.exp(rng.standard_normal((n, 1)))  # lengths of all kinds
    v[rng.random(n) < 0.3] = v[0]  # a vector that many rows hold
    return [(int(i), int(rng.integers(0, 4)), [float(x) for x in v[i]]) for i in range(n)]


@pytest.mark.parametrize("bucket,lane,block", [(4096, 48 << 20, 128 << 10), (16, 2000, 512)])
def test_negatives_are_brute_force(spark, monkeypatch, bucket, lane, block):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "LANE_BYTES", lane)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block)
    rows = vectors(1, 400, 6) + [(1000 + i, lab, v[:3]) for i, lab, v in vectors(2, 120, 3)]
    rows += [rows[50], rows[100], (2000, None, [1.0] * 6), (2050, 1, None), (2100, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2150, 1, [math.inf] * 6), (2200, 1, []), (None, 1, [1.0] * 6), (2250, 2, [0.0] * 6), (2300, 2, [-5.0] * 6)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, label int, embedding array<double>, norm int").repartition(5)
    assert sorted(map(tuple, negatives.mine(df).collect())) == brute_negatives(rows)


def test_negatives_of_few_and_of_large_numbers(spark):
    kind = "vec_id long, label int, embedding array<double>"
    assert negatives.mine(spark.createDataFrame([], kind)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0])], kind)).count() == 0
    few = [(50, 1, [1.0, 0.0]), (51, 1, [1.0, 0.5]), (52, 2, [0.75, 0.0]), (53, 2, [0.75, 0.0])]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(few, kind)).collect())) == brute_negatives(few)
    large = [(i, lab, [x * 2.0**18 for x in v]) for i, lab, v in vectors(3, 120, 4)]  # beyond what floating point adds exactly
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(large, kind)).collect())) == brute_negatives(large)
    with pytest.raises(Exception, match="62 bits"):
        negatives.mine(spark.createDataFrame([(i, lab, [x * 2.0**30 for x in v]) for i, lab, v in vectors(3, 60, 4)], kind)).collect()


def test_buckets_are_passed_over_by_length():
    rng = np.random.default_rng(5)
    looked = []

    class Seen(negatives.Bucket):
        def scores(self, anchors, peak):
            looked.append(self.most)
            return super().scores(anchors, peak)

    sizes = [1000, 100, 10, 1]
    lane = []
    for size in sizes:
        v = (rng.random((50, 8)) * size).astype(np.int64) + 1
        lane.append(Seen(float(np.sqrt((v**2).sum(axis=1)).max()), np.arange(50) + 100 * size, np.arange(50) % 2, v))
    anchor = np.full((1, 8), 7, np.int64)
    found = list(negatives.visit(lane, np.array([50]), np.array([1]), anchor, None))
    assert len(looked) == 1 and len(found) == 5  # the first bucket holds five that no shorter vector can beat
    looked.clear()
    list(negatives.visit(lane, np.array([50]), np.array([1]), anchor, [[found[-1][3]]]))
    assert len(looked) == 1

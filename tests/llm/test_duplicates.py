"""SimHash, substring dedup, decontamination and components against brute force."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import components, decontaminate, simhash, substring

DOCS = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


# ------------------------------------------------------------------ components


def closure(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (-3, 1000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = closure(p for p in pairs if p[0] != p[1])
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ simhash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def test_golay_code():
    words = simhash.codewords()
    weights = collections.Counter(int(x).bit_count() for x in words)
    assert weights == {0: 1, 7: 253, 8: 506, 11: 1288, 12: 1288, 15: 506, 16: 253, 23: 1}
    rng = random.Random(2)
    for bits in (21, 22, 23):
        for _ in range(400):
            a = rng.getrandbits(bits)
            b = a
            for _ in range(rng.randrange(3)):
                b ^= 1 << rng.randrange(bits)
            ka, kb = (set(simhash.near_indices(np.array([x]), bits)[0].tolist()) for x in (a, b))
            assert ka & kb and len(ka) <= 6


def test_keys_find_every_pair_within_two_bits():
    rng = random.Random(3)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 2))
        ka, kb = (set(k.tolist()) for k in simhash.golay_keys(np.array([a, b], np.uint64).view(np.int64)))
        assert ka & kb


def test_fingerprints_in_blocks(monkeypatch):
    text = " ".join(f"Wörd{i % 97} x{i}" for i in range(500)) + "\tEND one"
    want = plain_fingerprint(text)
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == want
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 100)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 7)
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b"  \n") == 0
    assert simhash.fingerprint(b"A b") & (1 << 64) - 1 == plain_fingerprint("a b")


def test_components_within_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(400)]
    rows = [(i, " ".join(base)) for i in range(5)]
    for i in range(150):  # a dense group: one or two words changed
        words = list(base)
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(400)] = f"v{rng.randrange(9)}"
        rows.append((10 + i, " ".join(words)))
    rows += [(200 + i, " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(6)))) for i in range(100)] + [(300, None), (301, ""), (None, " "), (302, "one"), (302, "one")]
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = closure(links + [(i, i) for i in range(len(rows))])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    want = sorted(((d, f"{fps[i]:016x}", least.get(root[i])) for i, (d, _) in enumerate(rows)), key=str)
    for bucket in (16, 2):  # the second sends nearly everything through the words half way between
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        out = simhash.components_within(frame(spark, rows).withColumn("fp", F.lit("clash")))
        assert sorted(((r["doc_id"], r["h"], r["component_id"]) for r in out.withColumn("h", simhash.hex64(F.col("fp"))).collect()), key=str) == want
    assert simhash.components_within(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("ane", "olo", "ist", "ura", "emi")]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(60)]
    rows = list(enumerate(clean))
    planted = []
    for k in range(40):  # copies with about one word in fifty changed: similarity of 0.8 and more
        words = clean[k].split()
        for _ in range(4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
        planted.append((k, 100 + k))
    rows += [(200 + i, clean[50] + f" tail{i}") for i in range(60)] + [(400, None), (401, ""), (402, " "), (None, clean[0])]
    got = {r["id"]: r["root"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)  # every semi join shuffles
    assert got == {r["id"]: r["root"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert sum(got[a] == got[b] == a for a, b in planted) >= 39
    assert all(got[200 + i] == 50 for i in range(60))
    assert all(got[k] == k for k in range(60))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows).withColumn("id", F.lit("clash"))).collect()}
    assert set(range(60)) | {400, 401, 402, None} <= kept and not any(200 <= (x or 0) < 300 for x in kept)


def edited(words, share, rng, tag):
    """``words`` with about ``share`` of them replaced by words of ``tag``."""
    out = list(words)
    for at in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[at] = f"{tag}{at}"
    return out


def shingle_similarity(a, b):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_soft_keys_are_shared_at_the_threshold(spark):
    rng = random.Random(11)
    pairs = []
    while len(pairs) < 400:
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 300))]
        b = edited(a, 0.022, rng, "v")
        if 0.8 <= shingle_similarity(a, b) < 0.85:
            pairs.append((a, b))
    rows = [(2 * i + side, " ".join(t)) for i, pair in enumerate(pairs) for side, t in enumerate(pair)]
    codes = [(r["id"], np.frombuffer(r["codes"], "<i2").reshape(-1, 3 * simhash.BANDS, 3)) for r in simhash.sketches(frame(spark, rows), 5, "doc_id", "text").collect()]
    keys = {i: set(simhash.soft_keys(c, simhash.PROBES)[0].tolist()) for i, c in codes}
    assert sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(400)) >= 380


def test_links_are_of_the_stated_similarity(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 200))]
        b = edited(a, (0.033, 0.018)[k % 2], rng, "v")  # similarity of 0.65 to 0.9
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[2 * k + 1] = shingle_similarity(a, b)
    rows += [(500, "one two three four five six seven eight"), (501, "one two three four five six seven eight nine")]  # four shingles of five
    want[501] = 0.8
    got = {r["id"]: r["root"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    below = [b for b, s in want.items() if s < 0.8]
    assert len(below) >= 20 and all(got[b] == b for b in below)
    near = [b for b, s in want.items() if s >= 0.8]
    assert len(near) >= 5 and sum(got[b] == b - 1 for b in near) >= 0.95 * len(near)


def near_classes(rows):
    """Least id of what links of 0.8 and more connect, by comparing all pairs."""
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return closure(links + [(i, i) for i in sets])


def test_links_of_groups_by_brute_force(spark, monkeypatch):
    """Whatever shares a key is compared: all texts in one bucket, families whose members link through others, or not at all."""
    monkeypatch.setattr(simhash, "soft_keys", lambda codes, probes: np.zeros((len(codes), 1), np.int64))
    rng = random.Random(13)
    rows = []
    for family in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range((80, 150, 40)[family])]
        sub = edited(base, 0.1, rng, "s")  # a family within the family
        for k in range(70):
            words = list(base if k % 3 else sub)
            for _ in range(rng.randrange(7)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(4)}"
            rows.append((1000 * family + k, " ".join(words[: len(words) - rng.randrange(4)])))
    rows += [(5000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60)))) for i in range(30)]
    want = near_classes(rows)
    assert len(set(want.values())) >= 60 and max(collections.Counter(want.values()).values()) >= 10
    assert {r["id"]: r["root"] for r in simhash.near_duplicates(frame(spark, rows)).collect()} == want


def test_equal_fingerprints_are_no_proof(spark, monkeypatch):
    monkeypatch.setattr(simhash, "APART", 512)
    monkeypatch.setattr(simhash, "soft_keys", lambda codes, probes: np.zeros((len(codes), 1), np.int64))  # one bucket for all
    rng = random.Random(13)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(25)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t[:-1] + ["x"])) for i, t in enumerate(texts)]
    got = {r["id"]: r["root"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_repeated_ids_and_odd_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, "another text of five words"), (1, text), (2, text + " more"), (3, "one two"), (4, "one two"), (5, None), (6, ""), (None, text), (7, "ONE two")]
    got = collections.Counter((r["id"], r["root"]) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == {(1, 1): 3, (2, 1): 1, (3, 3): 1, (4, 3): 1, (7, 3): 1}
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


# ------------------------------------------------------------------ substrings


def plain_digest(rows, window):
    """rows: (doc_id, text); null ids last, equal rows are one document."""
    order = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for d, t in order:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d, t] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return sorted(((d, *out[d, t]) for d, t in rows), key=str)


def random_documents(seed, n=80, words=5):
    rng = random.Random(seed)
    passage = " ".join(f"p{rng.randrange(30)}" for _ in range(60))
    rows = []
    for i in range(n):
        parts = [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(60)))]
        if rng.random() < 0.5:
            at = rng.randrange(20)
            parts.insert(rng.randrange(2), " ".join(passage.split()[at : at + rng.randrange(15, 45)]))
        rows.append((i, "\n ".join(parts)))
    return rows + [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, " \t\n"), (505, "a b é"), (None, rows[5][1]), (506, "same " * 100), (3, rows[3][1])]


def test_digest_by_brute_force(spark, monkeypatch):
    for seed, words in ((1, 3), (2, 40)):
        rows = random_documents(seed, words=words)
        got = sorted((tuple(r) for r in substring.digest(frame(spark, rows).withColumn("kept", F.lit("clash"))).collect()), key=str)
        assert got == plain_digest(rows, 20)
    assert substring.digest(frame(spark, rows).limit(0)).count() == 0


def test_other_columns_stay_whatever_their_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    names = ["kid", "dg", "spans", "row", "out", "_kid", "_raw", "a.b", "lost", "n_words"]
    docs = frame(spark, [(1, text), (2, "x  " + text + "\ty"), (3, None)])
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    out = substring.remove_repeats(docs, joined=False, columns=("count", "removed", "left"))
    got = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert out.columns == [*docs.columns, "count", "removed", "left"]
    assert all(r[n] == k for r in got.values() for k, n in enumerate(names))
    assert [(got[i]["count"], got[i]["removed"], got[i]["left"]) for i in (1, 2, 3)] == [(30, 0, text), (32, 30, "x  y"), (0, 0, "")]
    assert substring.remove_repeats(docs).columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "kept"]


def test_long_documents_in_segments():
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(45)]
    words: list[str] = []
    while len(words) < 3000:
        words += [f"w{rng.randrange(9)}" for _ in range(rng.randrange(5, 80))] + passage[rng.randrange(9) :]
    raw = " ".join(words[:3000]).encode()
    import unittest.mock as mock

    def spans_of(block_words):
        with mock.patch.object(substring, "BLOCK_WORDS", block_words):
            settled, entries = [], []
            for block in substring.segments([(1, 7, raw)], 20):
                s, e = substring.index_block(block, 20, 3)
                settled += s
                entries += e
            for p in range(3):
                settled += substring.settle([e for q, e in entries if q == p])
            return substring.removal_mask(3000, b"".join(s for _, _, s in settled), 20)

    whole = spans_of(10**6)
    assert whole is not None and (whole == spans_of(211)).all()


def test_digest_as_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in substring.digest(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    assert got == sorted(con.execute(substring.DIGEST_SQL).fetchall())


def test_cut_keeps_white_space():
    gone = np.array([False, True, True, False, False])
    assert substring.cut(b" a  bb\nc\td \n\n e", gone) == b" a  d \n\n e"
    assert substring.cut(b"a b", np.array([False, True])) == b"a"
    assert substring.cut(b"a b", np.array([True, True])) == b""


def test_rolled_hashes_depend_on_the_window_only():
    h = np.arange(100, dtype=np.uint64)
    both = np.concatenate([h, h])
    r = substring.rolled(both, 20, substring.ROLL_B)
    assert (r[:81] == r[100:181]).all() and len(np.unique(r)) == 100
    assert (substring.sliding_min(both, 15) == [both[i : i + 15].min() for i in range(186)]).all()


def test_windows_of_a_frequent_anchor_are_dealt_by_their_own_hash(spark, monkeypatch):
    rng = random.Random(14)
    phrase = "the very common phrase of six".split()
    texts = [[*(f"w{rng.randrange(10**6)}" for _ in range(14)), *phrase, *(f"w{rng.randrange(10**6)}" for _ in range(14))] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t[3:])) for i, t in enumerate(texts[:20])]
    blocks = [(i, i, t.encode()) for i, t in rows]
    anchors, n, total = substring.counted_anchors(next(substring.segments(blocks, 20)), 20)
    hot = anchors[n >= 20]
    _, entries = substring.index_block(next(substring.segments(blocks[:1], 20)), 20, 64, hot)
    _, plain = substring.index_block(next(substring.segments(blocks[:1], 20)), 20, 64)
    count = lambda e: sum(len(substring.unpack_entry(raw)[2]) for _, raw in e)
    assert total >= 80 and count(entries) == count(plain) == 15
    for frequent, counted in ((10**9, 1), (0, 1), (4, 4)):  # every anchor, none, some
        monkeypatch.setattr(substring, "FREQUENT", frequent)
        monkeypatch.setattr(substring, "COUNTED", counted)
        got = sorted((tuple(r) for r in substring.digest(frame(spark, rows)).collect()), key=str)
        assert got == plain_digest(rows, 20)


def test_windows_under_one_anchor_are_told_apart_by_the_whole_hash(monkeypatch):
    real = substring.rolled

    def low_bits(h, size, base):  # one anchor for all; hashes of windows differ in their low 24 bits only
        out = real(h, size, base)
        return np.zeros_like(out) if base == substring.ROLL_A else out & np.uint64((1 << 24) - 1)

    monkeypatch.setattr(substring, "rolled", low_bits)
    texts = [" ".join(f"{side}{i}" for i in range(40)) for side in "ab"] + [" ".join(f"a{i}" for i in range(40))]
    entries = []
    for k, text in enumerate(texts):  # a block each
        for block in substring.segments([(k, k, text.encode())], 20):
            entries += substring.index_block(block, 20, 1)[1]
    assert [(kid, np.frombuffer(spans, substring.SPAN)["n"].sum()) for kid, _, spans in substring.settle([e for _, e in entries])] == [(2, 21)]


def test_sources_of_spans(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = substring.find_spans(frame(spark, [(1, "x " + text), (2, "y z " + text)])).collect()
    spans = np.frombuffer(bytes(got[0]["spans"]), substring.SPAN)
    assert len(got) == 1 and got[0]["kid"] == 2
    assert [(int(s["at"]) - int(s["ref_at"]), int(s["ref"])) for s in spans] == [(1, 1)] * len(spans) and spans["n"].sum() == 21


# ------------------------------------------------------------------ decontamination


def test_leaks_verbatim_and_reparameterised(spark):
    item = "Tom said that Alice has 12 apples and gives Bob 5 apples per day over 3 km, how many apples does Alice have?"
    bench = spark.createDataFrame([(1, item), (2, "the cat sat"), (3, None), (4, item)], "item_id long, text string")
    docs = frame(
        spark,
        [
            (10, "Intro words here. " + item + " And more text follows."),
            (11, "Jim said that Carol has 99 apples and gives Dave 7 apples per day over 4 miles, how many apples does Carol have?"),
            (12, "Jim said that Carol has 99 apples and gives Dave 7 apples per day over 4 km, how many apples does Erin Fay Gus have?"),
            (13, "the cat sat on the mat"), (14, None), (15, ""), (16, "Nothing of the kind, only " * 50), (None, item), (10, "another text of the same id"),
        ],
    )
    got = {r["doc_id"]: r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {10, 11, None} | ({12} if got.get(12) and got[12]["slot_consistency"] >= 0.8 else set())
    assert all(r["item_id"] == 1 for r in got.values())
    assert not got[10]["reparameterised"] and got[11]["reparameterised"] and got[11]["slot_consistency"] == 1.0
    kept = decontaminate.drop_contaminated(docs.withColumn("item_id", F.lit("clash")), bench)
    assert {13, 14, 15, 16} <= {r["doc_id"] for r in kept.collect()} and kept.filter("text like 'another%'").count() == 1
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_inconsistent_slots_are_no_leak(spark):
    item = "first 1 two 1 three 1 four 1 five 1 six 1 seven 1 eight 2 nine 2 ten 2 end of it all"
    other = "first 1 two 2 three 3 four 4 five 5 six 6 seven 7 eight 8 nine 9 ten 10 end of it all"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"] for r in decontaminate.find_leaks(frame(spark, [(1, item), (2, other)]), bench).collect()}
    assert got == {1}


def leaks(spark, items, rows):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()}


def test_a_leak_stands_in_one_place(spark):
    words = [f"item{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(40)]
    far = " ".join(f"other{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(180))
    half = " ".join(words[:20]), " ".join(words[20:])
    got = leaks(spark, [(1, " ".join(words))], [(1, f"{half[0]} {far} {half[1]}"), (2, f"{far} {half[0]} a word or two {half[1]} {far}"), (3, f"{half[0]} {far}")])
    assert set(got) == {(2, 1)}


def test_tables_of_numbers_are_no_leak(spark):
    rng = random.Random(5)
    item = " ".join(str(100 + i) for i in range(12))
    table = " ".join(str(rng.randrange(200, 10**6)) for _ in range(1000))
    got = leaks(spark, [(1, item), (2, "Anna Berta Cara Dora Ella Fina Gina")], [(1, table), (2, table + " " + item + " and more"), (3, "so Mia Nora Olga Pia Rita Sara Tina Ute Vera Wanda")])
    assert set(got) == {(2, 1)} and got[2, 1]["n_slots"] == 12 and not got[2, 1]["reparameterised"]


def test_two_values_may_not_become_one(spark):
    item = "first 1 two 2 three 3 four 4 five 5 six 6 end of it all"
    rows = [(1, "first 9 two 9 three 9 four 9 five 9 six 9 end of it all"), (2, "first 91 two 92 three 93 four 94 five 95 six 96 end of it all")]
    got = leaks(spark, [(1, item)], rows)
    assert set(got) == {(2, 1)} and got[2, 1]["reparameterised"]


def test_long_texts_and_repeats_in_decontamination(spark):
    item = "a question of some length about nothing in particular at all"
    rows = [(1, ("word " * 50_000) + item), (2, f"{item} " * 300), (2, f"{item} " * 300), (3, item + " x"), (3, "other")]
    got = leaks(spark, [(1, item), (2, None), (3, "")], rows)
    assert {k: r["coverage"] for k, r in got.items()} == {(1, 1): 1.0, (2, 1): 1.0, (3, 1): 1.0}


def test_leaks_by_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " ".join(t.split())
    items = [(r["item_id"], flat(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in flat(r["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 2


def test_templates_stand_word_for_word(spark):
    df = spark.createDataFrame([("So — Anna paid 3,50 EUR, then Bob's 12km run. | x",)], "t string")
    row = df.select(decontaminate.template_words(F.col("t")).alias("w"), decontaminate.raw_words(F.col("t")).alias("r")).first()
    assert len(row["w"]) == len(row["r"])
    pairs = dict(zip(row["r"], row["w"], strict=True))
    assert pairs["3,50"] == decontaminate.NUMBER and pairs["EUR,"] == decontaminate.UNIT and pairs["Bob's"] == decontaminate.NAME and pairs["12km"] == decontaminate.NUMBER


def test_a_common_opening_pairs_nobody(spark, monkeypatch):
    opening = "what is the value of the following expression when"
    rng = random.Random(6)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    tail = lambda: " ".join(rng.choice(words) for _ in range(12))
    items = [(i, f"{opening} {tail()}") for i in range(400)]
    docs = [(i, f"{opening} {tail()} {opening} {tail()}") for i in range(4000)]
    docs[17] = (17, f"before {items[3][1]} after")
    made = {}
    whole = decontaminate.materialize

    def counting(df, name):
        out = whole(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "materialize", counting)
    leaks = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in leaks.collect()] == [(17, 3, 1.0)]
    assert made["template-pairs"] < 100 and made["template-matches"] < 5000


def test_short_items_match_whole_short_texts(spark):
    items = spark.createDataFrame([(1, "Yes."), (2, "It costs 5 dollars"), (3, "!!"), (4, "7 8 9")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "yes"), (2, "yes it is so and more"), (3, "it costs 99 dollars"), (4, "??"), (5, ""), (6, "7 8 9"), (7, "6 5 4"), (8, None)], DOCS)
    got = sorted((r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == [(1, 1, False), (3, 2, True), (6, 4, False)]

"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint is cut into segments.  Each segment is decoded to the indices of
Golay codewords near it, which gives several short keys instead of one exact
value, so two segments that differ in a few bits still share a key.  Documents
that share keys are joined and verified; components of the links are classes.

Two uses:

* :func:`components_within` links 64-bit fingerprints that differ in at most
  two bits, exactly.  Three segments (22, 21 and 21 bits): of two errors at
  least one segment has none (pigeonhole) and its neighbour at most two, which
  the words in the ball of radius one around it decode to a common codeword.
* :func:`near_duplicates` links documents whose five-word shingle sets have a
  similarity of 0.8 or more.  Fingerprints of 512 bits, whose segments are
  decoded with the bits' majorities as weights, find who is to be compared with
  whom; links rest on the sets themselves, as hashes.

Copies meet as one fingerprint first, and no bucket's pairs are formed when it
has many members: :func:`components_within` meets those through the words half
way between them, 65 a fingerprint; :func:`near_duplicates` compares the members
of a group by their differences to one reference set, all pairs of 0.8 and more
being connected (see :func:`_links`).

Defined results: null, empty and white-space texts have fingerprint zero and
link to each other like any others (:func:`components_within`), or are never
near-duplicates (:func:`near_duplicates`); texts of fewer words than a shingle
are one shingle; a class is named by its least id, null ids are never a name
unless a component has no other; repeated rows are kept; rows of one id with
different texts are compared each; an empty table gives no row; texts are read
whole, a block at a time; columns of other names are no input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard
from .common import materialize, shuffle_width, tidy
from .components import components

SEED = 42
#: Members of a bucket up to which its pairs are formed.
BUCKET = 16
#: Bytes of a text that are hashed at a time, and shingles whose bits are counted at a time.
BLOCK_BYTES = 1 << 20
BLOCK_SHINGLES = 1 << 15

# ---------------------------------------------------------------- Golay codes

#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101

_decoded: list[np.ndarray] = []
_signs: list[np.ndarray] = []


def codewords() -> np.ndarray:
    """The 4096 words of the perfect code of length 23, by message."""
    message = np.arange(4096, dtype=np.uint32)
    word = np.zeros(4096, np.uint32)
    for bit in range(12):
        word ^= np.where(message >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0))
    return word


def decoder() -> np.ndarray:
    """Message of the one codeword within three bits, for each of the 2^23 words."""
    if not _decoded:
        one = [1 << i for i in range(23)]
        two = [a | b for i, a in enumerate(one) for b in one[:i]]
        three = [t | c for t in two for c in one if c > t]
        table = np.zeros(1 << 23, np.uint16)
        words = codewords()
        for error in [0, *one, *two, *three]:
            table[words ^ np.uint32(error)] = np.arange(4096)
        _decoded.append(table)
    return _decoded[0]


def near_indices(segment: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices of each word and of all words one bit away, as rows."""
    flips = np.array([0, *(1 << i for i in range(bits))], np.uint32)
    return decoder()[segment.astype(np.uint32)[:, None] ^ flips[None, :]]


def sign_words() -> np.ndarray:
    """The extended code of length 24 as +1 / -1, one codeword a column."""
    if not _signs:
        w = codewords()
        bits = (w[None, :] >> np.arange(23, dtype=np.uint32)[:, None] & 1).astype(np.int8)
        bits = np.vstack([bits, bits.sum(axis=0) % 2])
        _signs.append((2 * bits - 1).astype(np.float32))
    return _signs[0]


# --------------------------------------------------------------- fingerprints


def shingle_hashes(raw: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles of A-Z lower-cased words, repeats included, in blocks."""
    carry: list[bytes] = []
    total, at = 0, 0
    while at < len(raw):
        end = at + BLOCK_BYTES
        if end < len(raw):
            ends = [e for e in (raw.find(b" ", end), raw.find(b"\n", end)) if e >= 0]
            end = min(ends, default=len(raw))
        fresh = raw[at:end].lower().split()
        at = end
        total += len(fresh)
        words = carry + fresh
        if len(words) >= size:
            yield _hashes(words, size)
            carry = words[len(words) - size + 1 :] if size > 1 else []
        else:
            carry = words
    if 0 < total < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    text = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    begin = (end - length)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(begin, end[size - 1 :].tolist(), strict=True)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK_SHINGLES):
        part = np.ascontiguousarray(h[at : at + BLOCK_SHINGLES])
        out += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprint(raw: bytes | None, size: int = 3) -> int:
    """64-bit majority fingerprint, as a signed number."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(raw or b"", size):
        n += len(h)
        counts += bit_counts(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """``id``, ``fp`` (signed 64-bit) for every row of ``docs``."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(pd.Series([fingerprint(r, size) for r in raws], dtype="int64") for raws in batches)

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col).cast("string").cast("binary")).alias("fp"))


# ------------------------------------------------- exact links within two bits

#: Segments of a 64-bit fingerprint: first bit, bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def golay_keys(fps: np.ndarray) -> list[np.ndarray]:
    """For each segment: its exact value joined with the near codewords of the next segment."""
    fps = fps.view(np.uint64)
    seg = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)) for a, n in SEGMENTS]
    near = [near_indices(s, n) for s, (_, n) in zip(seg, SEGMENTS, strict=True)]
    keys = []
    for k in range(3):
        index = near[(k + 1) % 3].astype(np.uint64)
        keys.append(np.uint64(k << 40) | (seg[k][:, None] << np.uint64(12)) | index)
    both = np.sort(np.hstack(keys), axis=1).view(np.int64)
    return [row[np.append(True, row[1:] != row[:-1])] for row in both]


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links_within_two(nodes: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` that connect whatever distinct fingerprints ``fp`` differ in one or two bits."""

    @F.pandas_udf("array<long>")
    def keys(fps: pd.Series) -> pd.Series:
        return pd.Series(golay_keys(fps.to_numpy(np.int64, copy=True)) if len(fps) else [])

    keyed = nodes.select("fp", F.explode(keys("fp")).alias("key"))
    count = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(keyed.join(count, "key"), "golay-keys")
    few = shared.filter(F.col("n") <= BUCKET)
    pairs = (
        few.select("key", F.col("fp").alias("u"))
        .join(few.select("key", F.col("fp").alias("v")), "key")
        .filter((F.col("u") < F.col("v")) & (apart(F.col("u"), F.col("v")) <= 2))
        .select("u", "v")
    )
    # Two words at most two bits apart have a word in common among themselves and
    # their one-bit neighbours; whatever meets there is linked to the least one.
    many = shared.filter(F.col("n") > BUCKET).select("fp").distinct()
    steps = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    halves = many.select("fp", F.explode(steps).alias("step")).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("mid"))
    hubs = halves.groupBy("mid").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("mid", "hub")
    stars = halves.join(hubs, "mid").filter("fp <> hub").select(F.col("hub").alias("u"), F.col("fp").alias("v"))
    return pairs.unionAll(stars).distinct()


def components_within(docs: DataFrame, size: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each row of ``docs``: id, fp (signed), component_id (least id reachable through links of at most two bits)."""
    fps = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    classes = components(links_within_two(nodes))
    rooted = nodes.join(classes, nodes["fp"] == classes["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    final = rooted.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return fps.join(final, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ----------------------------------------------- similar shingle sets, 512 bits

WORDS = 8
BANDS = 7
#: Choices of codewords by rank (0: best fit) for the three segments of a band: the likeliest of the three best each.
PROBES = [c for c in product(range(3), repeat=3) if sum(c) <= 3]
#: Bits of 512 up to which the sets of a pair that met nobody else are compared.  Sets of similarity 0.8 differ in 77.5
#: bits on average (512 * acos(2 * 0.8 / 1.8) / pi), the smallest ones (four shingles of five) in 96; four deviations of 8.8 more.
APART = 131
#: Least similarity of a link, as a fraction: common shingles by all shingles of the two sets.
SIMILAR = (4, 5)
#: The same in shingles that only one of two sets has: a link has SPAN of them at most for STEP shingles of both sets.
SPAN, STEP = SIMILAR[1] + SIMILAR[0], SIMILAR[1] - SIMILAR[0]
#: A shingle is frequent in a group when one in so many differences holds it.
FREQUENT = 64
#: Keys, and ids, up to which a semi join broadcasts them; counted first.
BROADCAST_ROWS = 500_000


def shingle_set(raw: bytes | None, size: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    parts = list(shingle_hashes(raw or b"", size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_mark(h: np.ndarray) -> int:
    """Hash of a shingle set, as a signed number."""
    mark = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    return mark - (1 << 64) if mark >> 63 else mark


def wide_counts(h: np.ndarray) -> np.ndarray:
    """Bit counts of distinct shingles over eight mixes of their hashes."""
    counts = [bit_counts(h)]
    for k in range(1, WORDS):
        x = (h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        counts.append(bit_counts(x ^ (x >> np.uint64(32))))
    return np.concatenate(counts)


def nearest_codes(lean: np.ndarray) -> np.ndarray:
    """The three best codewords of every segment, for each row of ``lean`` (how far each bit is from even)."""
    rows = np.arange(len(lean))
    signs = sign_words()
    best = np.zeros((len(lean), 3 * BANDS, 3), "<i2")
    for s in range(3 * BANDS):
        fit = lean[:, 24 * s : 24 * s + 24].astype(np.float32) @ signs
        for rank in range(3):
            best[:, s, rank] = fit.argmax(axis=1)
            fit[rows, best[:, s, rank]] = -np.inf
    return best


def soft_keys(codes: np.ndarray, probes: list[tuple[int, int, int]]) -> np.ndarray:
    """Keys of each row of ``codes``: every probe of every band of three segments."""
    codes = codes.astype(np.int64)
    keys = np.zeros((len(codes), BANDS, len(probes)), np.int64)
    for b in range(BANDS):
        for p, (i, j, k) in enumerate(probes):
            keys[:, b, p] = (b << 36) | (codes[:, 3 * b, i] << 24) | (codes[:, 3 * b + 1, j] << 12) | codes[:, 3 * b + 2, k]
    return keys.reshape(len(codes), -1)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``w`` (fingerprint), ``mark`` (hash of the shingle set), ``codes`` (:func:`nearest_codes`) of every document with a word."""

    @F.pandas_udf("w array<long>, mark long, codes binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(sketched(batches))

    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raws in batches:
            w, mark, codes = [], [], []
            for at in range(0, len(raws), 256):
                lean, some = [], []
                for r in raws.iloc[at : at + 256]:
                    h = shingle_set(r, size)
                    lean.append(2 * wide_counts(h) - len(h))
                    some.append(len(h) > 0)
                    mark.append(set_mark(h))
                lean = np.stack(lean)
                words = np.packbits(lean > 0, axis=1, bitorder="little").view("<i8")
                w += [x if ok else None for x, ok in zip(words, some, strict=True)]
                codes += [c.tobytes() for c in nearest_codes(lean)]
            yield pd.DataFrame({"w": pd.Series(w, dtype=object), "mark": np.array(mark, np.int64), "codes": pd.Series(codes, dtype=object)})

    sketch = sketch.asNondeterministic()  # else the filter below runs it a second time
    out = docs.select(F.col(id_col).alias("id"), sketch(F.col(text_col).cast("string").cast("binary")).alias("_s")).filter("_s.w is not null")
    return out.select("id", "_s.w", "_s.mark", "_s.codes")


def _keys_of(labelled: DataFrame, probes: list[tuple[int, int, int]]) -> DataFrame:
    """``g``, ``s``, ``key``: the keys of the members of each group; rows of one group that stand together send each key once."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i2").reshape(-1, 3 * BANDS, 3)
            keys = soft_keys(codes, probes)
            row = np.repeat(np.arange(len(g)), keys.shape[1])
            keys = keys.ravel()
            order = np.lexsort((keys, g[row]))
            row, keys = row[order], keys[order]
            own = g[row]
            new = np.append(True, (own[1:] != own[:-1]) | (keys[1:] != keys[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(own[new]), pa.array(s[row[new]]), pa.array(keys[new])], names=["g", "s", "key"])

    return labelled.select("g", "s", "codes").mapInArrow(expand, "g long, s long, key long")


def _groups(nodes: DataFrame, keep) -> DataFrame:
    """``p``, ``node``: every node in its own group, and in each group it has to be compared with.

    A node's own group is the largest bucket that its best codewords put it in.
    Then all keys are sent once a group, not once a member, and where groups
    share a key the smaller ones' members join the largest: whichever two nodes
    share a key are in one group.
    """
    best = _keys_of(nodes.select(F.col("node").alias("g"), F.lit(1).cast("long").alias("s"), "codes"), PROBES[:1]).select(F.col("g").alias("node"), "key")
    order = best.join(nodes.select("node", F.struct("least", "mark", "node").alias("o")), "node")
    bucket = order.groupBy("key").agg(F.count("*").alias("n"), F.min("o").alias("hub")).filter("n > 1").select("key", "n", F.col("hub.node").alias("hub"))
    own = best.join(bucket, "key").groupBy("node").agg(F.max_by("hub", F.struct("n", "key")).alias("g"))
    grouped = nodes.join(own, "node", "left").select("node", F.coalesce("g", "node").alias("g"), "codes")
    sizes = grouped.groupBy("g").agg(F.count("*").alias("s"))
    labelled = keep(grouped.join(sizes, "g").select("node", "g", "s", "codes"), "groups")
    # Members side by side, large groups over several tasks, and tasks small enough for many keys a row.
    every = _keys_of(labelled.repartitionByRange(shuffle_width(nodes.sparkSession), "g", "node").sortWithinPartitions("g"), PROBES)
    met = keep(every.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("key"), "met-keys")
    sharing = keep(every.join(_small(met), "key", "left_semi").distinct(), "sharing")
    top = sharing.groupBy("key").agg(F.max_by("g", F.struct("s", "g")).alias("p"))
    meet = sharing.join(top, "key").filter("g <> p").select("p", "g").distinct()
    members = labelled.select("g", "node")
    return members.withColumnRenamed("g", "p").unionAll(meet.join(members, "g").select("p", "node"))


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, marked for a broadcast if a count finds them few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def shingle_sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``least``, ``mark``, ``shingles`` (distinct hashes) of every row of ``docs``."""

    @F.pandas_udf("mark long, shingles array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(made(batches))

    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raws in batches:
            own = [shingle_set(r, size) for r in raws]
            yield pd.DataFrame({"mark": np.array([set_mark(h) for h in own], np.int64), "shingles": pd.Series([h.view(np.int64) for h in own], dtype=object)})

    sets = sets.asNondeterministic()  # else a later join's null test runs it first, on rows that are not asked for
    out = docs.select(F.col(id_col).alias("least"), sets(F.col(text_col).cast("string").cast("binary")).alias("_s"))
    return out.select("least", "_s.mark", "_s.shingles")


def _either(a: str, b: str) -> Column:
    """What only one of two sets holds."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _links(nodes: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str, keep) -> DataFrame:
    """Edges ``u``, ``v`` between nodes of similarity 0.8 and more that connect whatever such nodes share a key.

    In a group every set is replaced by its difference to one reference set: two
    sets differ in just the shingles that their differences differ in.  Around a
    reference near the middle differences are short, and most have no shingle in
    common; then their lengths tell whether they link, and all that link by
    length link to the one of least difference.  The others must share one of
    their rarest shingles (prefix filtering), so a group of n similar documents
    costs about n rows and not the square.
    """
    groups = keep(_groups(nodes, keep), "memberships")
    others = groups.filter("p <> node").groupBy("p").agg(F.count("*").alias("others"))
    groups = keep(groups.join(others, "p"), "groups-met")
    w = nodes.select("node", "w")
    bits = sum((apart(F.col("wu")[k], F.col("wv")[k]) for k in range(1, WORDS)), apart(F.col("wu")[0], F.col("wv")[0]))
    two = groups.filter("others = 1 and p <> node").join(w.withColumnRenamed("w", "wu"), "node").join(w.select(F.col("node").alias("p"), F.col("w").alias("wv")), "p").filter(bits <= APART)
    kept = keep(groups.filter("others > 1").unionAll(two.select("p", "node", "others")), "groups-kept")

    name = nodes.select("node", "least", "mark")
    asked = keep(kept.select(F.explode(F.array("p", "node")).alias("node")).distinct().join(name, "node"), "asked")
    ids = _small(keep(asked.select(F.col("least").alias("_asked")).distinct(), "asked-ids"))
    own = shingle_sets(docs.select(id_col, text_col).join(ids, F.col(id_col) == F.col("_asked"), "left_semi"), size, id_col, text_col)
    sets = keep(own.join(asked, ["least", "mark"]).groupBy("node").agg(F.any_value("shingles").alias("su")), "shingle-sets")
    both = kept.join(sets, "node").join(sets.select(F.col("node").alias("p"), F.col("su").alias("sp")), "p")
    apart_ = keep(both.select("p", "node", "others", F.size("su").alias("n"), F.size("sp").alias("np"), _either("su", "sp").alias("d")), "differences")
    stars = apart_.filter((F.size("d") * SPAN <= (F.col("n") + F.col("np")) * STEP) & (F.col("p") != F.col("node"))).select(F.col("p").alias("u"), F.col("node").alias("v"))

    # Move the reference to the middle: shingles that most differences hold change sides.  Frequent shingles, at most
    # FREQUENT times a difference's length of them, go to the end of the order.
    many = apart_.filter("others > 1").select("p", "node", "n", "d")
    held = many.groupBy("p").agg(F.count("*").alias("k"))
    often = many.select("p", F.explode("d").alias("t")).groupBy("p", "t").agg(F.count("*").alias("c")).filter("c > 1").join(held, "p").filter(F.col("c") * FREQUENT > F.col("k"))
    listed = often.groupBy("p").agg(F.array_sort(F.collect_list(F.struct(F.least("c", F.col("k") - F.col("c")).alias("r"), "t", (F.col("c") * 2 > F.col("k")).alias("f")))).alias("l"))
    listed = listed.select("p", F.col("l.t").alias("often"), F.filter("l", lambda x: x["f"])["t"].alias("flips"))
    none = F.array().cast("array<bigint>")
    centred = many.join(listed, "p", "left").withColumns({"often": F.coalesce("often", none), "flips": F.coalesce("flips", none)}).withColumn("d", _either("d", "flips"))
    ordered = F.concat(F.array_sort(F.array_except("d", "often")), F.array_intersect("often", "d"))
    centred = keep(centred.select("p", "node", "n", F.size("d").alias("m"), (F.size("d") * SPAN - F.col("n") * STEP).alias("x"), ordered.alias("d")), "centred")
    middle = centred.groupBy("p").agg(F.min(F.struct("x", "node")).alias("c"), F.max("n").alias("most"))
    roled = centred.join(middle, "p").withColumn("core", F.col("x") + F.col("c.x") <= 0)
    cores = roled.filter(F.col("core") & (F.col("node") != F.col("c.node"))).select(F.col("c.node").alias("u"), F.col("node").alias("v"))

    # Pairs with a common shingle in their differences, not both in the core.  ``low``: the least difference of a partner.
    strays = roled.filter(~F.col("core")).groupBy("p").agg(F.min("m").alias("stray"))
    roled = keep(roled.select("p", "node", "n", "m", "d", "core", "most").join(strays, "p"), "roles")
    room = F.expr(f"(n + least(n * {SIMILAR[1]} div {SIMILAR[0]}, most)) * {STEP} div {SPAN}")
    low = F.when(F.col("core"), F.col("stray")).otherwise(0)
    common = F.floor((F.col("m") + F.col("low") - F.col("room") + 1) / 2)
    roled = roled.withColumn("room", room)
    prefix = F.greatest(F.lit(0), F.least(F.col("m"), F.col("m") - common + 1)).cast("int")
    shorter = roled.withColumn("low", F.greatest(F.col("m"), low)).withColumn("prefix", prefix)
    longer = roled.filter(~F.col("core") | (F.col("m") >= F.col("stray"))).withColumn("low", F.greatest(F.col("m") - F.col("room"), low)).withColumn("prefix", prefix)

    def tokens(side: DataFrame, s: str) -> DataFrame:
        cut = side.filter("prefix > 0").select("p", "node", "n", "m", "core", F.posexplode(F.slice("d", 1, F.col("prefix"))).alias("at", "t"))
        return cut.select("p", "t", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "m", "core", "at")))

    shared = F.expr(f"(m_a + m_b - (n_a + n_b) * {STEP} div {SPAN} + 1) div 2")
    met = tokens(shorter, "a").join(tokens(longer, "b"), ["p", "t"]).filter(
        ~(F.col("core_a") & F.col("core_b"))
        & ((F.col("m_a") < F.col("m_b")) | ((F.col("m_a") == F.col("m_b")) & (F.col("node_a") < F.col("node_b"))))
        & (shared >= 1)
        & (F.col("at_a") + shared <= F.col("m_a"))
        & (F.col("at_b") + shared <= F.col("m_b"))
    )
    pairs = met.select("p", F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct()
    side = roled.select("p", "node", "n", "m", "d")
    for s in ("u", "v"):
        pairs = pairs.join(side.select("p", *(F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in ("node", "n", "m", "d"))), ["p", s])
    differ = F.col("m_u") + F.col("m_v") - 2 * F.size(F.array_intersect("d_u", "d_v"))
    found = pairs.filter(differ * SPAN <= (F.col("n_u") + F.col("n_v")) * STEP).select("u", "v")
    return stars.unionAll(cores).unionAll(found).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """``id``, ``root``: for every id with words, the least id of its class of near-duplicates."""
    known = materialize(sketches(docs.filter(F.col(id_col).isNotNull()), size, id_col, text_col), "sketches")
    same = known.groupBy("w", "mark").agg(F.min("id").alias("least"), F.any_value("codes").alias("codes"))
    nodes = materialize(same.withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    spent: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        spent.append(materialize(df, name))
        return spent[-1]

    classes = components(_links(nodes, docs, size, id_col, text_col, keep))
    discard(*spent)
    rooted = materialize(nodes.select("node", "w", "mark", "least").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    discard(nodes)
    named = rooted.groupBy("root").agg(F.min("least").alias("name"))
    of = rooted.join(named, "root").select("w", "mark", "name")
    return known.select("id", "w", "mark").join(of, ["w", "mark"]).select("id", F.col("name").alias("root"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs``, all columns, but those that have a near-duplicate of smaller id.

    Rows with a null id or without words always stay; of rows with one id all stay or go.
    """
    gone = near_duplicates(docs, size, id_col, text_col).filter("id <> root").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")

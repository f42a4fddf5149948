"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference, cut into blocks of a few megabytes.  A block
is indexed by anchors: the smallest hash among the word groups inside each
window, so equal windows always share their anchor wherever they stand.

* Parse against the own block: windows that already occur earlier in the block
  are settled there; of equal windows only the first one leaves the block, so
  a passage that a third of all documents share costs one entry a block.
* Parse against every other block: entries meet their equals through a shuffle
  by anchor hash.  An anchor that occurs once drops out with all its windows;
  under the others, windows are compared one by one.  Windows of a frequent
  anchor, found by a count beforehand, are dealt by their own hash instead, so
  a phrase that a third of all documents use fills no task.
* Greedy factors: settled windows of a document whose sources are consecutive
  join into maximal factors.  Windows that run over a factor's boundary were
  looked up on their own, so no repeat hides there.

A factor of at least ``window`` words is a duplicate span.  Order of documents:
smaller id first, null ids last, then a hash of the text; rows with equal id
and text are one document.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; other columns are untouched, whatever their names; an empty table
gives no row; long texts are hashed a megabyte at a time and indexed in pieces
that overlap by a window less one word; of equal windows the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard
from .common import materialize, shuffle_width, tidy

WINDOW = 20
GROUP = 6
#: Words of a reference block, and bytes of a text that are split at a time.
BLOCK_WORDS = 250_000
BLOCK_BYTES = 1 << 20
#: Odd multipliers of the rolling hashes and of the finishing mix.
ROLL_A = 0x9E3779B97F4A7C15
ROLL_B = 0xC2B2AE3D27D4EB4F
MIX_A = 0xFF51AFD7ED558CCD
MIX_B = 0xC4CEB9FE1A85EC53
MASK = (1 << 64) - 1

#: An anchor is frequent when it holds one run in so many for each shuffle partition; runs in a block from which it is counted.
FREQUENT = 4
COUNTED = 4

ENTRY = "part int, entry binary, bucket int, spans binary"
SPAN = np.dtype([("at", "<i4"), ("n", "<i4"), ("ref", "<i8"), ("ref_at", "<i4")])
RUN = np.dtype([("anchor", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("n", "u1")])
KEY = np.dtype([("kid", "<i8"), ("dg", "<i8")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(33))


def rolled(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries, by doubling."""
    out, have, power = None, 0, h
    width = 1
    while True:
        if size & width:  # append a run of ``width`` entries after the ``have`` collected ones
            out = power if out is None else out[: len(out) - width] * np.uint64(pow(base, width, 1 << 64)) + power[have : have + len(out) - width]
            have += width
        if width * 2 > size:
            return mixed(out)
        power = power[: len(power) - width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
        width *= 2


def sliding_min(v: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive entries."""
    width = 1
    while width * 2 <= size:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    rest = size - width
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def blocks_of(raw: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words of a text, a megabyte at a time."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            ends = [e for e in (raw.find(b" ", end), raw.find(b"\n", end)) if e >= 0]
            end = min(ends, default=len(raw))
        yield raw[at:end].split()
        at = end


def word_hashes(raw: bytes) -> np.ndarray:
    parts = []
    for words in blocks_of(raw):
        if words:
            held = np.empty(len(words), object)
            held[:] = words
            parts.append(hash_array(held, categorize=False))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def segments(docs: Iterable[tuple[int, int, bytes]], window: int) -> Iterator[list[tuple[int, int, int, np.ndarray]]]:
    """Blocks of (kid, dg, first word, word hashes); long documents overlap by a window less one word."""
    held, size = [], 0
    for kid, dg, raw in docs:
        h = word_hashes(raw)
        step = BLOCK_WORDS
        for at in range(0, max(0, len(h) - window + 1), step):
            piece = h[at : at + step + window - 1]
            if size and size + len(piece) > BLOCK_WORDS:
                yield held
                held, size = [], 0
            held.append((kid, dg, at, piece))
            size += len(piece)
    if held:
        yield held


def joined_runs(*columns: np.ndarray, steps: int = 1) -> np.ndarray:
    """Starts of maximal runs: the last ``steps`` columns grow by one, the others stay."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        go = np.ones(len(new) - 1, bool)
        for k, c in enumerate(columns):
            go &= c[1:] == c[:-1] + (c.dtype.type(1) if k >= len(columns) - steps else c.dtype.type(0))
        new[1:] = ~go
    return np.flatnonzero(new)


def windows_of(pieces: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, piece, place in it and anchor of every window that lies inside one piece; and where it begins."""
    size = np.array([len(h) for h in pieces])
    h = np.concatenate(pieces)
    n = size - window + 1
    piece = np.repeat(np.arange(len(pieces)), n)
    own = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[piece] + own
    return h, piece, own, at


def anchors_of(h: np.ndarray, window: int, at: np.ndarray) -> np.ndarray:
    return sliding_min(rolled(h, GROUP, ROLL_A), window - GROUP + 1)[at]


def counted_anchors(block, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Anchors of several runs of a block, how many each has, and how many runs there are."""
    h, piece, own, at = windows_of([s[3] for s in block], window)
    anchor = anchors_of(h, window, at)
    starts = joined_runs(anchor, piece, own)
    found, n = np.unique(anchor[starts], return_counts=True)
    return found[n >= COUNTED], n[n >= COUNTED], len(starts)


def index_block(block, window: int, parts: int, frequent: np.ndarray | None = None):
    """Settled spans by document, and entries by partition, of one block."""
    block = sorted(block, key=lambda s: s[:3])
    keys: dict[tuple[int, int], int] = {}
    pieces, doc, first = [], [], []
    seen = set()
    for kid, dg, at, h in block:
        if (kid, dg, at) not in seen:  # equal id and text: one document
            seen.add((kid, dg, at))
            doc.append(keys.setdefault((kid, dg), len(keys)))
            first.append(at)
            pieces.append(h)
    h, piece, own, at = windows_of(pieces, window)
    anchor = anchors_of(h, window, at)
    whole = rolled(h ^ np.uint64(MIX_A), window, ROLL_B)[at]
    doc_of = np.array(doc, np.uint32)[piece]
    place = (np.array(first)[piece] + own).astype(np.uint32)
    del h, at, piece, own

    order = np.argsort(whole, kind="stable")
    same = np.zeros(len(order), bool)
    w, a = whole[order], anchor[order]
    same[1:] = (w[1:] == w[:-1]) & (a[1:] == a[:-1])
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    later, source = order[same], head[same]
    del w, a, head
    table = np.array(list(keys), dtype=np.int64).reshape(-1, 2)
    settled = spans_by_doc(doc_of[later].astype(np.int64), place[later], doc_of[source].astype(np.int64), place[source], table)

    left = np.ones(len(whole), bool)
    left[later] = False
    left = np.flatnonzero(left)
    anchor, whole, doc_of, place = anchor[left], whole[left], doc_of[left], place[left]
    runs = joined_runs(anchor, doc_of, place)
    hot = np.zeros(len(anchor), bool) if frequent is None else np.isin(anchor, frequent)
    if hot.any():  # windows of frequent anchors are runs of their own
        edge = np.zeros(len(anchor) + 1, bool)
        edge[runs] = True
        edge[:-1] |= hot
        edge[1:] |= hot
        runs = np.flatnonzero(edge[:-1])
    length = np.diff(np.append(runs, len(anchor)))
    if len(length) and length.max() > 255:  # a run's length takes one byte
        runs = np.concatenate([np.arange(r, r + k, 255) for r, k in zip(runs, length, strict=True)])
        length = np.diff(np.append(runs, len(anchor)))
    part = (np.where(hot[runs], whole[runs], anchor[runs]) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[by], np.arange(parts + 1))
    entries = []
    whole = whole.astype("<u8")
    for p in range(parts):
        mine = by[edges[p] : edges[p + 1]]
        if len(mine):
            entries.append((p, pack_entry(mine, runs, length, anchor, whole, doc_of, place, table)))
    return settled, entries


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every run, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def pack_entry(mine, runs, length, anchor, whole, doc_of, place, table) -> bytes:
    """Keys, runs, and the hash of each window."""
    docs, doc = np.unique(doc_of[runs[mine]], return_inverse=True)
    out = np.empty(len(mine), RUN)
    out["anchor"], out["doc"], out["at"], out["n"] = anchor[runs[mine]], doc, place[runs[mine]], length[mine]
    windows = whole[ragged(runs[mine], length[mine])]
    return b"".join(
        (
            np.array([len(docs), len(mine), len(windows)], "<i8").tobytes(),
            table[docs].astype("<i8").tobytes(),
            out.tobytes(),
            windows.tobytes(),
        )
    )


def unpack_entry(raw: bytes):
    d, r, w = np.frombuffer(raw, "<i8", 3)
    keys = np.frombuffer(raw, KEY, d, 24)
    runs = np.frombuffer(raw, RUN, r, 24 + 16 * d)
    windows = np.frombuffer(raw, "<u8", w, 24 + 16 * d + RUN.itemsize * r)
    return keys, runs, windows


def spans_by_doc(doc, place, ref_doc, ref_place, table: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Greedy factors: settled windows whose places and sources go on side by side, gathered by document."""
    if not len(doc):
        return []
    order = np.lexsort((place, doc))
    doc, place, ref_doc, ref_place = doc[order], place[order].astype(np.int64), ref_doc[order], ref_place[order].astype(np.int64)
    runs = joined_runs(doc, ref_doc, place, ref_place, steps=2)
    out = np.empty(len(runs), SPAN)
    out["at"], out["n"] = place[runs], np.diff(np.append(runs, len(doc)))
    out["ref"], out["ref_at"] = table[ref_doc[runs], 0], ref_place[runs]
    owner = doc[runs]
    edge = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
    return [(int(table[owner[i], 0]), int(table[owner[i], 1]), out[i:j].tobytes()) for i, j in zip(edge[:-1], edge[1:], strict=True)]


def settle(entries: list[bytes]) -> list[tuple[int, int, bytes]]:
    """Spans of the windows of one anchor partition that occur earlier in some block."""
    keys, runs, windows, at = [], [], [], 0
    for raw in entries:
        k, r, w = unpack_entry(raw)
        r = r.copy()
        r["doc"] += at
        at += len(k)
        keys.append(k), runs.append(r), windows.append(w)
    if not keys:
        return []
    keys, runs = np.concatenate(keys), np.concatenate(runs)
    table, rank = np.unique(keys, return_inverse=True)
    order = np.argsort(runs["anchor"], kind="stable")
    a = runs["anchor"][order]
    many = np.zeros(len(a), bool)
    many[1:] = a[1:] == a[:-1]
    many[:-1] |= many[1:].copy()
    mine = np.sort(order[many])
    if not len(mine):
        return []
    size = runs["n"].astype(np.int64)
    starts = np.cumsum(size) - size
    pick = ragged(starts[mine], size[mine])
    edges = np.cumsum([0, *(len(w) for w in windows)])
    whole = np.empty(len(pick), np.uint64)
    lo = np.searchsorted(pick, edges)
    for k, w in enumerate(windows):
        whole[lo[k] : lo[k + 1]] = w[pick[lo[k] : lo[k + 1]] - edges[k]]
    anchor = np.repeat(runs["anchor"][mine], size[mine])
    doc = np.repeat(rank.ravel()[runs["doc"][mine]], size[mine])
    place = np.repeat(runs["at"][mine].astype(np.int64), size[mine]) + ragged(np.zeros(len(mine), np.int64), size[mine])
    order = np.lexsort((place, doc, whole, anchor))
    anchor, whole, doc, place = anchor[order], whole[order], doc[order], place[order]
    same = np.zeros(len(order), bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = same & ((doc != doc[head]) | (place != place[head]))
    pairs = np.stack([table["kid"], table["dg"]], axis=1)
    return spans_by_doc(doc[later], place[later], doc[head[later]], place[head[later]], pairs)


def pack_spans(found: list[tuple[int, int, bytes]], parts: int) -> list[tuple[int, bytes]]:
    """Spans of many documents as one record for each bucket of documents."""
    by: dict[int, list[tuple[int, int, bytes]]] = {}
    for row in found:
        by.setdefault((row[0] ^ row[1]) % parts, []).append(row)
    return [
        (b, b"".join([np.array([len(rows)], "<i8").tobytes(), np.array([(k, d, len(s)) for k, d, s in rows], "<i8").tobytes(), *(s for _, _, s in rows)]))
        for b, rows in sorted(by.items())
    ]


def unpack_spans(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at = 8 + 24 * n
    for kid, dg, size in np.frombuffer(raw, "<i8", 3 * n, 8).reshape(-1, 3).tolist():
        yield kid, dg, raw[at : at + size]
        at += size


def _named(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """``_kid`` (null ids last) and ``_dg``, which together name a document."""
    text = F.col(text_col).cast("string")
    return {"_kid": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "_dg": F.xxhash64(text, F.col(id_col).isNull())}


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def _batch(*columns: tuple[str, pa.DataType, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for _, kind, values in columns], names=[name for name, _, _ in columns])


def find_spans(docs: DataFrame, window: int = WINDOW, id_col="doc_id", text_col="text") -> DataFrame:
    """Settled spans, one row for each document that has any: kid, dg, spans (packed ``SPAN`` records)."""
    parts = shuffle_width(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            kid, dg, raw = batch.columns
            for i in range(batch.num_rows):
                yield kid[i].as_py(), dg[i].as_py(), raw[i].as_py()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(counted(batches))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in segments(rows(batches), window):
            found, n, total = counted_anchors(block, window)
            yield _batch(("anchor", pa.int64(), [*found.view(np.int64).tolist(), None]), ("n", pa.int64(), [*n.tolist(), total]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(indexed(batches))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in segments(rows(batches), window):
            settled, entries = index_block(block, window, parts, frequent)
            known = pack_spans(settled, parts)
            none = [None] * len(known), [None] * len(entries)
            yield _batch(
                ("part", pa.int32(), [p for p, _ in entries] + [b for b, _ in known]),
                ("entry", pa.binary(), [e for _, e in entries] + none[0]),
                ("bucket", pa.int32(), none[1] + [b for b, _ in known]),
                ("spans", pa.binary(), none[1] + [s for _, s in known]),
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(met_of(batches))

    def met_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            entry = batch.column("entry")
            through = batch.filter(entry.is_null()).select(["bucket", "spans"])
            if through.num_rows:
                yield through
            for p, e in zip(batch.column("part").to_pylist(), entry.to_pylist(), strict=True):
                if e is not None:
                    held.setdefault(p, []).append(e)
        for p in list(held):
            known = pack_spans(settle(held.pop(p)), parts)
            yield _batch(("bucket", pa.int32(), [b for b, _ in known]), ("spans", pa.binary(), [s for _, s in known]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(gathered(batches))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for raw in batch.column("spans").to_pylist():
                for kid, dg, own in unpack_spans(raw):
                    by.setdefault((kid, dg), []).append(own)
        keys = list(by)
        for at in range(0, len(keys), 2_000):
            some = keys[at : at + 2_000]
            yield _batch(("kid", pa.int64(), [k for k, _ in some]), ("dg", pa.int64(), [d for _, d in some]), ("spans", pa.binary(), [b"".join(by[k]) for k in some]))

    keyed = docs.select(*(c.alias(n) for n, c in _named(docs, id_col, text_col).items()), _bytes(text_col).alias("_raw"))
    # At most ``FREQUENT * parts`` anchors come back.
    runs = materialize(keyed.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = runs.filter("anchor is null").first()
    often = runs.filter(F.col("anchor").isNotNull() & (F.col("n") * (FREQUENT * parts) > (total["n"] if total else 0))).select("anchor").collect()
    discard(runs)
    frequent = np.array([r["anchor"] for r in often], np.int64).view(np.uint64)
    met = keyed.mapInArrow(index, ENTRY).repartitionById(parts, F.col("part")).mapInArrow(meet, "bucket int, spans binary")
    return met.repartitionById(parts, F.col("bucket")).mapInArrow(gather, "kid long, dg long, spans binary")


def removal_mask(n: int, spans: bytes, window: int) -> np.ndarray | None:
    """Which of ``n`` words a settled window covers; None: none."""
    found = np.frombuffer(spans, SPAN)
    if not len(found):
        return None
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, found["at"], 1)
    np.add.at(turn, found["at"] + found["n"] + window - 1, -1)
    return np.cumsum(turn[:n]) > 0


#: White space of the contract.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def cut(raw: bytes, gone: np.ndarray) -> bytes:
    """``raw`` without the words marked in ``gone``, other white space as it was."""
    inside = ~SPACE[np.frombuffer(raw, np.uint8)]
    turn = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    stop = np.append(begin[1:], len(raw))  # a word takes the white space after it along
    keep = np.ones(len(raw) + 1, np.int64)
    keep[:] = 0
    np.add.at(keep, begin[gone], 1)
    np.add.at(keep, stop[gone], -1)
    out = np.frombuffer(raw, np.uint8)[np.cumsum(keep[:-1]) == 0].tobytes()
    return out.rstrip() if len(gone) and gone[-1] else out


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col="doc_id", text_col="text", joined: bool = True, columns=("n_words", "n_removed", "kept")) -> DataFrame:
    """Every row of ``docs`` with all its columns and three more, named by ``columns``: words, removed words, what is kept.

    Kept: the words that stay, joined by one space, or with their own white
    space where ``joined`` is False.  Columns of ``docs`` that have one of the
    three names are replaced; no other name can clash.
    """
    spans = find_spans(docs, window, id_col, text_col)

    @F.pandas_udf("n long, lost long, kept string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, all_spans in batches:
            rows = []
            for raw, own in zip(raws, all_spans, strict=True):
                words = raw.split()
                gone = removal_mask(len(words), own, window) if own else None
                lost = 0 if gone is None else int(gone.sum())
                if joined:
                    kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                else:
                    kept = raw if gone is None else cut(raw, gone)
                rows.append((len(words), lost, kept.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["n", "lost", "kept"])

    # One column holds the row, so that whatever its columns are called, and the text crosses the join once.
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in _named(docs, id_col, text_col).items()))
    both = row.join(spans.hint("shuffle_hash"), (F.col("_kid") == F.col("kid")) & (F.col("_dg") == F.col("dg")), "left")
    out = both.select("row", apply(_bytes(f"row.`{text_col}`"), F.col("spans")).alias("out"))
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in columns]
    return out.select(*own, *(F.col(f"out.{c}").alias(n) for c, n in zip(("n", "lost", "kept"), columns, strict=True)))


def digest(docs: DataFrame, window: int = WINDOW, id_col="doc_id", text_col="text") -> DataFrame:
    """The contract's rows: id, n_words, n_removed, kept_sha256."""
    out = remove_repeats(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)), window, id_col, text_col)
    return out.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

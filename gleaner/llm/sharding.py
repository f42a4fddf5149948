"""Sharding as vector bin packing: bytes, tokens and rows balanced together.

Equal texts form a group, and groups are placed whole as long as a shard has
room for their bytes.  The driver never sees all groups: small ones are hashed
into a fixed number of cells; a group that is large against a cell is a cell of
its own.  Large groups are placed first, from large to small, then the cells,
each on the shard whose residual capacity has the largest dot product with it,
and a last pass moves the smallest cells from the fullest to the emptiest shard
while that evens the bytes.  Only a group whose bytes no shard can hold any more
is dealt to cells by row.  Law: ``bytes``.

Everything after one pass over the texts works on a narrow table of digests,
written once; hot groups are pre-aggregated before any shuffle.

Defined results: null text counts as empty (size 16, crc 0) and forms a group;
null ids and repeated rows are placed like others; a text of any length is one
row and never cut; shards of equal dot product go by number, cells of equal size
by name; an empty table gives no row; columns of other names are no input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
#: Hashed cells for each shard; groups of more than a HOT-th of a shard are cells of their own; pieces of a shard's
#: size that a group is cut into which fits none.
FINE = 128
HOT = 64
PIECES = 8
OVERHEAD = 16
WORD = r"[^\x20\x09-\x0D]+"


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row for each row of ``docs``; ``row`` is unique and, once written, stable."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.md5(text.cast("binary"))).alias("g"),
        F.monotonically_increasing_id().alias("row"),
    )


def place(groups: np.ndarray, shards: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each large group (rows: bytes, tokens, rows), -1 where its bytes fit none, and the room that is left."""
    room = np.ones((shards, 3))
    out = np.full(len(groups), -1, np.int64)
    need = groups * shards / np.maximum(total, 1)
    for i in np.lexsort((np.arange(len(need)), -need[:, 0])):
        fits = room[:, 0] >= need[i, 0] - 1e-9
        if fits.any():
            out[i] = int(np.where(fits, room @ need[i], -np.inf).argmax())
            room[out[i]] -= need[i]
    return out, room


def fill(cells: np.ndarray, room: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shard of each cell, on top of what takes up ``room`` already."""
    need = cells * len(room) / np.maximum(total, 1)
    out = np.zeros(len(need), np.int64)
    for i in np.lexsort((np.arange(len(need)), -need.max(axis=1), -need[:, 0])):
        fits = (room >= need[i] - 1e-9).all(axis=1)
        gain = room @ need[i]
        best = int(np.where(fits, gain, -np.inf).argmax()) if fits.any() else int(gain.argmax())
        out[i] = best
        room[best] -= need[i]
    return even(need, out, room)


def even(need: np.ndarray, out: np.ndarray, room: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """Move cells from the fullest shard to the emptiest while the bytes get more even."""
    for _ in range(rounds):
        full, empty = int(room[:, 0].argmin()), int(room[:, 0].argmax())
        gap = room[empty, 0] - room[full, 0]
        own = np.flatnonzero(out == full)
        good = own[(need[own, 0] > 0) & (need[own, 0] < gap)]
        if not len(good) or gap < 1e-4:
            break
        i = good[np.abs(need[good, 0] - gap / 2).argmin()]
        out[i] = empty
        room[full] += need[i]
        room[empty] -= need[i]
    return out


def assign(docs: DataFrame, shards: int = SHARDS, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    held = materialize(digests(docs, id_col, text_col), "digests")
    sums = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    whole = held.agg(*sums).first()
    total = np.array([whole["b"] or 0, whole["t"] or 0, whole["n"]], float)
    most = max(1, int(total[0]) // (shards * HOT))
    # Groups above ``most`` bytes: at most shards * HOT of them.
    large = held.groupBy("g").agg(*sums).filter(F.col("b") > most).orderBy(F.desc("b"), "g").collect()
    where, room = place(np.array([[r["b"], r["t"], r["n"]] for r in large], float).reshape(-1, 3), shards, total)
    cuts = [1 if s >= 0 else -(-int(r["b"]) // (most * (HOT // PIECES))) for r, s in zip(large, where, strict=True)]
    hot = F.broadcast(spark.createDataFrame([(bytes(r["g"]), int(c)) for r, c in zip(large, cuts, strict=True)], "hot binary, cuts long"))
    cell = F.when(F.col("cuts").isNull(), F.concat(F.lit("s"), F.pmod(F.xxhash64("g"), F.lit(shards * FINE)))).otherwise(F.concat(F.lit("h"), F.hex("g"), F.lit("/"), F.pmod(F.xxhash64("row"), F.col("cuts"))))
    celled = held.join(hot, F.col("g") == F.col("hot"), "left").select("id", "size", "tokens", "crc", "row", cell.alias("cell"))
    # At most shards * (FINE + 2 * HOT) cells; those of whole groups have their place.
    fixed = {f"h{bytes(r['g']).hex().upper()}/0": int(s) for r, s in zip(large, where, strict=True) if s >= 0}
    loose = [r for r in celled.groupBy("cell").agg(*sums).orderBy("cell").collect() if r["cell"] not in fixed]
    own = fill(np.array([[r["b"], r["t"], r["n"]] for r in loose], float).reshape(-1, 3), room, total)
    known = [*fixed.items(), *((r["cell"], int(s)) for r, s in zip(loose, own, strict=True))]
    placed = F.broadcast(spark.createDataFrame(known, "cell string, shard int"))
    out = celled.join(placed, "cell").select("id", "size", "crc", "row", "shard", F.shiftright("row", 33).alias("part"))
    # Slots: numbered inside each written partition, then shifted by the partitions before it.
    counts = out.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = out.withColumn("k", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1)
    return own.join(base, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("k")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

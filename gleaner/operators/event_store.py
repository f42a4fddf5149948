"""The event log as a store: exactly-once appends with dense ids, deletion by URL, and substring search by trigrams.

The log is a folder of segments and of numbered manifests.  An append writes a
segment, its ids going on from the last one, and then publishes the manifest
that names it.  A batch of a stream carries its number; the manifest remembers
the last number of every stream, so a batch that is played again after a crash
adds no row, and a segment that no manifest names was never there.  Deleting a
URL adds its name and the last id it is gone up to; readers merge.

Beside every segment lie its trigrams: for each three characters in a row of a
lower-cased URL the files that hold them.  A search for a substring intersects
the files of its trigrams and reads only those, newest segments first, until it
has what it wants; what it reads is verified by the pattern itself.

Defined results: patterns whose literal parts have fewer than three characters
have no trigrams, and all files are candidates; events without a URL match no
pattern and are never deleted by URL; an empty append is remembered as its
batch and adds no segment.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENTS
from ..session import discard, settled
from . import events
from .versions import Versions

#: Folders that the trigrams of a segment are dealt to, and events of a file about.
GRAM_FOLDERS = 16
FILE_ROWS = 500_000
#: Segments above which an append asks for a merge of the small ones, and events up to which a segment is small.
SEGMENTS = 64
SMALL = 1_000_000
#: Deleted URLs up to which they are broadcast; the manifest counts them.
BROADCAST_URLS = 100_000
ORDER = ["ts", "event_type", "url", "outcome", "reason", "details_json"]


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text."""
    t = F.lower(text)
    last = F.length(t) - 2
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def literal_parts(pattern: str) -> list[str]:
    """What a pattern wants literally: the parts between its wildcards ``%`` and ``_``."""
    return [p for p in re.split(r"[%_]", pattern) if len(p) >= 3]


class EventStore(Versions):
    """An event log under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path.rstrip("/"), "events")

    def _held(self, version: int | None = None) -> tuple[int, dict]:
        version = self.version() if version is None else version
        return (0, {"segments": [], "gone": [], "streams": {}, "last": 0}) if version is None else (version, self._read_version(version))

    # ------------------------------------------------------------- reading

    def _alive(self, rows: DataFrame, held: dict) -> DataFrame:
        """``rows`` without those of deleted URLs."""
        if not held["gone"]:
            return rows
        gone = self.spark.read.schema("_url string, _upto long").parquet(*(f"{self.root}/{g['folder']}" for g in held["gone"]))
        last = gone.groupBy("_url").agg(F.max("_upto").alias("_upto"))
        last = F.broadcast(last) if sum(g["urls"] for g in held["gone"]) <= BROADCAST_URLS else last
        return rows.join(last, (F.col("url") == F.col("_url")) & (F.col("id") <= F.col("_upto")), "left_anti")

    def _rows(self, paths: list[str], held: dict) -> DataFrame:
        if not paths:
            return events.empty(self.spark)
        return self._alive(self.spark.read.schema(EVENTS).parquet(*paths), held)

    def read(self, version: int | None = None) -> DataFrame:
        """All events of a version, the newest by default."""
        _, held = self._held(version)
        return self._rows([f"{self.root}/{s['folder']}" for s in held["segments"]], held)

    def files(self, url_filter: str, version: int | None = None) -> list[str] | None:
        """Files that may hold a URL like the filter, newest segments first; None: all."""
        wanted = sorted({g for part in literal_parts(url_filter) for g in self.spark.range(1).select(grams(F.lit(part))).first()[0]})
        _, held = self._held(version)
        if not wanted or not held["segments"]:
            return None
        folders = sorted({r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(self._folder(F.col("gram"))).collect()})
        paths = [p for s in held["segments"] for k in folders if self._fs().exists(self._path(p := f"grams/{s['folder']}/f={k}"))]
        if not paths:
            return []
        held_grams = self.spark.read.schema("gram string, file string").parquet(*(f"{self.root}/{p}" for p in paths))
        found = held_grams.filter(F.col("gram").isin(wanted)).groupBy("file").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(wanted))
        place = {s["folder"]: k for k, s in enumerate(held["segments"])}
        return sorted((r["file"] for r in found.collect()), key=lambda f: -place[f.split("/")[0]])  # names of files, no rows

    def recent(self, limit: int = 200, event_types: list[str] | None = None, url_filter: str | None = None, version: int | None = None) -> DataFrame:
        """Newest first, as :func:`gleaner.operators.events.recent` says of the whole log; reads no more segments and files than it takes."""
        _, held = self._held(version)
        files = self.files(url_filter, version) if url_filter else None
        by_segment: dict[str, list[str]] = {s["folder"]: [] if files is not None else [s["folder"]] for s in held["segments"]}
        for f in files or []:
            by_segment[f.split("/")[0]].append(f)
        left, take = [by_segment[s["folder"]] for s in reversed(held["segments"]) if by_segment[s["folder"]]], 1
        while True:  # twice as many segments each time
            rows = self._rows([f"{self.root}/{p}" for own in left[:take] for p in own], held)
            found = events.recent(rows, limit, event_types, url_filter)
            if take >= len(left) or found.count() >= limit:
                return found
            take *= 2

    # ------------------------------------------------------------- writing

    @staticmethod
    def _folder(gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(GRAM_FOLDERS)).cast("int")

    def _segment(self, rows: DataFrame, first: int, n: int) -> dict:
        """Write numbered rows as a segment, in files by id, and its trigrams."""
        folder = f"s-{first:016d}-{uuid.uuid4().hex}"
        parts = max(1, -(-n // FILE_ROWS))
        rows.repartitionByRange(parts, "id").sortWithinPartitions("id").write.parquet(f"{self.root}/{folder}")
        back = self.spark.read.schema(EVENTS).parquet(f"{self.root}/{folder}")
        name = F.concat(F.lit(f"{folder}/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        held = back.filter("url is not null").select("url", name.alias("file")).distinct().select("file", F.explode(grams(F.col("url"))).alias("gram")).distinct()
        held.withColumn("f", self._folder(F.col("gram"))).repartition(GRAM_FOLDERS, "f").sortWithinPartitions("gram").write.partitionBy("f").parquet(f"{self.root}/grams/{folder}")
        return {"folder": folder, "rows": n}

    def append(self, new: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Append events (without ids), numbered on in order of time; returns how many.

        With a ``stream`` and the number of its ``batch`` a batch is added once,
        however often it comes.
        """
        version, held = self._held()
        if stream is not None and held["streams"].get(stream, -1) >= batch:
            return 0
        numbered = settled(events.numbered(new.select(*ORDER), ORDER, "id", held["last"]).select(*events.empty(self.spark).columns), "appended")
        n = numbered.count()
        segments = [*held["segments"], self._segment(numbered, held["last"] + 1, n)] if n else held["segments"]
        discard(numbered)
        streams = held["streams"] | ({} if stream is None else {stream: batch})
        self._publish(version + 1, held | {"segments": segments, "streams": streams, "last": held["last"] + n})
        if len(segments) > SEGMENTS:
            self.merge()
        return n

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch`` that appends each batch of the named stream exactly once."""

        def keep(batch: DataFrame, number: int) -> None:
            self.append(batch, stream, number)

        return keep

    def delete_urls(self, urls: list[str]) -> int:
        """Delete the events of URLs so far; returns how many.  What is written grows with the URLs only."""
        version, held = self._held()
        n = self.read().filter(F.col("url").isin(urls)).count()
        if n:
            folder = f"gone-{uuid.uuid4().hex}"
            self.spark.createDataFrame([(u, held["last"]) for u in urls], "_url string, _upto long").coalesce(1).write.parquet(f"{self.root}/{folder}")
            self._publish(version + 1, held | {"gone": [*held["gone"], {"folder": folder, "urls": len(urls)}]})
        return n

    def merge(self, small: int = SMALL, everything: bool = False) -> int | None:
        """Rewrite neighbouring small segments as one (``everything``: all), without deleted events; the new version, if there is one."""
        version, held = self._held()
        runs: list[list[dict]] = []
        for s in held["segments"]:
            if everything or (s["rows"] <= small and runs and runs[-1][-1]["rows"] <= small):
                if runs:
                    runs[-1].append(s)
                    continue
            runs.append([s])
        if not any(len(r) > 1 for r in runs) and not (everything and held["gone"]):
            return None
        segments = []
        for run in runs:
            if len(run) == 1 and not everything:
                segments += run
                continue
            rows = settled(self._rows([f"{self.root}/{s['folder']}" for s in run], held), "merged")
            if n := rows.count():
                segments.append(self._segment(rows, int(run[0]["folder"].split("-")[1]), n))
            discard(rows)
        return self._publish(version + 1, held | {"segments": segments, "gone": [] if everything else held["gone"]})

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions and the folders that only those used; returns how many folders went."""
        kept = [self._read_version(v) for v in self._forget(keep)]
        used = {s["folder"] for m in kept for s in m["segments"]} | {g["folder"] for m in kept for g in m["gone"]}
        gone = self._sweep([n for n in self._names() if n.startswith(("s-", "gone-"))], used)
        self._sweep([f"grams/{n}" for n in self._names("grams")], {f"grams/{u}" for u in used})
        return gone

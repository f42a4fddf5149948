"""Numbered manifests in a folder: what a writer publishes at once, and readers see whole or not at all."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Versions:
    """A folder of ``manifest-<number>.json``; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root, name

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str = "") -> list[str]:
        fs, at = self._fs(), self._path(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        """Published versions, in order."""
        return sorted(int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in self._names()) if m)

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def _read_version(self, version: int) -> dict:
        stream = self._fs().open(self._path(f"manifest-{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> int:
        """Make ``manifest`` the version ``number``; an error where another writer did."""
        fs = self._fs()
        draft, final = self._path(f".draft-{uuid.uuid4().hex}"), self._path(f"manifest-{number:010d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer published version {number} of {self.name}")
        return number

    def _forget(self, keep: int) -> list[int]:
        """Delete all but the last ``keep`` manifests; returns the versions that are left."""
        versions, fs = self.versions(), self._fs()
        for v in versions[: -max(1, keep)]:
            fs.delete(self._path(f"manifest-{v:010d}.json"), False)
        return versions[-max(1, keep) :]

    def _sweep(self, folders: list[str], used: set[str | None]) -> int:
        """Delete those of ``folders`` that nothing uses; returns how many."""
        fs = self._fs()
        return sum(bool(fs.delete(self._path(f), True)) for f in folders if f not in used)

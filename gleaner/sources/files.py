"""File sources and sinks: URL lists, local text, saved results, pages, PDFs, read-only views."""

from __future__ import annotations

from collections.abc import Callable
from io import BytesIO
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXTRACTION, chunk_violations, extraction_violations
from ..session import settled


def clean_urls(lines: DataFrame) -> DataFrame:
    """``url`` of trimmed lines (column value) that are neither blank nor comments."""
    url = F.regexp_replace(F.col("value"), r"(?U)^\s+|\s+$", "")
    return lines.select(url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return clean_urls(spark.read.text(path))


def write_urls(urls: DataFrame, path: str) -> None:
    """Write a cleaned list; nothing left to write is an error."""
    clean = clean_urls(urls.select(F.col(urls.columns[0]).alias("value")))
    if not clean.limit(1).count():
        raise ValueError("no urls to write")
    clean.write.mode("overwrite").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole files; bytes that are no UTF-8 become replacement characters."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved extraction results; a record that does not fit the schema fails the read."""
    return spark.read.schema(EXTRACTION).option("mode", "FAILFAST").option("multiLine", True).json(path)


class Sorted(NamedTuple):
    """Rows that go on, rows that are kept aside with their ``reason``, and how many of each there were, read and sorted in one pass."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def quarantine(rows: DataFrame, violations: Callable[[DataFrame], DataFrame], unreadable: str | None = None) -> Sorted:
    """Sort ``rows`` by what ``violations`` (which adds a column of that name) says of them.

    ``unreadable`` names a column that holds the text of a record that could
    not be read; such a row is bad whatever else it holds.  Rows are read once:
    they are written, and counted on the way by an observation.
    """
    lost = F.col(unreadable).isNotNull() if unreadable else F.lit(False)
    reason = F.when(lost, "unreadable record").when(F.size("violations") > 0, F.array_join("violations", ","))
    seen = Observation()
    marked = violations(rows).withColumn("reason", reason)
    counted = marked.observe(seen, F.count("*").alias("read"), F.count("reason").alias("bad"), F.count(F.when(lost, 1)).alias("unreadable"))
    held = settled(counted, "sorted")
    spare = ["violations", "reason", *([unreadable] if unreadable else [])]
    return Sorted(held.filter("reason is null").drop(*spare), held.filter("reason is not null").drop("violations"), {k: int(v) for k, v in seen.get.items()})


def sort_results(spark: SparkSession, path: str, multi_line: bool = True) -> Sorted:
    """Saved extraction results, one bad record no longer ending the read: see :func:`quarantine`; bad rows keep their text as ``record``.

    A file is one record, or, without ``multi_line``, a line is.
    """
    fields = spark.createDataFrame([], f"{EXTRACTION}, record string").schema
    read = spark.read.schema(fields).options(mode="PERMISSIVE", columnNameOfCorruptRecord="record", multiLine=multi_line).json(path)
    return quarantine(read, extraction_violations, "record")


def sort_chunks(chunks: DataFrame) -> Sorted:
    """Chunks that may be stored, and those that may not."""
    return quarantine(chunks, chunk_violations)


def pdf_text(body: Column) -> Column:
    """Struct of ``text`` and ``failure`` of PDF bodies; null bodies give null.

    The text is that of all pages that have any, apart by an empty line.  What
    cannot be read, also for want of a PDF reader, says so in ``failure``.
    """

    @F.pandas_udf("text string, failure string")
    def read(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_pdf_text(r) for r in raws], columns=["text", "failure"])

    return F.when(body.isNotNull(), read(body))


def _pdf_text(raw: bytes | None) -> tuple[str | None, str | None]:
    if not raw:
        return "", None
    try:
        from pypdf import PdfReader

        texts = [page.extract_text() or "" for page in PdfReader(BytesIO(bytes(raw))).pages]
    except Exception as e:  # noqa: BLE001  a broken file flags its row
        return None, f"pdf text extraction failed: {e}"
    return "\n\n".join(t for t in texts if t.strip()), None


def pdf_supported() -> bool:
    """Is a PDF reader installed? Without one, PDF rows are flagged instead."""
    import importlib.util

    return importlib.util.find_spec("pypdf") is not None


def read_view(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table to look at only; one that does not exist has no rows."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)

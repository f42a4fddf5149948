"""Sections to chunks of bounded size whose concatenation is the section, byte for byte."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id

MAX_CHARS = 2000
#: A sentence ends at its mark, with the space behind it or at the window's end.
SENTENCE_END = re.compile(r"[.!?](?: |$)")


def cut_line(line: str, limit: int) -> Iterator[str]:
    """Pieces of an overlong line: after the last sentence, else before the last blank, else at the limit."""
    at = 0
    while len(line) - at > limit:
        window = line[at : at + limit]
        end = 0
        for m in SENTENCE_END.finditer(window):
            end = m.end()
        if not end:
            blank = window.rfind(" ")
            end = blank if blank > 0 else limit
        yield window[:end]
        at += end
    if at < len(line):
        yield line[at:]


def split_section(content: str, limit: int = MAX_CHARS) -> list[str]:
    """Whole lines packed greedily; an overlong line is cut and never shares a piece."""
    if len(content) <= limit:
        return [content]
    out: list[str] = []
    held: list[str] = []
    size = 0
    for line in content.splitlines(keepends=True):
        if held and size + len(line) > limit:
            out.append("".join(held))
            held, size = [], 0
        if len(line) <= limit:
            held.append(line)
            size += len(line)
        else:
            out.extend(cut_line(line, limit))
    if held:
        out.append("".join(held))
    return out


def pieces(content: Column, limit: int = MAX_CHARS) -> Column:
    """Array of the pieces of one section."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_section(t, limit))

    return cut(content)


def chunk_errors(results: DataFrame) -> Column:
    """Why a result cannot be chunked; null: it can."""
    blank = F.array_position(F.transform("sections", lambda s: F.trim(F.regexp_replace(F.coalesce(s["content"], F.lit("")), r"(?U)\s+", " ")) == ""), True)
    return F.when(F.coalesce(F.size("sections"), F.lit(0)) <= 0, "no sections to chunk: extraction result is empty").when(blank > 0, F.concat(F.lit("section "), blank.cast("string"), F.lit(" has empty content")))


def chunk_results(results: DataFrame, limit: int = MAX_CHARS, ingest_timestamp: Column | None = None) -> DataFrame:
    """One row a chunk of every result that can be chunked; see :func:`chunk_failures` for the others."""
    good = results.filter(chunk_errors(results).isNull())
    one = good.select("*", F.posexplode("sections").alias("_i", "_s"))
    cut = one.withColumn("_pieces", pieces(F.col("_s.content"), limit))
    rows = cut.select("*", F.posexplode("_pieces").alias("_j", "_piece"))
    stamp = F.current_timestamp() if ingest_timestamp is None else ingest_timestamp
    return rows.select(
        chunk_id(F.col("source_url"), F.col("_i") + 1, F.col("_j") + 1).alias("chunk_id"),
        "source_url",
        "scrape_timestamp",
        "page_title",
        "content_type",
        "confidence",
        F.col("_s.heading").alias("section_heading"),
        F.col("_s.level").alias("section_level"),
        (F.col("_i") + 1).alias("section_index"),
        (F.col("_j") + 1).alias("chunk_index"),
        F.size("_pieces").alias("chunk_total"),
        F.col("_piece").alias("content"),
        "truncated",
        "extraction_notes",
        stamp.alias("ingest_timestamp"),
    )


def chunk_failures(results: DataFrame) -> DataFrame:
    """url and reason of the results that cannot be chunked."""
    return results.select(F.col("source_url").alias("url"), chunk_errors(results).alias("reason")).filter("reason is not null")


def chunk_stats(chunks: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """For each url: sections, chunks, the sections that were split, and the limit."""
    return chunks.groupBy("source_url").agg(
        F.countDistinct("section_index").alias("num_sections"),
        F.count("*").alias("num_chunks"),
        F.array_sort(F.collect_set(F.when(F.col("chunk_total") > 1, F.col("section_index")))).alias("sections_split"),
        F.lit(limit).alias("max_chunk_chars"),
    )


def reassembled(chunks: DataFrame) -> DataFrame:
    """For each section, the concatenation of its chunks."""
    return chunks.groupBy("source_url", "section_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "").alias("content"))

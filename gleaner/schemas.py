"""Schemas of the records that flow through the engine, and their cross-field checks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FETCH_OUTCOMES = ("success", "empty", "blocked", "failed")
STRIP_OUTCOMES = ("stripped", "fallback", "empty")
CONTENT_TYPES = ("html", "pdf", "text", "unknown")
STATES = ("pending", "processing", "done", "blocked", "flagged", "retrying", "failed")
TERMINAL_STATES = ("done", "blocked", "flagged", "failed")
INGEST_STATUSES = ("stored", "blocked", "flagged", "fetch_failed", "no_content")

FETCH_RESULT = (
    "url string, outcome string, html string, raw binary, status_code int, content_type string, "
    "final_url string, fetcher string, reason string, visible_text string"
)
#: The same, and what happened on the way.
FETCH_LOG = FETCH_RESULT + (
    ", hops array<struct<from_url: string, to_url: string, code: int>>, retries array<struct<code: int, attempt: int, wait: double>>, lost_charset string, waited double"
)
BLOCK = "struct<heading: string, level: int, text: string>"
STRIP_RESULT = (
    f"title string, outcome string, text string, method string, chars_before int, chars_after int, num_blocks int, num_tables int, blocks array<{BLOCK}>, "
    "warnings array<struct<stage: string, reason: string, chars_before: int, chars_after: int>>"
)
SECTION = "struct<heading: string, content: string, level: int>"
EXTRACTION = (
    "source_url string, scrape_timestamp timestamp, page_title string, content_type string, "
    f"confidence double, extraction_notes string, truncated boolean, sections array<{SECTION}>"
)
VALIDATION = "source_url string, scrape_timestamp timestamp, is_valid boolean, errors array<string>, should_retry boolean, retry_count int"
CHUNK = (
    "chunk_id string, source_url string, scrape_timestamp timestamp, page_title string, content_type string, confidence double, "
    "section_heading string, section_level int, chunk_index int, chunk_total int, content string, truncated boolean, "
    "extraction_notes string, ingest_timestamp timestamp"
)
CORPUS = CHUNK + ", embedding array<float>"
FRONTIER = "url string, state string, attempts int, next_attempt_ts timestamp, reason string, added_at timestamp, updated_at timestamp"
EVENTS = "id long, ts timestamp, event_type string, url string, outcome string, reason string, details_json string"
CITATION = "struct<source_url: string, scrape_timestamp: string, page_title: string, section_heading: string, quote: string>"
ANSWER = f"struct<answer: string, citations: array<{CITATION}>>"
EVIDENCE = "struct<text: string, provenance: map<string, string>>"

#: Confidence that a record without sections may have at most.
EMPTY_CONFIDENCE = 0.5


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def sections_confidence_ok(sections: Column, confidence: Column) -> Column:
    """A record without sections is not confident."""
    return (F.coalesce(F.size(sections), F.lit(0)) > 0) | (confidence <= EMPTY_CONFIDENCE)


def retry_ok(should_retry: Column, retry_count: Column) -> Column:
    return ~should_retry | (retry_count < 1)


def chunk_index_ok(index: Column, total: Column) -> Column:
    return (index >= 1) & (index <= total)


def in_unit_range(value: Column) -> Column:
    return value.isNotNull() & value.between(0.0, 1.0)


def extraction_violations(df: DataFrame) -> DataFrame:
    """``df`` of extraction results with ``violations``: names of the checks that fail, in a fixed order."""
    checks = [
        ("source_url_not_http", ~is_http(F.col("source_url"))),
        ("scrape_timestamp_missing", F.col("scrape_timestamp").isNull()),
        ("content_type_unknown_value", ~F.coalesce(F.col("content_type").isin(*CONTENT_TYPES), F.lit(False))),
        ("confidence_out_of_range", ~in_unit_range(F.col("confidence"))),
        ("empty_but_confident", ~F.coalesce(sections_confidence_ok(F.col("sections"), F.col("confidence")), F.lit(True))),
        ("section_level_below_one", F.coalesce(F.exists("sections", lambda s: s["level"] < 1), F.lit(False))),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks))))


def chunk_violations(df: DataFrame) -> DataFrame:
    """``df`` of chunks with ``violations``."""
    checks = [
        ("source_url_not_http", ~is_http(F.col("source_url"))),
        ("content_empty", F.coalesce(F.length("content"), F.lit(0)) < 1),
        ("confidence_out_of_range", ~in_unit_range(F.col("confidence"))),
        ("chunk_index_beyond_total", ~F.coalesce(chunk_index_ok(F.col("chunk_index"), F.col("chunk_total")), F.lit(False))),
        ("timestamp_missing", F.col("scrape_timestamp").isNull() | F.col("ingest_timestamp").isNull()),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks))))


def parse_timestamp(text: Column) -> Column:
    """Timestamp of ISO text that carries an offset; naive text gives null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))

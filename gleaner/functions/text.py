"""Identifiers, provenance, reports and small string or time functions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(url: Column, section_index: Column, chunk_index: Column) -> Column:
    """SHA-1 of the url and the two 1-based indexes, joined by NUL: the same for every ingestion."""
    return F.sha1(F.concat_ws("\x00", url, section_index.cast("string"), chunk_index.cast("string")).cast("binary"))


def collection_slug(model: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(model, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def collection_name(model: Column, dimension: Column, prefix: str = "corpus") -> Column:
    """Null where the name would not be valid."""
    name = F.concat(F.lit(f"{prefix}_"), collection_slug(model), F.lit("_"), dimension.cast("string"))
    return F.when(name.rlike("^[A-Za-z0-9_]{3,128}$"), name)


def iso_utc(ts: Column) -> Column:
    """Millisecond ISO text of a timestamp, in UTC."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def metadata_json(chunk: dict[str, Column] | None = None) -> Column:
    """A chunk's metadata as JSON; null fields are left out."""
    names = ("source_url", "scrape_timestamp", "ingest_timestamp", "content_type", "confidence", "chunk_index", "chunk_total", "truncated", "page_title", "section_heading", "section_level", "extraction_notes")
    given = chunk or {}
    stamps = ("scrape_timestamp", "ingest_timestamp")
    return F.to_json(F.struct(*((iso_utc(given.get(n, F.col(n))) if n in stamps else given.get(n, F.col(n))).alias(n) for n in names)))


def provenance(url: Column, stamp: Column, page_title: Column | None = None, heading: Column | None = None) -> Column:
    """Map with url and time always, title and heading where they are known."""
    optional = [(k, v) for k, v in (("page_title", page_title), ("section_heading", heading)) if v is not None]
    full = F.create_map(F.lit("source_url"), url, F.lit("scrape_timestamp"), stamp, *(x for k, v in optional for x in (F.lit(k), v)))
    return F.map_filter(full, lambda k, v: k.isin("source_url", "scrape_timestamp") | v.isNotNull())


def numbered(errors: Column) -> Column:
    """``1. first`` lines."""
    return F.array_join(F.transform(errors, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e)), "\n")


#: A decimal number, with or without an exponent.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def backoff_seconds(attempt: Column, base: float = 1.0, retry_after: Column | None = None) -> Column:
    """Wait before the next try, without jitter: a numeric Retry-After wins, else powers of two up to 30."""
    wait = F.least(F.lit(30.0), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))
    given = F.when(F.trim(retry_after).rlike(NUMBER), F.trim(retry_after).cast("double")) if retry_after is not None else None
    return wait if given is None else F.coalesce(given, wait)


def domain(url: Column) -> Column:
    """Network location, or the url itself where it has none."""
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), url)


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def flat_preview(text: Column, size: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def marker_name(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


#: What an outcome of an event says; the first list that holds it wins.
SEVERITY = {
    "ok": (
        "success", "ok", "corpus_hit", "kept_static", "completed", "single_shot_ok", "corpus_miss_single_shot_ok", "dismissed", "rescued", "stale_element_recovered", "title_ok",
    ),
    "error": (
        "error", "failed", "fetch_failed", "blocked", "flagged", "no_content", "parse_exhausted", "corpus_error", "answer_generation_failed", "navigation_error", "browser_error", "chunk_ingest_failed", "chunk_failed",
    ),
    "warn": (
        "obstacle_detected", "encoding_fallback", "rate_limit_wait", "strip_parse_warning", "detection_failure", "timeout", "answer_fallback_rescued", "answer_unwrap_rescue", "networkidle_timeout", "load_more_stall",
    ),
    "progress": ("tool_use", "json_from_content", "json_mode", "retrying", "store_start", "fetch_done", "validate_done", "stripping", "extracting"),
}


def severity(outcome: Column) -> Column:
    """``ok``, ``error``, ``warn``, ``progress`` or ``other``."""
    out = F.lit("other")
    for name in ("progress", "warn", "error", "ok"):
        out = F.when(outcome.isin(*SEVERITY[name]), name).otherwise(out)
    return out


def ingest_report(url: Column, status: Column, fetch_outcome: Column, reason: Column, stored: Column, sections: Column, confidence: Column, validation_json: Column) -> Column:
    """The text that a one-URL ingestion prints; its wording is a fixed value."""
    none = F.lit("None")
    return (
        F.when(status.isin("blocked", "fetch_failed"), F.format_string("fetch outcome=%s reason=%s -> no ingestion", fetch_outcome, F.coalesce(reason, none)))
        .when(status == "no_content", "fetch succeeded but no content to ingest")
        .when((status == "flagged") & sections.isNull(), F.concat(F.lit("validation failed -> not ingested (flagged, see validation_flagged event)\n"), F.coalesce(validation_json, F.lit("{}"))))
        .otherwise(F.concat(F.format_string("url=%s is_valid=True stored_chunks=%d sections=%d confidence=%s", url, stored, sections, confidence), F.coalesce(F.concat(F.lit("\nchunk_failed reason="), reason), F.lit(""))))
    )


def chunk_report(stored: Column, collection: Column, error: Column) -> Column:
    return F.concat(F.format_string("stored_chunks=%d collection=%s", stored, collection), F.coalesce(F.concat(F.lit("\nchunk_failed reason="), error), F.lit("")))


def exit_code(error: Column) -> Column:
    return F.when(error.isNotNull(), 1).otherwise(0)

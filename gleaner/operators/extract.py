"""Structured extraction: routing, a pluggable extractor, and clean-up of what it returns.

An extractor is a Python callable ``(content, content_type, page_title,
repair_errors) -> dict or None`` with the keys ``sections``, ``confidence`` and
optionally ``page_title``, ``extraction_notes``, ``truncated``.  It runs in
``mapInPandas``; rows that need no extractor never reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SECTION

Extractor = Callable[[str, str, "str | None", "str | None"], "dict | None"]

#: Why a row is flagged.
UNSUPPORTED = "unsupported content type: no extraction path exists"
BLANK = "empty content: nothing to extract"
NO_OUTPUT = "model returned no parseable structured output"
#: Least confidence of content wrapped as one section.
WRAPPED_CONFIDENCE = 0.3
CALLS = "array<struct<outcome: string, reason: string>>"
ANSWERED = f"raw_sections array<{SECTION}>, raw_confidence double, raw_title string, raw_notes string, raw_truncated boolean, failure string, calls {CALLS}"


def heading_sections(content: str, content_type: str, page_title: str | None, repair_errors: str | None = None) -> dict:
    """Deterministic offline extractor: paragraphs, a short line without a full stop opening a section."""
    sections: list[dict] = []
    for part in content.split("\n\n"):
        head, sep, rest = part.partition("\n")
        if sep and rest.strip() and len(head) <= 120 and not head.rstrip().endswith((".", "!", "?", ":", ",", ";")):
            sections.append({"heading": head.strip() or None, "content": rest, "level": 2})
        elif part.strip():
            sections.append({"heading": None, "content": part, "level": None})
    return {"sections": sections, "confidence": 0.9 if sections else 0.0, "page_title": page_title}


def blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") == "", F.lit(True))


def route(df: DataFrame) -> DataFrame:
    """``df`` (content, content_type, content_failure) with ``flag``: why a row needs no extractor; null: it goes on."""
    return df.withColumn("flag", F.when(F.col("content_type") == "unknown", UNSUPPORTED).when(F.col("content_failure").isNotNull(), F.col("content_failure")).when(blank(F.col("content")), BLANK))


def _answers(rows: DataFrame, extractor: Extractor, parse_retry: int) -> DataFrame:
    fields = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for content, kind, title, errors in zip(pdf["content"], pdf["content_type"], pdf["page_title"], pdf["repair_errors"], strict=True):
                raw, failure, calls = None, NO_OUTPUT, []
                for _ in range(parse_retry + 1):
                    try:
                        raw = extractor(content, kind, title, errors)
                        calls.append(("success", "structured output") if isinstance(raw, dict) else ("tool_use_parse_failed", NO_OUTPUT))
                    except Exception as e:  # noqa: BLE001  a failing extractor flags its row
                        failure = f"llm call failed: {e}"
                        calls.append(("tool_use_failed", failure))
                    if isinstance(raw, dict):
                        try:
                            sections = [{"heading": s.get("heading"), "content": s.get("content") or "", "level": s.get("level")} for s in raw.get("sections") or []]
                            made.append((sections, float(raw["confidence"]), raw.get("page_title"), raw.get("extraction_notes"), bool(raw.get("truncated", False)), None, calls))
                            break
                        except (AttributeError, KeyError, TypeError, ValueError) as e:
                            raw, failure = None, f"schema validation failed: {e!r}"
                            calls[-1] = ("tool_use_parse_failed", failure)
                else:
                    made.append((None, None, None, None, False, failure, calls))
            out = pd.DataFrame(made, columns=["raw_sections", "raw_confidence", "raw_title", "raw_notes", "raw_truncated", "failure", "calls"], index=pdf.index)
            yield pd.concat([pdf, out], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInPandas(run, f"{ddl}, {ANSWERED}")


def noted(notes: Column, more: Column) -> Column:
    """``notes`` with one more remark."""
    return F.nullif(F.trim(F.concat(F.coalesce(notes, F.lit("")), F.lit(" | "), more), F.lit(" |")), F.lit(""))


def finish(rows: DataFrame) -> DataFrame:
    """Clean an extractor's answer: drop blank sections, wrap content without any, keep the pipeline's provenance."""
    full = F.filter("raw_sections", lambda s: ~blank(s["content"]))
    dropped = F.size("raw_sections") - F.size(full)
    wrap = (F.size(full) == 0) & ~blank(F.col("content"))
    notes = F.when(dropped > 0, noted(F.col("raw_notes"), F.concat(dropped.cast("string"), F.lit(" empty sections filtered")))).otherwise(F.col("raw_notes"))
    notes = F.when(wrap, noted(notes, F.lit("extractor returned 0 sections; raw content wrapped as fallback"))).otherwise(notes)
    one = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.regexp_replace("content", r"(?U)^\s+|\s+$", "").alias("content"), F.lit(None).cast("int").alias("level")))
    ok = F.col("failure").isNull()
    return rows.select(
        "source_url",
        "scrape_timestamp",
        F.when(ok, F.col("raw_title")).otherwise(F.col("page_title")).alias("page_title"),
        "content_type",
        F.when(~ok, 0.0).when(wrap, F.greatest("raw_confidence", F.lit(WRAPPED_CONFIDENCE))).otherwise(F.col("raw_confidence")).alias("confidence"),
        F.when(ok, notes).otherwise(F.col("failure")).alias("extraction_notes"),
        F.coalesce("raw_truncated", F.lit(False)).alias("truncated"),
        F.when(~ok, F.array().cast(f"array<{SECTION}>")).when(wrap, one).otherwise(full).alias("sections"),
        F.when(ok & wrap, "fallback_section").when(ok, "extracted").otherwise("flagged").alias("extraction_outcome"),
        "content",
        "content_failure",
        "trail",
        "calls",
    )


def flagged(rows: DataFrame, reason: Column) -> DataFrame:
    """Zero-confidence results without sections that keep their provenance."""
    return rows.select(
        "source_url", "scrape_timestamp", "page_title", "content_type", F.lit(0.0).alias("confidence"), reason.alias("extraction_notes"), F.lit(False).alias("truncated"),
        F.array().cast(f"array<{SECTION}>").alias("sections"), F.lit("flagged").alias("extraction_outcome"), "content", "content_failure", "trail", F.lit(None).cast(CALLS).alias("calls"),
    )


#: Optional columns of what is extracted: errors to repair, why there is no content, and a record of earlier rounds.
OPTIONAL = ("repair_errors", "content_failure", "trail")


def extract(df: DataFrame, extractor: Extractor = heading_sections, parse_retry: int = 1) -> DataFrame:
    """Results for rows of (source_url, scrape_timestamp, page_title, content_type, content) and the ``OPTIONAL`` columns.

    The plan that is returned runs the extractor each time it runs: whoever
    reads it more than once settles it first.
    """
    df = df.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in df.columns})
    rows = route(df.select("source_url", "scrape_timestamp", "page_title", "content_type", "content", *OPTIONAL))
    asked = _answers(rows.filter("flag is null").drop("flag"), extractor, parse_retry)
    return finish(asked).unionByName(flagged(rows.filter("flag is not null"), F.col("flag")))

"""Validation with a bounded repair: check, extract the failing rows once more, check again, flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbered
from ..session import settled
from . import extract as ex

MIN_CONFIDENCE = 0.5
REPAIR_BUDGET = 1
#: The texts of the checks, here and in :func:`errors`.
UNKNOWN_TYPE = "unsupported content type: unknown"


def errors(min_confidence: float = MIN_CONFIDENCE, sections: str = "sections", confidence: str = "confidence", content_type: str = "content_type") -> Column:
    """Ordered array of what is wrong with a result; empty: nothing. Sections are counted from 0."""
    none = F.coalesce(F.size(sections), F.lit(0)) <= 0
    return F.array_compact(
        F.concat(
            F.array(F.when(none, "no content extracted: sections list is empty")),
            F.coalesce(F.transform(sections, lambda s, i: F.when(ex.blank(s["content"]), F.concat(F.lit("section "), i.cast("string"), F.lit(" has empty content")))), F.array().cast("array<string>")),
            F.array(F.when(F.col(confidence) < min_confidence, "confidence below threshold")),
            F.array(F.when(F.col(content_type) == "unknown", UNKNOWN_TYPE)),
        )
    )


def flag_reason(content_type: Column, skip_repair: bool = False) -> Column:
    """Why a failing result is flagged rather than repaired."""
    return F.when(content_type == "unknown", "unsupported_content_type").otherwise("skipped_repair" if skip_repair else "repair_budget_exhausted")


#: What a round of extraction and validation leaves in ``trail``: one JSON object a line.
ROUND = "retry_count int, extraction string, validation string, num_sections int, confidence double, truncated boolean, title string, notes string, content_type string, " + f"calls {ex.CALLS}"


def _round(outcome: Column) -> Column:
    fields = (F.col("retry_count"), F.col("extraction_outcome").alias("extraction"), outcome.alias("validation"), F.size("sections").alias("num_sections"), "confidence", "truncated", F.col("page_title").alias("title"), F.col("extraction_notes").alias("notes"), "content_type", "calls")
    return F.concat_ws("\n", "trail", F.to_json(F.struct(*fields)))


def rounds(checked: DataFrame, *keep: str) -> DataFrame:
    """The rounds that validated results went through, a row each, with the columns of ``ROUND``."""
    each = checked.select(*keep, F.explode(F.split("trail", "\n")).alias("_r"))
    return each.select(*keep, F.from_json("_r", ROUND).alias("_r")).select(*keep, "_r.*")


def validate(results: DataFrame, extractor: ex.Extractor = ex.heading_sections, min_confidence: float = MIN_CONFIDENCE, budget: int = REPAIR_BUDGET, skip_repair: bool = False, parse_retry: int = 1) -> DataFrame:
    """Results (with ``content``) and ``errors``, ``is_valid``, ``should_retry``, ``retry_count``, ``flag_reason``, ``trail``.

    Each of the ``budget`` rounds extracts only the rows that fail and may be
    repaired; the others are done with, so no round can see them again.  Results
    are written before they are split, so no extractor is asked twice.
    """
    if "extraction_outcome" not in results.columns:
        results = results.withColumn("extraction_outcome", F.lit("extracted"))
    if "trail" not in results.columns:
        results = results.withColumn("trail", F.lit(None).cast("string"))
    if "calls" not in results.columns:
        results = results.withColumn("calls", F.lit(None).cast(ex.CALLS))
    finished, open_ = None, results.withColumn("retry_count", F.lit(0))
    for count in range(budget + 1):
        last = skip_repair or count == budget
        if not (last and finished is None):
            open_ = settled(open_, "results")
        checked = open_.withColumn("errors", errors(min_confidence))
        fails = F.size("errors") > 0
        again = F.lit(False) if last else fails & (F.col("content_type") != "unknown")
        checked = checked.withColumn("trail", _round(F.when(~fails, "valid").when(again, "repairing").otherwise("failed")))
        done = checked.filter(~again)
        finished = done if finished is None else finished.unionByName(done.select(*finished.columns))
        if last:
            break
        failing = checked.filter(again)
        if failing.isEmpty():
            break
        open_ = ex.extract(failing.withColumn("repair_errors", numbered(F.col("errors"))), extractor, parse_retry).withColumn("retry_count", F.lit(count + 1))
    return finished.withColumns(
        {
            "is_valid": F.size("errors") == 0,
            "should_retry": F.lit(False),
            "flag_reason": F.when(F.size("errors") > 0, flag_reason(F.col("content_type"), skip_repair)),
        }
    )

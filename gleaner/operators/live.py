"""Live queries: the corpus first, a single-shot result on a miss, nothing written back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import answer_from_markdown, answer_ok, json_in_text, render_evidence, unwrap_answer
from ..functions.text import iso_utc, provenance
from ..schemas import ANSWER, EVIDENCE
from ..session import settled
from .corpus import cosine_distance
from .events import event


def status_of_miss(status: Column, has_result: Column) -> Column:
    """Live status of an ingest status."""
    return F.when((status == "stored") & has_result, "single_shot_ok").when(status == "stored", "flagged").otherwise(status)


def event_of_miss(status: Column, has_result: Column) -> Column:
    return F.concat(F.lit("corpus_miss_single_shot_"), F.when((status == "stored") & has_result, "ok").when(status == "stored", "flagged").otherwise(status))


def section_evidence() -> Column:
    """Evidence of a result: one piece a section."""
    return F.transform(
        "sections",
        lambda s: F.struct(s["content"].alias("text"), provenance(F.col("source_url"), iso_utc(F.col("scrape_timestamp")), F.col("page_title"), s["heading"]).alias("provenance")),
    ).cast(f"array<{EVIDENCE}>")


def corpus_hits(requests: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Evidence for the requests (request_id, url, query_vector or null) whose URL is in the corpus.

    With a vector the ``k`` nearest chunks of the URL, nearest first; without,
    all of its chunks.
    """
    rows = requests.join(corpus, requests["url"] == corpus["source_url"]).withColumn("distance", cosine_distance(F.col("embedding"), F.col("query_vector")))
    w = Window.partitionBy("request_id").orderBy(F.col("distance").asc_nulls_last(), "chunk_id")
    ranked = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("query_vector").isNull() | (F.col("_r") <= k))
    piece = F.struct(F.col("content").alias("text"), provenance(F.col("source_url"), iso_utc(F.col("scrape_timestamp")), F.col("page_title"), F.col("section_heading")).alias("provenance"))
    one = ranked.groupBy("request_id", "url").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", piece.alias("e"))), lambda a, b: a["_r"] - b["_r"]), lambda x: x["e"]).alias("evidence"),  # the chunks of one URL
        F.min_by(provenance(F.col("url"), iso_utc(F.col("scrape_timestamp")), F.col("page_title")), "_r").alias("provenance"),
    )
    return one.select("request_id", "url", F.lit(True).alias("found_in_corpus"), F.lit("corpus").alias("source_used"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"), "provenance", "evidence", F.lit("corpus_hit").alias("event_outcome"))


def misses(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """Requests whose URL the corpus does not have."""
    return requests.join(corpus.select(F.col("source_url").alias("url")), "url", "left_anti")


def miss_results(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Live results of missed requests from ingest outcomes (url, status, reason, and the result's fields, null without one)."""
    rows = requests.select("request_id", "url").join(outcomes, "url")
    ok = F.col("sections").isNotNull() & (F.col("status") == "stored")
    none = F.array().cast(f"array<{EVIDENCE}>")
    bare = F.create_map(F.lit("source_url"), F.col("url"))
    return rows.select(
        "request_id",
        "url",
        F.lit(False).alias("found_in_corpus"),
        F.lit("live_scrape").alias("source_used"),
        status_of_miss(F.col("status"), ok).alias("status"),
        F.when(ok, F.lit(None).cast("string")).when(F.col("status") == "stored", "stored outcome without a result").otherwise(F.col("reason")).alias("reason"),
        F.when(ok, provenance(F.col("source_url"), iso_utc(F.col("scrape_timestamp")), F.col("page_title"))).otherwise(bare).alias("provenance"),
        F.when(ok, section_evidence()).otherwise(none).alias("evidence"),
        event_of_miss(F.col("status"), ok).alias("event_outcome"),
    )


def corpus_errors(requests: DataFrame, why: str) -> DataFrame:
    """Results of requests to a corpus that cannot be read."""
    none = F.lit(None).cast("string")
    bare = F.create_map(F.lit("source_url"), F.col("url"))
    return requests.select("request_id", "url", F.lit(False).alias("found_in_corpus"), F.lit("error").alias("source_used"), F.lit("error").alias("status"), F.coalesce(F.lit(why), none).alias("reason"), bare.alias("provenance"), F.array().cast(f"array<{EVIDENCE}>").alias("evidence"), F.lit("corpus_error").alias("event_outcome"))


def live_query(requests: DataFrame, corpus: DataFrame | Callable[[], DataFrame], ingest_single, k: int = 5) -> DataFrame:
    """Results for all requests; ``ingest_single(urls) -> outcomes`` runs the chain without writing, for missed URLs only.

    ``corpus`` is a table or what opens one; a corpus that cannot be opened or
    read gives error results and no scrape.
    """
    try:
        found = corpus() if callable(corpus) else corpus
        hits = settled(corpus_hits(requests, found, k), "live-hits")
    except Exception as e:  # noqa: BLE001  whatever is wrong with it, the request gets an answer
        return corpus_errors(requests, str(e).split("\n")[0])
    missed = settled(requests.join(hits.select("request_id"), "request_id", "left_anti"), "live-misses")
    return hits.unionByName(miss_results(missed, ingest_single(missed.select("url").distinct())))


def live_events(results: DataFrame, now: Column) -> DataFrame:
    """One event a request; ``query_given`` where the results say what was asked."""
    asked = F.col("query").isNotNull() if "query" in results.columns else F.lit(False)
    told = F.col("event_outcome") != "corpus_error"
    return event(results, "live_query", F.col("url"), F.col("event_outcome"), F.col("reason"), now, found_in_corpus=F.when(told, F.col("found_in_corpus")), source_used=F.when(told, F.col("source_used")), evidence_count=F.when(told, F.size("evidence")), query_given=F.when(told, asked), error=F.when(~told, F.col("reason")))


def render(results: DataFrame) -> DataFrame:
    return results.withColumn("rendered", render_evidence(F.col("evidence")))


def _asked(complete, question, evidence) -> tuple[str | None, str | None]:
    try:
        return complete(question, evidence), None
    except Exception as e:  # noqa: BLE001  a failing model gives no answer
        return None, f"llm call failed: {e}"


#: Why there is no answer.
NO_OUTPUT = "model returned no parseable structured output"
NO_SCHEMA = "schema validation failed: answer or citations missing"
QUESTION = 200


def answers(results: DataFrame, complete, parse: bool = True) -> DataFrame:
    """Results with ``answer`` (null on failure), ``answer_outcome``, ``answer_error`` (why the structured path failed) and ``answer_length`` (of the text before it was unwrapped).

    ``complete(question, rendered evidence) -> text or None`` is any Python
    callable; its text is read as JSON, alone or fenced, and unwrapped, else as
    Markdown.
    """

    @F.pandas_udf("text string, failure string")
    def ask(questions: pd.Series, evidence: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_asked(complete, q, e) for q, e in zip(questions, evidence, strict=True)], columns=["text", "failure"])

    # Written, for what is read from the text below must not ask again.
    asked = settled(render(results).withColumn("_asked", ask(F.col("query"), F.col("rendered"))), "answers")
    text = F.col("_asked.text")
    parsed = F.from_json(json_in_text(text), ANSWER)
    unwrapped = unwrap_answer(parsed)
    rescued = answer_from_markdown(text, F.col("evidence"))
    good = answer_ok(unwrapped)
    outcome = F.when(good & (unwrapped["answer"] != parsed["answer"]), "unwrapped").when(good, "answered").when(rescued.isNotNull(), "fallback_rescue").otherwise("failed")
    error = F.when(~good, F.coalesce("_asked.failure", F.when(json_in_text(text).isNull(), NO_OUTPUT).otherwise(NO_SCHEMA)))
    return asked.withColumns({"answer": F.when(good, unwrapped).otherwise(rescued), "answer_outcome": outcome, "answer_error": error, "answer_length": F.length(parsed["answer"])}).drop("_asked")


def answer_events(answered: DataFrame, now: Column | None = None) -> DataFrame:
    """Events of :func:`answers`: what was unwrapped, rescued from prose, or failed; plain answers write none."""
    url = F.col("url") if "url" in answered.columns else F.lit(None).cast("string")
    told = {"evidence_count": F.size("evidence"), "question": F.substring("query", 1, QUESTION)}
    of = lambda outcome: answered.filter(F.col("answer_outcome") == outcome)
    unwrapped = event(of("unwrapped"), "answer_unwrap_rescue", url, F.lit("unwrapped"), F.lit("JSON-inside-JSON detected and unwrapped"), now, original_length=F.col("answer_length"), answer_length=F.length("answer.answer"))
    why = F.concat(F.lit("structural path failed ("), F.col("answer_error"), F.lit("), rescued from markdown"))
    rescued = event(of("fallback_rescue"), "answer_fallback_rescued", url, F.lit("fallback_rescue"), why, now, **told)
    failed = event(of("failed"), "answer_generation_failed", url, F.lit("failed"), F.col("answer_error"), now, **told)
    return unwrapped.unionByName(rescued).unionByName(failed)

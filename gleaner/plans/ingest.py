"""The whole chain: fetched pages to a stored corpus, statuses and events.

Every step that costs a request, a model call or a pass over whole pages runs
once for each row: stripped content, validated results and embedded chunks are
written, and everything else is derived from those tables.  What a step cannot
use leaves the chain with a status and never reaches the costlier ones behind it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CorpusSettings, ExtractorSettings, ObstaclePolicy, RetrySettings
from ..functions.html import content_type
from ..operators import chunk, corpus as corpora, embed, events, extract, fetch, frontier, strip, validate
from ..schemas import SECTION
from ..session import settled, temporary
from ..sources.files import pdf_text

#: Why a fetch without a body ends the chain; further down the texts of reasons are fixed as well.
NO_CONTENT = "fetch succeeded but no usable content (no html, no raw bytes)"
#: Fields of a result that an outcome carries, null where there is no result.
RESULT = {
    "source_url": "string", "scrape_timestamp": "timestamp", "page_title": "string", "content_type": "string", "confidence": "double", "extraction_notes": "string", "truncated": "boolean",
    "sections": f"array<{SECTION}>", "errors": "array<string>", "flag_reason": "string",
}


def charset_of(mime: Column) -> Column:
    """The charset that a content type declares; null: none."""
    return F.nullif(F.regexp_extract(F.lower(mime), r"""charset\s*=\s*["']?([^"';\s]+)""", 1), F.lit(""))


@dataclass
class Ingested:
    """What came of a set of fetched pages."""

    outcomes: DataFrame
    chunks: DataFrame
    events: DataFrame


def _content(fetched: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Fetch results without their bodies, with ``kind``, ``content``, what stripping said, and ``usable``.

    ``strict_compat``: decoded text that is not HTML counts as no content, as
    bodies without bytes once did; else it is the content.
    """
    kind = content_type(F.split(F.col("content_type"), ";")[0])
    ok = F.col("outcome") == "success"
    typed = fetched.withColumn("kind", kind)
    marked = ok & (F.col("kind") == "html") & (F.coalesce(F.length("html"), F.lit(0)) > 0)
    pdf = ok & (F.col("kind") == "pdf") & F.col("raw").isNotNull()
    read = typed.withColumns({"_strip": F.when(marked, strip.strip_html(F.when(marked, F.col("html")), F.when(marked, F.col("visible_text")))), "_pdf": pdf_text(F.when(pdf, F.col("raw")))})
    body = F.when(F.col("kind") != "pdf", F.col("raw"))
    declared = charset_of(F.col("content_type"))
    raw = fetch.decode_body(body, declared)
    text = raw if strict_compat else F.coalesce(raw, F.when(F.col("kind") == "text", F.col("html")))
    content = F.when(marked, F.coalesce("_strip.text", F.lit(""))).otherwise(F.coalesce("_pdf.text", text))
    bodies = ("html", "raw", "visible_text")
    lost = [] if "lost_charset" in typed.columns else [F.when(ok & fetch.encoding_fallback(F.when(declared.isNotNull(), body), declared), declared).alias("lost_charset")]
    return read.select(
        *(F.col(c) for c in typed.columns if c not in bodies),
        content.alias("content"),
        F.col("_pdf.failure").alias("content_failure"),
        F.when(marked, F.col("_strip.title")).alias("page_title"),
        F.when(marked, F.struct(*(f"_strip.{c}" for c in ("outcome", "method", "title", "chars_before", "chars_after", "num_blocks", "num_tables", "warnings")))).alias("strip"),
        *lost,
        (ok & (content.isNotNull() | F.col("raw").isNotNull())).alias("usable"),
    )


def ingest(
    fetched: DataFrame,
    scrape_timestamp: Column | None = None,
    extractor: extract.Extractor = extract.heading_sections,
    settings: ExtractorSettings | None = None,
    corpus: CorpusSettings | None = None,
    embedder=None,
    write_to_corpus: bool = True,
    strict_compat: bool = False,
) -> Ingested:
    """Run the chain over fetch results; without writing, nothing is chunked or embedded and nothing repaired.

    ``fetched`` is read once, however it comes about, and the extractor and the
    embedder see each row once (a repaired one once more).
    """
    settings, corpus = settings or ExtractorSettings(), corpus or CorpusSettings()
    now = F.current_timestamp() if scrape_timestamp is None else scrape_timestamp
    ready = settled(_content(fetched, strict_compat), "content")
    ok = F.col("outcome") == "success"
    inputs = ready.filter("usable").select(F.col("url").alias("source_url"), now.alias("scrape_timestamp"), "page_title", F.col("kind").alias("content_type"), F.coalesce("content", F.lit("")).alias("content"), "content_failure")
    results = extract.extract(inputs, extractor, settings.parse_retry)
    with temporary():  # what each round of validation wrote goes once its outcome is written, without the bodies
        validated = validate.validate(results, extractor, settings.min_confidence, settings.repair_budget, not write_to_corpus, settings.parse_retry)
        checked = settled(validated.drop("content", "content_failure"), "validated", outlive=True)

    early = ready.filter("not usable").select(
        "url",
        F.when(F.col("outcome") == "blocked", "blocked").when(~ok, "fetch_failed").otherwise("no_content").alias("status"),
        F.when(ok, NO_CONTENT).otherwise(F.col("reason")).alias("reason"),
        F.when(ok, "").otherwise(F.col("outcome")).alias("fetch_outcome"),
        F.lit(0).alias("stored_chunks"),
        F.lit(False).alias("written"),
        *(F.lit(None).cast(t).alias(c) for c, t in RESULT.items()),
    )
    url = F.col("source_url").alias("url")
    bad = checked.filter("not is_valid").select(
        url, F.lit("flagged").alias("status"), F.concat(F.lit("validation failed: "), F.size("errors").cast("string"), F.lit(" errors, repair budget exhausted")).alias("reason"), F.lit("success").alias("fetch_outcome"),
        F.lit(0).alias("stored_chunks"), F.lit(False).alias("written"), *(F.lit(None).cast(t).alias(c) if c == "sections" else F.col(c) for c, t in RESULT.items()),
    )
    good = checked.filter("is_valid")
    fallen: list[tuple[str, str]] = []
    pieces = chunk.chunk_results(good, corpus.max_chunk_chars, now)
    if write_to_corpus:
        embedder = embedder or embed.load_embedder(corpus, on_fallback=lambda *models: fallen.append(models))
        made = settled(pieces.withColumn("_e", embed.try_embed(F.col("content"), embedder, corpus.batch_size)), "chunks")
        sizes = made.groupBy(url).agg(F.count("*").cast("int").alias("_n"), F.min("_e.failure").alias("_why"))
        sizes = sizes.unionByName(chunk.chunk_failures(good).select("url", F.lit(0).alias("_n"), F.col("reason").alias("_why")))
        whole = good.withColumn("url", F.col("source_url")).join(sizes, "url", "left")
        failed = F.col("_why").isNotNull()
        stored = whole.select(
            "url", F.when(failed, "flagged").otherwise("stored").alias("status"), F.col("_why").alias("reason"), F.lit("success").alias("fetch_outcome"),
            F.when(failed, 0).otherwise(F.coalesce("_n", F.lit(0))).alias("stored_chunks"), (~failed).alias("written"), *RESULT,
        )
        lost = sizes.filter("_why is not null").select(F.col("url").alias("source_url"))
        kept = made.join(lost, "source_url", "left_anti")
        chunks = kept.select(*pieces.columns, F.col("_e.vector").alias("embedding"))
    else:
        stored = good.select(url, F.lit("stored").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit("success").alias("fetch_outcome"), F.lit(0).alias("stored_chunks"), F.lit(False).alias("written"), *RESULT)
        made = kept = pieces.limit(0)
        chunks = kept.withColumn("embedding", F.lit(None).cast("array<float>"))
    outcomes = reduce(DataFrame.unionByName, [early, stored, bad])
    if write_to_corpus:
        outcomes = settled(outcomes, "outcomes")
    log = [*fetch_events(ready, now), *extraction_events(checked, now), *model_events(checked, extractor, fallen, now), *chunk_events(made, outcomes, now, corpus.max_chunk_chars), *lifecycle_events(outcomes, now, write_to_corpus)]
    return Ingested(outcomes, chunks, reduce(DataFrame.unionByName, log))


# ------------------------------------------------------------------- events


def fetch_events(ready: DataFrame, now: Column) -> list[DataFrame]:
    """Attempts, decisions, obstacles on the way and stripping, as far as ``ready`` tells."""
    url = F.col("url")
    out = [events.event(ready, "fetch_attempt", url, F.col("outcome"), F.col("reason"), now, fetcher=F.col("fetcher"), status_code=F.col("status_code"))]
    if "decision" in ready.columns:
        out.append(events.event(ready, "fetch_decision", url, F.col("decision"), F.col("decision_reason"), now, static_status=F.col("status_code"), content_type=F.col("content_type")))
    if "hops" in ready.columns:
        hop = ready.select("url", F.explode("hops").alias("h"))
        why = F.format_string("redirect %d: %s -> %s", "h.code", "h.from_url", "h.to_url")
        out.append(events.event(hop, "obstacle_detected", url, F.lit("follow_and_log"), why, now, obstacle=F.lit("unexpected_redirect"), policy=F.lit("follow_and_log"), detection_method=F.lit("redirect_chain_detected")))
    if "retries" in ready.columns:
        tried = ready.select("url", F.explode("retries").alias("r"))
        out.append(events.event(tried, "obstacle_detected", url, F.lit("retry_with_backoff"), F.format_string("HTTP %d, attempt %d", "r.code", "r.attempt"), now, obstacle=fetch.retryable(F.col("r.code")), policy=F.lit("retry_with_backoff"), wait=F.col("r.wait")))
    if "lost_charset" in ready.columns:
        why = F.format_string("encoding fallback: declared charset '%s' and UTF-8 both failed, using latin-1 with replacement chars", "lost_charset")
        out.append(events.event(ready.filter("lost_charset is not null"), "obstacle_detected", url, F.lit("encoding_fallback"), why, now, obstacle=F.lit("encoding_fallback"), charset=F.col("lost_charset"), fallback=F.lit("latin-1")))
    if "waited" in ready.columns:
        out.append(events.event(ready.filter("waited > 0"), "rate_limit_wait", url, F.lit("wait"), F.lit(None).cast("string"), now, seconds=F.col("waited")))
    stripped = ready.filter("strip is not null")
    warned = stripped.select("url", F.explode("strip.warnings").alias("w"))
    out.append(events.event(warned, "strip_parse_warning", url, F.lit("fallback"), F.col("w.reason"), now, stage=F.col("w.stage"), chars_before=F.col("w.chars_before"), chars_after=F.col("w.chars_after")))
    out.append(events.event(stripped, "strip_attempt", url, F.col("strip.outcome"), None, now, **{c: F.col(f"strip.{c}") for c in ("method", "title", "chars_before", "chars_after", "num_blocks", "num_tables")}))
    return out


def extraction_events(checked: DataFrame, now: Column, policy: ObstaclePolicy | None = None) -> list[DataFrame]:
    """Every round's extraction and validation, and what was flagged."""
    policy = policy or ObstaclePolicy()
    each, url = validate.rounds(checked, "source_url"), F.col("source_url")
    known = {c: F.col(c) for c in ("content_type", "confidence", "num_sections", "truncated", "title")}
    bad = checked.filter("flag_reason is not null")
    out = [
        events.event(each, "extraction_attempt", url, F.col("extraction"), None, now, **known),
        events.event(each.filter("extraction = 'flagged'"), "extraction_flagged", url, F.lit("flagged"), F.col("notes"), now, content_type=F.col("content_type")),
        events.event(each, "validation_attempt", url, F.col("validation"), None, now, retry_count=F.col("retry_count"), num_sections=F.col("num_sections"), confidence=F.col("confidence")),
        events.event(bad, "validation_flagged", url, F.lit("flagged"), F.array_join("errors", "; "), now, flag_reason=F.col("flag_reason"), retry_count=F.col("retry_count"), num_errors=F.size("errors")),
    ]
    if policy.is_enabled("data_integrity"):
        why = F.concat(F.lit("data_integrity: "), F.array_join("errors", "; "))
        out.append(events.event(bad, "obstacle_detected", url, F.lit("flagged"), why, now, obstacle=F.lit("data_integrity"), detection_method=F.lit("schema_validation_failed"), policy=F.lit(policy.policy_for("data_integrity")), flag_reason=F.col("flag_reason"), retry_count=F.col("retry_count"), num_errors=F.size("errors")))
    return out


def model_events(checked: DataFrame, extractor, fallen: list[tuple[str, str]], now: Column) -> list[DataFrame]:
    """Calls of a language model, by an extractor that names its ``model``, and embedding models that gave way to another."""
    out, nowhere = [], F.lit(None).cast("string")
    if model := getattr(extractor, "model", None):
        call = validate.rounds(checked, "source_url").select("source_url", F.explode("calls").alias("c"))
        out.append(events.event(call, "llm_call", F.col("source_url"), F.col("c.outcome"), F.col("c.reason"), now, model=F.lit(model)))
    for first, second in fallen:
        one = checked.sparkSession.range(1)
        out.append(events.event(one, "embed_model_fallback", nowhere, F.lit("fallback"), F.lit(f"{first} failed to load, using {second}"), now, model=F.lit(first), fallback_model=F.lit(second)))
    return out


def chunk_events(made: DataFrame, outcomes: DataFrame, now: Column, limit: int) -> list[DataFrame]:
    """Chunked URLs, and those whose chunks could not be made or embedded."""
    stats = chunk.chunk_stats(made, limit)
    stage = F.when(F.col("reason").startswith("embedder failed"), "embed").when(F.col("reason").startswith("store failed"), "store").otherwise("chunk")
    bad = outcomes.filter("status = 'flagged' and flag_reason is null")
    return [
        events.event(stats, "chunk_complete", F.col("source_url"), F.lit("ok"), None, now, **{c: F.col(c) for c in ("num_sections", "num_chunks", "sections_split", "max_chunk_chars")}),
        events.event(bad, "chunk_failed", F.col("url"), F.lit("failed"), F.col("reason"), now, stage=stage),
    ]


def lifecycle_events(outcomes: DataFrame, now: Column, write: bool = True) -> list[DataFrame]:
    """Where each URL's chain ended, and where its storing began."""
    ended = F.when(F.col("status").isin("blocked", "fetch_failed", "no_content"), "fetch_done").when(F.col("flag_reason").isNotNull(), "validate_done").otherwise("completed")
    sections = F.when(F.col("sections").isNotNull(), F.size("sections"))
    out = [events.event(outcomes, "ingest_lifecycle", F.col("url"), ended, None, now, stage=ended, status=F.col("status"), fetch_outcome=F.nullif("fetch_outcome", F.lit("")), stored_chunks=F.col("stored_chunks"), num_sections=sections, reason_=F.col("reason"))]
    if write:
        out.append(events.event(outcomes.filter("sections is not null"), "ingest_lifecycle", F.col("url"), F.lit("store_start"), None, now, stage=F.lit("store_start"), num_sections=sections))
    return out


# ------------------------------------------------------------------- storing


def store(done: Ingested, collection: corpora.Corpus, now: Column | None = None) -> Ingested:
    """Write the chunks to ``collection``; the outcomes and events say how that went.

    A store that fails makes flagged outcomes of the stored ones, with the
    reason, and keeps what was there before.
    """
    now = F.current_timestamp() if now is None else now
    sizes = done.chunks.groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n"))
    name = F.lit(collection.name)
    begun = events.event(sizes, "chunk_ingest_begin", F.col("url"), F.lit("begin"), None, now, planned_chunks=F.col("n"), collection=name)
    if done.chunks.isEmpty():
        return done
    try:
        collection.store(done.chunks)
    except Exception as e:  # noqa: BLE001  whatever fails, the chain ends with an outcome
        why = f"{type(e).__name__}: {e}".split("\n")[0]
        lost = events.event(sizes, "chunk_ingest_failed", F.col("url"), F.lit("failed"), F.lit(f"store operation failed: {why}"), now, error=F.lit(why), collection=name, chunk_count=F.col("n"))
        hit = F.col("status") == "stored"
        outcomes = done.outcomes.withColumns(
            {"reason": F.when(hit, F.lit(f"store failed: {why}")).otherwise(F.col("reason")), "stored_chunks": F.when(hit, 0).otherwise(F.col("stored_chunks")), "written": F.col("written") & ~hit, "status": F.when(hit, "flagged").otherwise(F.col("status"))}
        )
        said = events.event(done.outcomes.filter(hit), "chunk_failed", F.col("url"), F.lit("failed"), F.lit(f"store failed: {why}"), now, stage=F.lit("store"))
        return Ingested(outcomes, done.chunks.limit(0), reduce(DataFrame.unionByName, [done.events, begun, lost, said]))
    ended = events.event(sizes, "chunk_ingest_complete", F.col("url"), F.lit("complete"), None, now, chunk_count=F.col("n"), collection=name)
    return Ingested(done.outcomes, done.chunks, reduce(DataFrame.unionByName, [done.events, begun, ended]))


def run_batch(queue: DataFrame, urls: DataFrame, fetcher, now: Column, retry: RetrySettings | None = None, collection: corpora.Corpus | None = None, **options):
    """One pass: enqueue, take what is due, ingest it, store it in ``collection`` if there is one, move the states.

    ``fetcher(urls) -> fetch results`` is any plan over a DataFrame of URLs; it
    runs once.  Returns frontier, ingested, events.
    """
    retry = retry or RetrySettings()
    full = frontier.recover_interrupted(frontier.add_urls(queue, urls, now), now)
    full = settled(full, "frontier")
    due = settled(frontier.pending_due(full, now).select("url"), "due")
    working = frontier.mark_processing(full, due, now)
    done = ingest(fetcher(due), scrape_timestamp=now, **options)
    if collection is not None:
        done = store(done, collection, now)
    after = frontier.apply_outcomes(working, done.outcomes.select("url", "status", "reason"), now, retry.max_attempts, retry.backoff_seconds)
    after = settled(after, "frontier")
    moved = after.join(due, "url", "left_semi")
    log = events.event(moved, "batch_url_state", F.col("url"), F.col("state"), F.col("reason"), now, attempts=F.col("attempts"))
    nowhere = F.lit(None).cast("string")
    started = events.event(due.agg(F.count("*").alias("n")), "batch_run", nowhere, F.lit("started"), None, now, urls=F.col("n"))
    finished = events.event(summary(moved), "batch_run", nowhere, F.lit("finished"), None, now, total=F.col("total"), by_state=F.col("by_state"))
    return after, done, reduce(DataFrame.unionByName, [done.events, log, started, finished])


def summary(after: DataFrame) -> DataFrame:
    return frontier.by_state(after)


def fetch_offline(pages: DataFrame, threshold: float = fetch.THRESHOLD) -> DataFrame:
    """Stored pages through the fetch decision, without a renderer."""
    return fetch.fetch_pages(fetch.static_from_pages(pages), None, threshold)

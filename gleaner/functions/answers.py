"""Evidence, citations and rescue of model output, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ANSWER, CITATION, SECTION

QUOTE = 300
CITED = 3


def render_evidence(evidence: Column) -> Column:
    """Numbered blocks of an array of (text, provenance)."""

    def block(e: Column, i: Column) -> Column:
        prov = e["provenance"]
        heading = F.nullif(F.element_at(prov, "section_heading"), F.lit(""))
        return F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] source_url="), F.coalesce(F.element_at(prov, "source_url"), F.lit("?")),
            F.coalesce(F.concat(F.lit(" section_heading="), heading), F.lit("")), F.lit("\n"), F.coalesce(e["text"], F.lit("")),
        )

    return F.array_join(F.transform(evidence, block), "\n\n")


def citations_of(evidence: Column) -> Column:
    """Citations of the first three pieces of evidence that have a source and a text."""
    some = F.filter(evidence, lambda e: (F.coalesce(F.element_at(e["provenance"], "source_url"), F.lit("")) != "") & (F.coalesce(e["text"], F.lit("")) != ""))
    made = F.transform(
        some,
        lambda e: F.struct(
            F.element_at(e["provenance"], "source_url").alias("source_url"),
            F.coalesce(F.element_at(e["provenance"], "scrape_timestamp"), F.lit("")).alias("scrape_timestamp"),
            F.element_at(e["provenance"], "page_title").alias("page_title"),
            F.element_at(e["provenance"], "section_heading").alias("section_heading"),
            F.substring(e["text"], 1, QUOTE).alias("quote"),
        ),
    )
    return F.slice(made, 1, CITED)


def answer_from_markdown(text: Column, evidence: Column) -> Column:
    """Answer of prose that ignored the schema; null without a text or anything to cite."""
    body = F.when(text.rlike(r"\*\*Answer\*\*\s*\n"), F.regexp_extract(text, r"(?s)\*\*Answer\*\*\s*\n(.*?)(?=\n\*\*|\z)", 1)).otherwise(text)
    body = F.nullif(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(""))
    cited = citations_of(evidence)
    return F.when(body.isNotNull() & (F.size(cited) > 0), F.struct(body.alias("answer"), cited.alias("citations")))


def json_in_text(text: Column) -> Column:
    """The text if it is JSON, else the first fenced block that is; null: none."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)```"), F.lit(1)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    good = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull() & b.rlike(r"^\s*[{\[]"))
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.get(good, 0))


def unwrap_answer(answer: Column) -> Column:
    """An answer whose text is itself a JSON answer gives the inner one; its citations only where the outer has none."""
    inner = F.from_json(F.when(F.ltrim(answer["answer"]).startswith("{"), answer["answer"]), ANSWER)
    cited = F.when(F.size(answer["citations"]) > 0, answer["citations"]).otherwise(inner["citations"])
    return F.when(inner["answer"].isNotNull(), F.struct(inner["answer"].alias("answer"), cited.alias("citations"))).otherwise(answer)


def answer_ok(answer: Column) -> Column:
    """Text and at least one citation, every quote non-empty."""
    return F.coalesce((F.length(answer["answer"]) > 0) & (F.size(answer["citations"]) > 0) & F.forall(answer["citations"], lambda c: F.length(c["quote"]) > 0), F.lit(False))


def sections_from_json(text: Column) -> Column:
    """Array of sections from JSON text; null where it is no such array."""
    return F.from_json(text, f"array<{SECTION}>")


def citations_from_json(text: Column) -> Column:
    return F.from_json(text, f"array<{CITATION}>")

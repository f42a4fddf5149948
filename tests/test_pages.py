"""Stripping, extraction, validation and chunking."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.operators import chunk, extract, strip, validate
from gleaner.schemas import EXTRACTION

ARTICLE = """<html><head><title>My page</title><script>var x = "</p>";</script></head><body>
<nav><ul><li>Home</li><li>About</li></ul></nav>
<article><h1>Main</h1><p>First paragraph.</p><p>Second one.</p><h2>Part A</h2><p>Text of A.</p><h2>Part B</h2><p>Text of B.</p></article>
<footer>Copyright</footer></body></html>"""
TABLE = "<body><h1>T</h1><p>Prose</p><h2>Data</h2><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td><td>3</td></tr></table><h2>End</h2></body>"


def test_article_keeps_headings_and_drops_furniture():
    got = strip.strip_page(ARTICLE)
    assert (got["outcome"], got["method"], got["title"]) == ("stripped", "content", "My page")
    assert [(b["heading"], b["level"]) for b in got["blocks"]] == [("Main", 1), ("Part A", 2), ("Part B", 2)]
    assert "Home" not in got["text"] and "Copyright" not in got["text"] and "var x" not in got["text"]
    assert got["text"].startswith("Main\nFirst paragraph.\n\nSecond one.\n\nPart A\nText of A.")
    assert got["num_blocks"] == 3 and got["chars_before"] == len(ARTICLE) and got["chars_after"] == len(got["text"])


def test_table_and_list():
    got = strip.strip_page(TABLE)
    assert got["num_tables"] == 1 and "A | B 1 | 3" in got["text"]
    assert "End" in [b["heading"] for b in got["blocks"]]
    assert strip.strip_page("<body><p>x</p><ul><li>a</li><li>b</li></ul></body>")["text"] == "x\n\na b"


@pytest.mark.parametrize("blank", [None, "", "   ", "\n\t"])
def test_blank_is_empty(blank):
    got = strip.strip_page(blank)
    assert got["outcome"] == "empty" and got["blocks"] == [] and got["text"] == ""


def test_fallbacks():
    assert strip.strip_page("just  text")["method"] == "raw"
    assert strip.strip_page("<script>var a</script>")["outcome"] == "empty"
    large = "<body><nav>" + "<a>menu</a> " * 900 + "</nav><p>tiny</p></body>"
    assert strip.strip_page(large)["method"] == "html-text-content"
    shown = strip.strip_page(large, "seen  by the browser")
    assert (shown["method"], shown["text"]) == ("browser-visible-text", "seen by the browser")


@given(st.text(alphabet="<>/ph1 \"'=abdivtr&;!-", max_size=200))
@settings(max_examples=200, deadline=None)
def test_never_raises(raw):
    assert strip.strip_page(raw)["outcome"] in ("stripped", "fallback", "empty")


def test_strip_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, ARTICLE, "x"), (2, None, "y")], "page_id long, html string, title string")
    out = strip.strip_pages(df)
    assert [r["outcome"] for r in out.orderBy("page_id").collect()] == ["stripped", "empty"]
    blocks = strip.blocks(out, ["page_id"]).orderBy("block_index").collect()
    assert [(b["block_index"], b["heading"]) for b in blocks] == [(1, "Main"), (2, "Part A"), (3, "Part B")]
    whole = out.filter("page_id = 1").select(strip.block_text(F.col("blocks")), "text").first()
    assert whole[0] == whole[1]


# ------------------------------------------------------------------ chunks


@given(st.text(alphabet=st.sampled_from("ab. !?\n\r\x0b\x85 xyz"), max_size=600), st.integers(5, 60))
@settings(max_examples=300, deadline=None)
def test_chunks_join_to_the_section_and_keep_the_bound(content, limit):
    made = chunk.split_section(content, limit)
    assert "".join(made) == content
    assert all(len(p) <= limit for p in made)
    assert content == "" or all(made)


def test_cut_prefers_sentences_then_blanks():
    assert list(chunk.cut_line("One two. Three four", 12)) == ["One two. ", "Three four"]
    assert list(chunk.cut_line("aaa bbb ccc", 7)) == ["aaa", " bbb", " ccc"]
    assert list(chunk.cut_line("x" * 10, 4)) == ["xxxx", "xxxx", "xx"]
    assert chunk.split_section("y" * 2000, 2000) == ["y" * 2000]


def result(spark, *rows):
    return spark.createDataFrame(list(rows), EXTRACTION)


def row(url="https://a/", sections=(("H", "text", 2),), confidence=0.9, kind="html", title="T"):
    import datetime as dt

    return (url, dt.datetime(2026, 1, 1), title, kind, confidence, None, False, [tuple(s) for s in sections])


def test_chunk_results(spark):
    df = result(spark, row(sections=[("H", "x" * 2500, 1), (None, "short", None)]), row("https://empty/", []), row("https://blank/", [("h", "ok", 1), ("h", "  ", 1)]))
    got = chunk.chunk_results(df).orderBy("section_index", "chunk_index").collect()
    assert [(r["source_url"], r["section_index"], r["chunk_index"], r["chunk_total"], len(r["content"])) for r in got] == [("https://a/", 1, 1, 2, 2000), ("https://a/", 1, 2, 2, 500), ("https://a/", 2, 1, 1, 5)]
    assert {r["url"]: r["reason"] for r in chunk.chunk_failures(df).collect()} == {"https://empty/": "no sections to chunk: extraction result is empty", "https://blank/": "section 2 has empty content"}
    stats = chunk.chunk_stats(chunk.chunk_results(df)).first()
    assert (stats["num_sections"], stats["num_chunks"], stats["sections_split"], stats["max_chunk_chars"]) == (2, 3, [1], 2000)


# ------------------------------------------------------------------ extraction, validation


def inputs(spark, *rows):
    return spark.createDataFrame([(u, None, t, k, c) for u, t, k, c in rows], "source_url string, scrape_timestamp timestamp, page_title string, content_type string, content string")


def test_routing(spark):
    def boom(*_):
        raise AssertionError("must not be asked")

    got = extract.extract(inputs(spark, ("u", "t", "unknown", "x"), ("v", "t", "html", " \n")), boom).collect()
    assert {r["source_url"]: (r["extraction_outcome"], r["confidence"], r["extraction_notes"]) for r in got} == {"u": ("flagged", 0.0, extract.UNSUPPORTED), "v": ("flagged", 0.0, extract.BLANK)}


def test_blank_sections_and_wrapping(spark):
    def half(content, *_):
        return {"sections": [{"heading": "a", "content": "kept"}, {"heading": "b", "content": "  "}], "confidence": 0.7, "extraction_notes": "n", "page_title": "model's"}

    r = extract.extract(inputs(spark, ("u", "t", "html", "body")), half).first()
    assert [s["content"] for s in r["sections"]] == ["kept"] and r["extraction_notes"] == "n | 1 empty sections filtered" and r["page_title"] == "model's" and r["content_type"] == "html"
    w = extract.extract(inputs(spark, ("u", "t", "html", " body ")), lambda *_: {"sections": [], "confidence": 0.1}).first()
    assert [s["content"] for s in w["sections"]] == ["body"] and w["confidence"] == 0.3 and w["extraction_outcome"] == "fallback_section"


def test_failing_extractor_is_tried_again_then_flagged(spark):
    r = extract.extract(inputs(spark, ("u", "t", "html", "body")), lambda *_: None).first()
    assert r["extraction_notes"] == extract.NO_OUTPUT and r["confidence"] == 0.0 and r["sections"] == []

    def broken(*_):
        raise ValueError("down")

    assert extract.extract(inputs(spark, ("u", "t", "html", "body")), broken).first()["extraction_notes"] == "llm call failed: down"
    assert extract.extract(inputs(spark, ("u", "t", "html", "body")), lambda *_: {"sections": 3, "confidence": "x"}).first()["extraction_notes"].startswith("schema validation failed")


def test_default_extractor():
    got = extract.heading_sections("Title\nBody one.\n\nNo heading here.", "html", "t")
    assert [(s["heading"], s["content"]) for s in got["sections"]] == [("Title", "Body one."), (None, "No heading here.")]


def test_error_list(spark):
    df = result(spark, row(sections=[("a", "x", 1), ("b", " ", 1)], confidence=0.49, kind="unknown"), row("https://b/", [], 0.5), row("https://c/", confidence=0.5))
    got = {r["source_url"]: r["e"] for r in df.select("source_url", validate.errors().alias("e")).collect()}
    assert got["https://a/"] == ["section 1 has empty content", "confidence below threshold", "unsupported content type: unknown"]
    assert got["https://b/"] == ["no content extracted: sections list is empty"] and got["https://c/"] == []


@pytest.mark.parametrize(("budget", "valid", "count"), [(0, False, 0), (1, True, 1), (2, True, 1)])
def test_repair_budget(spark, budget, valid, count):
    def better(content, kind, title, errors):
        return {"sections": [{"content": content}], "confidence": 0.9 if errors else 0.1}

    first = extract.extract(inputs(spark, ("u", "t", "html", "body")), better)
    r = validate.validate(first, better, budget=budget).first()
    assert (r["is_valid"], r["retry_count"], r["should_retry"]) == (valid, count, False)
    assert r["flag_reason"] == (None if valid else "repair_budget_exhausted")


def test_unknown_is_never_repaired(spark):
    first = extract.extract(inputs(spark, ("u", "t", "unknown", "body")))
    r = validate.validate(first).first()
    assert (r["is_valid"], r["retry_count"], r["flag_reason"]) == (False, 0, "unsupported_content_type")
    assert validate.validate(extract.extract(inputs(spark, ("u", "t", "html", "b")), lambda *_: {"sections": [], "confidence": 0.1}), skip_repair=True).first()["flag_reason"] == "skipped_repair"


def text_of(html):
    return strip.strip_page(html)["text"]


def test_boxes_of_links_are_left_out_whatever_they_are_called():
    links = "".join(f"<li><a href='/{i}'>item number {i}</a></li>" for i in range(5))
    prose = "<p>" + "A sentence with a <a href='/x'>link</a> in it, and then some more of it. " * 4 + "</p>"
    want = text_of(f"<body><h1>T</h1>{prose}</body>")
    assert text_of(f"<body><div class='x1'><ul>{links}</ul></div><h1>T</h1>{prose}<div>{links}</div></body>") == want
    each = "".join(f"<div><a href='/{i}'>one link a box {i}</a></div>" for i in range(5))
    assert text_of(f"<body><div>{each}</div><div id='m'><h1>T</h1>{prose}</div></body>") == want
    assert text_of(f"<body><div><h1>T</h1><div><div>{prose}<div><span>See </span>{each}</div></div></div></div></body>") == want
    assert "item number 3" in text_of(f"<body><ul>{links}</ul></body>")  # nothing but links
    assert "one link" in text_of("<body><div><a href='/'>one link</a> <a href='/'>two</a></div><p>text</p></body>")  # too few to tell
    assert "item number 3" in text_of(f"<body><div><h1>Contents</h1><p>x</p>{links}</div></body>")  # holds the heading
    assert text_of(f"<body><div><ul>{links}<h1>T</h1>{prose}") and text_of("<div></ul></div><a><a></div><div>" * 50 + "end") == "end"

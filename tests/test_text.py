"""Heuristics over HTML, MIME types, URLs and small text functions."""

import html as stdlib_html
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import answers, text
from gleaner.functions import html as H


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'string' if not isinstance(values[n], (int, float)) else 'double' if isinstance(values[n], float) else 'int'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def visible(raw):
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        raw = re.sub(pattern, " ", raw)
    return len(re.sub(r"\s", "", stdlib_html.unescape(raw)))


@pytest.mark.parametrize(
    "page",
    ["<p>hi</p>", "", "a&nbsp;b&copy;c &amp; d &#39;e&#x27; &middot;", "<script>var a='<p>';</script>x<STYLE>p{}</STYLE>y", "&&& &unknownthing; &amp;nbsp;", "é  z", "<p>unclosed <b x", "&copy 2020 &lt;b&gt;"],
)
def test_visible_length_as_the_standard_library_sees_it(spark, page):
    assert one(spark, H.visible_text_length(F.col("h")), h=page) == visible(page)


def test_looks_empty_branches(spark):
    pages = [(None,), ("",), ("<p>short</p>",), ("<p>" + "x" * 300 + "</p>",), ("x" * 300 + " Access Denied",), ("<a " + "y" * 40000 + ">" + "x" * 250 + "</a>",), ("Cloudflare " + "x" * 500,)]
    got = [r[0] for r in spark.createDataFrame(pages, "h string").select(H.looks_empty(F.col("h"))).collect()]
    assert got == [True, True, True, False, True, True, True]


def test_null_visible_length_is_zero(spark):
    assert one(spark, H.visible_text_length(F.col("h")), h=None) == 0


@pytest.mark.parametrize(
    ("mime", "kind", "htmlish"),
    [("text/html; charset=x", "html", True), ("application/pdf", "pdf", False), ("TEXT/plain", "text", True), ("application/json", "text", False), ("application/xml", "text", True), ("image/png", "unknown", False), ("", "unknown", True), (None, "unknown", True)],
)
def test_mime(spark, mime, kind, htmlish):
    row = spark.createDataFrame([(mime,)], "m string").select(H.content_type(F.col("m")), H.is_html_like(F.col("m"))).first()
    assert tuple(row) == (kind, htmlish)


def test_obstacles(spark):
    rows = [("Please verify you are human", "http://a"), ("please Log In", "http://a/login?x"), ("log in", "http://a/x"), ("We use COOKIES", "http://a"), ("Show more", "http://a"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, u string").select(H.obstacle_of(F.col("t"), F.col("u"))).collect()]
    assert got == ["captcha_gate", "session_expiry", None, "cookie_banner", "load_more", None]


def test_overlays(spark):
    rows = [("<div role='dialog'>x", "popup_modal"), ("<DIALOG open>", "popup_modal"), ('<p aria-modal="true">', "popup_modal"), ("<p>a dialog</p>", None), ("<div role=dialog>we use cookies", "cookie_banner"), ("<div role=dialog>load more", "popup_modal")]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(H.obstacle_of(F.col("t"), F.lit("https://a/"))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]
    assert [r[0] for r in spark.createDataFrame([("Close",), ("reject",), (None,)], "t string").select(H.dismiss_rank(F.col("t"), "popup_modal")).collect()] == [2, None, None]


def test_dismiss_rank_refuses_first(spark):
    rows = [("Reject all",), ("Accept all",), ("Accept necessary only",), ("More",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(H.dismiss_rank(F.col("t"))).collect()] == [0, 1, 0, None]


def test_challenge_frames(spark):
    df = spark.createDataFrame([(["https://x/RECAPTCHA/api"],), (["https://x"],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(H.has_challenge_frame(F.col("s"))).collect()] == [True, False, False]


def test_blocks_of_text(spark):
    assert one(spark, H.normalize_block(F.col("t")), t="  a \t b  \n\n\n\n c ") == "a b\n\nc"
    assert one(spark, H.collapse_spaces(F.col("t")), t=" a  b\n\tc ") == "a b c"
    assert one(spark, H.heading_level(F.col("t")), t="h3") == 3
    assert one(spark, H.heading_level(F.col("t")), t="x") is None
    assert one(spark, H.looks_html(F.col("t")), t="<x>") and not one(spark, H.looks_html(F.col("t")), t="x")


def test_title(spark):
    assert one(spark, H.title(F.col("h")), h="<title> </title><h1>B <i>c</i></h1>") == "B  c"
    assert one(spark, H.title(F.col("h")), h="<title>A</title>") == "A"
    assert one(spark, H.title(F.col("h")), h="none") is None


def test_chunk_id_is_stable(spark):
    import hashlib

    got = one(spark, text.chunk_id(F.col("u"), F.lit(1), F.lit(2)), u="http://é")
    assert got == hashlib.sha1("http://é\x001\x002".encode()).hexdigest()


def test_collection_name(spark):
    assert one(spark, text.collection_name(F.col("m"), F.lit(1024)), m="BAAI/bge-m3") == "corpus_BAAI_bge_m3_1024"
    assert one(spark, text.collection_name(F.col("m"), F.lit(8)), m="x" * 200) is None
    assert one(spark, text.collection_name(F.col("m"), F.lit(8), "bad-prefix"), m="x") is None


def test_backoff(spark):
    assert one(spark, text.backoff_seconds(F.col("a"), 1.0), a=2) == 4.0
    assert one(spark, text.backoff_seconds(F.col("a"), 1.0), a=9) == 30.0
    assert one(spark, text.backoff_seconds(F.lit(2), 1.0, F.col("r")), r="7") == 7.0
    assert one(spark, text.backoff_seconds(F.lit(2), 1.0, F.col("r")), r="soon") == 4.0


def test_domain(spark):
    assert one(spark, text.domain(F.col("u")), u="https://user@h.example:81/p?q") == "user@h.example:81"
    assert one(spark, text.domain(F.col("u")), u="no url") == "no url"


def test_previews(spark):
    assert one(spark, text.preview(F.col("t")), t="x" * 201) == "x" * 200 + "..."
    assert one(spark, text.preview(F.col("t")), t="x" * 200) == "x" * 200
    assert one(spark, text.flat_preview(F.col("t")), t=" a\n b ") == "a b"


def test_severity(spark):
    want = {"corpus_hit": "ok", "completed": "ok", "fetch_failed": "error", "no_content": "error", "flagged": "error", "timeout": "warn", "encoding_fallback": "warn", "retrying": "progress", "fetch_done": "progress", "stored": "other", "begin": "other", "empty": "other", None: "other"}
    rows = [(o,) for o in want]
    assert [r[0] for r in spark.createDataFrame(rows, "o string").select(text.severity(F.col("o"))).collect()] == list(want.values())


def test_retry_after_is_any_number(spark):
    rows = [("1500000", 1500000.0), ("0.0005", 0.0005), (" 7 ", 7.0), ("1e2", 100.0), ("soon", 4.0), ("", 4.0), (None, 4.0)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(text.backoff_seconds(F.lit(2), 1.0, F.col("t"))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]


def test_numbered_errors(spark):
    assert spark.createDataFrame([(["a", "b"],)], "e array<string>").select(text.numbered(F.col("e"))).first()[0] == "1. a\n2. b"


def test_reports(spark):
    def report(status, reason=None, sections=2, fetch="failed"):
        df = spark.createDataFrame([(status, reason, sections)], "s string, r string, n int")
        return df.select(text.ingest_report(F.lit("u"), F.col("s"), F.lit(fetch), F.col("r"), F.lit(3), F.col("n"), F.lit("0.9"), F.lit('{"errors":[]}'))).first()[0]

    assert report("blocked", "HTTP 403", fetch="blocked") == "fetch outcome=blocked reason=HTTP 403 -> no ingestion"
    assert report("no_content") == "fetch succeeded but no content to ingest"
    assert report("stored") == "url=u is_valid=True stored_chunks=3 sections=2 confidence=0.9"
    assert report("flagged", "boom").endswith("\nchunk_failed reason=boom")
    assert report("flagged", "x", None).startswith("validation failed -> not ingested")
    df = spark.createDataFrame([(None,), ("bad",)], "e string")
    assert [tuple(r) for r in df.select(text.chunk_report(F.lit(1), F.lit("c"), F.col("e")), text.exit_code(F.col("e"))).collect()] == [("stored_chunks=1 collection=c", 0), ("stored_chunks=1 collection=c\nchunk_failed reason=bad", 1)]


EVIDENCE = "e array<struct<text: string, provenance: map<string, string>>>"


def test_evidence_and_citations(spark):
    pieces = [("one", {"source_url": "u1", "section_heading": "H"}), ("", {"source_url": "u2"}), ("x" * 400, {"source_url": "u3", "scrape_timestamp": "t"}), ("four", {}), ("five", {"source_url": "u5"}), ("six", {"source_url": "u6"})]
    df = spark.createDataFrame([(pieces,)], EVIDENCE)
    shown = df.select(answers.render_evidence(F.col("e"))).first()[0]
    assert shown.startswith("[1] source_url=u1 section_heading=H\none\n\n[2] source_url=u2\n\n\n[3]") and "[4] source_url=?\nfour" in shown
    cited = df.select(answers.citations_of(F.col("e"))).first()[0]
    assert [(c["source_url"], len(c["quote"]), c["scrape_timestamp"]) for c in cited] == [("u1", 3, ""), ("u3", 300, "t"), ("u5", 4, "")]


def test_answer_rescues(spark):
    df = spark.createDataFrame([("**Answer**\nIt is so.\n\n**Citations**\n- x", [("proof", {"source_url": "u"})]), ("plain", []), ("  ", [("p", {"source_url": "u"})])], f"t string, {EVIDENCE}")
    got = [r[0] for r in df.select(answers.answer_from_markdown(F.col("t"), F.col("e"))).collect()]
    assert got[0]["answer"] == "It is so." and got[0]["citations"][0]["quote"] == "proof" and got[1] is None and got[2] is None


def test_json_in_text(spark):
    rows = [('{"a": 1}',), ('say\n```json\n{"b": 2}\n```\nend',), ("```\nnope\n```",), ("nothing",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(answers.json_in_text(F.col("t"))).collect()] == ['{"a": 1}', '{"b": 2}', None, None]


def test_unwrap(spark):
    from gleaner.schemas import ANSWER

    inner = '{"answer": "in", "citations": [{"source_url": "u", "quote": "q"}]}'
    rows = [((inner, []),), (("plain", []),), ((inner, [("s", "", None, None, "keep")]),)]
    got = [r[0] for r in spark.createDataFrame(rows, f"a {ANSWER}").select(answers.unwrap_answer(F.col("a"))).collect()]
    assert (got[0]["answer"], got[0]["citations"][0]["quote"]) == ("in", "q")
    assert got[1]["answer"] == "plain" and got[2]["citations"][0]["quote"] == "keep"


def test_sections_from_json(spark):
    rows = [('[{"heading": "h", "content": "c"}]',), ("not json",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(answers.sections_from_json(F.col("t"))).collect()]
    assert got[0][0]["content"] == "c" and not got[1]

"""Records that do not fit, bodies in other charsets, and the events that models and parsers leave."""

import datetime as dt
import json

from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.config import CorpusSettings
from gleaner.operators import live, strip
from gleaner.plans import ingest as plan
from gleaner.sources import files

T = dt.datetime(2026, 1, 1)
FETCH = schemas.FETCH_RESULT


def fetched(spark, *rows):
    return spark.createDataFrame([(u, "success", html, raw, 200, kind, None, "static", None, None) for u, html, raw, kind in rows], FETCH)


def test_bad_records_are_kept_aside_and_good_ones_go_on(spark, tmp_path):
    good = {"source_url": "https://a/", "scrape_timestamp": "2026-01-01T00:00:00Z", "content_type": "html", "confidence": 0.9, "truncated": False, "sections": [{"heading": "h", "content": "c", "level": 1}]}
    for name, text in (("1", json.dumps(good)), ("2", json.dumps(good | {"source_url": "ftp://b/", "confidence": 1.5})), ("3", '{"source_url": "https://c/", "sections": ['), ("4", json.dumps(good | {"sections": "none"}))):
        (tmp_path / f"{name}.json").write_text(text)
    done = files.sort_results(spark, str(tmp_path))
    assert [r["source_url"] for r in done.good.collect()] == ["https://a/"] and set(done.good.columns) == {f.split()[0] for f in "source_url scrape_timestamp page_title content_type confidence extraction_notes truncated sections".split()}
    bad = {r["reason"]: r["record"] for r in done.bad.collect()}
    assert set(bad) == {"unreadable record", "source_url_not_http,confidence_out_of_range"} and bad["unreadable record"]
    assert done.counts == {"read": 4, "bad": 3, "unreadable": 2}


def test_chunks_are_sorted_by_their_checks(spark):
    row = ("id", "https://a/", T, "t", "html", 0.9, None, None, 1, 1, "text", False, None, T)
    rows = [row, (*row[:8], 3, 2, *row[10:]), (*row[:10], "", *row[11:]), ("id", "x", None, *row[3:])]
    done = files.sort_chunks(spark.createDataFrame(rows, schemas.CHUNK))
    assert done.good.count() == 1 and sorted(r["reason"] for r in done.bad.collect()) == ["chunk_index_beyond_total", "content_empty", "source_url_not_http,timestamp_missing"]
    assert done.counts == {"read": 4, "bad": 3, "unreadable": 0}


def test_raw_bodies_are_read_in_their_charset(spark):
    text = '{"name": "Café Größe"}'
    rows = fetched(
        spark,
        ("https://1/", None, text.encode("latin-1"), "application/json; charset=ISO-8859-1"),
        ("https://2/", None, text.encode("utf-8"), "application/json"),
        ("https://3/", None, text.encode("cp1252"), 'text/plain; charset="windows-1252"'),
        ("https://4/", None, text.encode("latin-1"), "text/plain; charset=utf-16"),
    )
    done = plan.ingest(rows)
    assert {r["source_url"]: r["content"] for r in done.chunks.collect()} == {f"https://{k}/": text for k in (1, 2, 3)} | {"https://4/": done.chunks.filter("source_url = 'https://4/'").first()["content"]}
    lost = done.events.filter("outcome = 'encoding_fallback'").collect()
    assert [r["url"] for r in lost] in ([], ["https://4/"])  # bytes of an even number may be read as that charset


def test_undeclared_and_wrong_charsets_fall_back(spark):
    raw = "Größe?".encode("latin-1") + b"\x80"
    done = plan.ingest(fetched(spark, ("https://1/", None, raw, "text/plain; charset=ascii"), ("https://2/", None, raw, "text/plain")))
    assert {r["content"] for r in done.chunks.collect()} == {"Größe?\x80"}
    lost = done.events.filter("outcome = 'encoding_fallback'").collect()
    assert [(r["event_type"], r["url"]) for r in lost] == [("obstacle_detected", "https://1/")] and "'ascii'" in lost[0]["reason"]


def test_model_calls_and_embedders_that_give_way_are_events(spark):
    def extractor(content, kind, title, errors):
        if "down" in content:
            raise RuntimeError("no line")
        if "prose" in content:
            return None
        if "shape" in content:
            return {"sections": [{"content": "x"}]}
        return {"sections": [{"content": content}], "confidence": 0.9}

    extractor.model = "some-model"
    rows = fetched(spark, *((f"https://{w}/", None, w.encode(), "text/plain") for w in ("fine", "down", "prose", "shape")))
    done = plan.ingest(rows, extractor=extractor, corpus=CorpusSettings(model="no-such-model"))
    calls = {(r["url"], r["outcome"]): r["n"] for r in done.events.filter("event_type = 'llm_call'").groupBy("url", "outcome").agg(F.count("*").alias("n")).collect()}
    # Two tries a round, and a round of repair.
    assert calls == {("https://fine/", "success"): 1, ("https://down/", "tool_use_failed"): 4, ("https://prose/", "tool_use_parse_failed"): 4, ("https://shape/", "tool_use_parse_failed"): 4}
    assert all('"model":"some-model"' in r["details_json"] for r in done.events.filter("event_type = 'llm_call'").collect())
    fell = done.events.filter("event_type = 'embed_model_fallback'").collect()
    assert [(r["outcome"], r["url"]) for r in fell] == [("fallback", None)] and "no-such-model" in fell[0]["reason"]
    plain = plan.ingest(rows)
    assert plain.events.filter("event_type in ('llm_call', 'embed_model_fallback')").count() == 0


def test_a_page_that_is_nearly_all_markup_warns(spark):
    html = "<html><body><p>few words</p>" + '<div class="x"></div>' * 400 + "</body></html>"
    got = strip.strip_page(html)
    assert got["method"] == "html-text-content" and [w["stage"] for w in got["warnings"]] == ["ratio_fallback"]
    done = plan.ingest(fetched(spark, ("https://1/", html, None, "text/html")))
    warned = done.events.filter("event_type = 'strip_parse_warning'").collect()
    assert [(r["url"], r["outcome"]) for r in warned] == [("https://1/", "fallback")] and '"stage":"ratio_fallback"' in warned[0]["details_json"] and "9/" in warned[0]["reason"]


def test_answers_tell_how_they_came_about(spark):
    df = spark.createDataFrame([(q, f"https://{q}/", [("proof", {"source_url": "u"})]) for q in ("whole", "inner", "prose", "down")] + [("none", "https://none/", [])], "query string, url string, evidence array<struct<text: string, provenance: map<string, string>>>")
    whole = json.dumps({"answer": "yes", "citations": [{"source_url": "u", "quote": "proof"}]})

    def model(question, evidence):
        if question == "down":
            raise RuntimeError("no line")
        return {"whole": whole, "inner": json.dumps({"answer": whole, "citations": []}), "prose": "just words", "none": "just words"}[question]

    log = {r["event_type"]: r for r in live.answer_events(live.answers(df.filter("query <> 'none'"), model), F.lit(T)).collect()}
    assert set(log) == {"answer_unwrap_rescue", "answer_fallback_rescued", "answer_generation_failed"}
    assert log["answer_unwrap_rescue"]["url"] == "https://inner/" and '"answer_length":3' in log["answer_unwrap_rescue"]["details_json"]
    assert log["answer_generation_failed"]["reason"] == "llm call failed: no line" and '"evidence_count":1' in log["answer_generation_failed"]["details_json"]
    assert log["answer_fallback_rescued"]["reason"].endswith("rescued from markdown")
    lone = live.answers(df.filter("query = 'none'"), model).first()
    assert (lone["answer_outcome"], lone["answer_error"]) == ("failed", live.NO_OUTPUT)


def test_temporary_tables_go_with_their_block(spark):
    from pathlib import Path

    from gleaner import session

    with session.temporary():
        outer = session.settled(spark.range(3), "outer")
        with session.temporary():
            inner = session.settled(spark.range(4), "inner")
            assert inner.count() == 4
        assert not Path(inner._settled.removeprefix("file:")).exists() and outer.count() == 3
        path = Path(outer._settled.removeprefix("file:"))
        assert path.exists()
    assert not path.exists()

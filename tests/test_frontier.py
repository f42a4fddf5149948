"""Frontier, event log, streams, fetch decisions, sources and settings."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleaner import config, schemas
from gleaner.operators import events, fetch, frontier
from gleaner.plans import ingest as plan
from gleaner.schemas import EVENTS, FRONTIER
from gleaner.sources import files, http
from gleaner.streaming import frontier as stream

T = dt.datetime(2026, 1, 1)


def at(seconds):
    return F.timestamp_seconds(F.lit(dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc).timestamp() + seconds))


def state_of(df):
    return {r["url"]: (r["state"], r["attempts"], r["reason"]) for r in df.collect()}


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_enqueue_once(spark):
    f = frontier.add_urls(frontier.empty(spark), urls(spark, "a", "b", "a", "", None), at(0))
    assert state_of(f) == {"a": ("pending", 0, None), "b": ("pending", 0, None)}
    assert frontier.add_urls(f, urls(spark, "a", "c"), at(1)).count() == 3


def test_deadlines(spark):
    f = frontier.add_urls(frontier.empty(spark), urls(spark, "a"), at(0))
    f = frontier.mark_processing(f, urls(spark, "a"), at(0))
    f = frontier.apply_outcomes(f, spark.createDataFrame([("a", "fetch_failed", "x")], "url string, status string, reason string"), at(0))
    assert state_of(f)["a"] == ("retrying", 1, "attempts=1/2")
    assert frontier.pending_due(f, at(4)).count() == 0 and frontier.pending_due(f, at(5)).count() == 1
    f = frontier.mark_processing(f, urls(spark, "a"), at(6))
    f = frontier.apply_outcomes(f, spark.createDataFrame([("a", "fetch_failed", "x")], "url string, status string, reason string"), at(6))
    assert state_of(f)["a"] == ("failed", 2, "attempts=2/2") and f.first()["next_attempt_ts"] is None


def test_status_to_state(spark):
    names = {"stored": "done", "blocked": "blocked", "flagged": "flagged", "no_content": "failed", "fetch_failed": "retrying"}
    f = frontier.mark_processing(frontier.add_urls(frontier.empty(spark), urls(spark, *names), at(0)), urls(spark, *names), at(0))
    out = frontier.apply_outcomes(f, spark.createDataFrame([(n, n, None) for n in names], "url string, status string, reason string"), at(1))
    assert {u: s for u, (s, _, _) in state_of(out).items()} == names
    assert state_of(out)["no_content"][2] == "no_content"
    total = frontier.by_state(out).first()
    assert total["total"] == 5 and total["by_state"]["done"] == 1
    assert {r["state"]: r["n"] for r in frontier.counts(out).collect()}["failed"] == 1


def test_recovery_and_guards(spark):
    f = spark.createDataFrame([("a", "processing", 1, None, None, T, T), ("b", "done", 1, None, None, T, T)], FRONTIER)
    assert state_of(frontier.recover_interrupted(f, at(1))) == {"a": ("pending", 1, None), "b": ("done", 1, None)}
    with pytest.raises(ValueError):
        frontier.check_known(f, urls(spark, "nope"))
    frontier.check_known(f, urls(spark, "a"))
    with pytest.raises(ValueError):
        frontier.complete(f, "a", "pending")
    assert state_of(frontier.complete(f, "a", "flagged", "r"))["a"] == ("flagged", 1, "r")
    assert frontier.get(f, "a").count() == 1 and frontier.delete_url(f, "a").count() == 1
    assert [r["url"] for r in frontier.states(f).collect()] == ["a", "b"]


def random_log(seed, keys=60, n=400):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", i, rng.choice(["fetch_failed"] * 5 + ["stored", "blocked", "flagged", "no_content"])) for i in range(n)]


@pytest.mark.parametrize(("seed", "most"), [(1, 1), (2, 2), (3, 3)])
def test_fold_is_the_sequential_machine(spark, seed, most):
    log = random_log(seed)
    want: dict = {}
    for key, _, status in log:
        want[key] = stream.advance(*want.get(key, ("pending", 0)), status, most)
    got = {r["key"]: (r["state"], r["attempts"]) for r in frontier.fold(spark.createDataFrame(log, "key string, id long, status string"), most).collect()}
    assert got == want


def test_stream_is_the_fold(spark, tmp_path):
    log = random_log(7, keys=15, n=120)
    for k, part in enumerate((log[:50], log[50:90], log[90:])):
        spark.createDataFrame(part, "key string, id long, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, id long, status string").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    query = stream.frontier_stream(source).writeStream.outputMode("update").format("memory").queryName("frontier_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["key"]: (r["state"], r["attempts"]) for r in spark.sql("SELECT key, max_by(state, attempts) AS state, max(attempts) AS attempts FROM frontier_out GROUP BY key").collect()}
    want = {r["key"]: (r["state"], r["attempts"]) for r in frontier.fold(spark.createDataFrame(log, "key string, id long, status string")).collect()}
    assert got == want


@pytest.mark.parametrize("most", [1, 2, 3])
def test_stream_takes_batches_as_they_arrive_and_runs_no_python(spark, tmp_path, most):
    """Ids may go back from batch to batch; attempts after a final one change nothing; a key without a name is one key."""
    log = [(None if key == "k0" else key, i, status) for key, i, status in random_log(most, keys=12, n=150)]
    random.Random(5).shuffle(log)
    want: dict = {}
    for k in range(3):
        part = log[50 * k : 50 * k + 50]
        spark.createDataFrame(part, "key string, id long, status string").coalesce(1).write.parquet(str(tmp_path / "in" / f"n={k}"))
        for key, _, status in sorted(part, key=lambda r: r[1]):
            want[key] = stream.advance(*want.get(key, ("pending", 0)), status, most)
    got, touched = {}, []

    def keep(batch, _):
        rows = batch.collect()
        got.update({r["key"]: (r["state"], r["attempts"]) for r in rows})
        touched.append({r["key"] for r in rows})

    source = spark.readStream.schema("key string, id long, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "n=*"))
    query = stream.frontier_stream(source, most).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    plan = query._jsq.explainInternal(False)
    assert got == want and touched == [{r[0] for r in log[50 * k : 50 * k + 50]} for k in range(3)]
    assert "StateStoreSave" in plan and "Pandas" not in plan


def test_event_rates_stream(spark, tmp_path):
    spark.createDataFrame([(i, T + dt.timedelta(minutes=i), "x", "u", None, None, None) for i in range(10)], EVENTS).write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "log"))
    query = stream.event_rates(stream.live_tail(source, "u")).writeStream.outputMode("complete").format("memory").queryName("rates_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("rates_out").collect()) == [5, 5]


# ------------------------------------------------------------------ events


def test_event_ids_continue_in_order(spark):
    log = spark.createDataFrame([(7, T, "a", None, None, None, None)], EVENTS)
    new = events.event(urls(spark, "u2", "u1", "u1"), "b", F.col("url"), ts=at(0))
    out = events.append(log, new)
    assert sorted((r["id"], r["url"]) for r in out.collect()) == [(7, None), (8, "u1"), (9, "u1"), (10, "u2")]
    assert events.append(events.empty(spark), new).agg(F.min("id"), F.max("id")).first() == (1, 3)


def test_filters(spark):
    log = spark.createDataFrame([(1, T, "a", "http://x/É", None, None, None), (2, T, "b", "http://y\\z", "ok", None, None), (3, T, "a", None, None, None, None)], EVENTS)
    assert [r["id"] for r in events.recent(log, 2).collect()] == [3, 2]
    assert [r["id"] for r in events.recent(log, 9, [], None).collect()] == [3, 2, 1]
    assert [r["id"] for r in events.recent(log, 9, ["a"], "X/").collect()] == [1]
    assert [r["id"] for r in events.recent(log, 9, None, "y\\").collect()] == [2]
    assert [r["event_type"] for r in events.types(log).collect()] == ["a", "b"]


def test_spacing_across_partitions(spark):
    rng = random.Random(2)
    made = sorted((rng.randrange(500), f"http://{rng.choice('aaaaab')}/{i}") for i in range(300))
    rows = [(i, T + dt.timedelta(seconds=t), "x", u, None, None, None) for i, (t, u) in enumerate(made)]
    want, last = {}, {}
    for i, ts, _, u, *_ in rows:
        d = u[7]
        want[i] = max(0.0, 3.0 - (ts - last[d]).total_seconds()) if d in last else 0.0
        last[d] = ts
    got = {r["id"]: r["wait"] for r in events.spacing(spark.createDataFrame(rows, EVENTS).repartition(7), 3.0).collect()}
    assert got == want
    assert events.spacing(events.empty(spark)).count() == 0


def test_durations(spark):
    rows = [(1, T, "x", "u", None, None, None), (2, T + dt.timedelta(seconds=2.5), "x", "u", None, None, None), (3, T, "x", None, None, None, None)]
    got = {r["id"]: r["duration_seconds"] for r in events.stage_durations(spark.createDataFrame(rows, EVENTS), "url").collect()}
    assert got == {1: 0.0, 2: 2.5, 3: 0.0}


def test_unfinished(spark):
    log = spark.createDataFrame([(1, T, "chunk_ingest_begin", "u", None, None, None), (2, T, "chunk_ingest_complete", "u", None, None, None), (3, T, "chunk_ingest_begin", "v", None, None, None), (4, T, "chunk_ingest_begin", "u", None, None, None)], EVENTS)
    assert {(r["url"], r["begun"]) for r in events.unfinished(log).collect()} == {("u", 4), ("v", 3)}


# ------------------------------------------------------------------ fetch, sources, settings


def test_decision_table(spark):
    rows = [("blocked", "blocked", None, "text/html"), ("down", "failed", None, None), ("pdf", "success", None, "application/pdf"), ("thin", "success", "<p>x</p>", "text/html"), ("rich", "success", "<p>" + "x" * 500 + "</p>", None)]
    static = spark.createDataFrame([(u, o, h, None, 200, c, u, "static", None, None) for u, o, h, c in rows], schemas.FETCH_RESULT)
    assert {r["url"]: r["decision"] for r in fetch.decide(static).collect()} == {"blocked": "no_fallback", "down": "fallback", "pdf": "kept_static", "thin": "fallback", "rich": "kept_static"}
    browser = spark.createDataFrame([("thin", "success", "<p>rendered</p>", None, 200, "text/html", "thin", "browser", None, "rendered")], schemas.FETCH_RESULT)
    got = {r["url"]: (r["outcome"], r["fetcher"]) for r in fetch.fetch_pages(static, browser).collect()}
    assert got == {"blocked": ("blocked", "static"), "down": ("failed", "browser"), "pdf": ("success", "static"), "thin": ("success", "browser"), "rich": ("success", "static")}


def test_bodies(spark):
    rows = [("é".encode(), "utf-8"), ("é".encode("latin-1"), "utf-8"), ("é".encode("latin-1"), "ISO-8859-1"), ("é".encode(), None), (None, None)]
    got = spark.createDataFrame(rows, "b binary, c string").select(fetch.decode_body(F.col("b"), F.col("c")), fetch.encoding_fallback(F.col("b"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("é", False), ("é", True), ("é", False), ("é", False), (None, False)]
    rows = [("привет".encode("windows-1251"), "Windows-1251"), ("日本".encode("shift_jis"), "shift_jis"), ("naïve".encode("utf-16"), "utf-16"), ("é".encode(), "no-such"), (b"\xff\xfe\xfd", "utf-16"), (b"\xe9\xff", "ascii"), (b"", "koi8-r")]
    got = spark.createDataFrame(rows, "b binary, c string").select(fetch.decode_body(F.col("b"), F.col("c")), fetch.encoding_fallback(F.col("b"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("привет", False), ("日本", False), ("naïve", False), ("é", False), ("ÿþý", True), ("éÿ", True), ("", False)]


def test_statuses(spark):
    got = spark.createDataFrame([(s,) for s in (200, 403, 404, 429, 503)], "s int").select(fetch.status_outcome(F.col("s")), fetch.retryable(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("success", None), ("blocked", None), ("failed", None), ("failed", "rate_limit"), ("failed", "server_errors")]


def fake_fetch(url, settings):
    return http.blank_result(url, "success", html=f"<p>{url}</p>", status_code=200, content_type="text/html")


def test_fetch_source_and_spacing(spark):
    http.register(spark)
    got = spark.read.format("gleaner_fetch").option("urls", "http://a/1\nhttp://a/2\nhttp://b/1").option("fetcher", "tests.test_frontier:fake_fetch").option("min_interval", "0").load()
    assert {r["url"]: r["html"] for r in got.collect()} == {u: f"<p>{u}</p>" for u in ("http://a/1", "http://a/2", "http://b/1")}
    clock, slept = [0.0], []
    s = http.Spacing(1.0, lambda: clock[0], lambda x: (slept.append(x), clock.__setitem__(0, clock[0] + x)))
    assert [s.wait("http://a/1"), s.wait("http://b/1"), s.wait("http://a/2")] == [0.0, 0.0, 1.0] and slept == [1.0]
    assert http.wait_before(0, 1.0, "7") == 7.0 and 4.0 <= http.wait_before(2, 1.0, None) <= 4.5


def test_static_fetch_over_a_local_server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, kind, body = {"/ok": (200, "text/html; charset=utf-8", "é".encode("latin-1")), "/pdf": (200, "application/pdf", b"%PDF"), "/no": (403, "text/html", b"")}.get(self.path, (503, "text/html", b""))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, quick = f"http://127.0.0.1:{server.server_port}", {"backoff_base_seconds": 0.001, "max_retries": 1}
    try:
        assert http.static_fetch(base + "/ok", quick)["html"] == "é"
        assert http.static_fetch(base + "/pdf", quick)["raw"] == b"%PDF"
        assert http.static_fetch(base + "/no", quick)["outcome"] == "blocked"
        assert http.static_fetch(base + "/other", quick)["reason"] == "HTTP 503"
    finally:
        server.shutdown()
    assert http.static_fetch(base + "/ok", quick)["outcome"] == "failed"


def test_url_lists(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# no\n  http://a \n\n\t\nhttp://b\n")
    got = files.read_urls(spark, str(tmp_path / "urls.txt"))
    assert {r["url"] for r in got.collect()} == {"http://a", "http://b"}
    files.write_urls(got, str(tmp_path / "out"))
    assert files.read_urls(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        files.write_urls(urls(spark, "# only", " "), str(tmp_path / "none"))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff")
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first()["content"] == "ok �"
    assert bytes(files.read_binaries(spark, str(tmp_path / "a.txt")).first()["content"]) == b"ok \xff"
    assert files.read_view(spark, str(tmp_path / "missing"), EVENTS).count() == 0
    (tmp_path / "r.json").write_text('{"source_url": "https://a/", "scrape_timestamp": "2026-01-01T00:00:00Z", "content_type": "html", "confidence": 0.9, "truncated": false, "sections": [{"content": "x"}]}')
    assert files.read_results(spark, str(tmp_path / "r.json")).first()["sections"][0]["content"] == "x"
    (tmp_path / "bad.json").write_text('{"confidence": "high"}')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.read_results(spark, str(tmp_path / "bad.json")).collect()


def test_settings(tmp_path, monkeypatch):
    assert config.RetrySettings.of({"max_attempts": 3, "backoff_seconds": 1}).max_attempts == 3
    for bad in ({"max_attempts": 0, "backoff_seconds": 1}, {"max_attempts": 1}, {"max_attempts": 1, "backoff_seconds": 1, "x": 2}):
        with pytest.raises(ValueError):
            config.RetrySettings.of(bad)
    (tmp_path / "c.json").write_text('{"parse_retry": 1, "min_confidence": 0.5, "repair_budget": 4}')
    with pytest.raises(ValueError):
        config.load_json(config.ExtractorSettings, tmp_path / "c.json")
    with pytest.raises(ValueError):
        config.load_json(config.ExtractorSettings, tmp_path / "missing.json")
    monkeypatch.setenv(config.CORPUS_PATH_VARIABLE, "/elsewhere")
    assert config.corpus_settings().path == "/elsewhere"
    p = config.ObstaclePolicy()
    assert (p.is_enabled("captcha_gate"), p.policy_for("captcha_gate"), p.max_retries_for("blocked_clicks"), p.max_retries_for("popup_modal")) == (True, "terminal_blocked", 2, 3)
    assert (p.is_enabled("nope"), p.policy_for("nope")) == (False, "")
    with pytest.raises(ValueError):
        config.ObstaclePolicy.of({"nope": {"enabled": True, "detection_method": "x", "policy": "y"}})
    assert config.collection_name("BAAI/bge-m3", 1024) == "corpus_BAAI_bge_m3_1024"
    with pytest.raises(ValueError):
        config.collection_name("x" * 200, 4)
    (tmp_path / ".env").write_text("# c\nA='1'\nB=2\nbroken\n")
    env = {"B": "keep"}
    assert config.load_dotenv(tmp_path / ".env", env) == {"A": "1"} and env == {"B": "keep", "A": "1"}


def test_obstacles_join(spark):
    got = fetch.with_policy(spark.createDataFrame([("rate_limit",), ("odd",), (None,)], "obstacle string")).collect()
    assert [(r["obstacle"], r["policy"], r["max_retries"]) for r in got] == [("rate_limit", "retry_with_backoff", 3), ("odd", "", 3), (None, "", 3)]
    assert fetch.obstacle_table(spark).count() == 14


def test_violations(spark):
    rows = [("ftp://a", None, None, "odd", 1.5, None, False, []), ("https://a", T, None, "html", 0.5, None, False, [])]
    got = [r["violations"] for r in schemas.extraction_violations(spark.createDataFrame(rows, schemas.EXTRACTION)).collect()]
    assert got == [["source_url_not_http", "scrape_timestamp_missing", "content_type_unknown_value", "confidence_out_of_range", "empty_but_confident"], []]
    stamps = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01T00:00:00",), ("2026-01-01T02:00:00+02:00",)], "t string").select(schemas.parse_timestamp(F.col("t"))).collect()
    assert [r[0] for r in stamps] == [T, None, T]


# ------------------------------------------------------------------ the whole chain


def test_batch_end_to_end(spark):
    text = "<html><body><h1>Head</h1><p>" + "word " * 100 + "</p></body></html>"
    pages = {"https://good/": ("success", text), "https://gate/": ("blocked", None), "https://down/": ("failed", None), "https://thin/": ("success", "<p></p>")}

    def fetcher(due):
        table = spark.createDataFrame([(u, o, h, None, 200, "text/html", u, "static", None if h else "no", None) for u, (o, h) in pages.items()], schemas.FETCH_RESULT)
        return table.join(due, "url", "left_semi")

    after, done, log = plan.run_batch(frontier.empty(spark), urls(spark, *pages), fetcher, at(0))
    assert {u: s for u, (s, _, _) in state_of(after).items()} == {"https://good/": "done", "https://gate/": "blocked", "https://down/": "retrying", "https://thin/": "flagged"}
    assert {r["url"]: r["stored_chunks"] for r in done.outcomes.collect()}["https://good/"] == done.chunks.count() == 1
    kinds = {r["event_type"]: r["n"] for r in log.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {
        "fetch_attempt": 4, "strip_attempt": 2, "extraction_attempt": 3, "extraction_flagged": 2, "validation_attempt": 3, "validation_flagged": 1, "obstacle_detected": 1,
        "chunk_complete": 1, "ingest_lifecycle": 5, "batch_url_state": 4, "batch_run": 2,
    }
    last = log.filter("event_type = 'batch_run' and outcome = 'finished'").select(F.from_json("details_json", "total long, by_state map<string,long>").alias("d")).first()["d"]
    assert last["total"] == 4 and last["by_state"] == {"done": 1, "blocked": 1, "retrying": 1, "flagged": 1}
    again, _, _ = plan.run_batch(after, urls(spark, *pages), fetcher, at(10))
    assert state_of(again)["https://down/"][:2] == ("failed", 2) and state_of(again)["https://good/"][1] == 1


def test_text_content_needs_no_bytes(spark):
    fetched = spark.createDataFrame([("https://t/", "success", "plain text body", None, 200, "text/plain", None, "static", None, None), ("https://j/", "success", None, bytearray(b'{"a": 1}'), 200, "application/json", None, "static", None, None)], schemas.FETCH_RESULT)
    got = {r["url"]: r["status"] for r in plan.ingest(fetched).outcomes.collect()}
    assert got == {"https://t/": "stored", "https://j/": "stored"}
    assert {r["url"]: r["status"] for r in plan.ingest(fetched, strict_compat=True).outcomes.collect()}["https://t/"] == "no_content"
    single = plan.ingest(fetched, write_to_corpus=False)
    assert single.chunks.count() == 0 and not any(r["written"] for r in single.outcomes.collect())


class Counted:
    """Counts calls by a line in a file, whatever process they happen in."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, what):
        with open(self.path, "a") as f:
            f.write(what.replace("\n", " ") + "\n")

    def lines(self):
        try:
            return sorted(open(self.path).read().splitlines())
        except FileNotFoundError:
            return []


PAGE = "<html><body><h1>Head {0}</h1><p>" + "word " * 100 + "</p></body></html>"


def read_all(done):
    """Everything that came of a pass, several times."""
    for _ in range(2):
        done.outcomes.collect(), done.chunks.collect(), done.events.collect()


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_every_costly_step_runs_once(spark, tmp_path, budget):
    from gleaner.operators.embed import HashingEmbedder

    asked, fetched, embedded = (Counted(tmp_path / n) for n in ("asked", "fetched", "embedded"))

    def extractor(content, kind, title, errors):
        asked(content[:6])
        return {"sections": [{"content": content}], "confidence": 0.1 if content.startswith("Head 0") or not errors and content.startswith("Head 1") else 0.9}

    class Embedder(HashingEmbedder):
        def embed(self, texts):
            for t in texts:
                embedded(t[:6])
            return super().embed(texts)

    def fetcher(due):
        def run(batches):
            for pdf in batches:
                for u in pdf["url"]:
                    fetched(u)
                yield pdf

        table = spark.createDataFrame([(f"https://{i}/", "success", PAGE.format(i), None, 200, "text/html", None, "static", None, None) for i in range(10)], schemas.FETCH_RESULT)
        return table.join(due.mapInPandas(run, "url string"), "url")

    names = [f"https://{i}/" for i in range(10)]
    after, done, log = plan.run_batch(frontier.empty(spark), urls(spark, *names), fetcher, at(0), extractor=extractor, embedder=Embedder(), settings=config.ExtractorSettings(repair_budget=budget))
    read_all(done), log.collect(), after.collect()
    assert fetched.lines() == names
    repaired = (["Head 0"] * budget) + (["Head 1"] if budget else [])
    assert asked.lines() == sorted([f"Head {i}" for i in range(10)] + repaired)
    flagged = {"https://0/"} if budget else {"https://0/", "https://1/"}
    assert {r["url"] for r in done.outcomes.filter("status = 'flagged'").collect()} == flagged
    assert embedded.lines() == [f"Head {i}" for i in range(len(flagged), 10)]
    tries = log.filter("event_type = 'validation_attempt' and url = 'https://1/'").collect()
    assert sorted(r["outcome"] for r in tries) == (["repairing", "valid"] if budget else ["failed"])


def test_an_empty_page_is_extracted_twice(spark, tmp_path):
    asked = Counted(tmp_path / "asked")

    def nothing(content, *_):
        asked(content)
        return {"sections": [], "confidence": 0.0}

    fetched = spark.createDataFrame([("https://e/", "success", "<p>nearly nothing</p>", None, 200, "text/html", None, "static", None, None)], schemas.FETCH_RESULT)
    done = plan.ingest(fetched, extractor=nothing)
    read_all(done)
    assert [r["status"] for r in done.outcomes.collect()] == ["flagged"] and len(asked.lines()) == 2
    kinds = [(r["event_type"], r["outcome"]) for r in done.events.collect()]
    assert kinds.count(("extraction_attempt", "fallback_section")) == 2 and ("validation_attempt", "repairing") in kinds and ("validation_attempt", "failed") in kinds


def test_pdf_and_embedder_failures_are_outcomes(spark):
    from gleaner.operators.embed import HashingEmbedder

    class Picky(HashingEmbedder):
        def embed(self, texts):
            if any("special" in t for t in texts):
                raise RuntimeError("no vector")
            return super().embed(texts)

    rows = [(f"https://{i}/", "success", PAGE.format(i), None, 200, "text/html", None, "static", None, None) for i in range(3)]
    rows[1] = (rows[1][0], "success", PAGE.format(1).replace("word", "special", 1), *rows[1][3:])
    rows += [("https://p/", "success", None, bytearray(b"%PDF-1.4 broken"), 200, "application/pdf", None, "static", None, None), ("https://n/", "success", None, None, 200, "application/pdf", None, "static", None, None)]
    done = plan.ingest(spark.createDataFrame(rows, schemas.FETCH_RESULT), embedder=Picky())
    got = {r["url"]: (r["status"], r["reason"], r["stored_chunks"]) for r in done.outcomes.collect()}
    assert got["https://1/"] == ("flagged", "embedder failed: no vector", 0) and got["https://0/"][0] == got["https://2/"][0] == "stored"
    assert got["https://p/"][0] == "flagged" and got["https://n/"][0] == "no_content"
    assert {r["source_url"] for r in done.chunks.collect()} == {"https://0/", "https://2/"}
    notes = done.events.filter("event_type = 'extraction_flagged'").collect()
    assert len(notes) == 2 and all(n["reason"].startswith("pdf text extraction failed") for n in notes)  # the repair reads the same bytes
    failed = done.events.filter("event_type = 'chunk_failed'").collect()
    assert [(r["url"], r["details_json"]) for r in failed] == [("https://1/", '{"stage":"embed"}')]


def test_store_writes_events_and_survives_failure(spark, tmp_path):
    from gleaner.operators import corpus, events

    rows = [(f"https://{i}/", "success", PAGE.format(i), None, 200, "text/html", None, "static", None, None) for i in range(3)]
    done = plan.ingest(spark.createDataFrame(rows, schemas.FETCH_RESULT))
    collection = corpus.Corpus(spark, str(tmp_path), "corpus_hashing_64")
    stored = plan.store(done, collection, at(1))
    log = events.append(events.empty(spark), stored.events)
    assert collection.read().count() == done.chunks.count() == 3 and events.unfinished(log).count() == 0
    assert log.filter("event_type in ('chunk_ingest_begin', 'chunk_ingest_complete')").count() == 6

    class Broken(corpus.Corpus):
        def _publish(self, *_):
            raise OSError("disk is full")

    lost = plan.store(done, Broken(spark, str(tmp_path), "corpus_hashing_64"), at(2))
    assert {(r["status"], r["reason"], r["written"]) for r in lost.outcomes.collect()} == {("flagged", "store failed: OSError: disk is full", False)}
    log = events.append(log, lost.events.filter("event_type like 'chunk%'"))
    assert events.unfinished(log).count() == 3 and collection.read().count() == 3 and collection.version() == 1


def test_what_happened_on_the_way_is_told(spark):
    row = ("https://a/", "success", PAGE.format(0), None, 200, "text/html", "https://c/", "static", None, None, [("https://a/", "https://b/", 301), ("https://b/", "https://c/", 302)], [(429, 0, 1.5)], "koi", 0.25)
    done = plan.ingest(spark.createDataFrame([row], schemas.FETCH_LOG))
    got = sorted((r["outcome"], r["reason"]) for r in done.events.filter("event_type in ('obstacle_detected', 'rate_limit_wait')").collect())
    assert [o for o, _ in got] == ["encoding_fallback", "follow_and_log", "follow_and_log", "retry_with_backoff", "wait"]
    assert got[1][1] == "redirect 301: https://a/ -> https://b/"


def test_fetching_a_table_of_urls(spark):
    many = spark.range(200).select(F.concat(F.lit("https://d"), F.col("id") % 7, F.lit(".example/"), F.col("id")).alias("url")).unionAll(spark.createDataFrame([("",), (None,)], "url string"))
    got = http.fetch_urls(many, 3, fetcher="tests.test_frontier:fake_fetch", min_interval=0).collect()
    assert len(got) == 200 and all(r["outcome"] == "success" and r["hops"] == [] and r["waited"] == 0 for r in got)


def test_attempts_of_a_hot_key_are_numbered_across_partitions(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(300)] + [(None, 7), (None, 3)]
    got = frontier.running_attempts(spark.createDataFrame(rows, "key string, id long").repartition(9)).collect()
    want = {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, []).append(i)
    assert {(r["key"], r["id"]): r["attempt"] for r in got} == {(k, i): n + 1 for k, ids in want.items() for n, i in enumerate(ids)}


def test_the_furthest_of_two_outcomes_counts(spark):
    f = frontier.mark_processing(frontier.add_urls(frontier.empty(spark), urls(spark, "https://a/"), at(0)), urls(spark, "https://a/"), at(0))
    two = spark.createDataFrame([("https://a/", "fetch_failed", "x"), ("https://a/", "stored", None), ("https://a/", "blocked", "y")], "url string, status string, reason string")
    assert [r["state"] for r in frontier.apply_outcomes(f, two, at(1)).collect()] == ["done"]

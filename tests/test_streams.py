"""Deadlines that fire, the newest events of a key, unfinished ingestions, and analytics over range partitions."""

import datetime as dt
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.operators import events
from gleaner.plans.queries import QUERIES
from gleaner.plans.sql import SQL
from gleaner.schemas import EVENTS
from gleaner.streaming import deadlines, live

T = dt.datetime(2026, 1, 1)
ATTEMPTS = "key string, id long, status string"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def started(spark, tmp_path, name, **options):
    source = spark.readStream.schema(ATTEMPTS).parquet(str(tmp_path / "in"))
    view = deadlines.frontier_deadlines(source, **options)
    out = str(tmp_path / "out")

    def keep(batch, _):
        batch.write.mode("append").parquet(out)

    return view.writeStream.queryName(name).outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()


def seen(spark, tmp_path):
    try:
        return {(r["key"], r["cause"], r["state"], r["attempts"]) for r in spark.read.schema(deadlines.OUT).parquet(str(tmp_path / "out")).collect()}
    except Exception:  # noqa: BLE001  nothing is written yet
        return set()


def until(spark, tmp_path, query, want, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not want <= seen(spark, tmp_path):
        assert query.isActive, query.exception()
        time.sleep(0.5)
    assert want <= seen(spark, tmp_path), seen(spark, tmp_path)


def test_a_retry_comes_out_by_itself_and_after_a_restart(spark, tmp_path):
    put(spark, [("a", 1, "added"), ("a", 2, "fetch_failed"), ("b", 1, "stored"), ("c", 1, "added")], ATTEMPTS, tmp_path / "in")
    query = started(spark, tmp_path, "deadlines_1", backoff_seconds=3.0)
    until(spark, tmp_path, query, {("a", "added", "pending", 0), ("a", "attempt", "retrying", 1), ("b", "attempt", "done", 1), ("c", "added", "pending", 0), ("a", "due", "retrying", 1)})
    query.stop()
    put(spark, [("d", 1, "fetch_failed"), ("a", 3, "fetch_failed"), ("b", 2, "fetch_failed"), ("c", 2, "added")], ATTEMPTS, tmp_path / "in")
    query = started(spark, tmp_path, "deadlines_2", backoff_seconds=3.0)
    until(spark, tmp_path, query, {("d", "attempt", "retrying", 1), ("a", "attempt", "failed", 2)})
    query.stop()  # d's deadline passes while nothing runs
    time.sleep(3)
    query = started(spark, tmp_path, "deadlines_3", backoff_seconds=3.0)
    until(spark, tmp_path, query, {("d", "due", "retrying", 1)})
    query.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["key"], r["cause"]) for r in rows if r["cause"] == "due") == [("a", "due"), ("d", "due")]
    assert not [r for r in rows if r["key"] == "b" and r["attempts"] > 1] and sum(r["key"] == "c" for r in rows) == 1


def test_newest_events_after_every_batch(spark, tmp_path):
    rng = random.Random(3)
    log, held = [], {}
    for batch in range(3):
        new = [(100 * batch + i, T + dt.timedelta(seconds=rng.randrange(40)), "x", rng.choice(["u", "v", None]), rng.choice(["ok", None]), None, "{}") for i in range(60)]
        log += new
        put(spark, new, EVENTS, tmp_path / "log")
        view = live.newest(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "log")), 7)

        def keep(df, _):
            rows = df.collect()
            held.update({u: sorted((r["ts"], r["id"]) for r in rows if r["url"] == u) for u in {r["url"] for r in rows}})

        assert live.refresh(view, str(tmp_path / "cp"), keep, 120)
        whole = spark.createDataFrame(log, EVENTS)
        for u in ("u", "v"):
            assert held[u] == [(r["ts"], r["id"]) for r in events.for_url(whole, u, 7).collect()]
        assert len(held[None]) == 7


def test_newest_events_late_ones_too_and_without_python(spark, tmp_path):
    """Old events in new batches, equal times, no URL or an empty one: as a sort of all that has come says, for the URLs of the batch."""
    rng = random.Random(8)
    log = [(i, T + dt.timedelta(seconds=rng.randrange(30)), rng.choice("xyz"), rng.choice(["u", "u", "v", "", None]), rng.choice(["ok", None]), rng.choice(["why", None]), rng.choice(["{}", None])) for i in range(150)]
    rng.shuffle(log)
    for k in range(3):
        put(spark, log[50 * k : 50 * k + 50], EVENTS, tmp_path / "log")
    got = []

    def keep(batch, _):
        got.append(sorted((tuple(r) for r in batch.collect()), key=lambda r: r[0]))

    view = live.newest(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")), 4)
    query = view.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    for k, rows in enumerate(got):
        of = {u: sorted((r for r in log[: 50 * k + 50] if (r[3] or "") == u), key=lambda r: (r[1], r[0]))[-4:] for u in {r[3] or "" for r in log[50 * k : 50 * k + 50]}}
        assert rows == sorted((r for held in of.values() for r in held), key=lambda r: r[0])
    plan = query._jsq.explainInternal(False)
    assert len(got) == 3 and "StateStoreSave" in plan and "Pandas" not in plan and "TransformWithState" not in plan


def test_newest_events_of_no_user(spark, sf, tmp_path):
    """Events without a user have no URL, and are three rows of the query as of its SQL."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS user_id) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in QUERIES["newest_streamed"](spark, str(tmp_path)).collect()]
    want = con.execute(SQL["newest_streamed"]).fetchall()
    assert sum(r[0] is None for r in want) == 3 and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_unfinished_as_a_stream(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, at = [], T
    for i in range(120):
        at += dt.timedelta(seconds=rng.randrange(1, 30))
        rows.append((i, at, rng.choice(["chunk_ingest_begin", "chunk_ingest_complete", "other"]), f"u{rng.randrange(12)}", None, None, None))
    want = {(r["url"], r["begun"]) for r in events.unfinished(spark.createDataFrame(rows, EVENTS)).collect()}
    far = [(1000, at + dt.timedelta(days=9), "chunk_ingest_begin", "end", None, None, None), (1001, at + dt.timedelta(days=9), "chunk_ingest_complete", "end", None, None, None)]
    for part in (rows[:50], rows[50:], far):
        put(spark, part, EVENTS, tmp_path / "log")
    view = live.unfinished(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log")), "2 days", "1 minute")
    query = view.writeStream.outputMode("append").format("memory").queryName(f"unfinished_{seed}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = {}
    for r in spark.table(f"unfinished_{seed}").collect():
        got[r["url"]] = max(r["begun"], got.get(r["url"], -1))
    assert set(got.items()) == want and want


def bursts(seed, n=300):
    rng = random.Random(seed)
    made = sorted((rng.choice([0, 0, 1, 50, 51, 300]) + rng.random() * 3, f"http://{rng.choice('aaaaab')}/{i}") for i in range(n))
    return [(i, T + dt.timedelta(seconds=round(t, 6)), "x", u, None, None, None) for i, (t, u) in enumerate(made)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spacing_as_it_is_kept(spark, seed):
    rows = bursts(seed)
    step, last, want = 750_000, {}, {}
    for i, ts, _, u, *_ in rows:
        at = (ts - T) // dt.timedelta(microseconds=1)
        start = max(at, last.get(u[:8], -(10**18)) + step)
        want[i], last[u[:8]] = (start - at) / 1e6, start
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    got = events.kept_spacing(df, 0.75)
    assert {r["id"]: r["wait"] for r in got.collect()} == want and got.columns == [*df.columns, "domain", "starts", "wait"]
    assert events.kept_spacing(df, 0).filter("wait <> 0").count() == 0 and events.kept_spacing(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_durations_of_each_run(spark, seed):
    rng = random.Random(seed)
    rows, at = [], T
    for i in range(400):
        at += dt.timedelta(seconds=rng.choice([0, 1, 2, 5, 100]))
        rows.append((i, at, rng.choice(["fetch_attempt", "strip_attempt", "ingest_lifecycle"]), rng.choice(["u", "u", "u", "v", None]), None, None, None))
    held, want = {}, {}
    for i, ts, kind, u, *_ in rows:
        run, first, last = held.get(u, (0, None, None))
        if last is None or (ts - last).total_seconds() > 60 or kind == "fetch_attempt":
            run, first = run + 1, ts
        held[u] = (run, first, ts)
        want[i] = (run, round((ts - first).total_seconds(), 2))
    df = spark.createDataFrame(rows, EVENTS).repartition(4)
    got = events.run_durations(df, 60, F.col("event_type") == "fetch_attempt")
    assert {r["id"]: (r["run"], r["duration_seconds"]) for r in got.collect()} == want
    assert got.columns == [*df.columns, "run", "duration_seconds"] and events.run_durations(df.limit(0), 60).count() == 0

"""The event log as a store: exactly once, merge on read, and search by trigrams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import event_store, events
from gleaner.schemas import EVENTS

T = dt.datetime(2026, 1, 1)


def made(spark, n, seed=1, start=0):
    rng = random.Random(seed)
    hosts = ["alpha", "Beta", "gamma", "ÉCOLE", "under_score", "per%cent"]
    rows = [(0, T + dt.timedelta(seconds=start + i), rng.choice(["a", "b"]), rng.choice([None, *(f"https://{h}.org/{rng.randrange(9)}" for h in hosts)]), None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, EVENTS).drop("id").repartition(3)


def test_ids_go_on_and_batches_come_once(spark, tmp_path):
    store = event_store.EventStore(spark, str(tmp_path))
    assert store.read().count() == 0 and store.recent(5).count() == 0
    assert store.append(made(spark, 40), "s", 0) == 40
    assert store.append(made(spark, 30, 2, 100), "s", 1) == 30
    assert store.append(made(spark, 30, 2, 100), "s", 1) == 0 and store.append(made(spark, 40), "s", 0) == 0  # played again
    assert store.append(made(spark, 5, 3, 200), "other", 0) == 5 and store.append(made(spark, 0), "s", 2) == 0
    rows = store.read().orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 76)) and [r["ts"] for r in rows] == sorted(r["ts"] for r in rows)


def test_a_crash_before_the_manifest_adds_nothing(spark, tmp_path):
    class Crashes(event_store.EventStore):
        def _publish(self, *_):
            raise OSError("gone")

    store = event_store.EventStore(spark, str(tmp_path))
    store.append(made(spark, 10), "s", 0)
    with pytest.raises(OSError):
        Crashes(spark, str(tmp_path)).append(made(spark, 7, 2, 50), "s", 1)
    assert store.read().count() == 10
    assert store.append(made(spark, 7, 2, 50), "s", 1) == 7
    assert [r["id"] for r in store.read().orderBy("id").collect()] == list(range(1, 18)) and store.vacuum() == 1


def test_sink_of_a_stream(spark, tmp_path):
    schema = made(spark, 1).schema
    store = event_store.EventStore(spark, str(tmp_path / "log"))
    for k in range(3):
        made(spark, 20, k, 100 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(store.sink("in")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert [r["id"] for r in store.read().select("id").orderBy("id").collect()] == list(range(1, 61))
    # The checkpoint's last commit is lost: the batch is played again, and found to be there.
    last = max((p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    query = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(store.sink("in")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and store.read().count() == 60


def told(df):
    return [(r["id"], r["url"]) for r in df.collect()]


@pytest.mark.parametrize("pattern", ["alpha", "ALPHA.org/3", "é", "cole.org", "org/%7", "b_ta", "under_score", "none at all", "ga", "x\\y", "per%cent.org"])
def test_search_is_the_scan(spark, store, pattern):
    whole = store.read()
    for limit, types in ((500, None), (7, ["a"])):
        assert told(store.recent(limit, types, pattern)) == told(events.recent(whole, limit, types, pattern))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    kept, event_store.FILE_ROWS = event_store.FILE_ROWS, 20
    out = event_store.EventStore(spark, str(tmp_path_factory.mktemp("events")))
    for k in range(3):
        out.append(made(spark, 60, k, 1000 * k))
    out.append(spark.createDataFrame([(T + dt.timedelta(days=9), "a", "https://only-here.net/rare", None, None, None)], made(spark, 1).schema))
    out.delete_urls(["https://gamma.org/1"])
    event_store.FILE_ROWS = kept
    return out


def test_files_without_the_trigrams_are_not_read(store):
    def read(df):
        return [f for f in df.inputFiles() if "/s-" in f]  # not the names of deleted URLs

    every = read(store.read())
    assert len(every) >= 10
    assert len(store.files("only-here")) == 1 and store.files("qqqq") == [] and store.files("qq") is None
    assert len(read(store.recent(5, None, "only-here.net"))) == 1
    assert len(read(store.recent(1))) == 1 and len(read(store.recent(5))) < len(every)  # newest segments first


def test_deleting_and_merging(spark, tmp_path):
    store = event_store.EventStore(spark, str(tmp_path))
    for k in range(3):
        store.append(made(spark, 50, k, 100 * k))
    url = "https://alpha.org/1"
    n = store.read().filter(F.col("url") == url).count()
    size = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    assert n and store.delete_urls([url]) == n and store.delete_urls([url]) == 0
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) - size < 4096
    assert store.read().count() == 150 - n and store.read(3).count() == 150
    store.append(spark.createDataFrame([(T, "a", url, None, None, None)], made(spark, 1).schema))
    assert told(store.recent(9, None, "alpha.org/1")) == [(151, url)]  # what comes later stays
    want = sorted(told(store.read()), key=str)
    assert store.merge() == 6 and len(store._held()[1]["segments"]) == 1 and sorted(told(store.read()), key=str) == want
    assert store.merge() is None and store.merge(everything=True) == 7 and sorted(told(store.read()), key=str) == want
    assert store.vacuum() > 0 and sorted(told(store.read()), key=str) == want and store.append(made(spark, 1)) == 1 and store.read().agg(F.max("id")).first()[0] == 152

"""Views of the event log as it grows: the newest events of each key, ingestions that never ended, bounded refreshes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.aggregates import largest
from ..schemas import EVENTS
from ..session import exists, remove, scratch
from .deadlines import PROVIDER

NEWEST = 50


def newest(log: DataFrame, n: int = NEWEST) -> DataFrame:
    """For every URL that a batch of the log touches, its newest ``n`` events by (ts, id), oldest first.

    After each batch they are what :func:`gleaner.operators.events.for_url`
    would say of the log so far.  Events without a URL are one key.  The state
    of a key is these events, and never grows beyond them.
    """
    event = F.struct("ts", "id", "event_type", "url", "outcome", "reason", "details_json")
    held = log.groupBy(F.coalesce("url", F.lit("")).alias("_key")).agg(largest(event, n).alias("held"))
    columns = (c.split() for c in EVENTS.split(", "))
    return held.select(F.explode("held").alias("e")).select(*(F.col(f"e.{name}").cast(kind).alias(name) for name, kind in columns))


def unfinished(log: DataFrame, patience: str = "1 hour", late: str = "10 minutes", begin: str = "chunk_ingest_begin", complete: str = "chunk_ingest_complete") -> DataFrame:
    """Begins (url, begun, ts) that no completion followed within ``patience``: url, id and time.

    A stream-stream left outer join: both sides remember only what the
    watermarks, ``late`` behind the newest event, still allow to meet, and a
    begin is reported once no completion in time can come any more.
    """
    begins = log.filter(F.col("event_type") == begin).select("url", F.col("id").alias("begun"), "ts").withWatermark("ts", late)
    ends = log.filter(F.col("event_type") == complete).select(F.col("url").alias("_url"), F.col("id").alias("_ended"), F.col("ts").alias("_at")).withWatermark("_at", late)
    later = (F.col("_at") > F.col("ts")) | ((F.col("_at") == F.col("ts")) & (F.col("_ended") > F.col("begun")))
    in_time = (F.col("_at") >= F.col("ts")) & (F.col("_at") <= F.col("ts") + F.expr(f"INTERVAL {patience}"))
    return begins.join(ends, (F.col("url") == F.col("_url")) & in_time & later, "left_outer").filter("_ended is null").select("url", "begun", "ts")


def drained(view: DataFrame, name: str) -> DataFrame:
    """All that a stream's view says once it has read what is there: rows with ``_batch``, as a table of the shared folder.

    The session's state store is one that knows timers for as long as the stream runs.
    """
    spark = view.sparkSession
    key, held = "spark.sql.streaming.stateStore.providerClass", None
    held = spark.conf.get(key, None)
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    spark.conf.set(key, PROVIDER)
    try:
        query = view.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if held is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, held)
    remove(spark, checkpoint)
    schema = StructType(view.schema.fields).add("_batch", "integer")
    return spark.read.schema(schema).parquet(f"{out}/*") if exists(spark, out) else spark.createDataFrame([], schema)


def refresh(view: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], seconds: float = 60.0) -> bool:
    """Bring what ``write(batch, id)`` keeps up to date with all that has arrived, within ``seconds``; false if it took longer and was stopped.

    The next refresh goes on from the checkpoint.  ``write`` may see a batch
    again after a crash, with the same id.
    """
    query = view.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    try:
        return bool(query.awaitTermination(max(1, round(seconds))))
    finally:
        if query.isActive:
            query.stop()

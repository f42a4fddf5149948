"""The frontier as a stream: attempts in, state changes out, attempts remembered for good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import smallest
from ..schemas import TERMINAL_STATES


def advance(state: str, attempts: int, status: str, max_attempts: int) -> tuple[str, int]:
    """One attempt; a terminal state stays what it is."""
    if state in TERMINAL_STATES:
        return state, attempts
    attempts += 1
    if status == "fetch_failed":
        return ("failed" if attempts >= max_attempts else "retrying"), attempts
    return {"stored": "done", "no_content": "failed"}.get(status, status), attempts


def frontier_stream(attempts: DataFrame, max_attempts: int = 2) -> DataFrame:
    """States of the keys an incoming batch of attempts (key, id, status) touches.

    Only the first attempts of a key can count, so ``max_attempts`` of them are
    its state, and :func:`advance` over them is what comes out.  A batch comes
    after those before it whatever its ids are, by the time that Spark notes
    for it.  State has no timeout: a forgotten key would be processed again.
    """

    def step(held: Column, attempt: Column) -> Column:
        state, tries, status = held["state"], held["attempts"] + 1, attempt["status"]
        failed = F.when(tries >= max_attempts, "failed").otherwise("retrying")
        now = F.when(status == "fetch_failed", failed).when(status == "stored", "done").when(status == "no_content", "failed").otherwise(status)
        return F.when(state.isin(*TERMINAL_STATES), held).otherwise(F.struct(now.alias("state"), tries.alias("attempts")))

    timed = attempts.select("key", F.struct(F.current_timestamp().alias("batch"), "id", "status").alias("attempt"))
    first = timed.groupBy("key").agg(smallest(F.col("attempt"), max_attempts).alias("first"))
    start = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("attempts"))
    return first.select("key", F.aggregate("first", start, step).alias("s")).select("key", "s.state", "s.attempts")


def live_tail(log: DataFrame, url: str | None = None) -> DataFrame:
    """Events of one URL (or all) as they are appended."""
    return log if url is None else log.filter(F.col("url") == url)


def event_rates(log: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, late ones within the watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")

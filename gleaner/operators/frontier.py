"""The URL frontier: a state machine over URLs, as DataFrames.

States: pending, processing, retrying, and the terminal done, blocked, flagged
and failed.  Two forms: transitions on a frontier table, set by set, and a fold
that derives every URL's state from the log of its attempts without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FRONTIER, TERMINAL_STATES
from ..session import settled

MAX_ATTEMPTS = 2
BACKOFF_SECONDS = 5.0
#: Statuses from the end of the chain to its begin.
FURTHEST = ("stored", "flagged", "no_content", "blocked", "fetch_failed")


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], FRONTIER)


def add_urls(frontier: DataFrame, urls: DataFrame, now: Column | None = None) -> DataFrame:
    """Frontier with the new ones among ``urls`` (column url) as pending; blank and known ones are skipped."""
    now = F.current_timestamp() if now is None else now
    fresh = urls.select(F.col("url")).filter((F.col("url").isNotNull()) & (F.col("url") != "")).dropDuplicates(["url"]).join(frontier.select("url"), "url", "left_anti")
    none = F.lit(None)
    return frontier.unionByName(fresh.select("url", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), none.cast("timestamp").alias("next_attempt_ts"), none.cast("string").alias("reason"), now.alias("added_at"), now.alias("updated_at")))


def pending_due(frontier: DataFrame, now: Column) -> DataFrame:
    """What may be worked on: pending, or retrying with its deadline reached; oldest first."""
    return frontier.filter((F.col("state") == "pending") | ((F.col("state") == "retrying") & (F.col("next_attempt_ts") <= now))).orderBy("added_at", "url")


def states(frontier: DataFrame) -> DataFrame:
    return frontier.orderBy("added_at", "url")


def get(frontier: DataFrame, url: str) -> DataFrame:
    return frontier.filter(F.col("url") == url)


def counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("state").agg(F.count("*").alias("n")).orderBy("state")


def _update(frontier: DataFrame, hit: Column, now: Column | None, **values: Column) -> DataFrame:
    values["updated_at"] = F.current_timestamp() if now is None else now
    return frontier.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in frontier.columns))


def mark_processing(frontier: DataFrame, urls: DataFrame, now: Column | None = None) -> DataFrame:
    """The URLs in ``urls`` start an attempt."""
    hit = F.col("_hit").isNotNull()
    marked = frontier.join(urls.select("url", F.lit(1).alias("_hit")).dropDuplicates(["url"]), "url", "left").select(*frontier.columns, "_hit")
    return _update(marked, hit, now, state=F.lit("processing"), attempts=F.col("attempts") + 1).drop("_hit")


def check_known(frontier: DataFrame, urls: DataFrame) -> None:
    """ValueError where one of ``urls`` is not in the frontier."""
    if missing := urls.select("url").join(frontier.select("url"), "url", "left_anti").limit(1).collect():
        raise ValueError(f"unknown url: {missing[0]['url']}")


def next_state(status: Column, attempts: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """State after an attempt that ended in ``status``."""
    return (
        F.when(status == "stored", "done")
        .when(status.isin("blocked", "flagged"), status)
        .when(status == "no_content", "failed")
        .when(attempts >= max_attempts, "failed")
        .otherwise("retrying")
    )


def next_reason(status: Column, reason: Column, attempts: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    return (
        F.when(status == "stored", F.lit(None).cast("string"))
        .when(status.isin("blocked", "flagged"), reason)
        .when(status == "no_content", F.coalesce(F.concat(F.lit("no_content: "), F.nullif(reason, F.lit(""))), F.lit("no_content")))
        .otherwise(F.concat(F.lit("attempts="), attempts.cast("string"), F.lit(f"/{max_attempts}")))
    )


def apply_outcomes(frontier: DataFrame, outcomes: DataFrame, now: Column | None = None, max_attempts: int = MAX_ATTEMPTS, backoff_seconds: float = BACKOFF_SECONDS) -> DataFrame:
    """Frontier after the outcomes (url, status, reason) of one pass.

    A completed row keeps the deadline it had; a failure sets or clears it.  Of
    several outcomes of one URL the one that got furthest counts.
    """
    now = F.current_timestamp() if now is None else now
    rank = F.array_position(F.array(*(F.lit(x) for x in FURTHEST)), F.col("status"))
    one = outcomes.groupBy("url").agg(F.min(F.struct(rank.alias("rank"), "status", F.col("reason").alias("why"))).alias("_o"))
    joined = frontier.join(one, "url", "left").select(*frontier.columns, "_o.status", "_o.why")
    status, tries = F.col("status"), F.col("attempts")
    state = next_state(status, tries, max_attempts)
    later = F.timestamp_micros(F.unix_micros(now) + F.lit(int(backoff_seconds * 1_000_000)))
    due = F.when(status != "fetch_failed", F.col("next_attempt_ts")).when(state == "retrying", later)
    return _update(joined, status.isNotNull(), now, state=state, reason=next_reason(status, F.col("why"), tries, max_attempts), next_attempt_ts=due).drop("status", "why")


def complete(frontier: DataFrame, url: str, state: str, reason: str | None = None, now: Column | None = None) -> DataFrame:
    if state not in TERMINAL_STATES:
        raise ValueError(f"not a terminal state: {state}")
    return _update(frontier, F.col("url") == url, now, state=F.lit(state), reason=F.lit(reason).cast("string"))


def recover_interrupted(frontier: DataFrame, now: Column | None = None) -> DataFrame:
    """What was in flight goes back to pending; attempts stay."""
    return _update(frontier, F.col("state") == "processing", now, state=F.lit("pending"))


def reset(frontier: DataFrame) -> DataFrame:
    return frontier.limit(0)


def delete_url(frontier: DataFrame, url: str) -> DataFrame:
    return frontier.filter(F.col("url") != url)


def fold(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """State of every key from its attempts (key, id, status): key, state, attempts.

    Attempts are numbered by id; one is final unless it is a failed fetch with
    budget left; what follows the first final one never happened.  Only the
    first ``max_attempts`` can count, so each key's attempts are cut to these
    while they are gathered.
    """
    n = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    numbered = attempts.select("key", "id", "status").withColumn("n", n).filter(F.col("n") <= max_attempts)
    final = (F.col("status") != "fetch_failed") | (F.col("n") >= max_attempts)
    cut = numbered.groupBy("key").agg(
        F.min(F.when(final, F.col("n"))).alias("stop"),
        F.max("n").alias("most"),
        F.min_by("status", F.when(final, F.col("n"))).alias("final_status"),
        F.max_by("status", "n").alias("last_status"),
    )
    status, tries = F.coalesce("final_status", "last_status"), F.coalesce("stop", "most")
    return cut.select("key", next_state(status, tries, max_attempts).alias("state"), tries.alias("attempts"))


def by_state(states_: DataFrame) -> DataFrame:
    """One row: total, and a map of state to count."""
    return states_.groupBy("state").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("by_state"))


def running_attempts(attempts: DataFrame) -> DataFrame:
    """Each attempt with its number within its key.

    Attempts lie in range partitions by key and id, so a key with a third of all
    attempts spans many; only its count in each crosses over to the next.
    """
    ranged = settled(attempts.repartitionByRange("key", "id").withColumn("_part", F.spark_partition_id()), "attempts")
    sizes = ranged.groupBy("key", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(F.col("key").alias("_key"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("key", "_part").orderBy("id")))
    joined = own.join(shift, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("attempt", (F.col("_before") + F.col("_k")).cast("int")).drop("_part", "_p", "_key", "_k", "_before")

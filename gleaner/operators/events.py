"""The append-only event log: appending, views, and the analytics over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import domain, severity
from ..schemas import EVENTS
from ..session import discard, settled


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], EVENTS)


def event(df: DataFrame, event_type: str, url: Column | None = None, outcome: Column | None = None, reason: Column | None = None, ts: Column | None = None, **details: Column) -> DataFrame:
    """Events (without id) of the rows of ``df``; no details give a null, not an empty object.  A detail may end in ``_``, to be named like a parameter."""
    none = F.lit(None).cast("string")
    return df.select(
        (F.current_timestamp() if ts is None else ts).alias("ts"),
        F.lit(event_type).alias("event_type"),
        (none if url is None else url).alias("url"),
        (none if outcome is None else outcome).alias("outcome"),
        (none if reason is None else reason).alias("reason"),
        (F.to_json(F.struct(*(v.alias(k.rstrip("_")) for k, v in details.items()))) if details else none).alias("details_json"),
    )


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """``log`` and the new events, numbered on from its last id in order of time.

    Ids are dense: numbered inside range partitions, then shifted by a window
    over one row a partition, so the log never gathers in one task.
    """
    last = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    order = ["ts", "event_type", "url", "outcome", "reason", "details_json"]
    return log.unionByName(numbered(new, order, "id", last))


def numbered(rows: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """``rows`` with dense numbers ``after + 1 ...`` in ``order``.

    Range partitions are written before they are counted: counts and rows must
    see the same partitions.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    own = settled(ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "numbered")
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = own.join(F.broadcast(before), F.col("_part") == F.col("_p"))  # one row a partition
    return joined.withColumn(name, (F.col("_before") + F.col("_k") + after).cast("long")).drop("_part", "_p", "_k", "_before")


def seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def recent(log: DataFrame, limit: int = 200, event_types: list[str] | None = None, url_filter: str | None = None) -> DataFrame:
    """Newest first; no types and no filter mean all. ``%`` and ``_`` of the filter are wildcards."""
    rows = log
    if event_types:
        rows = rows.filter(F.col("event_type").isin(event_types))
    if url_filter:
        rows = rows.filter(F.col("url").ilike("%" + url_filter.replace("\\", "\\\\") + "%"))
    return rows.orderBy(F.desc("id")).limit(limit)


def for_url(log: DataFrame, url: str, limit: int = 200) -> DataFrame:
    """The last ``limit`` events of a URL, oldest first."""
    return log.filter(F.col("url") == url).orderBy(F.desc("ts"), F.desc("id")).limit(limit).orderBy("ts", "id")


def types(log: DataFrame) -> DataFrame:
    return log.select("event_type").distinct().orderBy("event_type")


def newest_per(log: DataFrame, *keys: str) -> DataFrame:
    """The newest event of each key; partial aggregation keeps one row a key and task."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("id")).alias("_e"))
    return best.select(*(F.col(k) if k in keys else F.col(f"_e.{k}").alias(k) for k in log.columns))


def last_n_per(log: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` events of each key, in order; rows beyond ``n`` are dropped before the sort by key is complete."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("id")))
    return log.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def severities(log: DataFrame) -> DataFrame:
    return log.withColumn("severity", severity(F.col("outcome")))


def unfinished(log: DataFrame, begin: str = "chunk_ingest_begin", complete: str = "chunk_ingest_complete") -> DataFrame:
    """URLs whose last ``begin`` has no later ``complete``."""
    last = log.filter(F.col("event_type").isin(begin, complete)).groupBy("url").agg(F.max(F.when(F.col("event_type") == begin, F.col("id"))).alias("begun"), F.max(F.when(F.col("event_type") == complete, F.col("id"))).alias("ended"))
    return last.filter(F.col("begun").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("begun")))).select("url", "begun")


def stage_durations(log: DataFrame, *keys: str) -> DataFrame:
    """Seconds of each event since the first one of its keys; the first is aggregated before it is joined back."""
    names = {k: f"_key_{k}" for k in keys}
    first = log.groupBy(*(F.col(k).alias(n) for k, n in names.items())).agg(F.min("ts").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    joined = log.join(first, same)
    return joined.withColumn("duration_seconds", F.round(seconds(F.col("ts")) - seconds(F.col("_first")), 2)).drop("_first", *names.values())


def spacing(requests: DataFrame, min_interval: float = 1.0, url_col: str = "url") -> DataFrame:
    """For each request, the gap to the one before in its domain and the wait that would keep the interval.

    Requests lie in range partitions by domain and time, so a domain with a
    third of all requests spans many; only the last time of a domain in each
    partition crosses over to the next.
    """
    keyed = requests.withColumns({"domain": domain(F.col(url_col)), "_at": seconds(F.col("ts"))})
    ranged = settled(keyed.repartitionByRange("domain", "ts", "id").withColumn("_part", F.spark_partition_id()), "spacing")
    last = ranged.groupBy("domain", "_part").agg(F.max("_at").alias("_last"))
    before = last.select(F.col("domain").alias("_d"), F.col("_part").alias("_p"), F.lag("_last").over(Window.partitionBy("domain").orderBy("_part")).alias("_before"))
    own = ranged.withColumn("_own", F.lag("_at").over(Window.partitionBy("domain", "_part").orderBy("ts", "id")))
    joined = own.join(before, F.col("domain").eqNullSafe(F.col("_d")) & (F.col("_part") == F.col("_p")))
    out = joined.withColumn("gap", F.col("_at") - F.coalesce("_own", "_before"))
    wait = F.coalesce(F.greatest(F.lit(0.0), F.lit(float(min_interval)) - F.col("gap")), F.lit(0.0))
    return out.withColumn("wait", wait).drop("_at", "_part", "_p", "_d", "_own", "_before")


def kept_spacing(requests: DataFrame, min_interval: float = 1.0, url_col: str = "url") -> DataFrame:
    """For each request, when it starts (``starts``) and how long it waits for that, if the interval in its domain is kept.

    The clock restarts after each wait, so waits add up: request i starts at
    max(t_i, start_{i-1} + d), which is i d + max over j <= i of (t_j - j d).
    The maximum is a prefix scan: inside range partitions by domain and time it
    is a window, and from partition to partition only one count and one maximum
    a domain are carried, so a domain with a third of all requests spans many.
    Times are counted in whole microseconds; ties go by id.  An interval of zero
    or less means no waits.
    """
    step = max(0, round(min_interval * 1_000_000))
    keyed = requests.withColumns({"domain": domain(F.col(url_col)), "_at": F.unix_micros(F.col("ts").cast("timestamp"))})
    ranged = keyed.repartitionByRange("domain", "ts", "id").withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("domain", "_part").orderBy("ts", "id")
    held = settled(ranged.withColumn("_i", F.row_number().over(own).cast("long")), "kept-spacing")
    ahead = F.col("_at") - F.col("_i") * step  # places count from the partition's own first request
    parts = held.groupBy("domain", "_part").agg(F.count("*").alias("_n"), F.max(ahead).alias("_m"))
    before = Window.partitionBy("domain").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Of a domain, one row a partition: what came before, and its greatest lead with places counted from the domain's first.
    counted = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = counted.withColumn("_lead", F.max(F.col("_m") - F.col("_before") * step).over(before)).select(F.col("domain").alias("_d"), F.col("_part").alias("_p"), "_before", "_lead")
    joined = held.join(carried, F.col("domain").eqNullSafe(F.col("_d")) & (F.col("_part") == F.col("_p")))
    place = F.col("_i") + F.col("_before")
    lead = F.greatest(F.max(F.col("_at") - place * step).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_lead"))
    started = joined.withColumn("_start", place * step + lead) if step else joined.withColumn("_start", F.col("_at"))
    out = started.withColumns({"starts": F.timestamp_micros("_start"), "wait": (F.col("_start") - F.col("_at")) / 1_000_000})
    return out.drop("_at", "_part", "_i", "_d", "_p", "_before", "_lead", "_start")


def run_durations(log: DataFrame, gap: float, starts: Column | None = None, key: str = "url") -> DataFrame:
    """``log`` with the number of each event's run within its key, and the seconds since that run began.

    A key's first event begins a run, and so does an event more than ``gap``
    seconds after the one before, or one that ``starts`` says begins one.  Gaps
    and islands over range partitions by key and time: the last time, the runs
    and the last beginning of a key in each partition are carried to the next,
    one row each, so a key with a third of the log spans many.
    """
    begins = F.lit(False) if starts is None else F.coalesce(starts, F.lit(False))
    marked = log.withColumns({"_at": seconds(F.col("ts")), "_b": begins})
    ranged = settled(marked.repartitionByRange(key, "ts", "id").withColumn("_part", F.spark_partition_id()), "runs")
    own, later = Window.partitionBy(key, "_part").orderBy("ts", "id"), Window.partitionBy("_k").orderBy("_p")
    last = ranged.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.max("_at").alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(later)).drop("_last")
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))
    since = F.col("_at") - F.coalesce(F.lag("_at").over(own), F.col("_before"))
    flagged = ranged.join(last, same).withColumn("_new", F.col("_b") | since.isNull() | (since > float(gap))).drop("_k", "_p", "_before", "_b")
    own_rows = own.rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumns({"_runs": F.sum(F.col("_new").cast("int")).over(own_rows), "_from": F.last(F.when(F.col("_new"), F.col("_at")), ignorenulls=True).over(own_rows)})
    held = settled(flagged, "runs-marked")
    parts = held.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.max("_runs").alias("_n"), F.max("_from").alias("_f"))
    before = later.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_k", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"), F.last("_f", ignorenulls=True).over(before).alias("_begun"))
    out = held.join(carried, same).withColumns({"run": (F.col("_runs") + F.col("_earlier")).cast("int"), "duration_seconds": F.round(F.col("_at") - F.coalesce("_from", "_begun"), 2)})
    discard(ranged)
    return out.drop("_at", "_part", "_new", "_runs", "_from", "_k", "_p", "_earlier", "_begun")


def delete_url(log: DataFrame, url: str) -> DataFrame:
    return log.filter(~F.coalesce(F.col("url") == url, F.lit(False)))

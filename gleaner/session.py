"""Sessions with the settings the engine expects, and shipping of its code to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

#: Settings of a session that this package builds; a given session is left as it is.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Streams with timers need a state store that knows them.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, app: str = "gleaner", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or get) a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Rows of an Arrow batch where the session has Spark's default: whole texts make Spark's 10,000 rows heavy.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers, once a session.

    A session that has Spark's own size of Arrow batches gets ``BATCH_ROWS``
    from here on, for all its queries; one with another size keeps it.
    """
    key, usual, ours = BATCH_ROWS
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, ours)
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", None) != context.applicationId:
        path = os.path.join(tempfile.mkdtemp(prefix="gleaner-code-"), "gleaner.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(PACKAGE.rglob("*.py")):
                out.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(path)
        context._gleaner_shipped = context.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder; on a cluster
    that is an error, for no executor sees another machine's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return context._jsc.sc().getCheckpointDir().get()


_open: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Delete, at the end of the block, every intermediate table that was written in it: what is wanted is read or written by then."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            remove(spark, path)


def settled(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Costly steps with several readers run once, lineage does not grow from pass
    to pass, and a lost executor costs a re-read.  See :func:`discard` and
    :func:`temporary`, whose innermost block the table can be made to outlive.
    """
    spark = df.sparkSession
    path = scratch(spark, name, outlive)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of :func:`settled` frames that nothing will read any more."""
    for df in frames:
        path = getattr(df, "_settled", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def scratch(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A path for a new folder of intermediate data in the shared folder."""
    path = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"
    for held in _open[-2:-1] if outlive else _open[-1:]:
        held.append((spark, path))
    return path

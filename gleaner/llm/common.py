"""Helpers that every operator of the training-data subpackage shares.

Nothing here keeps state on the driver beyond small models; anything that must
cut lineage goes to a Parquet table in the folder named by
``spark.checkpoint.dir``, which all executors see (:func:`gleaner.session.settled`).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled

#: ASCII upper and lower case, for the contracts that lower-case A-Z only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's tables through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Write a table once in the shared folder and read it back.
materialize = settled


def shuffle_width(spark: SparkSession) -> int:
    """How many hash partitions the cluster is tuned for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def unsigned_split(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def held_out(doc_id: Column) -> Column:
    """True for the rows that no training may see: remainder 1 of the three folds."""
    return unsigned_split(doc_id) == 1


def sample_key(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id only, for bounded training samples."""
    return (F.xxhash64(doc_id.cast("string"), F.lit("gleaner-sample")).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def empty_like(df: DataFrame, schema: str) -> DataFrame:
    """An empty DataFrame of ``schema`` in the session of ``df``."""
    return df.sparkSession.createDataFrame([], schema)


def tidy(made: Iterator) -> Iterator:
    """Pass ``made`` on and hand freed memory back to the system at the end: workers live on between tasks."""
    import pyarrow as pa

    yield from made
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to do
        pass

"""Aggregates that keep a bounded number of values of a group, in batches and in streams alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def smallest(value: Column, k: int) -> Column:
    """The ``k`` smallest values of a group as an array, smallest first.

    Spark has this aggregate, and PySpark's plots use it, but under no public
    name.  It keeps ``k`` values a group before the shuffle, after it and in
    the state of a stream, where a window may not stand.
    """
    return F.sort_array(InternalFunction.collect_top_k(value, k, True))


def largest(value: Column, k: int) -> Column:
    """The ``k`` largest values of a group as an array, smallest first; see :func:`smallest`."""
    return F.sort_array(InternalFunction.collect_top_k(value, k, False))

"""Deletion of a URL from frontier, log and corpus together."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Left(NamedTuple):
    frontier: DataFrame
    events: DataFrame
    corpus: DataFrame
    deleted: dict[str, int]


def delete_everywhere(frontier: DataFrame, events: DataFrame, corpus: DataFrame, url: str) -> Left:
    """The three tables without the URL, and how many rows each lost."""
    of = {"frontier": (frontier, "url"), "events": (events, "url"), "corpus": (corpus, "source_url")}
    lost = {name: df.filter(F.col(c) == url).count() for name, (df, c) in of.items()}
    kept = [df.filter(~F.coalesce(F.col(c) == url, F.lit(False))) for df, c in of.values()]
    return Left(*kept, lost)


def clear(table: DataFrame) -> tuple[DataFrame, int]:
    """An empty table of the same shape, and the rows it had."""
    return table.limit(0), table.count()

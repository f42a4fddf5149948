"""Filter interaction audit: what each of five filters removes, in every order, and its fair share.

Every document has a mask: a bit for each filter it fails.  A part of the table
(a source) is described by how many documents have each of the 32 masks, and
nothing else of it matters.  As a game, the filters ``T`` together remove
``v(T)`` documents, those whose mask meets ``T``.  Its multilinear extension is
the removal polynomial

    f(x) = sum over masks S of count(S) * (1 - product over i in S of (1 - x_i)),

kept as one coefficient for each set of variables.  At the corners of the cube
it is ``v``, so survivors and removals after any prefix of any order are corner
values; the integral of its partial derivative by ``x_i`` along the diagonal is
the Shapley value of filter ``i``, computed with exact fractions and, times
120, the documents the filter removes summed over all orders.

The masks come from built-in functions alone.  Whether a text repeats an earlier
one is told by its SHA-256: the least id of each text that occurs more than once
is aggregated (partly before the shuffle) and joined back, a join that adaptive
execution splits where one text holds a third of all rows.

Defined results: null and empty texts have no words, and fail A only, and E
where a smaller id has no text either; a null id is never smaller or larger
than another, so it neither fails E nor makes others fail; repeated rows of one
id count each and do not fail E by one another; a document with several label
rows is good, or toxic, if one of them says so; a null source is the empty
string; an empty table gives no row; long texts are read whole; columns of
other names are no input.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard
from .common import materialize

FILTERS = "ABCDE"
ORDERS = [list(p) for p in permutations(range(len(FILTERS)))]
#: What a filter lets pass: words, distinct words of a hundred, upper-case letters of a hundred characters.
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_UPPER = 2
#: White space between words, and the characters that filter D looks for.
SPACE = r"[ \t-\r]+"
MARKS = "#$%&*|"

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text (not null) fails."""
    words = F.array_remove(F.split(text, SPACE), "")
    # An array of one binds the words, so that they are split once.
    fails = F.transform(
        F.array(words),
        lambda w: (F.size(w) < LEAST_WORDS).cast("int") + F.when(100 * F.size(F.array_distinct(w)).cast("long") < LEAST_DISTINCT * F.size(w).cast("long"), 2).otherwise(0),
    )[0]
    upper = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MOST_UPPER * F.length(text).cast("long")
    return fails + F.when(upper, 4).otherwise(0) + F.when(text.rlike(f"[{MARKS}]"), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """part, mask, good, toxic and n: how many documents have that mask and those labels."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = materialize(
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("m"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("h")),
        "audit-masks",
    )
    again = seen.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("h", "first")
    said = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    late = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    joined = seen.join(said, "id", "left").join(again, "h", "left")
    no = F.lit(False)
    counts = joined.groupBy("part", (F.col("m") + F.when(late, 16).otherwise(0)).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count("*").alias("n"))
    out = materialize(counts, "audit-counts")
    discard(seen)
    return out


class RemovalPolynomial:
    """Documents removed, as a multilinear polynomial in one variable a filter: a coefficient for each set of them."""

    def __init__(self, counts: list[int]):
        self.n = len(counts).bit_length() - 1
        # 1 - prod (1 - x_i) over S has the coefficient (-1)^(|T| + 1) for each T within S, not empty: a sum over supersets.
        above = list(counts)
        for i in range(self.n):
            for t in range(len(above)):
                if not t >> i & 1:
                    above[t] += above[t | 1 << i]
        self.coefficients = [0] + [a if t.bit_count() % 2 else -a for t, a in enumerate(above)][1:]
        # Value at every corner: the sum of the coefficients of its subsets.
        self.corners = list(self.coefficients)
        for i in range(self.n):
            for t in range(len(self.corners)):
                if t >> i & 1:
                    self.corners[t] += self.corners[t ^ 1 << i]

    def shapley(self, i: int) -> Fraction:
        """The integral over t from 0 to 1 of the derivative by ``x_i`` at (t, ..., t)."""
        return sum((Fraction(c, t.bit_count()) for t, c in enumerate(self.coefficients) if t >> i & 1), Fraction(0))


def orders_of(part: str, counts: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """The rows of one part, from its documents, good and toxic ones by mask."""
    every, well, ill = (RemovalPolynomial(c) for c in (counts, good, toxic))
    total, full = sum(counts), len(counts) - 1
    scaled = [every.shapley(i) * len(ORDERS) for i in range(every.n)]
    if any(s.denominator != 1 for s in scaled):
        raise ArithmeticError("a sum over all orders is not whole")
    fails = [every.corners[1 << i] for i in range(every.n)]
    alone = [every.corners[full] - every.corners[full ^ 1 << i] for i in range(every.n)]
    rows = []
    for order in ORDERS:
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = every.corners[after] - every.corners[before]
            rows.append((part, name, step, total - every.corners[after], removed, fails[i] - removed, alone[i], well.corners[after] - well.corners[before], ill.corners[after] - ill.corners[before], int(scaled[i])))
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """One row for each part, order of the five filters and step: see :data:`RESULT`."""
    known = masks(docs, labels, id_col, text_col, part_col)
    size = 1 << len(FILTERS)

    def column(hit: Column) -> Column:
        # An array of 32 sums, one a mask.
        return F.array(*(F.coalesce(F.sum(F.when((F.col("mask") == k) & hit, F.col("n"))), F.lit(0)) for k in range(size)))

    parts = known.groupBy("part").agg(column(F.lit(True)).alias("n"), column(F.col("good")).alias("good"), column(F.col("toxic")).alias("toxic"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                few = pdf.iloc[at : at + 64]
                yield pd.DataFrame([r for p, n, g, t in zip(few["part"], few["n"], few["good"], few["toxic"], strict=True) for r in orders_of(p, *(list(map(int, c)) for c in (n, g, t)))], columns=names)

    return parts.mapInPandas(rows, RESULT)


_W = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
#: DuckDB SQL with the query's rows: every order is walked, no polynomial.
AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, {_W} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, FALSE)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
p AS (SELECT DISTINCT part FROM d),
r AS (
  SELECT p.part, o, step, o[step] AS i,
         sum(n) FILTER (WHERE NOT list_bool_or(list_transform(o[1:step], lambda k: fails[k]))) AS kept,
         sum(n) FILTER (WHERE fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])), FALSE)) AS removed,
         sum(n) FILTER (WHERE fails[o[step]] AND coalesce(list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])), FALSE)) AS redundant,
         sum(n) FILTER (WHERE fails[o[step]] AND len(list_filter(fails, lambda z: z)) = 1) AS unique_fails,
         sum(n) FILTER (WHERE good AND fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])), FALSE)) AS good_lost,
         sum(n) FILTER (WHERE toxic AND fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])), FALSE)) AS toxic_lost
  FROM p JOIN c USING (part), s GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM r"""

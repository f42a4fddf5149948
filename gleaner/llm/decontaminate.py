"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become templates: names, numbers and the units behind numbers turn into
typed placeholders, other words are lower-cased and lose their punctuation.
Windows of five template words are hashed, and the windows of the benchmark
meet those of the documents in a hash join, so a question asked again with
other numbers or names still matches.  A window of placeholders only says
nothing; it counts by its words as they stand.

An item's leak holds half of its windows, so it holds at least one of any
``n - ceil(n / 2) + 1`` of them.  Documents and items are paired through the
rarest so many alone, counted over all documents: an opening that many items
and many documents share pairs nobody.  The pairs found, and only those, are
then laid side by side with all their windows.

An alignment lays an item beside one stretch of a document: the matches whose
places differ from the item's by about the same (a band of ``2 * DRIFT``
shifts, so that a value of one word more does not break it), one a window of
the item.  Whether the stretch is the same question shows in its slots: a value
of the item has to stand for one value of the document, and the other way round.

A pair (document, item) is a leak when one alignment holds at least half of the
item's windows and at least four fifths of its slot values, on either side, map
to one value (or it has no slots).  The alignment with most windows, then the
most consistent, then the first is reported.  The benchmark's windows are
broadcast only up to ``BROADCAST_WINDOWS`` rows, counted first; beyond it the
same join is a shuffled one.

Defined results: items of one to four template words are one window, and so are
such documents, so a short item matches a text that is nothing else; items
without a word match nothing; of items with the same template the smallest id is reported;
null and empty texts are clean; an empty table, of documents or items, gives no
row; texts are read whole, however long; rows with equal id and text are one
document; null ids are allowed; columns of other names are no input.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard
from .common import materialize

WORDS = 5
COVERAGE = 0.5
CONSISTENCY = 0.8
#: Half the width of an alignment, in words.
DRIFT = 4
BROADCAST_WINDOWS = 200_000

#: Placeholders: private-use characters, so that no word can be one.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
#: Units that turn into a placeholder behind a number.
UNITS = (
    "km m cm mm mile miles mi ft feet foot inch inches yard yards kg g mg lb lbs pound pounds ounce ounces oz ton tons "
    "l ml liter liters litre litres gallon gallons h hr hrs hour hours min mins minute minutes s sec secs second seconds "
    "day days week weeks month months year years dollar dollars usd eur euro euros cent cents percent degree degrees "
    "mph kmh hz khz mhz ghz kb mb gb tb w kw mw v kv a ma j kj cal kcal n pa kpa mol"
).split()

LONE_MARKS = r"(?<!\S)[^\p{L}\p{N}\s]++(?!\S)"
NAME_WORD = r"(?<=[\p{Ll},;:] )\p{Lu}[\p{Ll}'’-]++\S*+"
NUMBER_WORD = r"(?<!\S)[^\s\p{N}]*+\p{N}\S*+"
UNIT_WORD = rf"(?i)(?<={NUMBER} )(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])\S*+"
MARKS = rf"[^\p{{L}}\p{{N}}{NAME}{NUMBER}{UNIT}\s]++"


def raw_words(text: Column) -> Column:
    """White-space-separated words that hold a letter or a digit, as they stand."""
    return F.array_remove(F.split(F.regexp_replace(text, LONE_MARKS, ""), r"\s+"), "")


def template_words(text: Column) -> Column:
    """The template, word for word alongside :func:`raw_words`."""
    t = F.regexp_replace(text, LONE_MARKS, "")
    t = F.regexp_replace(t, NAME_WORD, NAME)
    t = F.regexp_replace(t, NUMBER_WORD, NUMBER)
    t = F.regexp_replace(t, UNIT_WORD, UNIT)
    return F.array_remove(F.split(F.regexp_replace(F.lower(t), MARKS, ""), r"\s+"), "")


def _windows(words: Column) -> Column:
    last = F.greatest(F.size(words) - WORDS, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, WORDS)))).otherwise(F.array().cast("array<bigint>"))


def _bare(spark: SparkSession) -> list[int]:
    """Hashes of the windows of placeholders only, short ones included."""
    rows = [(list(w),) for n in range(1, WORDS + 1) for w in product((NAME, NUMBER, UNIT), repeat=n)]
    return [r[0] for r in spark.createDataFrame(rows, "w array<string>").select(F.xxhash64("w")).collect()]


def windows(words: Column, raws: Column, bare: list[int]) -> Column:
    """Hashes of all windows, in order; fewer words are one window, none are none; bare windows as hashes of their raw words."""
    # An array of one binds a value for the expressions inside, so that nothing is computed for each window again,
    # and raw words not at all where no window is bare.
    def with_raws(plain: Column, own: Column) -> Column:
        return F.transform(plain, lambda h, i: F.when(h.isin(bare), F.xxhash64(F.slice(own, i + 1, WORDS), F.lit(WORDS))).otherwise(h))

    bound = F.transform(F.array(_windows(words)), lambda plain: F.when(F.exists(plain, lambda h: h.isin(bare)), F.transform(F.array(raws), lambda own: with_raws(plain, own))[0]).otherwise(plain))
    return bound[0]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """One row for each leak: id, item, coverage, n_windows, n_slots, slot_consistency, reparameterised, and ``dg`` (text hash)."""
    spark = docs.sparkSession
    items = materialize(
        benchmark.select(F.col(item_col).alias("item"), _text(item_text_col).alias("t"))
        .select("item", template_words(F.col("t")).alias("words"), raw_words(F.col("t")).alias("raws"))
        .groupBy("words")
        .agg(F.min("item").alias("item"), F.min_by("raws", "item").alias("raws"))
        .filter(F.size("words") > 0)
        .select("item", "words", "raws", F.greatest(F.size("words") - WORDS + 1, F.lit(1)).alias("n_windows"), F.xxhash64("words").alias("tid")),
        "items",
    )
    bare = _bare(spark)
    asked = materialize(items.select("tid", "n_windows", F.posexplode(windows(F.col("words"), F.col("raws"), bare)).alias("at", "h")), "item-windows")
    small = (items.agg(F.sum("n_windows")).first()[0] or 0) <= BROADCAST_WINDOWS

    def few(df: DataFrame) -> DataFrame:
        """At most a row a window of the benchmark: broadcast if these were counted to be few."""
        return F.broadcast(df) if small else df

    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string"), F.col(id_col).cast("string")).alias("dg"), _text(text_col).alias("t"))
    placed = keyed.select("id", "dg", template_words(F.col("t")).alias("words"), "t").select("id", "dg", F.posexplode(windows(F.col("words"), raw_words(F.col("t")), bare)).alias("place", "h"))
    held = materialize(placed.join(few(asked.select("h").distinct()), "h", "left_semi"), "document-windows")
    # The rarest windows of every item, as many as a leak cannot do without.
    often = held.groupBy("h").agg(F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.partitionBy("tid").orderBy(F.coalesce("n_docs", F.lit(0)), "at"))
    spared = F.ceil(F.col("n_windows") * COVERAGE).cast("int") - 1
    rare = asked.join(often, "h", "left").withColumn("rank", rank).filter((F.col("rank") <= F.col("n_windows") - spared) & F.col("n_docs").isNotNull())
    pairs = materialize(held.select("dg", "h").join(few(rare.select("tid", "h").distinct()), "h").select("dg", "tid").distinct(), "template-pairs")
    # One match for each window of the item in an alignment: a repeated window adds nothing.
    band = F.floor((F.col("place") - F.col("at")) / DRIFT)
    sides = pairs.join(few(asked.select("tid", "at", "h")), "tid").join(held, ["dg", "h"])
    met = sides.select("id", "dg", "tid", "at", "place", F.explode(F.array(band, band - 1)).alias("band"))
    met = materialize(met.groupBy("dg", "tid", "band", "at").agg(F.min("place").alias("place"), F.min("id").alias("id")), "template-matches")
    close = (
        met.groupBy("dg", "tid", "band")
        .agg(F.min("id").alias("id"), F.count("*").alias("hit"))
        .join(items.select("tid", "item", "n_windows"), "tid")
        .filter(F.col("hit") >= COVERAGE * F.col("n_windows"))
    )
    close = materialize(close, "close-pairs")

    # Slots, for close pairs only: the values that an alignment lays side by side.
    full = keyed.join(close.select("dg").distinct(), "dg", "left_semi").dropDuplicates(["dg"]).select("dg", raw_words(F.col("t")).alias("doc_raws"))
    slots = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.struct(F.get("words", F.col("at") + k).alias("kind"), F.get("raws", F.col("at") + k).alias("ours"), F.get("doc_raws", F.col("place") + k).alias("theirs"))),
        lambda s: F.coalesce(s["kind"].isin(NAME, NUMBER, UNIT), F.lit(False)),
    )
    key = ["dg", "tid", "band"]
    values = materialize(
        met.join(close.select(*key), key)
        .join(items.filter(F.exists("words", lambda w: w.isin(NAME, NUMBER, UNIT))).select("tid", "words", "raws"), "tid")
        .join(full, "dg")
        .select(*key, F.explode(slots).alias("s"))
        .select(*key, "s.kind", "s.ours", "s.theirs")
        .distinct(),
        "slot-values",
    )
    ours = values.groupBy(*key, "kind", "ours").agg(F.count("*").alias("n"), F.max(F.col("ours") != F.col("theirs")).alias("other"))
    theirs = values.groupBy(*key, "kind", "theirs").agg(F.count("*").alias("n"))
    one = F.avg((F.col("n") == 1).cast("double"))
    fits = ours.groupBy(*key).agg(F.count("*").alias("n_slots"), one.alias("a"), F.max("other").alias("other")).join(theirs.groupBy(*key).agg(one.alias("b")), key)
    judged = close.join(fits, key, "left").withColumn("same", F.coalesce(F.least("a", "b"), F.lit(1.0))).filter(F.col("same") >= CONSISTENCY)
    # Counters for maxima: more windows, more consistent, first.
    best = judged.groupBy("dg", "tid").agg(F.max(F.struct("hit", "same", (-F.col("band")).alias("first"), "id", "item", "n_windows", "n_slots", "other")).alias("l"))
    out = best.select(
        F.col("l.id").alias(id_col),
        F.col("l.item").alias(item_col),
        (F.col("l.hit") / F.col("l.n_windows")).alias("coverage"),
        F.col("l.n_windows").alias("n_windows"),
        F.coalesce("l.n_slots", F.lit(0)).cast("long").alias("n_slots"),
        F.col("l.same").alias("slot_consistency"),
        F.coalesce("l.other", F.lit(False)).alias("reparameterised"),
        "dg",
    )
    out = materialize(out, "leaks")
    discard(items, asked, held, pairs, met, close, values)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs``, all columns, that leak no benchmark item."""
    gone = find_leaks(docs, benchmark, id_col, text_col).select(F.col("dg").alias("_gone")).distinct()
    mark = F.xxhash64(F.col(text_col).cast("string"), F.col(id_col).cast("string"))
    return docs.join(gone, mark == F.col("_gone"), "left_anti")


_UNITS = "|".join(UNITS)
_ITEM_IS = {"item": ("benchmark", "item_id"), "doc": ("documents", "doc_id")}


def _words_sql(name: str) -> str:
    """CTEs that turn a table into word lists: ``r`` raw, ``c`` template."""
    table, key = _ITEM_IS[name]
    return rf"""
{name}0 AS (SELECT {key} AS id, regexp_extract_all(coalesce(text, ''), '(\s*)(\S+)', 1) AS s, regexp_extract_all(coalesce(text, ''), '(\s*)(\S+)', 2) AS w FROM {table}),
{name}1 AS (SELECT id, array_to_string(list_transform(w, lambda x, i: s[i] || CASE WHEN regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN x ELSE '' END), '') AS t FROM {name}0),
{name}2 AS (SELECT id, regexp_extract_all(t, '(\s*)(\S+)', 1) AS s, regexp_extract_all(t, '(\s*)(\S+)', 2) AS r FROM {name}1),
{name}3 AS (SELECT id, s, r, list_transform(r, lambda x, i: CASE
    WHEN i > 1 AND s[i] = ' ' AND regexp_matches(r[i - 1], '[\p{{Ll}},;:]$') AND regexp_matches(x, '^\p{{Lu}}[\p{{Ll}}''’-]+') THEN '<name>'
    WHEN regexp_matches(x, '\p{{N}}') THEN '<number>' ELSE x END) AS k FROM {name}2),
{name} AS (SELECT id, r, list_transform(k, lambda x, i: CASE WHEN x IN ('<name>', '<number>') THEN x
    WHEN i > 1 AND k[i - 1] = '<number>' AND s[i] = ' ' AND regexp_matches(x, '^(?i:{_UNITS})([^\p{{L}}\p{{N}}].*)?$') THEN '<unit>'
    ELSE regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g') END) AS c FROM {name}3)"""


def _window_sql(at: str) -> str:
    """The template window, or the raw words of one that is placeholders only."""
    kinds = "['<name>', '<number>', '<unit>']"
    cut = f"[{at}:{at} + {WORDS - 1}]"
    return f"CASE WHEN list_has_all({kinds}, c{cut}) THEN list_concat(['='], r{cut}) ELSE c{cut} END"


#: DuckDB SQL with the query's rows.
LEAK_SQL = rf"""
WITH {_words_sql("item")},{_words_sql("doc")},
items AS (SELECT min(id) AS item_id, arg_min(r, id) AS r, c, greatest(len(c) - {WORDS - 1}, 1) AS n FROM item WHERE len(c) > 0 GROUP BY c),
iw AS (SELECT item_id, r, c, n, unnest(range(1, n + 1)) AS i FROM items),
dw AS (SELECT id AS doc_id, r, c, unnest(range(1, greatest(len(c) - {WORDS - 1}, 1) + 1)) AS j FROM doc WHERE len(c) > 0),
iw5 AS (SELECT item_id, r, c, n, i, {_window_sql("i")} AS w FROM iw),
dw5 AS (SELECT doc_id, r, j, {_window_sql("j")} AS w FROM dw),
hits AS (SELECT doc_id, item_id, n, i, j, t.r AS ir, t.c AS ic, d.r AS dr, CAST(floor((j - i) / {DRIFT}.0) AS BIGINT) - o AS band
         FROM dw5 d JOIN iw5 t USING (w), (SELECT unnest([0, 1]) AS o)),
met AS (SELECT doc_id, item_id, band, i, min(j) AS j, any_value(n) AS n, any_value(ir) AS ir, any_value(ic) AS ic, any_value(dr) AS dr FROM hits GROUP BY doc_id, item_id, band, i),
near AS (SELECT doc_id, item_id, band, n, count(*) AS hit FROM met GROUP BY ALL HAVING count(*) >= {COVERAGE} * n),
slot AS (
  SELECT DISTINCT doc_id, item_id, band, ic[i + o] AS kind, ir[i + o] AS ours, dr[j + o] AS theirs
  FROM met JOIN near USING (doc_id, item_id, band), (SELECT unnest(range(0, {WORDS})) AS o) WHERE ic[i + o] IN ('<name>', '<number>', '<unit>')),
ours AS (SELECT doc_id, item_id, band, kind, ours, count(*) AS k, bool_or(ours <> theirs) AS other FROM slot GROUP BY ALL),
theirs AS (SELECT doc_id, item_id, band, kind, theirs, count(*) AS k FROM slot GROUP BY ALL),
fit AS (
  SELECT * FROM (SELECT doc_id, item_id, band, count(*) AS n_slots, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS a, bool_or(other) AS other FROM ours GROUP BY ALL)
  JOIN (SELECT doc_id, item_id, band, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS b FROM theirs GROUP BY ALL) USING (doc_id, item_id, band)),
judged AS (SELECT *, coalesce(least(a, b), 1.0) AS same FROM near LEFT JOIN fit USING (doc_id, item_id, band))
SELECT doc_id, item_id, hit / n AS coverage, CAST(n AS INTEGER) AS n_windows, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots, same AS slot_consistency,
       coalesce(other, FALSE) AS reparameterised, TRUE AS contaminated
FROM judged WHERE same >= {CONSISTENCY} QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY hit DESC, same DESC, band) = 1"""

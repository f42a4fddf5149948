"""Fetch decisions over tables of static and rendered fetches; the network itself is a pluggable source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OBSTACLES
from ..functions import html as H

THRESHOLD = 100
#: Reasons of the decisions.
BLOCKED = "blocked by site, no browser fallback"
INSUFFICIENT = "static content insufficient, falling back to browser fetch"
SUFFICIENT = "static fetch sufficient"
NOT_HTML = "non-HTML content type, static only"


def status_outcome(status: Column) -> Column:
    """Outcome of one HTTP status, retries used up."""
    return F.when(status.between(200, 299), "success").when(status == 403, "blocked").otherwise("failed")


def retryable(status: Column) -> Column:
    """The obstacle behind a status that is worth another try; null: none."""
    return F.when(status == 429, "rate_limit").when(status.between(500, 599), "server_errors")


#: Charsets that need no Python: UTF-8 and what the JVM decodes the same way for any bytes.
UTF8 = ("", "utf-8", "utf8", "utf_8", "u8")
LATIN = ("latin-1", "latin1", "latin_1", "l1", "iso-8859-1", "iso8859-1", "iso_8859_1", "iso8859", "8859", "cp819")


def _declared(body: Column, charset: Column) -> Column:
    """Text in the declared charset; null where there is no such charset or the bytes do not fit it."""

    @F.pandas_udf("string")
    def text(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
        out = []
        for raw, name in zip(bodies, charsets, strict=True):
            try:
                out.append(None if raw is None else bytes(raw).decode(name))
            except (LookupError, UnicodeDecodeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return text(body, charset)


def _charset(charset: Column) -> Column:
    return F.lower(F.trim(F.coalesce(charset, F.lit(""))))


def decode_body(body: Column, charset: Column) -> Column:
    """Text of bytes: the declared charset where it fits, else UTF-8, else Latin-1.

    Bodies in UTF-8 and Latin-1, declared or not, stay in the JVM; only the
    others are handed to Python.
    """
    low = _charset(charset)
    other = F.when(~low.isin(*UTF8, *LATIN), body)
    return F.when(low.isin(*LATIN), F.decode(body, "ISO-8859-1")).otherwise(F.coalesce(_declared(other, low), F.try_validate_utf8(body.cast("string")), F.decode(body, "ISO-8859-1")))


def encoding_fallback(body: Column, charset: Column) -> Column:
    """Was neither the declared charset nor UTF-8 good for the bytes?"""
    low = _charset(charset)
    return ~low.isin(*LATIN) & body.isNotNull() & F.try_validate_utf8(body.cast("string")).isNull() & _declared(F.when(~low.isin(*UTF8, *LATIN), body), low).isNull()


def decide(static: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Static results with ``decision``, ``decision_reason`` and ``needs_browser``."""
    htmlish = H.is_html_like(F.col("content_type"))
    static = static.withColumn("_visible", H.visible_text_length(F.col("html")))  # costly and read more than once
    static = static.withColumn("_short", F.col("html").isNull() | H.looks_empty(F.col("html"), threshold, F.col("_visible")))
    short = F.col("_short")
    decision = F.when(F.col("outcome") == "blocked", "no_fallback").when(F.col("outcome") != "success", "fallback").when(~htmlish, "kept_static").when(short, "fallback").otherwise("kept_static")
    reason = (
        F.when(F.col("outcome") == "blocked", BLOCKED)
        .when(F.col("outcome") != "success", F.concat(F.lit("static fetch failed ("), F.coalesce("reason", F.lit("None")), F.lit("), falling back to browser fetch")))
        .when(~htmlish, NOT_HTML)
        .when(short, INSUFFICIENT)
        .otherwise(SUFFICIENT)
    )
    out = static.withColumns({"decision": decision, "decision_reason": reason})
    return out.withColumn("needs_browser", F.col("decision") == "fallback").drop("_short", "_visible")


def fetch_pages(static: DataFrame, browser: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One fetch result for each static one: itself, or the rendered one where it is needed and there is one.

    Both tables have the columns of a fetch result; a needed but missing
    rendering is a failed fetch.
    """
    fields = ["outcome", "html", "raw", "status_code", "content_type", "final_url", "fetcher", "reason", "visible_text"]
    decided = decide(static, threshold)
    if browser is None:
        missing = F.col("needs_browser") & (F.col("outcome") == "success")
        return decided.withColumns({"reason": F.when(missing, "no rendered page").otherwise(F.col("reason")), "outcome": F.when(missing, "empty").otherwise(F.col("outcome"))})
    other = browser.select(F.col("url").alias("_url"), F.struct(*fields).alias("_b"))
    joined = decided.join(other, F.col("needs_browser") & (F.col("url") == F.col("_url")), "left")
    failed = F.struct(
        F.lit("failed").alias("outcome"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("int").alias("status_code"),
        F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("final_url"), F.lit("browser").alias("fetcher"), F.lit("no rendered page").alias("reason"), F.lit(None).cast("string").alias("visible_text"),
    )
    chosen = F.when(~F.col("needs_browser"), F.struct(*fields)).otherwise(F.coalesce("_b", failed))
    return joined.withColumn("_c", chosen).select("url", "_c.*", "decision", "decision_reason", "needs_browser")


def static_from_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Offline source: stored pages as successful static fetches."""
    none = F.lit(None)
    return pages.select(
        F.col(url_col).alias("url"), F.when(F.coalesce(F.length(html_col), F.lit(0)) > 0, "success").otherwise("failed").alias("outcome"), F.col(html_col).alias("html"), none.cast("binary").alias("raw"), F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"), F.col(url_col).alias("final_url"), F.lit("static").alias("fetcher"), none.cast("string").alias("reason"), none.cast("string").alias("visible_text"),
    )


def redirect_hops(fetches: DataFrame, hops_col: str = "hops") -> DataFrame:
    """One row a redirect: url, hop number from 1, from, to."""
    hop = fetches.select("url", F.posexplode(hops_col).alias("_i", "to_url"), hops_col)
    return hop.select("url", (F.col("_i") + 1).alias("hop"), F.when(F.col("_i") == 0, F.col("url")).otherwise(F.get(hops_col, F.col("_i") - 1)).alias("from_url"), "to_url")


def obstacle_table(spark) -> DataFrame:
    """The obstacle policy as a table of fourteen rows."""
    return spark.createDataFrame(list(OBSTACLES), "obstacle string, enabled boolean, detection_method string, policy string, max_retries int")


def with_policy(found: DataFrame, obstacle_col: str = "obstacle") -> DataFrame:
    """Rows with the policy of their obstacle; unknown ones are off, without policy, three retries."""
    table = F.broadcast(obstacle_table(found.sparkSession).withColumnRenamed("obstacle", "_o"))  # fourteen rows
    out = found.join(table, F.col(obstacle_col) == F.col("_o"), "left").drop("_o")
    return out.withColumns({"enabled": F.coalesce("enabled", F.lit(False)), "policy": F.coalesce("policy", F.lit("")), "max_retries": F.coalesce("max_retries", F.lit(3))})

"""A pluggable fetch source: a Python data source that calls a fetcher for every URL.

The default fetcher uses the standard library; any module-level callable
``(url, settings) -> dict`` with the columns of a fetch result can replace it,
a rendering browser included.  Retries, backoff and the spacing of requests to
one domain happen here; nothing else in the package touches the network.
"""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import domain
from ..schemas import FETCH_LOG, FETCH_RESULT

MOST_WAIT = 30.0
TEXT_TYPES = ("text/", "html", "xml")


def wait_before(attempt: int, base: float, retry_after: str | None, jitter: float = 0.5) -> float:
    """A numeric Retry-After wins, else powers of two up to half a minute, and some jitter."""
    try:
        return float(retry_after)
    except (TypeError, ValueError):
        return min(MOST_WAIT, base * 2**attempt) + random.uniform(0, jitter)


class Spacing:
    """Keeps an interval between requests to one domain, in one task."""

    def __init__(self, interval: float, clock=time.monotonic, sleep=time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, {}

    def wait(self, url: str) -> float:
        domain = urlsplit(url).netloc or url
        gap = self.clock() - self.last.get(domain, float("-inf"))
        pause = max(0.0, self.interval - gap)
        if pause:
            self.sleep(pause)
        self.last[domain] = self.clock()
        return pause


class _Hops(HTTPRedirectHandler):
    def __init__(self, most: int):
        self.max_redirections, self.hops = most, []

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.hops.append((req.full_url, newurl, code))
        return super().redirect_request(req, fp, code, msg, headers, newurl)


FIELDS = tuple(f.split()[0] for f in FETCH_RESULT.split(", "))
LOGGED = (*FIELDS, "hops", "retries", "lost_charset", "waited")


def blank_result(url: str, outcome: str, reason: str | None = None, **more) -> dict:
    return dict.fromkeys(LOGGED) | {"url": url, "outcome": outcome, "fetcher": "static", "reason": reason} | more


def static_fetch(url: str, settings: dict) -> dict:
    """One GET with bounded retries: 403 is blocked, 429 and server errors are tried again, the rest fails.

    Redirects, retries and a charset that did not hold are told with the result.
    """
    base, limit = float(settings.get("backoff_base_seconds", 1.0)), int(settings.get("max_retries", 3))
    hops, retries = _Hops(int(settings.get("max_redirects", 10))), []
    told = {"hops": hops.hops, "retries": retries}
    for attempt in range(limit + 1):
        try:
            with build_opener(hops).open(Request(url, headers={"User-Agent": settings.get("user_agent", "gleaner/0.1")}), timeout=float(settings.get("timeout_seconds", 30))) as got:
                body, kind = got.read(), got.headers.get("Content-Type")
                out = blank_result(url, "success", status_code=got.status, content_type=kind, final_url=got.url, **told)
                if any(t in (kind or "text/html").lower() for t in TEXT_TYPES):
                    charset = got.headers.get_content_charset()
                    text, lost = decode(body, charset)
                    return out | {"html": text, "lost_charset": (charset or "None") if lost else None}
                return out | {"raw": body}
        except HTTPError as e:
            if e.code == 403:
                return blank_result(url, "blocked", "HTTP 403", status_code=403, **told)
            if (e.code == 429 or e.code >= 500) and attempt < limit:
                wait = wait_before(attempt, base, e.headers.get("Retry-After"))
                retries.append((e.code, attempt, wait))
                time.sleep(wait)
                continue
            return blank_result(url, "failed", f"HTTP {e.code}", status_code=e.code, **told)
        except (URLError, OSError, ValueError) as e:
            return blank_result(url, "failed", f"{type(e).__name__}: {e}", **told)
    return blank_result(url, "failed", "retries used up", **told)


def decode(body: bytes, charset: str | None) -> tuple[str, bool]:
    """Text by the declared charset, else UTF-8, else Latin-1, and whether it came to that."""
    for name in (charset, "utf-8"):
        try:
            return body.decode(name or "utf-8"), False
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("latin-1", "replace"), True


def _fetcher(settings: dict):
    module, _, name = settings.get("fetcher", f"{__name__}:static_fetch").partition(":")
    return getattr(importlib.import_module(module), name)


def fetched(urls: Iterator[str], settings: dict) -> Iterator[tuple]:
    """Results, in the order of ``LOGGED``, one request after the other."""
    fetcher = _fetcher(settings)
    spacing = Spacing(float(settings.get("min_interval", "1.0")))
    for url in urls:
        waited = spacing.wait(url)
        got = fetcher(url, settings) | {"waited": waited}
        yield tuple(got.get(k) for k in LOGGED)


def fetch_urls(urls: DataFrame, partitions: int | None = None, **settings) -> DataFrame:
    """Fetch results (``FETCH_LOG``) of a table of URLs (column url), any number of them; they never pass through the driver.

    URLs of a domain share a task, so that the interval between its requests
    holds; a domain is as slow as its interval, whatever the cluster.  The plan
    fetches each time it runs: whoever reads it more than once settles it.
    """
    given = {k: str(v) for k, v in settings.items()}
    n = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (u for batch in batches for u in batch.column(0).to_pylist())
        for row in fetched(each, given):
            yield pa.RecordBatch.from_pylist([_plain(row)], schema=_arrow())

    return urls.filter("url is not null and url <> ''").select("url").repartition(n, domain(F.col("url"))).mapInArrow(run, FETCH_LOG)


def _plain(row: tuple) -> dict:
    out = dict(zip(LOGGED, row, strict=True))
    out["hops"] = [dict(zip(("from_url", "to_url", "code"), h, strict=True)) for h in out["hops"] or ()]
    out["retries"] = [dict(zip(("code", "attempt", "wait"), r, strict=True)) for r in out["retries"] or ()]
    return out


def _arrow() -> pa.Schema:
    text, whole = pa.string(), pa.int32()
    hop = pa.list_(pa.struct([("from_url", text), ("to_url", text), ("code", whole)]))
    retry = pa.list_(pa.struct([("code", whole), ("attempt", whole), ("wait", pa.float64())]))
    own = {"raw": pa.binary(), "status_code": whole, "hops": hop, "retries": retry, "waited": pa.float64()}
    return pa.schema([(k, own.get(k, text)) for k in LOGGED])


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[_Part]:
        """URLs of a domain share a partition, so their spacing holds."""
        n = int(self.options.get("numpartitions", "4"))
        parts: list[list[str]] = [[] for _ in range(n)]
        domains: dict[str, int] = {}
        for url in filter(None, self.options.get("urls", "").split("\n")):
            parts[domains.setdefault(urlsplit(url).netloc or url, len(domains)) % n].append(url)
        return [_Part(p) for p in parts if p] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return fetched(iter(partition.urls), self.options)


class FetchSource(DataSource):
    """``spark.read.format("gleaner_fetch").option("urls", newline-separated)``, for lists that the driver holds; see :func:`fetch_urls`."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_fetch"

    def schema(self) -> str:
        return FETCH_LOG

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(FetchSource)

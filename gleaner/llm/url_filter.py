"""URL filter: every glob rule in one bit-parallel automaton.

All patterns are packed side by side into 64-bit words, one bit per pattern
position.  Reading one character advances every pattern at once: shift all
words left by a bit, keep the positions whose symbol accepts the character,
and add back the positions that a wildcard lets stay.  A batch of URLs is
simulated together, one column of characters at a time, so the work is
(characters x words) numpy operations whatever the number of rules.

Glob syntax: ``*`` any run without ``/``; ``**`` any run; ``?`` one character
but ``/``; everything else is itself.  Patterns are matched against the whole
canonical URL, ``host + path``, lower-cased host (A-Z), no scheme, query or
fragment.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path, fits no rule and takes the default verdict.  Repeated rows are
judged each; of rules of one length that fit the same URL the first one given
counts; URLs are read whole, however long; an empty table gives no row.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: The host and path rules of the contract.
HOST_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

#: Globs that judge what no host rule fits.
BLOCK_GLOBS = (
    "**.exe",
    "**.zip",
    "**.iso",
    "**.apk",
    "**/login/**",
    "**/logout/**",
    "**/wp-admin/**",
    "**/cgi-bin/**",
    "ads.**",
    "*.ads.**",
    "*.doubleclick.*/**",
    "**/tracker/**",
    "**/cart/**",
    "**/tag/?/**",
)

#: Cells of a batch matrix that are simulated at a time.
CELLS = 1 << 22


def rule_globs(rule: str) -> tuple[str, str]:
    """The host itself and any subdomain, then any path that starts with the rule's."""
    return f"{rule}**", f"*.{rule}**"


def tokens(glob: str) -> list[str]:
    """``['a', '*', '**', '?']``-like symbols of a glob."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append("**")
            i += 2
        else:
            out.append(glob[i])
            i += 1
    return out


class ShiftAnd:
    """Multiword Shift-And automaton for many anchored globs."""

    def __init__(self, globs: Sequence[str]):
        parsed = [tokens(g) for g in globs]
        letters = sorted({t for p in parsed for t in p if t not in ("*", "**", "?")} | {"/"})
        self.code = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other character
        start, step, stay = [], [], []  # per state: is first; accepted codes; codes it may stay on
        codes = len(letters) + 1
        anything = (1 << codes) - 1
        within = anything & ~(1 << self.code["/"])
        self.last = []
        for p in parsed:
            start.append(True), step.append(0), stay.append(0)
            for t in p:
                if t == "*":
                    stay[-1] |= within
                elif t == "**":
                    stay[-1] |= anything
                else:
                    start.append(False), stay.append(0)
                    step.append(within if t == "?" else 1 << self.code[t])
            self.last.append(len(start) - 1)
        self.words = (len(start) + 63) // 64
        self.first = self._pack(start)
        self.step = np.stack([self._pack([s >> c & 1 for s in step]) for c in range(codes)])
        self.stay = np.stack([self._pack([s >> c & 1 for s in stay]) for c in range(codes)])

    def _pack(self, bits) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i, b in enumerate(bits):
            if b:
                out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def encode(self, url: str) -> np.ndarray:
        get = self.code.get
        return np.fromiter((get(c, 0) for c in url), np.uint8, len(url))

    def matches(self, urls: Sequence[str]) -> np.ndarray:
        """Boolean matrix (url, pattern)."""
        out = np.zeros((len(urls), len(self.last)), bool)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        at = 0
        while at < len(order):
            wide = max(1, len(urls[order[at]]))
            rows = order[at : at + max(1, CELLS // wide)]
            out[rows] = self._simulate([urls[i] for i in rows])
            at += len(rows)
        return out

    def _simulate(self, urls: list[str]) -> np.ndarray:
        """``urls`` from long to short, so that those still being read are a prefix."""
        size = np.array([len(u) for u in urls])
        codes = np.zeros((len(urls), int(size.max(initial=0))), np.uint8)
        for i, u in enumerate(urls):
            codes[i, : len(u)] = self.encode(u)
        state = np.repeat(self.first[None, :], len(urls), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for j in range(codes.shape[1]):
            live = int(np.searchsorted(-size, -j, side="left"))
            now, read = state[:live], codes[:live, j]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.step[read]) | (now & self.stay[read])
        last = np.array(self.last)
        return (state[:, last // 64] >> (last % 64).astype(np.uint64) & one).astype(bool)


class UrlFilter:
    """Longest fitting host rule first; without one, the block globs; else ``default``."""

    def __init__(self, rules=HOST_RULES, block_globs=BLOCK_GLOBS, default: str = "allow"):
        self.rules = sorted(rules, key=lambda r: -len(r[0]))
        self.default = default
        self.block = list(block_globs)
        self.automaton = ShiftAnd([g for r, _ in self.rules for g in rule_globs(r)] + self.block)

    def judge(self, urls: Sequence[str]) -> tuple[list, list]:
        hit = self.automaton.matches(urls)
        n = len(self.rules)
        fits = hit[:, 0 : 2 * n : 2] | hit[:, 1 : 2 * n : 2]
        which = np.where(fits.any(axis=1), fits.argmax(axis=1), n)
        blocked = hit[:, 2 * n :].any(axis=1)
        names = [r for r, _ in self.rules] + [None]
        verdicts = [v for _, v in self.rules]
        return [names[w] for w in which], [verdicts[w] if w < n else "block" if b else self.default for w, b in zip(which, blocked, strict=True)]


def filter_urls(pages: DataFrame, rules=HOST_RULES, block_globs=BLOCK_GLOBS, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: id, host, path, rule, verdict (one row for each input row)."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    parts = pages.select(
        F.col(id_col).alias(id_col),
        F.translate(F.regexp_extract(url, shape, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, shape, 2).alias("path"),
    )
    model = UrlFilter(rules, block_globs, default)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rule, verdict = model.judge(urls.tolist())
            yield pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    return parts.withColumn("_judged", judge(F.concat("host", "path"))).select(id_col, "host", "path", "_judged.rule", "_judged.verdict")


def _like(glob: str) -> str:
    """The regular expression of a glob, for the SQL check."""
    special = "\\.+()[]{}^$|"
    return "".join({"**": "(.|\\n)*", "*": "[^/]*", "?": "[^/]"}.get(t) or (f"\\{t}" if t in special else t) for t in tokens(glob))


def filter_sql(rules=HOST_RULES, block_globs=BLOCK_GLOBS, default: str = "allow") -> str:
    """DuckDB SQL with the same rows, from the definition of a rule rather than from the automaton."""
    values = ", ".join(f"('{r}', '{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for r, v in rules)
    blocked = " OR ".join(f"regexp_full_match(host || path, '{_like(g)}')" for g in block_globs)
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS u, position('://' IN coalesce(url, '')) AS p FROM pages),
rest AS (SELECT page_id, CASE WHEN p > 0 THEN substr(u, p + 3) ELSE '' END AS r FROM cut),
parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rule, verdict, rhost, rpath) AS (VALUES {values}),
fit AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN {blocked} THEN 'block' ELSE '{default}' END) AS verdict
FROM fit WHERE k = 1"""

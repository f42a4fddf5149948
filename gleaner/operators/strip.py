"""Boilerplate removal: HTML to heading-scoped blocks, in one Arrow UDF.

The parser keeps what carries content and drops navigation, footers, asides,
forms, scripts and boxes whose class or id names them as furniture.  A heading
opens a block; paragraphs, lists, tables, quotes and code belong to the block
they stand in.  It never raises: malformed markup is read as far as it goes.

Furniture without a telling name shows by its density: a box is worth its plain
text, less the text of its links, plus what the boxes in it are worth, as far
as that is more than nothing.  The worth is summed up on the way through the
page; boxes of several links that are worth less than nothing are left out on a
second way down, and what is left is the part of the page that is worth most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STRIP_RESULT

SKIPPED = frozenset("script style noscript template nav header footer aside form button select option iframe svg head object canvas".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
TEXT_BLOCKS = frozenset("p blockquote pre code dd dt figcaption".split())
LISTS = frozenset(("ul", "ol", "dl"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = re.compile(r"\b(ad|ads|advert|advertisement|banner|breadcrumbs?|comments?|cookie|consent|menu|navbar|newsletter|popup|promo|related|share|sidebar|social|sponsor(ed)?|subscribe)\b", re.I)
#: Pages longer than the first number keep at least the second share of their characters, else they fall back.
LARGE, LEAST = 5000, 0.05

#: Boxes that are judged by density, and links that one has at least to be left out.
BOXES = frozenset("div section ul ol dl".split())
LINKS = 3

METHODS = ("content", "browser-visible-text", "html-text-content", "raw")


def flat(text: str) -> str:
    return " ".join(text.split())


class _Box:
    """An open box: its number, its plain and linked characters, its links, and whether it holds the page's heading."""

    def __init__(self, number: int, tag: str):
        self.number, self.tag, self.plain, self.link, self.links, self.titled = number, tag, 0, 0, 0, False


class _Content(HTMLParser):
    """Collects (heading, level, text) blocks, the title, and all text; ``sparse``: boxes (by number) that are not worth it.

    ``without``: boxes to leave out, as an earlier way through the page found them.
    """

    def __init__(self, without: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.without, self.sparse = without, set()
        self.numbered, self.linked = 0, 0  # boxes seen, and open links
        self.boxes: list[_Box] = []
        self.blocks: list[list] = []
        self.heading, self.level, self.parts = None, None, []
        self.tables = 0
        self.skip: list[str] = []  # open elements inside furniture, the furniture first
        self.kind: str | None = None  # what the buffer will become
        self.buffer: list[str] = []
        self.lists: list[list[str]] = []
        self.rows: list[list[str]] | None = None
        self.titles: dict[str, str | None] = {"title": None, "h1": None}
        self.titling: str | None = None
        self.title_text: list[str] = []
        self.everything: list[str] = []
        self.mute = 0  # inside script or style

    def flush_text(self) -> None:
        text = flat("".join(self.buffer))
        self.buffer = []
        kind, self.kind = self.kind, None
        if self.rows is not None:
            if text and self.rows:
                self.rows[-1].append(text)
        elif kind == "heading":
            self.close_block()
            self.heading = text or None
        elif self.lists:
            if text:
                self.lists[-1].append(text)
        elif text:
            self.parts.append(text)

    def close_block(self) -> None:
        if self.heading or self.parts:
            self.blocks.append([self.heading, self.level if self.heading else None, "\n\n".join(self.parts)])
        self.heading, self.parts = None, []

    def close_box(self) -> None:
        """Judge the innermost box, and hand its worth to the one around it."""
        box = self.boxes.pop()
        worth, lost = box.plain - box.link, False
        if worth < 0 and box.links >= LINKS and not box.titled:
            self.sparse.add(box.number)
            lost = True
        if self.boxes and not lost:
            around = self.boxes[-1]
            around.titled |= box.titled
            if worth >= 0:
                around.plain += worth
            else:  # too few links to tell: they count further up
                around.plain, around.link, around.links = around.plain + box.plain, around.link + box.link, around.links + box.links

    def handle_starttag(self, tag, attrs):
        if tag in BOXES:
            self.numbered += 1
        if tag in ("script", "style"):
            self.mute += 1
        if tag in self.titles and self.titles[tag] is None and self.titling is None:
            self.titling, self.title_text = tag, []
        if tag in VOID:
            if tag in ("br", "hr") and not self.skip:
                self.buffer.append(" ")
            return
        if self.skip:
            self.skip.append(tag)
            return
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        if tag in SKIPPED or (tag in ("div", "section", "ul", "span", "p") and FURNITURE.search(named)) or (tag in BOXES and self.numbered in self.without):
            self.flush_text()
            self.skip.append(tag)
            return
        if tag in BOXES:
            self.boxes.append(_Box(self.numbered, tag))
        elif tag == "a":
            self.linked += 1
            if self.boxes:
                self.boxes[-1].links += 1
        elif tag == "h1" and self.boxes:
            self.boxes[-1].titled = True
        if tag in HEADINGS:
            self.flush_text()
            self.kind, self.next_level = "heading", HEADINGS[tag]
        elif tag in LISTS:
            self.flush_text()
            self.lists.append([])
        elif tag == "table":
            self.flush_text()
            self.tables += 1
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.flush_text()
            self.rows.append([])
        elif tag in ("td", "th", "li") or tag in TEXT_BLOCKS or tag in ("div", "article", "main", "section", "body"):
            self.flush_text()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        if tag == self.titling:
            self.titles[tag] = flat("".join(self.title_text)) or None
            self.titling = None
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if tag == "a":
            self.linked = max(0, self.linked - 1)
        elif tag in BOXES and any(b.tag == tag for b in self.boxes):
            while self.boxes[-1].tag != tag:
                self.close_box()
            self.close_box()
        if tag in HEADINGS and self.kind == "heading":
            level = self.next_level
            self.flush_text()
            self.level = level
        elif tag in LISTS and self.lists:
            self.flush_text()
            items = self.lists.pop()
            (self.lists[-1] if self.lists else self.parts).append(" ".join(items)) if items else None
        elif tag == "table" and self.rows is not None:
            self.flush_text()
            lines = [" | ".join(r) for r in self.rows if r]
            self.rows = None
            if lines:
                self.parts.append(" ".join(lines))
        elif tag in ("td", "th", "li", "tr") or tag in TEXT_BLOCKS or tag in ("div", "article", "main", "section", "body", "html"):
            self.flush_text()

    def handle_data(self, data):
        if self.titling is not None:
            self.title_text.append(data)
        if not self.mute:
            self.everything.append(data)
        if not self.skip:
            self.buffer.append(data)
            if self.boxes:
                size = len(flat(data))
                if self.linked:
                    self.boxes[-1].link += size
                else:
                    self.boxes[-1].plain += size

    def finish(self):
        try:
            self.close()
        except Exception:  # noqa: BLE001  malformed markup never raises
            pass
        while self.boxes:
            self.close_box()
        self.flush_text()
        if self.rows:
            lines = [" | ".join(r) for r in self.rows if r]
            if lines:
                self.parts.append(" ".join(lines))
        for items in self.lists:
            self.parts += [" ".join(items)] if items else []
        self.close_block()


def parse(html: str) -> tuple[_Content, str | None]:
    """What the parser collected, and why it stopped early, if it did."""
    p, failure = _read(html, frozenset())
    if p.sparse:
        dense, _ = _read(html, frozenset(p.sparse))
        if any(text for _, _, text in dense.blocks):  # a page of links alone stays as it is
            p = dense
    return p, failure


def _read(html: str, without: frozenset[int]) -> tuple[_Content, str | None]:
    p, failure = _Content(without), None
    try:
        p.feed(html)
    except Exception as e:  # noqa: BLE001  malformed markup never raises
        failure = f"markup parse failed: {e}"
    p.finish()
    return p, failure


def _warning(stage: str, reason: str, before: int | None = None, after: int | None = None) -> dict:
    return {"stage": stage, "reason": reason, "chars_before": before, "chars_after": after}


def strip_page(html: str | None, visible_text: str | None = None) -> dict:
    """One page to title, outcome, text, method, sizes and blocks."""
    before = len(html or "")
    out = {"title": None, "outcome": "empty", "text": "", "method": "raw", "chars_before": before, "chars_after": 0, "num_blocks": 0, "num_tables": 0, "blocks": [], "warnings": []}
    if not html or not html.strip():
        return out
    marked = "<" in html and ">" in html
    page, failure = parse(html) if marked else (None, None)
    if failure:
        out["warnings"].append(_warning("parse", failure))
    if page is not None:
        out["title"] = page.titles["title"] or page.titles["h1"]
        blocks = [{"heading": h, "level": v, "text": t} for h, v, t in page.blocks]
        text = "\n\n".join((b["heading"] + "\n" if b["heading"] else "") + b["text"] for b in blocks if b["text"])
        if blocks and text:
            if not (before > LARGE and len(text) / before < LEAST):
                return out | {"outcome": "stripped", "text": text, "method": "content", "chars_after": len(text), "num_blocks": len(blocks), "num_tables": page.tables, "blocks": blocks}
            out["warnings"].append(_warning("ratio_fallback", f"content extraction kept too little ({len(text)}/{before} chars, {len(text) / before * 100:.1f}%), falling back to all text", before, len(text)))
            if visible_text and visible_text.strip():
                return _fallback(out, visible_text, "browser-visible-text")
    return _fallback(out, "".join(page.everything) if page is not None else html, "html-text-content" if marked else "raw")


def _fallback(out: dict, text: str, method: str) -> dict:
    text = re.sub(r"[ \t]+", " ", text).strip()
    out = out | {"method": method}
    if text:
        out |= {"outcome": "fallback", "text": text, "chars_after": len(text), "num_blocks": 1, "blocks": [{"heading": None, "level": None, "text": text}]}
    return out


FIELDS = ["title", "outcome", "text", "method", "chars_before", "chars_after", "num_blocks", "num_tables", "blocks", "warnings"]


def strip_html(html: Column, visible_text: Column | None = None) -> Column:
    """Struct of :data:`gleaner.schemas.STRIP_RESULT`."""

    @F.pandas_udf(STRIP_RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for htmls, texts in batches:
            yield pd.DataFrame([strip_page(h, t) for h, t in zip(htmls, texts, strict=True)], columns=FIELDS)

    return run(html, F.lit(None).cast("string") if visible_text is None else visible_text)


def strip_pages(pages: DataFrame, html_col: str = "html", visible_col: str | None = None) -> DataFrame:
    """``pages`` without its markup, with the result's fields as columns."""
    done = pages.withColumn("_strip", strip_html(F.col(html_col), F.col(visible_col) if visible_col else None))
    keep = [F.col(c) for c in pages.columns if c != html_col and c not in FIELDS]
    return done.select(*keep, "_strip.*")


def blocks(stripped: DataFrame, keys: list[str]) -> DataFrame:
    """One row a block, numbered from 1."""
    return stripped.select(*keys, F.posexplode("blocks").alias("_at", "_b")).select(*keys, (F.col("_at") + 1).alias("block_index"), "_b.heading", "_b.level", "_b.text")


def block_text(found: Column) -> Column:
    """Text of an array of blocks: heading line, then text, blocks apart by an empty line; blocks without text are left out."""
    some = F.filter(found, lambda b: F.length(b["text"]) > 0)
    return F.array_join(F.transform(some, lambda b: F.concat(F.when(F.length(b["heading"]) > 0, F.concat(b["heading"], F.lit("\n"))).otherwise(""), b["text"])), "\n\n")

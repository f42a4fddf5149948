"""Heuristics over raw HTML and HTTP metadata, all native."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of pages that are never content.
ERROR_PHRASES = ("javascript is disabled", "robot check", "verify you're not a robot", "access denied", "cloudflare")
#: Words of challenge pages, sign-in walls, consent banners and pagination.
CHALLENGE_FRAMES = ("recaptcha", "hcaptcha", "captcha", "turnstile", "challenge")
CHALLENGE_TEXTS = (
    "verify you are human",
    "verify you're human",
    "unusual traffic",
    "just a moment",
    "checking your browser",
    "enter the captcha",
    "i'm not a robot",
    "im not a robot",
)
AUTH_URL = r"(?i)/(login|signin|sign-in|logon)([/?#]|$)"
AUTH_TEXTS = ("sign in", "log in", "enter your password")
CONSENT_TEXTS = ("cookie", "consent", "gdpr", "privacy policy", "we use cookies")
CONSENT_REJECT = ("reject", "decline", "deny", "necessary only")
CONSENT_ACCEPT = ("accept all", "accept", "agree", "allow all", "allow")
CLOSE_TEXTS = ("close", "dismiss", "ok", "×", "x", "✕", "✖")
LOAD_MORE = r"(?i)load more|show more|view more|see more|more results"

#: A dialog that lies over the page, in its markup.
OVERLAY = r"""(?i)<dialog[\s>]|<[^>]+\s(?:role\s*=\s*["']?dialog|aria-modal\s*=\s*["']?true)["'\s>]"""

#: White space as Unicode and Python see it.
SPACES = r"\s\x1c-\x1f\x85\xa0  -     　"

_one_char = sorted({n.rstrip(";") for n, v in html5.items() if len(v) == 1 and not v.isspace() and ord(v) < 0x2300}, key=lambda n: (-len(n), n))
_open = {n for n in html5 if not n.endswith(";")}
#: Entities of one visible character (rule: named, one code point below U+2300, or numeric); those of spaces are replaced first.
VISIBLE_ENTITY = r"&(?:(?:amp|lt|gt|quot|copy|middot);|#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|(?:" + "|".join(n for n in _one_char if n not in _open) + ");|(?:" + "|".join(n for n in _one_char if n in _open) + ");?)"
SPACE_ENTITY = r"&(?:nbsp;?|ensp;|emsp;|thinsp;|hairsp;|NewLine;|Tab;|#(?:9|10|11|12|13|32|160);|#[xX](?:9|[aA]|[bB]|[cC]|[dD]|20|[aA]0);)"

#: The same for Java, which can first see that no letter and no number sign follows.
_ENTITY = VISIBLE_ENTITY.replace("&", "&(?=[#a-zA-Z])", 1)

SCRIPT = r"(?is)<script.*?</script>"
STYLE = r"(?is)<style.*?</style>"
TAG = r"<[^>]+>"


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Case-insensitive: does ``text`` hold one of the (lower-case) phrases? Null: no."""
    low = F.lower(text)
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return F.coalesce(out, F.lit(False))


def content_type(mime: Column) -> Column:
    """``html``, ``pdf``, ``text`` or ``unknown`` for a MIME type."""
    low = F.lower(mime)
    return (
        F.when(low.contains("html"), "html")
        .when(low.contains("pdf"), "pdf")
        .when(low.contains("text") | low.contains("json") | low.contains("xml"), "text")
        .otherwise("unknown")
    )


def is_html_like(mime: Column) -> Column:
    """Could this type be decoded to text by a plain fetch? Unknown types may."""
    low = F.lower(mime)
    return F.when(F.coalesce(mime, F.lit("")) == "", True).otherwise(low.startswith("text/") | low.contains("html") | low.contains("xml"))


def visible_text_length(html: Column) -> Column:
    """Characters of visible text that are not white space."""
    t = F.regexp_replace(html, SCRIPT, " ")
    t = F.regexp_replace(t, STYLE, " ")
    t = F.regexp_replace(t, TAG, " ")
    t = F.regexp_replace(t, SPACE_ENTITY, " ")
    t = F.regexp_replace(t, _ENTITY, "x")
    return F.coalesce(F.length(F.regexp_replace(t, f"[{SPACES}]", "")), F.lit(0))


def is_error_page(html: Column) -> Column:
    return contains_any(html, ERROR_PHRASES)


def looks_empty(html: Column, threshold: float = 200, visible: Column | None = None) -> Column:
    """Too little visible text to be meaningful: absolutely, or for a large page relatively."""
    visible = visible_text_length(html) if visible is None else visible
    total = F.length(html)
    return F.when(F.coalesce(total, F.lit(0)) == 0, True).otherwise(is_error_page(html) | (visible < threshold) | ((total > 5000) & (visible < total * 0.01)))


def looks_html(text: Column) -> Column:
    return F.coalesce(text.contains("<") & text.contains(">"), F.lit(False))


def collapse_spaces(text: Column) -> Column:
    """All white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def normalize_block(text: Column) -> Column:
    """Blanks collapsed line by line, lines trimmed, at most one empty line in a row."""
    t = F.regexp_replace(text, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]+|[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), rf"^[{SPACES}]+|[{SPACES}]+$", "")


def heading_level(rend: Column) -> Column:
    """Level in a rendering like ``h2``; null without one."""
    found = F.regexp_extract(F.coalesce(rend, F.lit("")), "[hH]([1-9])", 1)
    return F.when(found != "", found.cast("int"))


def stripped_too_little(before: Column, after: Column) -> Column:
    """A large page of which hardly anything is left."""
    return (before > 5000) & (after < before * 0.05)


def title(html: Column) -> Column:
    """First non-blank ``<title>``, else the first ``<h1>``, of well-formed pages; else null."""

    def inner(tag: str) -> Column:
        raw = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
        return F.nullif(F.trim(F.regexp_replace(raw, TAG, " ")), F.lit(""))

    return F.coalesce(inner("title"), inner("h1"))


def obstacle_of(page_text: Column, url: Column) -> Column:
    """First obstacle that the text or the URL shows, as a name of the obstacle policy; null: none."""
    return (
        F.when(contains_any(page_text, CHALLENGE_TEXTS), "captcha_gate")
        .when(F.coalesce(url.rlike(AUTH_URL), F.lit(False)) & contains_any(page_text, AUTH_TEXTS), "session_expiry")
        .when(contains_any(page_text, CONSENT_TEXTS), "cookie_banner")
        .when(F.coalesce(page_text.rlike(OVERLAY), F.lit(False)), "popup_modal")
        .when(F.coalesce(page_text.rlike(LOAD_MORE), F.lit(False)), "load_more")
    )


def has_challenge_frame(sources: Column) -> Column:
    """Does one of an array of frame sources belong to a challenge?"""
    return F.coalesce(F.exists(sources, lambda s: contains_any(s, CHALLENGE_FRAMES)), F.lit(False))


def dismiss_rank(label: Column, obstacle: str = "cookie_banner") -> Column:
    """0: a button that refuses, 1: one that accepts (both on cookie banners only), 2: one that closes, null: none; the least wins within a label."""
    close = F.when(contains_any(label, CLOSE_TEXTS), 2)
    if obstacle != "cookie_banner":
        return close
    return F.when(contains_any(label, CONSENT_REJECT), 0).when(contains_any(label, CONSENT_ACCEPT), 1).otherwise(close)

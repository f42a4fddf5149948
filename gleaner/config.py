"""Validated settings: closed dataclasses filled from JSON, never inferred."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path


def _number(name: str, value, least=None, most=None, whole=False):
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
        raise ValueError(f"{name}: expected {'an integer' if whole else 'a number'}, got {value!r}")
    if (least is not None and value < least) or (most is not None and value > most):
        raise ValueError(f"{name}: {value!r} is out of range")


def _text(name: str, value):
    if not isinstance(value, str) or not value:
        raise ValueError(f"{name}: expected a non-empty string, got {value!r}")


class Settings:
    """Base of all settings: built from a mapping whose keys must match exactly."""

    @classmethod
    def of(cls, given: dict, complete: bool = True):
        names = {f.name for f in fields(cls)}
        if unknown := set(given) - names:
            raise ValueError(f"{cls.__name__}: unknown keys {sorted(unknown)}")
        if complete and (missing := names - set(given)):
            raise ValueError(f"{cls.__name__}: missing keys {sorted(missing)}")
        return cls(**given)


@dataclass(frozen=True)
class FetchSettings(Settings):
    rate_limit_min_interval_seconds: float = 1.0
    timeout_seconds: float = 30
    extended_timeout_seconds: float = 90
    empty_content_threshold_chars: int = 100
    user_agent: str = "gleaner/0.1"
    max_redirects: int = 10
    browser_settle_seconds: float = 5
    pagination_max_clicks: int = 5
    backoff_base_seconds: float = 1.0

    def __post_init__(self):
        _number("rate_limit_min_interval_seconds", self.rate_limit_min_interval_seconds, 0)
        _number("timeout_seconds", self.timeout_seconds, 1)
        _number("extended_timeout_seconds", self.extended_timeout_seconds, 1)
        _number("empty_content_threshold_chars", self.empty_content_threshold_chars, 0, whole=True)
        _text("user_agent", self.user_agent)
        _number("max_redirects", self.max_redirects, 1, whole=True)
        _number("browser_settle_seconds", self.browser_settle_seconds, 0)
        _number("pagination_max_clicks", self.pagination_max_clicks, 0, whole=True)
        _number("backoff_base_seconds", self.backoff_base_seconds, 0)


@dataclass(frozen=True)
class ExtractorSettings(Settings):
    parse_retry: int = 1
    min_confidence: float = 0.5
    repair_budget: int = 1

    def __post_init__(self):
        _number("parse_retry", self.parse_retry, 0, 3, whole=True)
        _number("min_confidence", self.min_confidence, 0, 1)
        _number("repair_budget", self.repair_budget, 0, 3, whole=True)


@dataclass(frozen=True)
class CorpusSettings(Settings):
    path: str = "data/corpus"
    collection_prefix: str = "corpus"
    model: str = "hashing"
    fallback_model: str = "hashing-small"
    auto_fallback_on_load_failure: bool = True
    batch_size: int = 32
    max_chunk_chars: int = 2000

    def __post_init__(self):
        for name in ("path", "collection_prefix", "model", "fallback_model"):
            _text(name, getattr(self, name))
        if not re.fullmatch(r"[A-Za-z0-9_-]+", self.collection_prefix):
            raise ValueError(f"collection_prefix: {self.collection_prefix!r}")
        _number("batch_size", self.batch_size, 1, whole=True)
        _number("max_chunk_chars", self.max_chunk_chars, 100, whole=True)


@dataclass(frozen=True)
class RetrySettings(Settings):
    max_attempts: int = 2
    backoff_seconds: float = 5

    def __post_init__(self):
        _number("max_attempts", self.max_attempts, 1, whole=True)
        _number("backoff_seconds", self.backoff_seconds, 0)


#: Obstacle, enabled, detector, policy, retries (None: not given).
OBSTACLES = (
    ("popup_modal", True, "detect_overlay_widget", "dismiss", None),
    ("cookie_banner", True, "detect_consent_banner", "dismiss", None),
    ("captcha_gate", True, "detect_challenge_widget", "terminal_blocked", None),
    ("server_errors", True, "http_status_5xx", "retry_with_backoff", 3),
    ("slow_responses", True, "response_time_exceeded", "extend_timeout", None),
    ("unexpected_redirect", True, "redirect_chain_detected", "follow_and_log", None),
    ("dom_drift", True, "locator_mismatch", "requery", None),
    ("blocked_clicks", True, "click_no_op", "retry_with_backoff", 2),
    ("rate_limit", True, "http_status_429", "retry_with_backoff", 3),
    ("data_integrity", True, "schema_validation_failed", "flag_and_skip", None),
    ("stale_element", True, "stale_element_reference", "requery", None),
    ("session_expiry", False, "auth_challenge_detected", "terminal_blocked", None),
    ("random_logout", False, "auth_redirect_detected", "terminal_blocked", None),
    ("load_more", True, "pagination_control_present", "paginate", None),
)
DEFAULT_RETRIES = 3


@dataclass(frozen=True)
class ObstaclePolicy:
    """Lookup of obstacles: absent ones are off, without policy, with the default retries."""

    rows: dict[str, tuple[bool, str, str, int | None]] = field(default_factory=lambda: {n: (e, d, p, r) for n, e, d, p, r in OBSTACLES})

    @classmethod
    def of(cls, given: dict[str, dict]) -> ObstaclePolicy:
        known = {n for n, *_ in OBSTACLES}
        rows = {}
        for name, row in given.items():
            if name not in known:
                raise ValueError(f"unknown obstacle {name!r}")
            if missing := {"enabled", "detection_method", "policy"} - set(row):
                raise ValueError(f"{name}: missing {sorted(missing)}")
            if row["detection_method"] not in {d for _, _, d, _, _ in OBSTACLES} or row["policy"] not in {p for _, _, _, p, _ in OBSTACLES}:
                raise ValueError(f"{name}: unknown detector or policy")
            rows[name] = (bool(row["enabled"]), row["detection_method"], row["policy"], row.get("max_retries"))
        return cls(rows)

    def is_enabled(self, name: str) -> bool:
        return self.rows.get(name, (False, "", "", None))[0]

    def policy_for(self, name: str) -> str:
        return self.rows.get(name, (False, "", "", None))[2]

    def max_retries_for(self, name: str) -> int:
        found = self.rows.get(name, (False, "", "", None))[3]
        return DEFAULT_RETRIES if found is None else found


def load_json(kind: type[Settings], path: str | Path) -> Settings:
    """Settings of ``kind`` from a JSON file; anything wrong is a ValueError."""
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError) as e:
        raise ValueError(f"{path}: {e}") from e
    if not isinstance(given, dict):
        raise ValueError(f"{path}: expected an object")
    return kind.of(given)


#: Environment variable that moves the corpus.
CORPUS_PATH_VARIABLE = "GLEANER_CORPUS_PATH"


def corpus_settings(given: dict | None = None) -> CorpusSettings:
    """Corpus settings; the environment's path wins."""
    given = dict(given or {})
    if os.environ.get(CORPUS_PATH_VARIABLE):
        given["path"] = os.environ[CORPUS_PATH_VARIABLE]
    return CorpusSettings.of(given, complete=False)


def load_dotenv(path: str | Path, environ: dict | None = None) -> dict[str, str]:
    """Set ``KEY=value`` lines that the environment does not have yet; returns what was set."""
    environ = os.environ if environ is None else environ
    added: dict[str, str] = {}
    file = Path(path)
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else []:
        key, sep, value = line.strip().partition("=")
        key = key.strip()
        if sep and key and not key.startswith("#") and key not in environ:
            added[key] = environ[key] = value.strip().strip("\"'")
    return added


COLLECTION_NAME = re.compile(r"[A-Za-z0-9_]{3,128}")


def collection_name(model: str, dimension: int, prefix: str = "corpus") -> str:
    """Name that keeps vectors of different models or dimensions apart."""
    slug = "_".join(re.findall(r"[A-Za-z0-9]+", model))
    name = f"{prefix}_{slug}_{dimension}"
    if not COLLECTION_NAME.fullmatch(name):
        raise ValueError(f"bad collection name: {name!r}")
    return name

"""Language identification by hierarchical discrimination.

A first layer of linear support vector machines, one per language family
against the rest, chooses the family; inside it, one-versus-one machines vote
between its closely related languages.  Features are hashed byte trigrams of
the whole lower-cased text, so short and long texts look alike after scaling.

Training sees a bounded sample of labelled rows: about ``per_language`` rows of
each language, fewer (but ``LEAST``) if that makes more than ``max_rows``, chosen
by a hash of id and text, so the driver holds a matrix whose size does not depend on the
corpus.  Every language found is learned.  Prediction reads every text in full.

Defined results: a text that is null or has no letter is ``und`` with score 0.
With no labelled row at all, every text is ``und``.  A language with no other
of its family needs no second layer.  Ties of families, votes and odds go to the
name that sorts first.  Repeated rows are predicted each and learned once; an
empty table gives no row; columns of other names are no input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample_key

#: Families of ISO 639-1 codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
    "indo-aryan": "hi bn ur pa mr gu ne si",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "malayic": "id ms",
    "baltic": "lv lt",
}

BINS = 4096
#: Rows of a language that are drawn at least, on average, where it has them.
LEAST = 20
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Bytes of a text whose trigrams are hashed at a time.
BLOCK = 1 << 20


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def features(text: str) -> np.ndarray:
    """Unit-length vector of square-rooted counts of hashed byte trigrams."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    count = np.zeros(BINS, np.int64)
    for at in range(0, len(raw) - 2, BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
        count += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    out = np.sqrt(count).astype(np.float32)
    return out / max(1e-9, float(np.sqrt((out * out).sum())))


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Squared-hinge linear machine by accelerated gradient descent; classes weigh alike. Last entry: bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1], np.float64)
    ahead, momentum, rate = w.copy(), 1.0, 0.25
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ ahead.astype(np.float32)))
        new = ahead - rate * (penalty * ahead - 2 * ((weight * y * gap).astype(np.float32) @ x))
        step = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / step * (new - w)
        w, momentum = new, step
    return w


class LanguageModel:
    """Families against the rest, then pairs of languages within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs, dtype=object)
        fams = np.array([family_of(n) for n in langs], dtype=object)
        self.families = sorted(set(fams))
        self.members = {f: sorted(set(names[fams == f])) for f in self.families}
        one = len(self.families) < 2
        self.top = np.stack([np.zeros(BINS + 1) if one else train_svm(x, np.where(fams == f, 1.0, -1.0)) for f in self.families]) if self.families else np.zeros((0, BINS + 1))
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (names == a) | (names == b)
                self.pairs[a, b] = train_svm(x[rows], np.where(names[rows] == a, 1.0, -1.0))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return UNKNOWN, 0.0
        margin = self.top[:, :-1] @ v + self.top[:, -1]
        odds = np.exp(3 * (margin - margin.max()))
        k = int(margin.argmax())
        own = self.members[self.families[k]]
        sure = {a: 1.0 for a in own}
        votes = {a: 0.0 for a in own}
        for a, b in combinations(own, 2):
            w = self.pairs[a, b]
            p = 1 / (1 + np.exp(-3 * float(w[:-1] @ v + w[-1])))
            votes[a] += p >= 0.5
            votes[b] += p < 0.5
            sure[a] *= p
            sure[b] *= 1 - p
        best = max(own, key=lambda a: (votes[a], sure[a]))
        return best, float(odds[k] / odds.sum() * sure[best])


def fit(docs: DataFrame, per_language: int = 500, max_rows: int = 32_000, id_col="doc_id", text_col="text", lang_col="lang") -> LanguageModel:
    """Train on about ``per_language`` rows of each language, ``max_rows`` at most in all, never on held-out rows."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    text = F.col(text_col).cast("string")
    keyed = known.select(F.col(lang_col).alias("lang"), text.alias("text"), sample_key(F.xxhash64(F.col(id_col), text)).alias("key"))
    found = keyed.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()  # a row a language
    if not found:
        return LanguageModel(np.zeros((0, BINS), np.float32), [])
    each = max(LEAST, min(per_language, max_rows // len(found)))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / max(1, r["n"]))) for r in found], "_lang string, _share double")

    @F.pandas_udf("binary")
    def sketch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).astype(np.float16).tobytes())

    drawn = keyed.join(F.broadcast(share), F.col("lang") == F.col("_lang")).filter(F.col("key") < F.col("_share"))
    rows = drawn.dropDuplicates(["lang", "key"]).select("lang", "key", sketch("text").alias("v")).orderBy("key").limit(2 * each * len(found)).collect()
    rows.sort(key=lambda r: (r["lang"], r["key"]))
    x = np.stack([np.frombuffer(bytes(r["v"]), np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, BINS), np.float32)
    return LanguageModel(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, lang_pred, score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = shipped.value
        for texts in batches:
            out = [(UNKNOWN, 0.0) if t is None or not LETTER.search(t) else held.predict(features(t)) for t in texts]
            yield pd.DataFrame(out, columns=["lang", "score"])

    return docs.select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col).cast("string")).alias("_p")).select(
        id_col, "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")
    )

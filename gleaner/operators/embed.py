"""Pluggable embedders; the default hashes words, so it needs no model file."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CorpusSettings, collection_name

WORD = re.compile(r"\w+")


class HashingEmbedder:
    """Normalised signed word counts in ``dimension`` hash cells."""

    def __init__(self, model_name: str = "hashing", dimension: int = 64):
        self.model_name, self.dimension = model_name, dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for w in WORD.findall((text or "").lower()):
                h = crc32(w.encode())
                v[h % self.dimension] += 1 if h >> 16 & 1 else -1
            norm = float(np.sqrt((v * v).sum()))
            out.append((v / norm if norm else v).astype(np.float32).tolist())
        return out


#: Fixed dimensions of the built-in models.
BUILT_IN = {"hashing": 64, "hashing-small": 16}


def make(model: str) -> HashingEmbedder:
    if model not in BUILT_IN:
        raise RuntimeError(f"no such embedding model: {model}")
    return HashingEmbedder(model, BUILT_IN[model])


def load_embedder(settings: CorpusSettings, factory: Callable[[str], object] = make, on_fallback: Callable[[str, str], None] | None = None):
    """The configured model, or the fallback where loading fails and that is allowed."""
    try:
        return factory(settings.model)
    except Exception as first:  # noqa: BLE001  any load failure counts
        if not settings.auto_fallback_on_load_failure:
            raise RuntimeError(f"embedding model failed to load: {first}") from first
        try:
            found = factory(settings.fallback_model)
        except Exception as second:
            raise RuntimeError(f"both embedding models failed to load: {first}; {second}") from second
        if on_fallback:
            on_fallback(settings.model, settings.fallback_model)
        return found


def collection_of(embedder, prefix: str = "corpus") -> str:
    """Always derived from the embedder, so a change of model never mixes vectors."""
    return collection_name(embedder.model_name, embedder.dimension, prefix)


def embed(text: Column, embedder, batch_size: int = 32) -> Column:
    """Vectors of a text column; the embedder goes to each worker once and sees ``batch_size`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = texts.tolist()
            made: list = []
            for at in range(0, len(given), batch_size):
                made += embedder.embed(given[at : at + batch_size])
            if len(made) != len(given):
                raise ValueError(f"embedder returned {len(made)} vectors for {len(given)} texts")
            yield pd.Series(made)

    return run(text)


def try_embed(text: Column, embedder, batch_size: int = 32) -> Column:
    """Struct of ``vector`` and ``failure``: like :func:`embed`, but a text that the embedder fails on says why.

    When a batch fails its texts are tried one by one, so one text fails alone.
    """

    def one(texts: list[str]) -> list[tuple]:
        try:
            made = embedder.embed(texts)
            if len(made) != len(texts):
                raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
            return [(v, None) for v in made]
        except Exception as e:  # noqa: BLE001  a failing embedder flags its rows
            return [(None, f"embedder failed: {e}")] if len(texts) == 1 else [r for t in texts for r in one([t])]

    @F.pandas_udf("vector array<float>, failure string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            given = texts.tolist()
            yield pd.DataFrame([r for at in range(0, len(given), batch_size) for r in one(given[at : at + batch_size])], columns=["vector", "failure"])

    return run(text)

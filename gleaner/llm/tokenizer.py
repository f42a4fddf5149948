"""Token ids of a public byte-pair vocabulary, piece by piece.

The vocabulary never merges across white space, so the ids of a text are the
ids of its white-space-separated pieces in order; and within a piece it never
merges letters with digits or marks, so the ids of a piece are those of its
runs.  Pieces and runs are remembered in bounded tables.  Unknown runs of a
batch are encoded by the tokenizer side by side.  Pieces beyond the Latin
blocks, or that may hold a special token, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces, and runs, remembered by one worker process: some 120 MB together when full.
PIECES = 150_000
RUNS_KEPT = 500_000
#: How the vocabulary's pre-tokeniser cuts lower-cased text of the characters below, pieces being apart
#: by line feeds; and what such text may not hold (other letters, numbers that are no digits, special tokens).
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+|\n")
OTHERS = re.compile(r"[^\x00-\u024f]|[\xb2\xb3\xb9\xbc-\xbe]|<\||[\x1c-\x1f\x85\xa0]")
#: Bytes of a text that are encoded at a time.
BLOCK = 1 << 20

_loaded: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """``ids(text)`` equals the tokenizer's own ids without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def ids(self, text: str | bytes | None) -> np.ndarray:
        """Unsigned 32-bit ids of the whole text."""
        return next(iter(self.ids_many([text])))

    def ids_many(self, texts: Iterable[str | bytes | None]) -> Iterator[np.ndarray]:
        """Ids of each text in order; short texts are looked up together, long ones a megabyte at a time."""
        held, size = [], 0
        for text in texts:
            raw = text.encode("utf-8", "replace") if isinstance(text, str) else bytes(text or b"")
            if len(raw) > BLOCK:
                yield from self._together(held)
                held, size = [], 0
                yield np.frombuffer(b"".join(self._lookup([p])[0] for p in self._blocks(raw)), "<u4")
                continue
            held.append(raw.split())
            size += len(raw)
            if size > BLOCK:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _blocks(self, raw: bytes) -> Iterator[list[bytes]]:
        at = 0
        while at < len(raw):
            end = at + BLOCK
            if end < len(raw):  # go on to the end of a piece
                ends = [e for e in (raw.find(b" ", end), raw.find(b"\n", end)) if e >= 0]
                end = min(ends, default=len(raw))
            yield raw[at:end].split()
            at = end

    def _together(self, held: list[list[bytes]]) -> Iterator[np.ndarray]:
        for raw in self._lookup(held):
            yield np.frombuffer(raw, "<u4")

    def _lookup(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids, as bytes, of texts given as pieces."""
        known = self.known
        fresh = set().union(*texts).difference(known)
        own = self._new(list(fresh)) if fresh else {}
        known.update(own)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in texts]
        if len(known) > PIECES:
            for p in own:
                del known[p]
        return out

    def _new(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that are not remembered."""
        text = b"\n".join(pieces).decode("utf-8", "replace")
        out: dict[bytes, bytes] = {}
        if OTHERS.search(text):
            texts = text.split("\n")
            odd = [p for p, t in zip(pieces, texts, strict=True) if OTHERS.search(t)]
            for p, e in zip(odd, self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in odd], add_special_tokens=False), strict=True):
                out[p] = array("I", e.ids).tobytes()
            plain = [(p, t) for p, t in zip(pieces, texts, strict=True) if p not in out]
            pieces, text = [p for p, _ in plain], "\n".join(t for _, t in plain)
        cut = RUNS.findall(text.lower())
        if len(self.runs) > RUNS_KEPT:
            self.runs = {}
        runs = self.runs
        unknown = list(set(cut).difference(runs))
        for at in range(0, len(unknown), 4096):
            self._encode_runs(unknown[at : at + 4096])
        runs["\n"] = b""  # the only run without ids: ends a piece
        found = list(map(runs.__getitem__, cut))
        size = np.fromiter(map(len, found), np.int64, len(found))
        edge = np.append(np.cumsum(size)[size == 0], size.sum()).tolist() if pieces else []
        raw = b"".join(found)
        out.update(zip(pieces, map(raw.__getitem__, map(slice, [0, *edge], edge)), strict=True))
        return out

    def _encode_runs(self, unknown: list[str]) -> None:
        """Remember runs; encoded side by side, each ends with a token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(unknown)], add_special_tokens=False)[0].ids, "<u4")
        edge = np.flatnonzero(self.ends[ids]) + 1
        own = [r for r in unknown if r != "\n"]
        if len(edge) == len(own):
            cuts = (4 * edge).tolist()
            self.runs.update(zip(own, map(ids.tobytes().__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
        else:  # not such a vocabulary: one by one
            for r, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                self.runs[r] = array("I", e.ids).tobytes()


def load(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

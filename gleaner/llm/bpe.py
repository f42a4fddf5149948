"""Byte-pair encoding by speculation, and decoding.

Greedy longest match over a trie of the vocabulary proposes the tokens of every
new word.  A sequence of tokens is what the merges make of its text exactly if
every two neighbours are compatible: run on the two of them alone, no merge may
cross the border between them.  That is tested for all neighbours of a batch at
once: the merges of the left token along its right edge and those of the right
token along its left edge are undone together, latest first, and at each step
the two pieces at the border are looked up in the merge table.  Words without
an incompatible pair are done; only the others are merged exactly, lowest rank
first.

Text is cut as the vocabulary's own tokenizer cuts it (:mod:`.tokenizer`: pieces
between white space, runs of letters, digits or marks within them), words and
pieces are remembered in bounded tables, and a text is read whole, a megabyte at
a time.

Defined results: null and empty texts, and texts of white space only, have no
ids and decode to the empty text; strings of special tokens in a text are those
tokens; bytes that are no UTF-8 are replaced; null ids and ids outside the
vocabulary decode to nothing; repeated rows are encoded each; an empty table
gives no row; all columns stay, and new ones take the names they are given.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .tokenizer import OTHERS, RUNS, RUNS_KEPT, WordTokenizer, default_path

#: Fixed value: the cut into words that ``RUNS`` repeats for plain text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A rank that no merge has.
NEVER = np.int64(1) << 40
LAST = (1 << 40, -1)
#: Words that are encoded together, and symbols up to which a word is merged without a heap.
WORDS = 8192
SHORT = 64

_loaded: dict[str, SpeculativeTokenizer] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else one beyond the first 256."""
    prints = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class MergeTable:
    """The merges of a vocabulary: which pair makes which token, and when."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        names = letters + [c + suffix for c in letters]
        plain = model["type"] == "BPE" and suffix and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
        if not plain or any(n not in vocab for n in names):
            raise ValueError("not a byte-level vocabulary with word ends")
        self.size = max(vocab.values()) + 1
        #: Token of each symbol: a byte, or (256 more) the last byte of a word.
        self.base = np.array([vocab[n] for n in names], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        parts = np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        self.left[made], self.right[made] = parts[:, 0], parts[:, 1]
        self.rank[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(self.rank[parts[:, 0]], self.rank[parts[:, 1]]) >= self.rank[made]).any():
            raise ValueError("a token is made in two ways, or before its parts")
        key = parts[:, 0] * self.size + parts[:, 1]
        order = np.argsort(key)
        self.keys, self.merged = key[order], made[order]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {(a, b): (k, m) for k, (a, b, m) in enumerate(zip(*parts.T.tolist(), made.tolist(), strict=True))}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or ``NEVER``."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[self.merged[at]], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (of a rank below ``before``) crosses the border between the tokens of each pair."""
        fine = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        # Ranks at which the left and the right piece are used up.  Equal merges run from left to right, so the left
        # piece is lost to a merge of the same rank, and the right piece is not.
        gone_x = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        gone_y = gone_x - 1
        while len(open_):
            m = self.pair_rank(x, y)
            crossed = (m < gone_x) & (m <= gone_y)
            fine[open_[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            open_, x, y, gone_x, gone_y, rx, ry = (v[on] for v in (open_, x, y, gone_x, gone_y, rx, ry))
            undo = rx > ry
            gone_x, gone_y = np.where(undo, rx, gone_x), np.where(undo, gone_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return fine

    def reachable(self) -> np.ndarray:
        """Tokens that the merges make of their own text."""
        out = np.zeros(self.size, bool)
        out[self.base] = True
        made = np.flatnonzero(self.rank >= 0)
        whole = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t, ok in sorted(zip(made.tolist(), whole.tolist(), strict=True), key=lambda p: self.rank[p[0]]):
            out[t] = ok and out[self.left[t]] and out[self.right[t]]
        return out

    def merge(self, tokens: list[int]) -> list[int]:
        """What the merges make of one word, exactly: the lowest rank first, of equal ones the leftmost."""
        if len(tokens) <= SHORT:
            return self._merge_short(list(tokens))
        n = len(tokens)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, tokens = self.ranks, list(tokens)
        heap = [(r[0], i, r[1], i + 1) for i in range(n - 1) if (r := ranks.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, made, j = heapq.heappop(heap)
            if tokens[i] < 0 or tokens[j] < 0 or after[i] != j or ranks.get((tokens[i], tokens[j])) != (rank, made):
                continue  # one of the two is no longer what it was
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m >= 0 and (r := ranks.get((tokens[k], tokens[m]))):
                    heapq.heappush(heap, (r[0], k, r[1], m))
        return [t for t in tokens if t >= 0]

    def _merge_short(self, tokens: list[int]) -> list[int]:
        get = self.ranks.get
        ranks = [get(p, LAST)[0] for p in zip(tokens, tokens[1:], strict=False)]
        while ranks and (low := min(ranks)) < LAST[0]:
            i = ranks.index(low)
            tokens[i : i + 2] = (made := get((tokens[i], tokens[i + 1])))[1:]
            del ranks[i]
            if i:
                ranks[i - 1] = get((tokens[i - 1], made[1]), LAST)[0]
            if i < len(ranks):
                ranks[i] = get((made[1], tokens[i + 1]), LAST)[0]
        return tokens


class Trie:
    """Tokens by their symbols; every node's children lie in one sorted array of (node, symbol)."""

    def __init__(self, table: MergeTable):
        keep = table.reachable()
        spelled: dict[int, tuple[int, ...]] = {int(t): (s,) for s, t in enumerate(table.base)}
        for t in np.argsort(np.where(table.rank >= 0, table.rank, NEVER))[: int((table.rank >= 0).sum())].tolist():
            spelled[t] = spelled[int(table.left[t])] + spelled[int(table.right[t])]
        child: dict[int, int] = {}
        token = [-1]
        for t, symbols in spelled.items():
            if keep[t]:
                node = 0
                for s in symbols:
                    key = node << 9 | s
                    node = child.get(key, 0)
                    if not node:
                        node = child[key] = len(token)
                        token.append(-1)
                token[node] = t
        self.keys = np.sort(np.fromiter(child, np.int64, len(child)))
        self.child = np.fromiter(map(child.__getitem__, self.keys.tolist()), np.int64, len(child))
        self.token = np.array(token, np.int64)

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token and length of the longest match from every place."""
        n = len(symbols)
        token, length = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        symbols = symbols.astype(np.int64)
        while len(at):
            key = node << 9 | symbols[at + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[k] == key
            at, node = at[found], self.child[k[found]]
            depth += 1
            own = self.token[node]
            named = own >= 0
            token[at[named]], length[at[named]] = own[named], depth
            more = at + depth < n
            at, node = at[more], node[more]
        return token, length


class SpeculativeTokenizer(WordTokenizer):
    """``ids(text)`` equals the tokenizer's own ids without special tokens, by the merges alone."""

    def __init__(self, path: str):
        super().__init__(path)  # for how it normalises and cuts text that is not plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if cut.get("pattern", {}).get("Regex") != PATTERN or spec["decoder"] is not None:
            raise ValueError("another cut into words, or a decoder of its own")
        self.table = MergeTable(spec["model"])
        self.trie = Trie(self.table)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letter = {c: b for b, c in enumerate(byte_letters())}
        #: Words that were proposed, and those of them that had to be merged.
        self.proposed = self.failed = 0

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each (not empty) word, as bytes."""
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(size) - 1
        raw[last] += 256
        token, length = self.trie.longest(raw)
        hop, at, places = length.tolist(), 0, []
        while at < len(hop):  # no match goes beyond a word's last symbol, so the words are one chain
            places.append(at)
            at += hop[at]
        places = np.array(places, np.int64)
        tokens, word = token[places], np.searchsorted(last, places)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(tokens[inner] * self.table.size + tokens[inner + 1], return_inverse=True)
        fine = self.table.compatible(pairs // self.table.size, pairs % self.table.size)
        bad = np.unique(word[inner[~fine[which]]]).tolist()
        cuts = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        flat = tokens.astype("<u4").tobytes()
        out = list(map(flat.__getitem__, map(slice, cuts, cuts[1:])))
        base, ends, sizes, merge = self.table.base[raw].tolist(), last.tolist(), size.tolist(), self.table.merge
        for w in bad:
            end = ends[w] + 1
            out[w] = array("I", merge(base[end - sizes[w] : end])).tobytes()
        self.proposed += len(words)
        self.failed += len(bad)
        return out

    def _encode_runs(self, unknown: list[str]) -> None:
        own = [r for r in unknown if r != "\n"]
        if own:
            self.runs.update(zip(own, self.words([r.encode() for r in own]), strict=True))

    def _new(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that are not remembered."""
        text = b"\n".join(pieces).decode("utf-8", "replace")
        odd: dict[bytes, list[str | bytes]] = {}
        if OTHERS.search(text):
            texts = text.split("\n")
            odd = {p: self._cut(t) for p, t in zip(pieces, texts, strict=True) if OTHERS.search(t)}
            plain = [(p, t) for p, t in zip(pieces, texts, strict=True) if p not in odd]
            pieces, text = [p for p, _ in plain], "\n".join(t for _, t in plain)
        cut = RUNS.findall(text.lower())
        if len(self.runs) > RUNS_KEPT:
            self.runs = {}
        runs = self.runs
        unknown = list({*cut, *(r for own in odd.values() for r in own if isinstance(r, str))}.difference(runs))
        for at in range(0, len(unknown), WORDS):
            self._encode_runs(unknown[at : at + WORDS])
        out = {p: b"".join(runs[r] if isinstance(r, str) else r for r in own) for p, own in odd.items()}
        runs["\n"] = b""  # the only run without ids: ends a piece
        found = list(map(runs.__getitem__, cut))
        size = np.fromiter(map(len, found), np.int64, len(found))
        edge = np.append(np.cumsum(size)[size == 0], size.sum()).tolist() if pieces else []
        raw = b"".join(found)
        out.update(zip(pieces, map(raw.__getitem__, map(slice, [0, *edge], edge)), strict=True))
        return out

    def _cut(self, text: str) -> list[str | bytes]:
        """Words of a piece that is not plain, as the tokenizer's own normaliser cuts it, and the ids of special tokens."""
        out: list[str | bytes] = []
        at = 0
        while at < len(text):
            found = min(((k, s) for s in self.specials if (k := text.find(s, at)) >= 0), default=(len(text), ""))
            part = self.tokenizer.normalizer.normalize_str(text[at : found[0]])
            for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part) if part else []:
                out.append(bytes(map(self.letter.__getitem__, word)).decode())
            if found[1]:
                out.append(np.array([self.specials[found[1]]], "<u4").tobytes())
            at = found[0] + len(found[1])
        return out


def load(path: str) -> SpeculativeTokenizer:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = SpeculativeTokenizer(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text, special tokens added to none."""
    path = path or default_path()

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(encoded(batches))

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = load(path)
        for texts in batches:
            own = list(tokens.ids_many(t.as_py() for t in texts))
            edge = np.cumsum([0, *map(len, own)])
            flat = np.concatenate(own) if own else np.zeros(0, "<u4")
            yield pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat.astype(np.int32)))

    ids = ids.asNondeterministic()  # else whoever reads the column twice encodes twice
    return docs.withColumn(ids_col, ids(F.col(text_col).cast("string").cast("binary")))


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each list of ids: their tokens joined by one space, special ones included."""
    path = path or default_path()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = name
        known = pa.array([t or None for t in tokens])
        for ids in batches:
            flat, size = ids.flatten(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            inside = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), False)
            named = known.take(pc.if_else(inside, flat, None))
            there = named.is_valid().to_numpy(zero_copy_only=False)
            count = np.concatenate([[0], np.cumsum(there)])
            edge = count[np.concatenate([[0], np.cumsum(size)])]
            yield pc.binary_join(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), named.drop_null()), " ")

    return rows.withColumn(text_col, text(F.col(ids_col).cast("array<int>")))


def digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of ids, hash of the ids, and hash of the decoded text of each row of ``docs``."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    back = decode(encode(rows, path, "_text", "_ids"), path, "_ids", "_decoded")
    said = F.array_join(F.col("_ids").cast("array<string>"), " ")
    return back.select(
        id_col,
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(said.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

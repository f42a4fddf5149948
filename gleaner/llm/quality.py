"""Document quality from a linear-chain conditional random field over lines.

Each line gets shape features of itself and of its two neighbours; a chain of
two states (bad, good) with learned transitions is trained by maximum
likelihood, every line of a labelled document carrying the document's label.
At prediction the forward-backward marginals of "good", weighted by line
length, are averaged into a document figure that a one-variable logistic
curve, fitted on the same training rows, turns into the score.

Training reads a bounded sample of rows: at most about ``max_docs`` labelled
documents, chosen by a hash of the id, and of a document of more than
``max_lines`` lines as many, spread evenly over the whole text.  Prediction reads
every line of every text, a megabyte at a time; it holds some fifty bytes a line.

Defined results: a null text counts as empty; an empty text is one empty line
and is scored like any other.  Documents with several labels count once, by
the largest.  Without labels the score is 0.5, and a score of 0.5 is kept.
Repeated rows are scored each; an empty table gives no row; columns of other
names are no input.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample_key, tidy

#: Classes of bytes: lower, upper, digit, space, stop, comma, shout, pipe, symbol, other mark, not ASCII, newline.
GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\r\x0b\x0c",
    b".?",
    b",;:",
    b"!",
    b"|",
    b"*&$%#@^~_=+<>{}[]\\",
    b"\"'()-/`",
]
WIDE, NEWLINE = len(GROUPS), len(GROUPS) + 1
CLASSES = len(GROUPS) + 2
TABLE = np.full(256, len(GROUPS) - 1, np.uint8)
for _i, _g in enumerate(GROUPS):
    TABLE[list(_g)] = _i
TABLE[128:] = WIDE
TABLE[10] = NEWLINE
#: Bytes of text whose classes are counted at a time.
BLOCK = 1 << 20
SHAPE = 20


def line_shapes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x SHAPE features, line lengths in bytes) of one text."""
    parts = list(shape_blocks(text))
    return np.vstack([f for f, _ in parts]), np.concatenate([size for _, size in parts])


def shape_blocks(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`line_shapes`, for the lines of about a megabyte at a time."""
    raw = text.encode("utf-8", "surrogatepass")
    seen: set[bytes] = set()
    at = 0
    while at <= len(raw):
        end = raw.find(b"\n", at + BLOCK)
        end = len(raw) if end < 0 else end
        yield _shapes(raw[at:end], seen)
        at = end + 1


def _shapes(raw: bytes, seen: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    lines = raw.split(b"\n")
    n = len(lines)
    count = np.zeros(n * CLASSES, np.int64)
    line = 0
    for at in range(0, len(b), BLOCK):
        cls = TABLE[b[at : at + BLOCK]]
        brk = cls == NEWLINE
        row = line + np.cumsum(brk) - brk
        count += np.bincount(row * CLASSES + cls, minlength=n * CLASSES)
        line = int(row[-1] + brk[-1])
    count = count.reshape(n, CLASSES).astype(np.float64)
    size = count[:, :NEWLINE].sum(axis=1)
    words = np.zeros(n)
    same = np.zeros(n)
    varied = np.zeros(n)
    stuck = np.zeros(n)
    again = np.zeros(n)
    for i, x in enumerate(lines):
        w = x.split()
        words[i] = len(w)
        if len(w) > 1:
            same[i] = sum(map(eq, w, w[1:])) / (len(w) - 1)
            varied[i] = len(set(w)) / len(w)
            stuck[i] = w[0].endswith((b"*", b"&", b"$", b"%", b"#")) + w[-1].endswith((b"|", b"!!"))
        if w:
            again[i] = x in seen
            seen.add(x)
    full = np.maximum(size, 1)[:, None]
    part = count[:, :NEWLINE] / full
    letters = np.maximum(1, count[:, 0] + count[:, 1] + count[:, WIDE])
    f = np.empty((n, SHAPE))
    f[:, 0] = 1
    f[:, 1] = np.log1p(size) / 5
    f[:, 2] = words == 0
    f[:, 3:14] = part * np.array([1, 2, 5, 2, 5, 5, 10, 10, 5, 5, 2])
    f[:, 14] = 2 * count[:, 1] / letters
    f[:, 15] = 3 * same
    f[:, 16] = varied
    f[:, 17] = np.log1p(words) / 4
    f[:, 18] = again
    f[:, 19] = stuck
    return f, size


def with_neighbours(f: np.ndarray) -> np.ndarray:
    """Own features, then the previous line's and the next line's (zeros at the ends)."""
    edge = np.zeros((1, f.shape[1]))
    return np.hstack([f, np.vstack([edge, f[:-1]]), np.vstack([f[1:], edge])])


def emissions(text: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of "good" at every line and the line lengths, without holding the features of all lines."""
    parts = [(f @ weights.reshape(3, SHAPE).T, size) for f, size in shape_blocks(text)]
    own, before, after = np.vstack([p for p, _ in parts]).T
    emit = own.copy()
    emit[1:] += before[:-1]
    emit[:-1] += after[1:]
    return emit, np.concatenate([size for _, size in parts])


def _pad(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Chains from long to short as one matrix, with their lengths."""
    size = np.array([len(c) for c in chains])
    out = np.zeros((len(chains), int(size.max())))
    for i, c in enumerate(chains):
        out[i, : len(c)] = c
    return out, size


def forward_backward(emit: np.ndarray, size: np.ndarray, trans: np.ndarray):
    """Marginals of state 1, pairwise marginals summed, and log Z, for chains sorted from long to short.

    ``emit`` holds the score of state 1 against 0 at each place, ``trans`` the 2 x 2 transition scores.
    """
    rows, wide = emit.shape
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(wide)]
    alpha = np.zeros((rows, wide, 2))
    beta = np.zeros((rows, wide, 2))
    alpha[:, 0, 1] = emit[:, 0]
    for t in range(1, wide):
        k = live[t]
        reach = alpha[:k, t - 1, :, None] + trans[None]
        alpha[:k, t] = np.logaddexp(reach[:, 0], reach[:, 1])
        alpha[:k, t, 1] += emit[:k, t]
    for t in range(wide - 2, -1, -1):
        k = live[t + 1]
        on = beta[:k, t + 1].copy()
        on[:, 1] += emit[:k, t + 1]
        reach = trans[None] + on[:, None, :]
        beta[:k, t] = np.logaddexp(reach[..., 0], reach[..., 1])
    end = alpha[np.arange(rows), size - 1]
    log_z = np.logaddexp(end[:, 0], end[:, 1])
    good = np.exp(np.minimum(0, alpha[..., 1] + beta[..., 1] - log_z[:, None]))
    good[np.arange(wide)[None, :] >= size[:, None]] = 0
    return good, alpha, beta, log_z, live


class LineModel:
    """Weights of the chain and of the closing logistic curve."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, curve: tuple[float, float]):
        self.weights, self.trans, self.curve = weights, trans, curve

    #: Places of padded chains that are worked on at a time.
    CELLS = 1 << 17

    def raw(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean marginal of "good", for each document's (:func:`emissions`)."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i][0]))
        at = 0
        while at < len(order):
            rows = order[at : at + max(1, self.CELLS // len(docs[order[at]][0]))]
            emit, size = _pad([docs[i][0] for i in rows])
            good = forward_backward(emit, size, self.trans)[0]
            for k, i in enumerate(rows):
                weight = docs[i][1] + 1
                out[i] = float((good[k, : size[k]] * weight).sum() / weight.sum())
            at += len(rows)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return self.closed([emissions(t, self.weights) for t in texts])

    def closed(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * _logit(self.raw(docs)) + self.curve[1])))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(docs: list[np.ndarray], sizes: list[np.ndarray], labels: list[int], rounds: int = 250, penalty: float = 1e-3) -> LineModel:
    """Maximum likelihood by Adam over all chains at once, then the closing curve."""
    if not docs:
        return LineModel(np.zeros(3 * SHAPE), np.zeros((2, 2)), (0.0, 0.0))
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    docs, sizes, labels = [docs[i] for i in order], [sizes[i] for i in order], np.array([labels[i] for i in order], float)
    x = np.vstack([with_neighbours(d) for d in docs])
    size = np.array([len(d) for d in docs])
    row = np.repeat(np.arange(len(docs)), size)
    col = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    # Chains weigh alike whatever their length, and the two labels weigh alike.
    share = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    weight = (share / size)[row]
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    emit = np.zeros((len(docs), int(size.max())))
    y = labels[row]
    for step in range(1, rounds + 1):
        emit[row, col] = x @ w
        good, alpha, beta, log_z, live = forward_backward(emit, size, trans)
        grad_w = x.T @ (weight * (good[row, col] - y)) + penalty * w
        grad_t = np.zeros((2, 2))
        for t in range(1, emit.shape[1]):
            k = live[t]
            on = beta[:k, t].copy()
            on[:, 1] += emit[:k, t]
            pair = np.exp(np.minimum(0, alpha[:k, t - 1, :, None] + trans[None] + on[:, None, :] - log_z[:k, None, None]))
            pair[labels[:k] > 0, 1, 1] -= 1
            pair[labels[:k] <= 0, 0, 0] -= 1
            grad_t += ((share / size)[:k, None, None] * pair).sum(axis=0)
        grad = np.concatenate([grad_w, (grad_t + 1e-2 * trans).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, trans = w - move[:-4], trans - move[-4:].reshape(2, 2)
    model = LineModel(w, trans, (1.0, 0.0))
    z = _logit(model.raw([(with_neighbours(d) @ w, s) for d, s in zip(docs, sizes, strict=True)]))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a lightly held logistic regression
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((p - labels) * z).sum() + 0.1 * (a - 1), (p - labels).sum() + 0.1 * b])
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 0.1, (q * z).sum()], [(q * z).sum(), q.sum() + 0.1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    model.curve = (max(0.05, float(a)), float(b))
    return model


def spread(n: int, most: int) -> np.ndarray:
    """At most ``most`` of ``n`` places, evenly over all of them."""
    return np.arange(n) if n <= most else np.linspace(0, n - 1, most).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_lines: int = 256, id_col="doc_id", text_col="text", label_col="quality") -> LineModel:
    """Train on about ``max_docs`` labelled documents, half of each label where there are enough; held-out rows never count."""
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id"))
        .agg((F.max(label_col) > 0).cast("int").alias("_y"))
    )
    count = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if not count:
        return train([], [], [])
    part = F.lit(0.0)
    for y, n in sorted(count.items()):
        part = F.when(F.col("_y") == y, F.lit(min(1.0, max_docs / 2 / n))).otherwise(part)
    chosen = known.filter(sample_key(F.col("_id")) < part)  # about max_docs rows of two small columns: bounded, so broadcast

    @F.pandas_udf("f binary, s binary")
    def shapes(texts: pd.Series) -> pd.DataFrame:
        out = [(f[at].astype(np.float32).tobytes(), s[at].tobytes()) for f, s in map(line_shapes, texts.fillna("")) for at in [spread(len(s), max_lines)]]
        return pd.DataFrame(out, columns=["f", "s"])

    # Rows that say the same count once; should ids repeat with many texts, a hash picks among all alike.
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
        .join(F.broadcast(chosen), "_id")
        .select("_y", "_id", shapes("_t").alias("_s"))
        .select("_y", "_s.f", "_s.s", F.xxhash64("_id", "_s.f").alias("_o"))
        .dropDuplicates(["_o", "_y"])
        .orderBy("_o")
        .limit(2 * max_docs)
        .collect()
    )
    return train(
        [np.frombuffer(bytes(r["f"]), np.float32).astype(np.float64).reshape(-1, SHAPE) for r in rows],
        [np.frombuffer(bytes(r["s"]), np.float64) for r in rows],
        [r["_y"] for r in rows],
    )


def _scorer(spark, model: LineModel):
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(scored(batches))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            model = shipped.value
            held = [emissions(t or "", model.weights) for t in texts]
            yield pd.Series(model.closed(held))

    return score


def classify(docs: DataFrame, model: LineModel, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted."""
    score = _scorer(docs.sparkSession, model)
    scored = docs.select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: LineModel, text_col="text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    score = _scorer(docs.sparkSession, model)
    return docs.filter(score(F.col(text_col).cast("string")) >= 0.5)

"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is a vector of surface measures of the
line and of its two neighbours; transitions between labels are learned too.
Forward-backward gives the marginal of good for every line, and the mean of
the marginals, weighted by line length, is the quality of the document.

Training reads a bounded sample of labelled documents, measured on the
executors; the lines of a document carry its label. Scoring is one pass over
the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm import textbytes as tb

#: most labelled documents per class that training reads
SAMPLE_PER_CLASS = 2000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
STEPS = 150

_ASIDE = np.ones(256, dtype=bool)
_ASIDE[10] = False


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_CLASSES = {
    "letter": _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5))),
    "upper": _table(bytes(range(65, 91))),
    "digit": _table(b"0123456789"),
    "space": _table(b" \t\r"),
    "symbol": _table(b"#$%&*@^~+=<>{}[]\\/_`"),
    "pipe": _table(b"|"),
    "stop": _table(b".?"),
    "bang": _table(b"!"),
    "comma": _table(b",;:"),
}
_STOP = _table(b".?!:\"')")
_UPPER = _CLASSES["upper"]


@dataclass
class Lines:
    """Lines of a slice: features with both neighbours, lengths in characters, range per text."""

    features: np.ndarray
    length: np.ndarray
    bounds: np.ndarray


def _distinct_counts(group: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values per group."""
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, group))
    g, v = group[order], h[order]
    fresh = np.ones(len(g), dtype=bool)
    fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[fresh], minlength=n).astype(float)


def measure(t: tb.Texts) -> Lines:
    """Line features of a slice of texts; a text without lines counts as one empty line."""
    spans = tb.words(t, lower=False, table=_ASIDE)
    start, end, per_text = spans.start, spans.end, np.diff(spans.bounds)
    n = len(start)
    sums = np.zeros(len(t.data) + 1, dtype=np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=sums[1:])
        return (sums[end] - sums[start]).astype(float)

    chars = count((t.data & 0xC0) != 0x80)
    safe = np.maximum(chars, 1)
    share = {k: count(table[t.data]) / safe for k, table in _CLASSES.items()}
    accents = np.zeros(len(t.data), dtype=bool)
    accents[:-1] = (t.data[:-1] == 0xC3) & (t.data[1:] >= 0x80) & (t.data[1:] <= 0x9E)
    share["upper"] += count(accents) / safe
    solid = tb.words(t, lower=False, table=tb.SOLID)
    line = np.searchsorted(start, solid.start, "right") - 1
    ok = (line >= 0) & (solid.start < end[np.maximum(line, 0)]) if n else np.zeros(len(line), bool)
    line, word = line[ok], solid.hash[ok]
    n_words = np.bincount(line, minlength=n).astype(float)[:n]
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    per_word = np.maximum(n_words, 1)
    repeated = np.bincount(line[again], minlength=n).astype(float)[:n] / per_word
    distinct = _distinct_counts(line, word, n)[:n] / per_word
    text = np.repeat(np.arange(t.n), per_text)
    key = tb.mix(spans.hash ^ tb.mix(text.astype(np.uint64)))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    copies = times[where] - 1.0
    last, first = t.data[np.maximum(end - 1, 0)] if n else np.zeros(0, np.uint8), t.data[start] if n else np.zeros(0, np.uint8)
    own = np.stack([
        np.log1p(chars), np.log1p(n_words), np.minimum(chars / per_word, 40), *share.values(), repeated, distinct, np.minimum(copies, 5), (copies > 0) & (n_words > 3),
        _STOP[last], _UPPER[first] | (first == 0xC3), chars / per_word > 12, share["symbol"] > 0.15, share["pipe"] > 0.03, repeated > 0.3, share["upper"] > 0.6, share["bang"] > 0.08,
    ], axis=1).astype(np.float32) if n else np.zeros((0, 24), np.float32)
    empty = np.flatnonzero(per_text == 0)
    if len(empty):
        at = spans.bounds[empty]
        own, chars, text = np.insert(own, at, 0, axis=0), np.insert(chars, at, 1), np.insert(text, at, empty)
    bounds = np.searchsorted(text, np.arange(t.n + 1))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    head, tail = bounds[:-1], bounds[1:] - 1
    before[head], after[tail] = own[head], own[tail]
    edge = np.zeros((len(own), 2), np.float32)
    edge[head, 0] = edge[tail, 1] = 1
    return Lines(np.hstack([own, before, after, edge]), np.maximum(chars, 1), bounds)


@dataclass
class Model:
    """Weights of a two-label chain; features are shifted and scaled first."""

    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift) * self.scale) @ self.weights + self.bias


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(evidence: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of label moves.

    All chains advance together, longest first, so step k works on those that
    still have a k-th line. Logs throughout: long documents do not underflow.
    """
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    start, length = bounds[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")
    forward, backward = np.zeros((len(evidence), 2)), np.zeros((len(evidence), 2))
    for k in range(steps):
        at = start[:alive[k]] + k
        if k:
            a = forward[at - 1]
            forward[at, 0] = _both(a[:, 0] + moves[0, 0], a[:, 1] + moves[1, 0])
            forward[at, 1] = _both(a[:, 0] + moves[0, 1], a[:, 1] + moves[1, 1])
        forward[at, 1] += evidence[at]
    for k in range(steps - 2, -1, -1):
        at = start[:alive[k + 1]] + k
        b = backward[at + 1]
        b1 = b[:, 1] + evidence[at + 1]
        backward[at, 0] = _both(moves[0, 0] + b[:, 0], moves[0, 1] + b1)
        backward[at, 1] = _both(moves[1, 0] + b[:, 0], moves[1, 1] + b1)
    joint = forward + backward
    good = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -700, 700)))
    pair = np.ones(max(0, len(evidence) - 1), dtype=bool)
    pair[bounds[1:-1] - 1] = False
    i = np.flatnonzero(pair)
    expected = np.zeros((2, 2))
    if len(i):
        norm = _both(joint[i, 0], joint[i, 1])
        for p in (0, 1):
            for q in (0, 1):
                expected[p, q] = np.exp(forward[i, p] + moves[p, q] + q * evidence[i + 1] + backward[i + 1, q] - norm).sum()
    return good, expected


def fit(features: np.ndarray, bounds: np.ndarray, label: np.ndarray, steps: int = STEPS, penalty: float = 1e-3) -> Model:
    """Maximum likelihood of the labelled chains by Adam; documents of the rarer class weigh as much in total."""
    shift = features.mean(axis=0)
    scale = 1 / np.maximum(features.std(axis=0), 1e-3)
    x = (features - shift) * scale
    model = Model(shift, scale, np.zeros(x.shape[1]), 0.0, np.zeros((2, 2)))
    truth = np.repeat(label, np.diff(bounds)).astype(float)
    lines = len(x)
    pair = np.ones(max(0, lines - 1), dtype=bool)
    pair[bounds[1:-1] - 1] = False
    same = np.flatnonzero(pair)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[same].astype(int), truth[same + 1].astype(int)), 1)
    theta, m, v = np.zeros(x.shape[1] + 5), 0.0, 0.0
    for k in range(1, steps + 1):
        good, expected = marginals(x @ theta[:-5] + theta[-5], bounds, theta[-4:].reshape(2, 2))
        miss = truth - good
        grad = np.concatenate([x.T @ miss, [miss.sum()], (seen - expected).ravel()]) / lines - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    model.weights, model.bias, model.moves = theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)
    return model


def in_fold(doc_id: Column, folds: int = FOLDS, held_out: int = HELD_OUT) -> Column:
    """Whether a document is held out from training; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))


def labelled_sample(labels: DataFrame, mark: str, per_class: int) -> DataFrame:
    """doc_id and label of at most ``per_class`` documents of each class, in a fixed shuffled order.

    Held-out documents, nulls, and documents with contradictory labels are left out.
    """
    clear = labels.filter(F.col("doc_id").isNotNull() & F.col(mark).isin(0, 1) & ~in_fold(F.col("doc_id")))
    clear = clear.groupBy("doc_id").agg(F.min(mark).alias("label"), F.max(mark).alias("other")).filter("label = other").select("doc_id", "label")
    order = F.md5(F.col("doc_id").cast("string"))
    return clear.filter("label = 0").orderBy(order).limit(per_class).unionByName(clear.filter("label = 1").orderBy(order).limit(per_class))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "quality", per_class: int = SAMPLE_PER_CLASS, steps: int = STEPS) -> Model | None:
    """The chain learned from at most ``per_class`` labelled documents of each class.

    None if there are no labelled documents of both classes; scores are then 0.5.
    """
    sample = labelled_sample(labels, mark, per_class)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "t")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tb.slices(tb.column(batch, "t")):
                got = measure(t)
                rows = [got.features[a:b].astype(np.float32).tobytes() for a, b in zip(got.bounds[:-1], got.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), batch.column(1).slice(t.first, t.n), pa.array(np.diff(got.bounds), pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "label", "n", "x"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    got = slim.mapInArrow(scan, f"doc_id {kind}, label int, n bigint, x binary").toPandas().sort_values(["doc_id", "n", "x"], kind="stable")
    if got["label"].nunique() < 2:
        return None
    sizes = got["n"].to_numpy()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(int(sizes.sum()), -1).astype(float)
    return fit(x, np.concatenate(([0], np.cumsum(sizes))), got["label"].to_numpy(), steps)


def document_scores(t: tb.Texts, model: Model | None) -> np.ndarray:
    """Length-weighted mean marginal of good, per text of a slice."""
    if model is None:
        return np.full(t.n, 0.5)
    got = measure(t)
    good, _ = marginals(model.evidence(got.features), got.bounds, model.moves)
    total = np.add.reduceat(good * got.length, got.bounds[:-1])
    return np.clip(total / np.add.reduceat(got.length, got.bounds[:-1]), 0.0, 1.0)


def scores(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1), one row per document.

    The whole text is scored. Null and empty texts count as one empty line.
    Repeated rows get equal scores; an empty table gives none.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tb.slices(tb.column(batch, "t")):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), pa.array(document_scores(t, model))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(scan, f"doc_id {kind}, score double")


def good_documents(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, all columns and rows as they are.

    Null and empty texts count as one empty line; repeated rows share their
    fate; without a model every score is 0.5; an empty table gives an empty one.
    """
    field = docs.schema.names.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [document_scores(t, model) >= threshold for t in tb.slices(batch.column(field))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(scan, docs.schema)

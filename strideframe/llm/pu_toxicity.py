"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of other documents,
whatever they hold, is unlabelled. With the share of toxic documents known (the
class prior), the risk on negatives is what the unlabelled ones show minus what
the positives explain. That difference must not become negative; where a step
would push it below zero, the step goes the other way. The classifier is linear
in hashed words and word beginnings, learned in numpy from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm import textbytes as tb
from strideframe.llm.line_crf import in_fold

#: most documents that training reads
POSITIVES, UNLABELLED = 2000, 6000
BITS = 18
BEGINNINGS = (5, 6)
THRESHOLD = 0.5
STEPS, RATE, DECAY = 300, 0.05, 2e-4
#: standard errors by which a feature must differ between positives and unlabelled texts
SIGNIFICANT = 4.0


def features(t: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text in a slice, and their bounds: words and word beginnings, hashed."""
    w = tb.words(t)
    text = np.repeat(np.arange(t.n), np.diff(w.bounds))
    keys = [w.hash] + [w.prefix_hash(k) ^ np.uint64(k) for k in BEGINNINGS]
    code = np.concatenate([(text << BITS) | (k >> np.uint64(64 - BITS)).astype(np.int64) for k in keys])
    code = np.unique(code)
    return (code & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(code >> BITS, np.arange(t.n + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Model:
    """Weight per feature number and a bias; the score is the sigmoid of their sum."""

    weights: np.ndarray
    bias: float

    def margin(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _sums(self.weights[code], bounds) + self.bias

    def score(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(code, bounds), -50, 50)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def informative(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], least: float = SIGNIFICANT) -> np.ndarray:
    """Features whose share of texts differs between the samples by at least ``least`` standard errors.

    Most words say nothing; left in, their small weights add up in long texts.
    """
    size, n, m = 1 << BITS, len(positive[1]) - 1, len(unlabelled[1]) - 1
    p, u = (np.bincount(positive[0], minlength=size) + 0.5) / (n + 1), (np.bincount(unlabelled[0], minlength=size) + 0.5) / (m + 1)
    both = (p * n + u * m) / (n + m)
    return np.abs(p - u) >= least * np.sqrt(both * (1 - both) * (1 / n + 1 / m))


def _only(code: np.ndarray, bounds: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that have a place, by place."""
    own = place[code]
    kept = np.concatenate(([0], np.cumsum(own >= 0)))
    return own[own >= 0], kept[bounds]


def fit(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Minimises prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss, by Adam.

    Every step uses both samples whole: a risk estimated on small batches falls
    below zero by chance and turns steps around.
    """
    chosen = np.flatnonzero(informative(positive, unlabelled))
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    (pc, pb), (uc, ub) = _only(*positive, place), _only(*unlabelled, place)
    size, n_pos, n_un = len(chosen), len(pb) - 1, len(ub) - 1
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        zp, zu = _sums(theta[pc], pb) + theta[-1], _sums(theta[uc], ub) + theta[-1]
        # slopes of log(1 + exp(-z)) and log(1 + exp(z)), as mean over texts
        up, down, other = (_sigmoid(zp) - 1) / n_pos, _sigmoid(zp) / n_pos, _sigmoid(zu) / n_un
        if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
            gp, gu = prior * (up - down), other
        else:
            gp, gu = prior * down, -other
        grad = np.bincount(pc, np.repeat(gp, np.diff(pb)), size + 1) + np.bincount(uc, np.repeat(gu, np.diff(ub)), size + 1)
        grad[-1] = gp.sum() + gu.sum()
        grad = grad + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[chosen] = theta[:-1]
    return Model(weights, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """The classifier from at most ``positives`` toxic and ``unlabelled`` other documents.

    Both samples are in a fixed shuffled order and leave out held-out
    documents. The class prior is the toxic share of the labelled training
    documents, held between 0.01 and 0.9. Null or contradictory labels teach nothing. None if there is no
    positive or no other document; scores are then 0.
    """
    clear = labels.filter(F.col("doc_id").isNotNull() & F.col(mark).isin(0, 1) & ~in_fold(F.col("doc_id")))
    clear = clear.groupBy("doc_id").agg(F.min(mark).alias("label"), F.max(mark).alias("other")).filter("label = other")
    share = clear.agg(F.avg("label").alias("share")).first()["share"]
    order = F.xxhash64("doc_id")
    pos = clear.filter("label = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("kind"))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    rest = slim.filter(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).select("doc_id").orderBy(order, "doc_id").limit(unlabelled)
    rest = rest.select("doc_id", F.lit(0).alias("kind")).distinct()
    sample = slim.join(F.broadcast(pos.unionByName(rest)), "doc_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tb.slices(tb.column(batch, "t")):
                code, bounds = features(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), batch.column(1).slice(t.first, t.n), pa.array([code[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc_id", "kind", "x"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "kind", "t").mapInArrow(scan, f"doc_id {kind}, kind int, x binary").toPandas().sort_values(["kind", "doc_id", "x"], kind="stable")

    def packed(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(rows), np.int32), np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int64)

    p, u = list(got.loc[got["kind"] == 1, "x"]), list(got.loc[got["kind"] == 0, "x"])
    if not p or not u:
        return None
    return fit(packed(p), packed(u), min(0.9, max(0.01, share)))


def scores(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier), one row per document.

    Whole texts are scored; null and empty texts have no features and get what
    the bias says. Repeated rows get equal scores.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tb.slices(tb.column(batch, "t")):
                got = np.zeros(t.n) if shared.value is None else shared.value.score(*features(t))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), pa.array(got)], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(scan, f"doc_id {kind}, score double")

"""Language of a text by rank-order n-gram profiles.

A profile is the list of the most frequent n-grams, best first. A document is
compared with each language's profile by the out-of-place distance: for each of
its n-grams the difference of the two places, or a fixed penalty where the
language lacks it. The closest language wins.

Profiles come from a bounded sample of documents per language, whole texts,
counted on the executors and summed in Spark. Prediction is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideframe.llm.line_crf import in_fold
from strideframe.session import settle

FOLDS, HELD_OUT = 4, 2
#: most documents per language that profiles are built from
SAMPLE_PER_LANGUAGE = 1000
#: parts that a language is ranked in first; rows of the sample's ids that may travel whole
SHARES, BROADCAST_ROWS = 64, 200_000
PROFILE = 300
LONGEST = 3
UNKNOWN = "und"
_BITS = np.uint64(21)


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text and their counts.

    Letters are lower-cased, any run of other characters is one gap that
    n-grams may begin or end with; a gap alone is no n-gram. A code holds up to
    three characters of 21 bits.
    """
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = np.where(_letters()[raw], raw, 32).astype(np.uint64)
    chars = np.concatenate(([np.uint64(32)], chars, [np.uint64(32)]))
    gap = chars == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[0] = True
    chars = chars[keep]
    gap = chars == 32
    found, code = [], np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, longest + 1):
        size = len(chars) - n + 1
        if size <= 0:
            break
        code = (code[:size] << _BITS) | chars[n - 1:]
        ok = ~gap[:size] if n == 1 else np.ones(size, dtype=bool)
        for k in range(1, n - 1):
            ok &= ~gap[k:k + size]
        if n == 2:
            ok &= ~(gap[:size] & gap[1:1 + size])
        found.append(code[ok])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, best first, ties to the smaller code."""
    if len(codes) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= floor
        codes, counts = codes[near], counts[near]
    return codes[np.lexsort((codes, -counts))][:size]


@dataclass
class Profiles:
    """Languages in code point order; for each known n-gram its place in every language."""

    languages: list[str]
    codes: np.ndarray
    places: np.ndarray
    size: int

    def closest(self, text: str | None) -> tuple[str, float]:
        """The language of least distance (ties: the first) and 1 - distance / greatest distance."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(*grams(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        away = np.full(len(self.languages), float((~known).sum() * self.size))
        mine = np.arange(len(own))[known]
        away += np.minimum(np.abs(self.places[at[known]] - mine[:, None]), self.size).sum(axis=0)
        best = int(away.argmin())
        return self.languages[best], 1 - away[best] / (len(own) * self.size)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE) -> Profiles:
    """Profiles from at most ``per_language`` training documents of each language.

    Rows that are held out, or lack a language or a text, teach nothing.
    """
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.col(lang).alias("lang")).filter(F.col("t").isNotNull() & F.col("lang").isNotNull() & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    mixed = F.xxhash64("doc_id")
    keyed = known.select("doc_id", "lang", mixed.alias("h"))
    # the first of each share of a language, then the first of those: no task ranks a whole language
    share = F.pmod(F.xxhash64("h"), F.lit(SHARES))
    for group in (["lang", share], ["lang"]):
        keyed = keyed.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("h", "doc_id"))).filter(F.col("place") <= per_language).drop("place")
    chosen = settle(keyed.select("doc_id", "lang").distinct(), "chosen")
    few = chosen.count() <= BROADCAST_ROWS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, t in zip(batch.column(0), batch.column(1), strict=True):
                codes, counts = grams(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([l.as_py()] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    sample = known.join(F.broadcast(chosen) if few else chosen, ["doc_id", "lang"], "left_semi").select("lang", "t")
    total = sample.mapInArrow(scan, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best, share = total, F.pmod(F.xxhash64("gram"), F.lit(SHARES))
    for group in (["lang", share], ["lang"]):
        best = best.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= size)
    best = best.toPandas()
    languages = sorted(best["lang"].unique())
    codes = np.unique(best["gram"].to_numpy(np.int64).view(np.uint64)) if len(best) else np.zeros(0, np.uint64)
    places = np.full((len(codes), len(languages)), size, dtype=np.int64)
    for k, name in enumerate(languages):
        part = best[best["lang"] == name]
        places[np.searchsorted(codes, part["gram"].to_numpy(np.int64).view(np.uint64)), k] = part["place"].to_numpy() - 1
    return Profiles(languages, codes, places, size)


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, one row per document; whole texts are read.

    A text that is null, empty or without letters gets ``und`` and score 0, and
    so does every text if no language was learned. Repeated rows get equal
    results.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [profiles.closest(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([float(g[1]) for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double")

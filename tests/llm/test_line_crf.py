import itertools
import zlib

import numpy as np
import pyarrow as pa

from strideframe.llm import line_crf as crf
from strideframe.llm import queries
from strideframe.llm import textbytes as tb


def test_marginals_equal_a_sum_over_all_labelings():
    rng = np.random.default_rng(3)
    evidence, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    bounds = np.array([0, 1, 5, 9])
    good, expected = crf.marginals(evidence, bounds, moves)
    want, pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in itertools.pairwise(bounds):
        weight = {y: np.exp(sum(e for e, v in zip(evidence[a:b], y, strict=True) if v) + sum(moves[p, q] for p, q in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=b - a)}
        total = sum(weight.values())
        for y, w in weight.items():
            want[a:b] += np.array(y) * w / total
            for p, q in itertools.pairwise(y):
                pairs[p, q] += w / total
    assert np.allclose(good, want) and np.allclose(expected, pairs)


def test_fit_climbs_to_a_stationary_point():
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 60)
    bounds = np.concatenate(([0], np.cumsum(rng.integers(1, 6, 60))))
    x = rng.normal(size=(bounds[-1], 4)) + np.repeat(label, np.diff(bounds))[:, None]
    model = crf.fit(x, bounds, label, steps=400)
    good, _ = crf.marginals(model.evidence(x), bounds, model.moves)
    assert np.mean((good > 0.5) == np.repeat(label, np.diff(bounds))) > 0.93


def _slice(texts):
    return next(tb.slices(pa.array(texts, pa.large_string()), 1 << 30))


def test_lines_measure_the_same_alone_and_among_others():
    texts = ["One line.\nAnother one here, longer\n\nlast", "", "a | b | c", "\n\n", "Élan!! ÉTÉ!!", "x x x x x\nx x x x x"]
    together = crf.measure(_slice(texts))
    for i, t in enumerate(texts):
        alone = crf.measure(_slice([t]))
        assert np.allclose(together.features[together.bounds[i]:together.bounds[i + 1]], alone.features)
    assert np.diff(together.bounds).tolist() == [3, 1, 1, 1, 1, 2]


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op6_line_crf_quality"](spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in labels if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (9, None, None), (8, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    model = crf.train(odd_docs, labels)
    got = crf.scores(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert crf.train(odd_docs, labels.limit(0)) is None and crf.train(no_docs, labels) is None
    assert {r.score for r in crf.scores(odd_docs, None).collect()} == {0.5}
    kept = crf.good_documents(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.score >= crf.THRESHOLD for r in got)
    assert crf.scores(no_docs, model).count() == 0 and crf.good_documents(no_docs, model).count() == 0

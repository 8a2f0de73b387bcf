import zlib

import numpy as np
import pyarrow as pa

from strideframe.llm import pu_toxicity as pu
from strideframe.llm import queries
from strideframe.llm import textbytes as tb


def _packed(texts):
    code, bounds = [], [0]
    for t in tb.slices(pa.array(texts, pa.large_string())):
        c, b = pu.features(t)
        code.append(c)
        bounds += (b[1:] + bounds[-1]).tolist()
    return np.concatenate(code), np.array(bounds)


def test_features_are_distinct_per_text_and_independent_of_neighbours():
    texts = ["Bad bad BAD word", "", "good words", "bad"]
    code, bounds = _packed(texts)
    for i, t in enumerate(texts):
        own, _ = _packed([t])
        assert sorted(code[bounds[i]:bounds[i + 1]]) == sorted(own) and len(set(own)) == len(own)
    assert bounds[2] == bounds[1]


def test_learns_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]

    def text(bad):
        return " ".join([*rng.choice(words, 40), *(rng.choice(["vile", "nasty", "foul"], 3) if bad else [])])

    positive, hidden = [text(True) for _ in range(150)], rng.random(600) < 0.2
    model = pu.fit(_packed(positive), _packed([text(b) for b in hidden]), 0.2)
    truth = rng.random(400) < 0.5
    score = model.score(*_packed([text(b) for b in truth]))
    assert np.mean((score >= 0.5) == truth) > 0.95


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES["op8_pu_toxicity"](spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = np.array([(got[i].predicted, q) for i, q in labels if got[i].held_out])
    assert (held[:, 0] == held[:, 1]).mean() > 0.9


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0), (None, 1, 1), (9, None, None), (8, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    model = pu.train(odd_docs, labels)
    got = pu.scores(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 6)}) == 1
    assert pu.train(odd_docs, labels.limit(0)) is None
    assert {r.score for r in pu.scores(odd_docs, None).collect()} == {0.0}
    assert pu.scores(no_docs, model).count() == 0

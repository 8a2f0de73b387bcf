import re

import numpy as np
import pytest

from strideframe.llm import dart_minhash as dm

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _shingles(text):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows):
    """Least id of each connected class by comparing all pairs."""
    sets = {i: _shingles(t or "") for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("counted", [False, True])
def test_signatures_agree_as_often_as_sets_do(counted):
    rng = np.random.default_rng(5)
    miss = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 200).astype(np.uint64)
        k = int(rng.integers(0, 150))
        a, b = np.sort(base), np.sort(np.concatenate((base[k:], rng.integers(0, 2**63, k).astype(np.uint64))))
        wa, wb = (rng.uniform(0.3, 3, 200), rng.uniform(0.3, 3, 200)) if counted else (np.ones(200), np.ones(200))
        sig = dm.throw(np.concatenate((a, b)), np.concatenate((wa, wb)), np.array([0, 200, 400]), 256)
        truth = dm.similarity(a.tobytes() + wa.astype(np.float32).tobytes(), b.tobytes() + wb.astype(np.float32).tobytes())
        miss.append((sig[0] == sig[1]).mean() - truth)
    assert abs(np.mean(miss)) < 0.012 and np.abs(miss).max() < 0.12


def test_equal_shingle_sets_have_equal_signatures_wherever_they_stand():
    rng = np.random.default_rng(6)
    a = np.sort(rng.integers(0, 2**63, 50).astype(np.uint64))
    sig = dm.throw(np.concatenate((a, a[:1], a)), np.ones(101), np.array([0, 50, 51, 51, 101]))
    assert (sig[0] == sig[3]).all() and not sig[2].any() and sig[1].all()


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for group in range(25):
        base = list(rng.choice(vocab, 150))
        for _ in range(int(rng.integers(1, 9))):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(0, 150))] = rng.choice(vocab)
            rows.append((i, " ".join(text)))
            i += 1
    base = list(rng.choice(vocab, 120))
    for _ in range(60):  # a star: each near the centre, most not near each other
        text = list(base)
        for at in rng.integers(0, 120, 2):
            text[at] = rng.choice(vocab)
        rows.append((i, " ".join(text)))
        i += 1
    rows += [(i, " ".join(base)), (i + 1, " ".join(base).upper() + "!"), (i + 2, "a b c"), (i + 3, "A, b. C"), (i + 4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dm.classes(docs).collect()}
    assert got == _brute(rows)
    kept = {r.doc_id for r in dm.one_of_each(docs).collect()}
    assert kept == set(got.values())


def test_queries_over_the_smallest_tables_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in dm.classes(docs).collect()} == _brute(rows)


def test_odd_rows(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.class_id, r.is_kept) for r in dm.classes(odd_docs).collect()), key=str)
    assert len(got) == odd_docs.count()
    assert got.count((1, 1, True)) == 2 and (8, 1, False) in got and (2, 2, True) in got and (3, 3, True) in got and (None, None, True) in got
    left = dm.one_of_each(odd_docs)
    assert left.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in left.collect()), key=str)
    assert ids.count(1) == 1 and 8 not in ids and ids.count(9) == 2 and len(ids) == odd_docs.count() - 2
    assert dm.classes(no_docs).count() == 0 and dm.one_of_each(no_docs).count() == 0

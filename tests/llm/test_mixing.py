import re

import pytest
from pyspark.sql import functions as F

from strideframe.llm import mixing


def _docs(spark, spec):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(spec)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def _targets(sizes, weights):
    """Shares the total by weight, capping at three times a size, by plain rounds."""
    total, left, out = sum(sizes), set(range(len(sizes))), {}
    while True:
        rest = total - sum(out.values())
        w = sum(weights[i] for i in left)
        over = [i for i in left if rest * weights[i] / w > 3 * sizes[i]]
        if not over:
            return [out.get(i, rest * weights[i] / w) for i in range(len(sizes))]
        for i in over:
            out[i] = 3.0 * sizes[i]
            left.discard(i)


def test_targets_caps_and_taken(spark):
    spec = [("a", 10)] * 300 + [("b", 7)] * 20 + [("c", 3)] * 5 + [(None, 4)] * 50 + [("B", 5)] * 40
    got = {r.doc_id: r for r in mixing.mixed(_docs(spark, spec), slice_rows=16).collect()}
    order = sorted({s for s, _ in spec if s}) + [None]
    sizes = [sum(n for s, n in spec if s == o) for o in order]
    want = dict(zip(order, _targets(sizes, [k % 3 + 1 for k in range(len(order))]), strict=True))
    assert len(got) == len(spec)
    taken = {}
    for i, (s, n) in enumerate(spec):
        r = got[i]
        assert (r.size, r.source_size) == (n, sizes[order.index(s)]) and r.target == pytest.approx(want[s])
        assert r.taken in (0, n, 2 * n, 3 * n)
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in spec:
        assert abs(taken[s] - want[s]) <= n


def test_positions_follow_the_integrated_schedule(spark):
    docs = _docs(spark, [("a", 5)] * 400 + [("b", 5)] * 400 + [("c", 5)] * 400)
    rows = mixing.training_order(docs).withColumn("part", F.spark_partition_id()).collect()
    for s, (a, b) in zip("abc", mixing.SCHEDULES, strict=True):
        at = sorted(r.position for r in rows if r.source == s)
        for t in (0.25, 0.5, 0.75):
            due = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            assert sum(x < t for x in at) / len(at) == pytest.approx(due, abs=0.01)
    by_part = {}
    for r in rows:
        by_part.setdefault(r.part, []).append(r.position)
    flat = [p for k in sorted(by_part) for p in by_part[k]]
    assert flat == sorted(flat)


def test_a_source_is_read_again_at_most_three_times(spark):
    docs = _docs(spark, [("a", 1000)] * 3 + [("b", 10)] * 2 + [("c", 10)] * 2)
    rows = mixing.training_order(docs).collect()
    for d in (3, 4, 5, 6):
        assert sorted(r["pass"] for r in rows if r.doc_id == d) == [1, 2, 3]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mixed(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in odd_docs.collect():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert any(x.doc_id == r.doc_id and x.size == size for x in rows)
    assert rows == mixing.mixed(odd_docs).collect()
    out = mixing.training_order(odd_docs)
    assert out.columns == [*odd_docs.columns, "position", "pass"]
    sizes = {(r.doc_id, r.text): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd_docs.collect()}
    assert sum(sizes[(r.doc_id, r.text)] for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mixed(no_docs).count() == 0 and mixing.training_order(no_docs).count() == 0


@pytest.mark.parametrize("copies,size", [(10, 300), (1, 40), (7, 33)])
def test_a_source_of_copies_meets_its_target_by_half_a_document(spark, copies, size):
    """One row repeated makes up a source; ids and sources may be null."""
    long, short = " ".join(["w"] * size), "w w w"
    rows = [(None, long, "b")] * copies + [(5, short, "a")] * 40 + [(k, short, None) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixed(docs).collect()
    for n, source_size in ((size, size * copies), (3, 120), (3, 90)):
        mine = [r for r in got if r.size == n and r.source_size == source_size]
        assert mine and abs(sum(r.taken for r in mine) - mine[0].target) <= n / 2 + 1e-6
        assert all(r.taken <= 3 * n for r in mine)
    order = mixing.training_order(docs).collect()
    for n, of in ((size, lambda r: r.source == "b"), (3, lambda r: r.source == "a"), (3, lambda r: r.source is None)):
        assert sum(n for r in order if of(r)) == sum(r.taken for r in got if r.size == n and r.source_size == n * sum(of(x) for x in docs.collect()))
    assert sorted(r["pass"] for r in order if r.source == "b")[0] == 1

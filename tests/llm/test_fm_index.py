import re

import numpy as np

from strideframe.llm import fm_index as fm

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOWN = {c: c + 32 for c in range(65, 91)}


def _words(text):
    return WORD.findall((text or "").translate(DOWN))


def _brute(text, items):
    w, hit, found = _words(text), set(), set()
    for item, body in items:
        b = _words(body)
        n = min(10, len(b))
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None), len(found)


def test_search_and_locate_equal_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(15):
        docs = [rng.integers(0, 4, rng.integers(0, 50)).astype(np.uint64) for _ in range(12)]
        docs += docs[:3]
        index = fm.ShardIndex(docs, 4)
        phrases = rng.integers(0, 5, (40, 3)).astype(np.uint64)
        got = {w: sorted(index.locate(np.arange(a, b))) for w, a, b in zip(*index.search(phrases), strict=True)}
        for k, p in enumerate(phrases):
            want = [index.starts[d] + i for d, x in enumerate(docs) for i in range(len(x) - 2) if (x[i:i + 3] == p).all()]
            assert got.get(k, []) == sorted(want)


def _case(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs home again at night"), (2, "Two words"), (3, None), (4, "!!"), (None, "ein Stück Kuchen für dich"), (5, "the quick brown fox jumps over the lazy dog and ran")]
    texts = ["He said: The QUICK brown fox, jumps over the lazy dog and -- slept. two\nWORDS!", "two lazy words", "stück kuchen", "x ein stück kuchen FÜR dich ein Stück Kuchen für dich", None, "", "quick brown fox jumps over the lazy dog and runs home again at night now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, texts, spark.createDataFrame(items, "item_id long, text string"), items


def test_leaks_equal_brute_force_in_one_block_and_in_many(spark):
    docs, texts, table, items = _case(spark)
    for options in ({}, {"block_bytes": 30}, {"shard_words": 5}):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.n_items) for r in fm.find_leaks(docs, table, **options).collect()}
        assert got == {i: _brute(t, items) for i, t in enumerate(texts)}


def test_removal_leaves_no_window(spark):
    docs, texts, table, items = _case(spark)
    out = {r.doc_id: r.text for r in fm.without_leaks(docs, table).collect()}
    assert all(_brute(t, items)[1] == 0 for t in out.values())
    assert out[1] == texts[1] and out[2] == texts[2] and out[4] is None and out[5] == ""
    assert out[0] == "He said:\n-- slept.\n!"


def test_texts_that_meet_after_a_cut_are_cut_again(spark):
    items = spark.createDataFrame([(1, "a b"), (2, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "k a x y b k")], "doc_id long, text string")
    assert [r.text.split() for r in fm.without_leaks(docs, items).collect()] == [["k", "k"]]


def test_spans_are_characters(spark):
    """Only A-Z are lower-cased, so the first run, with its capital umlaut, is another word."""
    docs, texts, table, _ = _case(spark)
    r = next(r for r in fm.find_leaks(docs, table).collect() if r.doc_id == 3)
    assert [texts[3][a:b] for a, b in r.runs] == ["ein Stück Kuchen für dich"]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "words stand here for a while and end"), (2, "")], "item_id long, text string")
    got = fm.find_leaks(odd_docs, items).collect()
    assert len(got) == odd_docs.count() and sum(r.n_hit == 8 for r in got) == 3
    out = fm.without_leaks(odd_docs, items)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert fm.find_leaks(no_docs, items).count() == 0
    none = items.limit(0)
    assert {r.n_hit for r in fm.find_leaks(odd_docs, none).collect()} == {0}
    assert fm.without_leaks(odd_docs, none).exceptAll(odd_docs).count() == 0


def test_removal_in_many_blocks_leaves_no_window_and_cuts_overlaps_whole(spark):
    docs, texts, table, items = _case(spark)
    out = {r.doc_id: r.text for r in fm.without_leaks(docs, table, block_bytes=100).collect()}
    assert out == {r.doc_id: r.text for r in fm.without_leaks(docs, table).collect()}
    items = spark.createDataFrame([(1, "a b"), (2, "x y"), (3, "p q r"), (4, "r s t")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "k a x y b k"), (2, "k x a b y k"), (3, "k p q r s t k"), (3, "k p q r s t k"), (4, None), (5, "k")], "doc_id long, text string")
    for size in (3, 5):
        got = sorted((r.doc_id, (r.text or "").split()) for r in fm.without_leaks(docs, items, block_bytes=size).collect())
        assert got == [(1, ["k", "k"]), (2, ["k", "k"]), (3, ["k", "k"]), (3, ["k", "k"]), (4, []), (5, ["k"])], size


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    """The next block is collected only after the pass over the block before it was written."""
    log, blocks, settle = [], fm.item_blocks, fm.settle

    def logged(*a, **k):
        for b in blocks(*a, **k):
            log.append("block")
            yield b

    monkeypatch.setattr(fm, "item_blocks", logged)
    monkeypatch.setattr(fm, "settle", lambda *a: log.append("written") or settle(*a))
    docs, texts, table, items = _case(spark)
    fm.find_leaks(docs, table, block_bytes=100).count()
    assert len(log) > 2 and log == ["block", "written"] * (len(log) // 2)

import re
import zlib
from collections import Counter

import numpy as np

from strideframe.llm import queries
from strideframe.llm import rank_profiles as rp


def _brute_grams(text):
    out = Counter()
    s = "_" + "_".join(x for x in re.split("_+", "".join(c if c.isalpha() else "_" for c in text.lower())) if x) + "_"
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i:i + n]
            if g.strip("_") and "_" not in g[1:-1]:
                out[g] += 1
    return out


def test_grams_equal_a_plain_count():
    for text in ("Hello, hello world", "a", "é1ß 日本語", "x  y", "one-two\nthree 3 four"):
        codes, counts = rp.grams(text)
        want = {}
        for g, n in _brute_grams(text).items():
            code = 0
            for c in g:
                code = code << 21 | (32 if c == "_" else ord(c))
            want[code] = n
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == want
    assert not len(rp.grams("12 !!")[0])


def test_distance_is_out_of_place():
    def code(c):
        return ord(c)

    p = rp.Profiles(["aa", "bb"], np.array([code("a"), code("b")], np.uint64), np.array([[0, 5], [1, 0]]), 10)
    # own order: a, b, then four n-grams that no profile has
    lang, score = p.closest("a b a")
    own = rp.ranked(*rp.grams("a b a"), 10)
    place = {g: i for i, g in enumerate(own.tolist())}
    away = 10 * (len(own) - 2) + abs(place[97] - 0) + abs(place[98] - 1)
    assert lang == "aa" and score == 1 - away / (10 * len(own))


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op10_rank_order_language"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [(got[d.doc_id].lang_pred, d.lang) for d in docs if got[d.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    profiles = rp.train(odd_docs)
    got = rp.identify(odd_docs, profiles).collect()
    assert len(got) == odd_docs.count()
    for r, d in zip(sorted(got, key=str), sorted(got, key=str), strict=True):
        assert 0 <= r.score <= 1
    texts = {2: None, 3: "", 6: "", 7: ""}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in texts)
    assert {r.lang_pred for r in rp.identify(odd_docs, rp.train(no_docs)).collect()} == {"und"}
    assert rp.identify(no_docs, profiles).count() == 0

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.llm import phrase_mining as pm


def counts(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", " ".join(w[i:i + k])] += 1
    return f, n


def brute(rows, min_count=30, top=2000):
    f, n = counts(rows)
    cand = {k: a for k, a in f.items() if " " in k[1] and a >= min_count}
    nested = set()
    for (lang, p), a in cand.items():
        w = p.split(" ")
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inner = (lang, " ".join(w[i:i + m]))
                if 100 * a >= 80 * f[inner]:
                    nested.add(inner)
    out = []
    for (lang, p), a in cand.items():
        if (lang, p) in nested:
            continue
        w = p.split(" ")
        parts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w))]
        score, _, l, r = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(parts))
        out.append((lang, p, a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(ranked)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(count=150, seed=5):
    rng = np.random.default_rng(seed)
    vocab = ["the", "Of", "and", "new", "york", "city", "hall", "Ünter", "é", "x", "rate-limit"]
    out = []
    for i in range(count):
        w = list(rng.choice(vocab, rng.integers(0, 120)))
        t = "".join(x + str(rng.choice([" ", "  ", "\t", ". ", ", ", "\n", " ", " "])) for x in w)
        out.append((t + (" new york city hall meets here" if i % 2 else ""), [None, "en", "de"][i % 3]))
    return out


@pytest.mark.parametrize("settings", [{}, {"shard_words": 300, "bucket_words": 200}, {"min_count": 3, "shard_words": 50, "bucket_words": 64}, {"min_count": 1, "top": 5}])
def test_collocations_like_brute_force(spark, monkeypatch, settings):
    monkeypatch.setattr(pm, "TRIGGER_EVERY", 4)
    rows = texts()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, text string, lang string").repartition(3)
    got = result(pm.collocations(docs, **settings))
    assert got == brute(rows, settings.get("min_count", 30), settings.get("top", 2000)) and got


@pytest.mark.parametrize("every,longest", [(1, 4096), (2, 4096), (5, 7), (1000, 4), (1000, 3)])
def test_every_phrase_begins_in_one_body_and_lies_in_its_chunk(every, longest):
    rng = np.random.default_rng(1)
    bounds = np.concatenate(([0], np.cumsum(rng.integers(0, 60, 40))))
    h = rng.integers(0, 6, bounds[-1]).astype(np.uint64)
    starts = pm.body_starts(h, bounds, every, longest)
    assert set(bounds[:-1][np.diff(bounds) > 0]) <= set(starts) and len(set(starts)) == len(starts)
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = [s for s in starts if a <= s < b]
        assert all(s + pm.OVERLAP <= b for s in own[1:])
        assert all(y - x <= max(longest, 1) or b - (x + longest) < pm.OVERLAP for x, y in zip(own, [*own[1:], b], strict=True))


def test_parse_depends_on_content_and_shares_chunks(spark):
    passage = " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([(f"intro {k} " * (k + 1) + passage, "en") for k in range(40)], "text string, lang string")
    parse = pm.dictionary(docs)
    assert parse.agg(F.max("freq")).first()[0] == 40
    assert parse.agg(F.sum(F.length("chunk"))).first()[0] < 3 * len(passage)


def test_repeated_word_and_long_piece(spark):
    rows = [("ha " * 20_000, "en"), ("ha ha ha", "en"), ("!?.,", "en"), ("   ", "de")]
    got = result(pm.collocations(spark.createDataFrame(rows, "text string, lang string")))
    assert got == brute(rows) and got[0][2] == "ha ha ha ha"


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    assert result(pm.collocations(odd_docs, min_count=2)) == brute(rows, 2)
    assert pm.collocations(no_docs).collect() == []


def test_scores_pass_64_bits(spark):
    big = 4 * 10**18
    expr = f"cast({pm.SCORE_SCALE} AS decimal(7,0)) * cast({big} AS decimal(19,0)) div (cast({big} AS decimal(19,0)) + cast({big} AS decimal(19,0)))"
    assert spark.range(1).select(F.expr(expr).alias("s")).first()["s"] == 1_000_000


def test_all_hashes_let_through_count_exactly(spark):
    """Counts do not depend on what the hashes kept away."""
    rows = texts(60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    shard = pm._Shard.of(pa.table({"lang": ["en", "en"], "chunk": [b"a b. c a b", b"a b c"], "is_last": [True, False], "freq": [2, 3]}))
    every = np.unique(np.concatenate([x for x in pm._hashes(shard)[::2][:2]]))
    got = {(r["lang"], r["phrase"]): r["n"] for r in pm._phrases(shard, every).to_pylist() if r["size"]}
    assert got == {("en", "a"): 4, ("en", "b"): 4, ("en", "c"): 2, ("en", "a b"): 4, ("en", "c a"): 2, ("en", "c a b"): 2}
    assert result(pm.collocations(docs, min_count=5)) == brute(rows, 5)

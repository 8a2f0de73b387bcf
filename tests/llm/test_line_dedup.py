import pytest
from pyspark.sql import functions as F

from strideframe.llm import line_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(texts, min_docs=10, min_chars=1):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))

    docs = [(t or "").split("\n") for t in texts]
    seen = {}
    for d in docs:
        for k in {key(x) for x in d}:
            seen[k] = seen.get(k, 0) + 1
    gone = {k for k, n in seen.items() if n >= min_docs and len(k) >= min_chars}
    return [(len(d), sum(key(x) in gone for x in d), "\n".join(x for x in d if key(x) not in gone)) for d in docs]


def result(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()}


@pytest.mark.parametrize("min_docs,min_chars", [(3, 1), (10, 1), (3, 8), (1, 1)])
def test_lines_like_brute_force(spark, min_docs, min_chars):
    texts = [f"own line {i}\n  SHARED Line\t\nÄpfel {i % 4}\n\nshared line\nown line {i}" for i in range(12)] + ["shared line", "", None, "\n\n", " \t \nx", "\x0bshared line\x0c", "É\né", "a\r\nSHARED LINE\r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert result(line_dedup.without_shared_lines(docs, min_docs=min_docs, min_chars=min_chars)) == dict(enumerate(brute(texts, min_docs, min_chars)))


def test_a_document_counts_once_and_copies_count_each(spark):
    docs = spark.createDataFrame([(1, "a\n" * 50 + "a")] + [(2, "b\nown")] * 10, "doc_id int, text string")
    got = {(r["doc_id"], r["n_dropped"], r["kept_text"]) for r in line_dedup.without_shared_lines(docs).collect()}
    assert got == {(1, 0, "a\n" * 50 + "a"), (2, 2, "")}


def test_heavy_and_light_lines_are_told_alike(spark, monkeypatch):
    texts = [f"{i}\nfooter\n{'x' if i % 5 == 0 else i * 7}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = dict(enumerate(brute(texts)))
    for share in (1, 3, 10_000):
        monkeypatch.setattr(line_dedup, "HEAVY_SHARE", share)
        assert result(line_dedup.without_shared_lines(docs)) == want


def test_odd_rows(odd_docs, no_docs):
    got = line_dedup.without_shared_lines(odd_docs, keep=("doc_id", "fp", "size", "t"), min_docs=2)
    assert got.columns == ["doc_id", "fp", "size", "t", "n_lines", "n_dropped", "kept_text"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r["n_lines"], r["n_dropped"]) for r in rows if r["kept_text"] == "") == [(1, 0), (1, 0), (1, 0), (1, 1), (1, 1), (1, 1)]
    assert line_dedup.without_shared_lines(no_docs).count() == 0


def test_main_path_is_native(spark, odd_docs):
    plan = line_dedup.without_shared_lines(odd_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "SerializeFromObject"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert odd_docs.select(line_dedup.line_key(F.lit(" ÀB c\t"))).first()[0] == "Àb c"

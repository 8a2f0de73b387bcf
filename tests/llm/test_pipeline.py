import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strideframe.llm import dart_minhash, fm_index, line_crf, mixing, secret_lexer

SF = "/root/testdata/sf0.001"


def test_registered():
    q = entry.queries()
    assert q["pipeline"] is corpus_pipeline.run
    assert all(any(name.startswith(f"op{n}_") for name in q) for n in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixture"]


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "mixture":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    kept = {r.doc_id for r in after.collect()}
    marks = [(r.doc_id in kept, r.quality) for r in labels.join(before, "doc_id").collect()]
    assert sum(k == bool(q) for k, q in marks) / len(marks) > 0.9
    before, after = seen["near_duplicates"]
    assert after.count() == dart_minhash.classes(before).select("class_id").distinct().count()
    before, after = seen["decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert after.count() == before.count() and fm_index.find_leaks(before, items).filter("n_hit > 0").count() > 0
    assert fm_index.find_leaks(after, items).filter("n_hit > 0").count() == 0
    before, after = seen["secrets"]
    assert after.count() == before.count() and secret_lexer.find_secrets(after).filter("spans <> ''").count() == 0
    before, after = seen["mixture"]
    plan = mixing.plan(before)
    assert after.count() == plan.agg(F.sum(F.col("n_passes") * F.col("copies"))).first()[0]
    words = after.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == plan.agg(F.sum(F.col("taken") * F.col("copies"))).first()[0]


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "position", "pass"] and 0 < out.select("doc_id").distinct().count() < docs.count()


def test_odd_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words stand here for a while"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[:len(docs.columns)] == docs.columns
            assert out.count() <= 3 * max(1, docs.count())


def test_quality_model_reads_labels_of_its_input_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = line_crf.train(docs, labels)
    b = line_crf.train(docs, labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert (a.weights == b.weights).all()

"""From raw documents to a training mix: the stages, and a run through all of them.

Stages work on what the stage before kept. Each result is written as Parquet to
the shared folder and read back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import dart_minhash, fm_index, line_crf, mixing, secret_lexer
from strideframe.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the documents whose lines are mostly good, as the labelled ones among them teach.

    Null and empty texts are one empty line and scored as such; repeated rows
    share their fate; without labels of both classes all stay; an empty table
    gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_crf.good_documents(docs, line_crf.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of copies and near copies.

    The least doc_id stays, of fully repeated rows one; null, empty and wordless
    texts all stay; an empty table gives an empty one.
    """
    return dart_minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts.

    No row goes: a text that was all benchmark becomes empty, null stays null,
    repeated rows are cut alike; without items nothing is cut.
    """
    return fm_index.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts.

    No row goes: null and empty texts stay as they are, repeated rows are masked
    alike; an empty table gives an empty one.
    """
    return secret_lexer.mask_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and pass of the mix, in training order.

    Null and empty texts have no words and are left out; of equal rows as many
    are read as the mix takes; null sources are a source of their own; an empty
    table gives an empty one.
    """
    return mixing.training_order(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: trained models, index search and lexing are not SQL; tests compare with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

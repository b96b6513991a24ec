"""From raw documents to packed training sequences: five stages, each a Spark job over what the one before kept.

Every stage but the last returns the columns of ``documents``, whatever further columns they have and whatever their names.
``run`` writes each stage's result as Parquet in the shared folder and rereads it as the next stage's input. Every
stage takes an empty table and returns an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import hostrules, jaccard, langid, packing, suffixdedup
from tapeloom.llm.batches import small_batches
from tapeloom.plans.stage import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a rule nor their host's verdict rejects.

    A null or empty text has no words and is rejected; a null host is a host of its own; rows without id, and rows that share
    one, are judged one by one; a very long text is measured alone.
    """
    small_batches(spark)
    return hostrules.judge(docs).where("kept").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language, learned from the labelled three quarters of the input.

    A text without a letter is rejected; without any labelled row all are; rows without id are learned from and judged like
    others; repeated rows are judged one by one; a long text is read whole.
    """
    small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).where("not rejected").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates; documents without id or words stay."""
    small_batches(spark)
    return jaccard.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that occurred before; n_chars follows the text.

    A null text stays null; rows without id are not cut; of rows that share an id each is cut as one more copy of
    that document; a document may become empty and stays.
    """
    small_batches(spark)
    cleaned = suffixdedup.cleaned_documents(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of near-equal windows.

    A null or empty text is its end token; rows without id are packed under a null id; repeated rows are packed once
    each; a long text fills windows of its own and the rest is packed with others.
    """
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("language identification", language),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeats),
    ("packing", packed),
]

# Hash-based learning, suffix orders and token packing are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

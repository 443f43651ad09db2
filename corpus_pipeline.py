"""Corpus pipeline: five of the training-data operators, one after another over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner may write it as Parquet and read it again between
stages. All stages but the last return the columns of ``documents``; each works on every row its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.langid import keep_identified
from provena.llm.minhash import keep_one_of_each
from provena.llm.mixing import mix_copies
from provena.llm.queries import tokenizer_path
from provena.llm.sentencepiece_bpe import encode_documents, load_model
from provena.llm.toxicity import drop_toxic
from provena.runtime import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without an identified language go."""
    return keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier, learned from labels, calls toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mix_copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy of every document, with their count and the digests of ids and decoded text."""
    return encode_documents(docs, load_model(tokenizer_path()), with_ids=True)


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]

#: fitted models and merges cannot be put in SQL; tests hold the rows of run() and of every stage against a plain Python version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("ids"))

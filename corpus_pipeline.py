"""From raw documents to training tokens: language, exact copies, near copies, mix, tokens.

Each stage reads the table that the one before it wrote. All but the last return the columns of
the documents they got, so stages can be left out or put in another order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.inputs import Registry
from marketloom.llm import chosen_path, fingerprints, language, merge_replay, mixing
from marketloom.llm.queries import language_model, vocabulary
from marketloom.session import materialize

q = Registry()


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; texts without a letter or far from all languages go."""
    told = language.identify(docs.select(F.struct("*").alias("document"), "text"), language_model(docs))
    return told.filter("not lang_rejected").select("document.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    return fingerprints.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: the one with the smallest id."""
    return chosen_path.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one in which a source's budget ends is cut there."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of the ids and of the decoded bytes."""
    told = merge_replay.digests(docs.select("doc_id", "lang", "source", "text"), vocabulary(), public_tokenizers.PATTERN)
    return told.select("doc_id", "lang", "source", F.col("_ids").alias("ids"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

#: Language models, similarity classes and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


@q("pipeline", ORACLE_SQL)
def pipeline(tables):
    return run(tables.spark, tables.folder)

"""A training corpus from raw documents, stage by stage.

Each stage's rows are written as Parquet into the shared folder and read again
by the next, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.bpe import encode
from lanternfish.llm.common import fresh_folder, removed, written
from lanternfish.llm.exact_dedup import exact_dedup
from lanternfish.llm.jaccard import jaccard_dedup
from lanternfish.llm.mixing import mixed_documents
from lanternfish.llm.queries import table, tokenizer
from lanternfish.llm.toxicity import clean_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity operator doesn't reject."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word n-grams the one with the least id."""
    return jaccard_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and so far, as the mix takes them. n_chars is counted anew."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids_text of each row of the mix."""
    return encode(docs, *tokenizer("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: SQL can't express the classifier or the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, f"corpus-{name}")
        written(stage(spark, docs, sf_dir), path)
        if before:
            removed(before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

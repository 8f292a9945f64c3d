"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

The stages drop toxic documents, take out repeated lines, keep one document of each
group of near-duplicates, drop documents with benchmark passages, and encode what
is left. Each judges all that its predecessor kept. All but the last return the
columns of ``documents``; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encaudit.llm import bpe, decontamination, line_dedup, simhash, toxicity
from encaudit.session import shared_dir, ship_package

VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted not to be toxic."""
    ship_package(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those with none left go."""
    ship_package(spark)
    shorter = line_dedup.without_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return shorter
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return shorter.select(*(length.alias(c) if c == "n_chars" else c for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship_package(spark)
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    ship_package(spark)
    vocabulary = bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    return bpe.round_trip(docs, vocabulary).select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode_texts),
]

#: Restored words, fuzzy lines, fingerprints and tokens are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole ``documents`` table."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"

    def apply(docs: DataFrame, numbered: tuple) -> DataFrame:
        number, (_, stage) = numbered
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return functools.reduce(apply, enumerate(STAGES), spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Exact duplicates: salted groups of equal digests, whole texts compared at every stage.

A digest that occurs once proves that its text occurs once, so only texts that
share a digest are compared. Rows of a digest are spread over ``salts`` groups;
equal texts are combined inside each salted group first, and the winners of the
groups (at most one per salt and text) are combined after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_duplicates(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which row of its group stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the
    row with the largest doc_id stays.

    A null text is an empty text, and empty texts are equal to each other. A null
    doc_id is smaller than any other; of rows that repeat both doc_id and text
    exactly one has ``kept``. Other columns are not read. An empty table gives an
    empty result. ``salts`` defaults to the number of shuffle partitions, so the
    largest group is spread over all of them.
    """
    if salts is None:
        salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    shared = _shared_digests(rows)
    alone = rows.select("doc_id", "digest", "salt").join(shared, ["digest", "salt"], "left_anti")
    local = _within_salts(rows.join(shared, ["digest", "salt"]))
    winners = _across_salts(local)
    grouped = local.drop("text").join(winners, ["digest", "salt", "text_no"])
    return alone.select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ).unionByName(
        grouped.select(
            "doc_id",
            "keep_id",
            "group_size",
            ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def _shared_digests(rows: DataFrame) -> DataFrame:
    """Every (digest, salt) whose digest belongs to more than one row."""
    salted = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n_rows"))
    repeated = salted.groupBy("digest").agg(F.sum("n_rows").alias("n_rows")).where("n_rows > 1")
    return salted.select("digest", "salt").join(repeated.select("digest"), "digest", "left_semi")


def _within_salts(rows: DataFrame) -> DataFrame:
    """Number the different texts of each salted group, and the rows of each text."""
    texts = Window.partitionBy("digest", "salt").orderBy("text")
    same = Window.partitionBy("digest", "salt", "text").orderBy(F.col("doc_id").desc_nulls_last())
    return rows.select(
        "doc_id",
        "digest",
        "salt",
        "text",
        F.row_number().over(same).alias("place"),
        F.dense_rank().over(texts).alias("text_no"),
    )


def _across_salts(local: DataFrame) -> DataFrame:
    """The row that stays and the size, for every text of every salted group."""
    same = Window.partitionBy("digest", "text")
    best = local.groupBy("digest", "salt", "text_no").agg(
        F.first("text").alias("text"),
        F.max("doc_id").alias("best_id"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return best.select(
        "digest",
        "salt",
        "text_no",
        F.max("best_id").over(same).alias("keep_id"),
        F.sum("n_rows").over(same).alias("group_size"),
    )


def without_duplicates(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; equal rows once."""
    stays = exact_duplicates(docs, salts).where("kept").select(F.col("doc_id").alias("_kept_id"), "text_sha256")
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    kept = docs.join(
        stays, docs["doc_id"].eqNullSafe(stays["_kept_id"]) & (digest == stays["text_sha256"]), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", "text"])

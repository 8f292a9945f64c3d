"""Which extensions a tree holds, and whether their files are text or binary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaudit.functions.kinds import BINARY, TEXT, file_kind
from encaudit.functions.paths import NO_EXTENSION, extension


def with_kind(files: DataFrame) -> DataFrame:
    """Adds ``kind``. Needs ``length`` and ``content`` (the first 4096 bytes are enough)."""
    return files.withColumn("kind", file_kind(F.col("content"), F.col("length")))


def extension_census(files: DataFrame) -> DataFrame:
    """Files per extension with their kinds, most frequent first.

    Rows shrink to (extension, kind) before the shuffle and are counted on the
    map side, so one extension holding most files costs nothing extra.
    """
    name = F.when(extension(F.col("path")) == "", NO_EXTENSION).otherwise(
        extension(F.col("path"))
    )
    kinds = with_kind(files).select(name.alias("extension"), "kind")
    counts = kinds.groupBy("extension").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("kind") == TEXT).alias("text_files"),
        F.count_if(F.col("kind") == BINARY).alias("binary_files"),
    )
    mixed = F.format_string("mixed (%d text / %d binary)", "text_files", "binary_files")
    return counts.withColumn(
        "kind",
        F.when((F.col("text_files") > 0) & (F.col("binary_files") > 0), mixed)
        .when(F.col("text_files") > 0, TEXT)
        .otherwise(BINARY),
    ).orderBy(F.desc("files"), "extension")


def text_extensions(census: DataFrame) -> DataFrame:
    """Sorted extensions with at least one text file: those worth converting."""
    return (
        census.where((F.col("text_files") > 0) & (F.col("extension") != NO_EXTENSION))
        .select("extension")
        .orderBy("extension")
    )


def census_totals(census: DataFrame) -> DataFrame:
    """Files scanned and number of extensions."""
    return census.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files_scanned"),
        F.count(F.lit(1)).alias("unique_extensions"),
    )

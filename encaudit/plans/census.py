"""Extension census of a tree: only the first bytes of each file are read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from encaudit.operators.census import extension_census
from encaudit.sources.tree import balance_files, listing_of, read_heads


def census(spark: SparkSession, root: str, skip_dirs: Iterable[str] = ()) -> DataFrame:
    """Census of one file or of all files below a root, whatever their extension."""
    return extension_census(read_heads(balance_files(listing_of(spark, root, skip_dirs))))

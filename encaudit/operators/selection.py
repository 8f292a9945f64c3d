"""Which files of a tree take part: extension filter and directories to skip."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaudit.functions.paths import extension, file_name, is_pruned, pruned_at


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    """True if the extension is one of the list, whatever the case."""
    wanted = sorted({value.lower() for value in extensions})
    return extension(path).isin(wanted)


def with_selection(files: DataFrame, extensions: Iterable[str]) -> DataFrame:
    """Adds ``file_name``, ``extension`` and ``selected``."""
    path = F.col("path")
    return files.withColumns(
        {
            "file_name": file_name(path),
            "extension": extension(path),
            "selected": has_extension(path, extensions),
        }
    )


def prune_directories(files: DataFrame, names: Iterable[str], relative_path: str) -> DataFrame:
    """Files with none of the directories to skip above them.

    The filter needs the path only, so it runs before any content is decoded.
    """
    return files.where(~is_pruned(F.col(relative_path), names))


def pruned_directories(files: DataFrame, names: Iterable[str], relative_path: str) -> DataFrame:
    """The directories that are skipped, topmost ones only, each once."""
    return (
        files.select(pruned_at(F.col(relative_path), names).alias("directory"))
        .where(F.col("directory").isNotNull())
        .distinct()
    )

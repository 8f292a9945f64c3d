"""The same checks on files as they arrive.

Labels and findings are computed inside the row of each file, so they need no
state and no watermark: a stream of files gives a stream of findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encaudit.functions.paths import extension
from encaudit.operators.encoding import with_label
from encaudit.operators.findings import findings

_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(
    spark: SparkSession, folder: str, max_files_per_trigger: int = 10_000
) -> DataFrame:
    """A stream of the files put into a folder (visible names only)."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(folder)
    )


def arriving_findings(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Findings of the files of a stream whose extension is wanted."""
    wanted = [value.lower() for value in extensions]
    chosen = files.where(extension(F.col("path")).isin(wanted))
    return findings(with_label(chosen))

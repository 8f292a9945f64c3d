"""Report tables over file results, findings and repair summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaudit.functions.contexts import CODE, COMMENT, UNSUPPORTED

# Row labels and default cells of the reports.
UNDETECTED = "Undetected or skipped early"
UNDETECTED_NOTE = "Unsupported extension or early processing error"
UNKNOWN = "Unknown"
UNKNOWN_ERROR = "Unknown error"
NO_ACTION = "No action was required"


def encoding_histogram(results: DataFrame, label: str = "report_label") -> DataFrame:
    """Files per detected label, most frequent first, and a last row for the rest.

    ``report_label`` leaves out files that needed no action; pass
    ``encoding_before`` to count every detected label.
    """
    counts = results.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("files"))
    missing = F.col("label").isNull()
    return (
        counts.select(
            F.coalesce("label", F.lit(UNDETECTED)).alias("encoding"),
            "files",
            F.when(missing, UNDETECTED_NOTE).otherwise("").alias("notes"),
            missing.alias("undetected"),
        )
        .orderBy("undetected", F.desc("files"), "encoding")
        .drop("undetected")
    )


def detection_totals(results: DataFrame, label: str = "report_label") -> DataFrame:
    """Files with a detected label, and all files."""
    return results.agg(
        F.count(F.col(label)).alias("detected_files"), F.count(F.lit(1)).alias("total_files")
    )


def converted_files(results: DataFrame) -> DataFrame:
    """Name, old and new encoding of every converted file."""
    return results.where("converted").select(
        "file_name",
        F.coalesce("encoding_before", F.lit(UNKNOWN)).alias("encoding_from"),
        F.coalesce("encoding_after", F.lit(UNKNOWN)).alias("encoding_to"),
    )


def skipped_files(results: DataFrame) -> DataFrame:
    """One row per skipped file."""
    return results.where("skipped").select("file_name", F.lit(NO_ACTION).alias("reason"))


def skipped_count(results: DataFrame) -> DataFrame:
    """Number of skipped files."""
    return results.agg(F.count_if("skipped").alias("skipped_files"))


def error_files(results: DataFrame) -> DataFrame:
    """Full path and message of every file that failed."""
    return results.where("error_skipped").select(
        "path", F.coalesce("error_description", F.lit(UNKNOWN_ERROR)).alias("error")
    )


def _columns(found: DataFrame, with_string: bool) -> DataFrame:
    columns = [
        F.col("file_name").alias("file"),
        F.col("char_found").alias("visible"),
        F.col("line"),
        F.col("char_position").alias("line_pos"),
        F.col("byte_sequence_file_pos").alias("file_pos"),
    ]
    if with_string:
        columns.append(F.col("string"))
    return found.select(*columns)


def findings_report(found: DataFrame, with_string: bool = False) -> DataFrame:
    """Findings as the reports show them. ``with_string`` needs findings with text."""
    return _columns(found, with_string)


def findings_in_comments(
    found: DataFrame, with_string: bool = False, only_relevant: bool = False
) -> DataFrame:
    """Findings inside comments; none of them is relevant."""
    inside = (F.col("comment_context") == COMMENT) & ~F.lit(only_relevant)
    return _columns(found.where(inside), with_string)


def findings_in_code(
    found: DataFrame, with_string: bool = False, only_relevant: bool = False
) -> DataFrame:
    """Findings outside comments; only visible ones are relevant."""
    shown = F.col("char_found") | ~F.lit(only_relevant)
    return _columns(found.where((F.col("comment_context") == CODE) & shown), with_string)


def findings_unsupported(found: DataFrame, with_string: bool = False) -> DataFrame:
    """Findings in files whose comments are not understood."""
    return _columns(found.where(F.col("comment_context") == UNSUPPORTED), with_string)


def flatten_findings(nested: DataFrame, column: str = "findings") -> DataFrame:
    """One row per element of a nested findings column; files without any drop out."""
    rows = nested.select("path", F.inline_outer(column))
    return rows.where(F.col("finding_no").isNotNull())


def repair_totals(summary: DataFrame) -> DataFrame:
    """Totals over all files that were looked at for repair."""
    totals = ["total", "applied", "skipped", "retries", "failed", "remaining"]
    return summary.agg(
        F.count(F.lit(1)).alias("files"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in totals],
    )


def scan_totals(files: DataFrame, results: DataFrame) -> DataFrame:
    """Results and files seen; they differ only if files were lost on the way."""
    seen = files.select(F.lit(1).alias("seen"), F.lit(0).alias("result"))
    got = results.select(F.lit(0).alias("seen"), F.lit(1).alias("result"))
    return seen.unionAll(got).agg(
        F.coalesce(F.sum("result"), F.lit(0)).alias("results"),
        F.coalesce(F.sum("seen"), F.lit(0)).alias("files_seen"),
    )

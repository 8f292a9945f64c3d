"""One outcome per file: skipped, converted, checked, repaired or an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaudit.functions.charsets import (
    SEVEN_BIT_LABELS,
    decode_plan,
    detect_label,
    is_unicode_label,
    normalize_label,
)
from encaudit.functions.findings import LINES, finding_array, line_array
from encaudit.operators.encoding import computed_once, to_utf8_bom
from encaudit.operators.selection import with_selection

#: Longer contents do not fit into a binary value of Spark.
_ROW_BYTES = (1 << 31) - 64

SKIP, CONVERT, CHECK, REPAIR, ERROR = "skip", "convert", "check", "repair", "error"

# Fixed value: how a converted file is labelled.
CONVERTED_LABEL = "utf-8(BOM)"

RESULT_COLUMNS = [
    "path",
    "file_name",
    "extension",
    "action",
    "encoding_before",
    "encoding_after",
    "report_label",
    "converted",
    "checked",
    "skipped",
    "error_skipped",
    "error_description",
]


def route(
    selected: Column, label: Column, checks: bool, convert: bool, repair: bool = False
) -> Column:
    """What to do with a file, in order of precedence."""
    action = F.when(~selected, SKIP).when(label.isNull(), ERROR)
    if repair:
        return action.otherwise(REPAIR)
    if convert:
        action = action.when(~is_unicode_label(label), CONVERT)
    return action.otherwise(CHECK if checks else SKIP)


def with_action(
    files: DataFrame,
    extensions: Iterable[str],
    checks: bool = True,
    convert: bool = False,
    repair: bool = False,
) -> DataFrame:
    """Adds ``file_name``, ``extension``, ``selected``, ``label`` and ``action``.

    A file whose extension is not wanted gets no label; its content is not looked at.
    """
    chosen = with_selection(files, extensions)
    if "unreadable" in files.columns:
        # a directory that could not be listed is an error whatever its name looks like
        chosen = chosen.withColumn("selected", F.col("selected") | F.col("unreadable"))
    detected = detect_label(F.col("content"))
    if "encoding_override" in files.columns:
        detected = F.coalesce("encoding_override", detected)
    labelled = chosen.withColumn("label", computed_once(F.when(F.col("selected"), detected)))
    return labelled.withColumn(
        "action", route(F.col("selected"), F.col("label"), checks, convert, repair)
    )


def audit_files(
    files: DataFrame,
    extensions: Iterable[str],
    checks: bool = True,
    convert: bool = False,
    repair: bool = False,
    with_text: bool = False,
    with_word: bool = False,
    keep_originals: bool = False,
) -> DataFrame:
    """The whole outcome of every file in one row, in one pass over the contents.

    Result columns of ``file_results`` plus ``write_charset``, ``new_content``
    (null unless converted), ``old_content`` (null unless there is something to
    repair, or to convert with ``keep_originals``), ``findings`` and ``lines`` (null
    unless checked; ``lines`` holds the damaged lines once each, and is empty without
    ``with_text``). Nothing is shuffled. Write it out once and take every report from
    the written table.
    """
    routed = with_action(files, extensions, checks, convert, repair)
    content, label, action = F.col("content"), F.col("label"), F.col("action")
    plan = decode_plan(content, label)
    converted = routed.withColumns(
        {
            "new_content": F.when(action == CONVERT, to_utf8_bom(content, label)),
            "write_charset": plan["write_charset"],
            "family": plan["family"],
        }
    )
    new = F.col("new_content")
    unreadable = content.isNull() & F.col("selected")
    too_large = unreadable & (F.col("length") > F.lit(_ROW_BYTES)) if "length" in files.columns else F.lit(False)
    # seven-bit encodings cannot hold the searched bytes: checked, and nothing found
    seven_bit = F.coalesce(normalize_label(label).isin(SEVEN_BIT_LABELS), F.lit(False))
    unsupported = action.isin(CHECK, REPAIR) & F.col("family").isNull() & ~seven_bit
    failed = (action == CONVERT) & new.isNull()
    error = (
        F.when(too_large, F.concat(F.lit("Too large for a row: "), "file_name"))
        .when(unreadable, F.concat(F.lit("Cannot read "), "file_name"))
        .when(action == ERROR, F.concat(F.lit("Cannot detect encoding of "), "file_name"))
        .when(
            unsupported,
            F.concat(F.lit("Cannot decode "), "file_name", F.lit(" from "), label),
        )
        .when(failed, F.concat(F.lit("Cannot convert "), "file_name", F.lit(" from "), label))
    )
    judged = converted.withColumn("error_description", error)
    fine = F.col("error_description").isNull()
    done = fine & (action == CONVERT)
    checked = fine & action.isin(CONVERT, CHECK, REPAIR)
    found = finding_array(
        F.coalesce(new, content),
        F.when(new.isNotNull(), "utf-8").otherwise(label),
        F.col("extension"),
        with_word,
    )
    seen, known_as = F.coalesce(new, content), F.when(new.isNotNull(), "utf-8").otherwise(label)
    lines = line_array(seen, known_as) if with_text else F.array().cast(LINES)
    kept = judged.withColumns(
        {
            "outcome": F.when(fine, action).otherwise(ERROR),
            "encoding_before": label,
            "encoding_after": F.when(done, CONVERTED_LABEL),
            "checked": checked,
            "converted": done,
            "findings": F.when(checked, found),
            "lines": F.when(checked, lines),
        }
    )
    kept_back = (F.col("outcome") == REPAIR) & (F.size("findings") > 0)
    if keep_originals:
        kept_back = kept_back | (F.col("action") == CONVERT)
    nothing = (F.col("outcome") == REPAIR) & (F.size("findings") == 0)
    return kept.select(
        "path",
        "file_name",
        "extension",
        F.col("outcome").alias("action"),
        "encoding_before",
        "encoding_after",
        F.when(F.col("outcome") != SKIP, F.col("encoding_before")).alias("report_label"),
        "converted",
        "checked",
        ((F.col("outcome") == SKIP) | nothing).alias("skipped"),
        (F.col("outcome") == ERROR).alias("error_skipped"),
        "error_description",
        "write_charset",
        "new_content",
        F.when(kept_back, F.col("content")).alias("old_content"),
        "findings",
        "lines",
    )


def file_results(audited: DataFrame) -> DataFrame:
    """One row per file without contents and findings."""
    return audited.select(*RESULT_COLUMNS)


def audited_findings(audited: DataFrame) -> DataFrame:
    """One row per damaged character of audited files."""
    # inline_outer with a filter: a plain inline would make the optimizer add a
    # size test below it and compute the findings twice when nothing is written
    rows = audited.select("path", "file_name", "write_charset", F.inline_outer("findings"))
    return rows.where(F.col("finding_no").isNotNull())


def audited_lines(audited: DataFrame) -> DataFrame:
    """The damaged lines of audited files, each once, if they were kept."""
    rows = audited.select("path", F.inline_outer("lines"))
    return rows.where(F.col("line").isNotNull())


def converted_contents(audited: DataFrame) -> DataFrame:
    """New content of the files that were converted, keyed by path."""
    return audited.where("converted").select("path", F.col("new_content").alias("content"))


def kept_originals(audited: DataFrame) -> DataFrame:
    """Old content of audited files, keyed by path, where it was kept."""
    kept = audited.where(F.col("old_content").isNotNull())
    return kept.select(
        "path", F.col("encoding_before").alias("label"), F.col("old_content").alias("content")
    )


def originals_to_back_up(files: DataFrame, extensions: Iterable[str]) -> DataFrame:
    """Content of the files a conversion would change, keyed by full path."""
    routed = with_action(files, extensions, checks=False, convert=True)
    return routed.where(F.col("action") == CONVERT).select("path", "label", "content")

"""Tables of damaged characters and of commented lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaudit.functions.arrays import bind
from encaudit.functions.charsets import decode_plan, utf8_view
from encaudit.functions.contexts import line_flags
from encaudit.functions.findings import finding_array, has_damage, line_array
from encaudit.functions.paths import extension, file_name


def damaged_files(files: DataFrame) -> DataFrame:
    """Files that may hold damaged characters, by a test on their raw bytes."""
    return files.where(has_damage(F.col("content"), decode_plan(F.col("content"), F.col("label"))))


def findings(files: DataFrame, with_word: bool = False) -> DataFrame:
    """One row per damaged character of files with ``path``, ``content``, ``label``.

    A map over the files: no shuffle, whatever the number of findings per file.
    Files without any are dropped by a byte search before anything is decoded.
    """
    path = F.col("path")
    found = finding_array(F.col("content"), F.col("label"), extension(path), with_word)
    plan = decode_plan(F.col("content"), F.col("label"))
    listed = damaged_files(files).select(
        "path",
        file_name(path).alias("file_name"),
        plan["write_charset"].alias("write_charset"),
        found.alias("found"),
    )
    # nothing above the generator reads the content, which would be copied for every finding;
    # inline_outer with a filter, as a plain inline may compute the findings twice
    rows = listed.select("path", "file_name", "write_charset", F.inline_outer("found"))
    return rows.where(F.col("finding_no").isNotNull())


def damaged_lines(files: DataFrame) -> DataFrame:
    """``path``, ``line``, ``string`` and ``line_text`` of the lines with damage, each once."""
    lines = line_array(F.col("content"), F.col("label"))
    return damaged_files(files).select("path", F.inline(lines))


def with_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with the text of their lines.

    Every finding then carries its whole line: ask for it where lines are short, or
    for the few findings that are shown.
    """
    return found.join(lines, ["path", "line"])


def commented_lines(files: DataFrame) -> DataFrame:
    """Every line of every file with ``is_commented``.

    Lines are those of the content read as UTF-8, with CR and CRLF as line ends.
    """
    text = F.regexp_replace(F.make_valid_utf8(utf8_view(F.col("content"))), "\r\n?", "\n")
    flags = bind(
        F.struct(text.alias("text"), extension(F.col("path")).alias("extension")),
        lambda bound: line_flags(bound["text"], bound["extension"]),
    )
    return files.select("path", F.posexplode(flags).alias("line", "is_commented")).withColumn(
        "line", F.col("line") + 1
    )


def are_lines_commented(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``is_commented`` for given ``(path, line)``; a line that does not exist gives false."""
    asked = lines.select("path", "line").distinct()
    wanted = files.join(asked.select("path").distinct(), "path", "left_semi")
    return asked.join(commented_lines(wanted), ["path", "line"], "left").withColumn(
        "is_commented", F.coalesce("is_commented", F.lit(False))
    )

"""Files of any size as rows of bounded size: findings and conversion chunk by chunk.

A chunk table has path, label, head (the first bytes of the file), chunk_no, start,
before, content and after (``sources.chunks`` makes it). Contents are read once and
never shuffled. Each chunk gives a row of totals and a list of what it found; only the
totals, a few numbers per chunk, are ordered along the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encaudit.functions.arrays import running
from encaudit.functions.charsets import decode_plan, decode_strict, has_chunks, raw
from encaudit.functions.chunked import chunk_body, chunk_scan, is_visible
from encaudit.functions.contexts import C_LIKE_EXTENSIONS, CODE, COMMENT, PYTHON_EXTENSIONS, UNSUPPORTED
from encaudit.functions.findings import FINDING_FIELDS
from encaudit.functions.paths import extension, file_name
from encaudit.session import settle

_CHUNK = ["chunk_no", "start", "before", "content", "after"]


def _is_code() -> Column:
    return F.lower(extension(F.col("path"))).isin(C_LIKE_EXTENSIONS + PYTHON_EXTENSIONS)


def _planned(chunks: DataFrame) -> DataFrame:
    """Chunks of supported charsets between their moved cuts: path, plan, chunk_no, start, body."""
    planned = chunks.withColumn("plan", decode_plan(F.col("head"), F.col("label"))).where(has_chunks(F.col("plan.family")))
    moved = chunk_body(F.struct(*_CHUNK), F.col("plan.family"), F.col("plan.skip"))
    return planned.select("path", "plan", "chunk_no", moved.alias("moved")).select(
        "path", "plan", "chunk_no", "moved.start", "moved.body"
    )


def scanned_chunks(chunks: DataFrame) -> DataFrame:
    """path, write_charset, visible, chunk_no, start, and what ``chunk_scan`` tells of each chunk."""
    family = F.col("plan.family")
    suffix = F.lower(extension(F.col("path")))
    scan = chunk_scan(F.col("body"), family, suffix, F.col("chunk_no") == 0)
    return (
        _planned(chunks)
        .select("path", F.col("plan.write_charset").alias("write_charset"), is_visible(family).alias("visible"),
                "chunk_no", "start", scan.alias("scan"))
        .select("path", "write_charset", "visible", "chunk_no", "start", "scan.*")
    )


def _ledger(scanned: DataFrame) -> DataFrame:
    """Per chunk what comes before it in its file: chars, lines, found, where its first line began, and its state."""
    along = Window.partitionBy("path").orderBy("chunk_no")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)

    def before(total: Column) -> Column:
        return F.coalesce(F.sum(total).over(earlier), F.lit(0).cast("long"))

    counted = scanned.select(
        "path",
        "chunk_no",
        F.col("total.chars").alias("chars"),
        F.col("total.lines").cast("long").alias("lines"),
        F.col("total.tail").cast("long").alias("tail"),
        F.size("found").cast("long").alias("found"),
    )
    summed = counted.select("*", *(before(F.col(name)).alias(f"{name}_before") for name in ("chars", "lines", "found")))
    began = F.when(F.col("lines") > 0, F.col("chars_before") + F.col("chars") - F.col("tail"))
    placed = summed.select(
        "path",
        "chunk_no",
        "chars_before",
        "lines_before",
        "found_before",
        F.coalesce(F.max(began).over(earlier), F.lit(0).cast("long")).alias("line_began"),
    )
    changes = F.transform("steps", lambda step: F.struct(step["before"].alias("before"), step["after"].alias("after")))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "changes")))
    composed = running(
        F.transform("changes", F.map_from_entries),
        lambda done, change: F.transform_values(done, lambda _, state: F.try_element_at(change, state)),
    )
    states = (
        scanned.where(_is_code())
        .select("path", "chunk_no", changes.alias("changes"))
        .groupBy("path")
        .agg(ordered.alias("steps"))
        .select("path", F.col("steps.chunk_no").alias("numbers"), F.col("steps.changes").alias("changes"))
        .select("path", F.posexplode(F.arrays_zip(F.col("numbers").alias("chunk_no"), composed.alias("after"))))
        # the composed change from the start of the file is the state of the next chunk
        .select("path", (F.col("col.chunk_no") + 1).alias("chunk_no"), F.try_element_at("col.after", F.lit("")).alias("state"))
    )
    return placed.join(states, ["path", "chunk_no"], "left")


def chunk_findings(chunks: DataFrame) -> DataFrame:
    """One row per damaged character of the files of a chunk table, as ``findings`` gives them.

    Counts are longs, as a file may have more lines and findings than an int holds.
    Files without a label, or of a charset that has no safe cuts (several bytes per
    character, without marks), give no rows. An empty table gives none.
    """
    scanned = settle(scanned_chunks(chunks))
    ledger = settle(_ledger(scanned))
    joined = scanned.where(F.size("found") > 0).join(ledger, ["path", "chunk_no"])
    state = F.coalesce("state", F.lit(""))
    flags = F.get(F.filter("steps", lambda step: step["before"] == state), F.lit(0))["flags"]
    each = joined.select(
        "path",
        file_name(F.col("path")).alias("file_name"),
        "write_charset",
        "visible",
        "start",
        "chars_before",
        "lines_before",
        "found_before",
        "line_began",
        _is_code().alias("coded"),
        F.posexplode(F.arrays_zip(F.col("found").alias("local"), flags.alias("flag"))).alias("number", "one"),
    )
    local = F.col("one.local")
    column = local["tail"] + F.when(local["lines"] == 0, F.col("chars_before") - F.col("line_began")).otherwise(0)
    context = F.when(~F.col("coded"), UNSUPPORTED).when(F.col("one.flag"), COMMENT).otherwise(CODE)
    return each.select(
        "path",
        "file_name",
        "write_charset",
        (F.col("found_before") + F.col("number") + 1).alias("finding_no"),
        (F.col("lines_before") + local["lines"] + 1).alias("line"),
        F.when(F.col("visible"), column).otherwise(-1).cast("long").alias("char_position"),
        F.col("visible").alias("char_found"),
        (F.col("start") + local["bytes"]).alias("byte_sequence_file_pos"),
        F.when(F.col("visible"), F.col("chars_before") + local["chars"]).alias("absolute_char_index"),
        context.alias("comment_context"),
        (context == COMMENT).alias("is_commented"),
    ).select("path", "file_name", "write_charset", *FINDING_FIELDS)


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """path, chunk_no and the text of each chunk, null where its bytes do not decode in the file's charset."""
    return _planned(chunks).select(
        "path", "chunk_no", decode_strict(F.col("body"), F.col("plan.family")).alias("text")
    )


def converted_chunks(chunks: DataFrame) -> DataFrame:
    """path, chunk_no and content: the files in UTF-8 with a mark, in parts to be put one after the other.

    Files with a chunk that does not decode are left out (``undecodable`` names them).
    """
    texts = settle(chunk_texts(chunks))
    mark = F.when(F.col("chunk_no") == 0, raw("EFBBBF")).otherwise(raw(""))
    failed = texts.where(F.col("text").isNull()).select("path").distinct()
    sound = texts.join(failed, "path", "left_anti")
    return sound.select("path", "chunk_no", F.concat(mark, F.encode("text", "UTF-8")).alias("content"))


def undecodable(chunks: DataFrame) -> DataFrame:
    """Paths of the files that do not decode in their charset, or have no charset that chunks decode."""
    known = chunk_texts(chunks).groupBy("path").agg(F.count_if(F.col("text").isNull()).alias("bad"))
    every = chunks.where("chunk_no = 0").select("path")
    return every.join(known.where("bad = 0"), "path", "left_anti")

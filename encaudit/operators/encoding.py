"""Labels, decoding and conversion of whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaudit.functions.arrays import bind
from encaudit.functions.charsets import (
    BOM_UTF8,
    body_of,
    decode_lossy,
    decode_plan,
    decode_strict,
    detect_label,
    encode_file,
    raw,
)


def with_label(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds ``label``, detected from the content.

    ``overrides(path, encoding)`` names encodings that bytes alone cannot tell.
    Join it to the listing, before the contents are read, when it is too large
    to be broadcast: then a shuffle moves paths, not contents.
    """
    detected = detect_label(F.col("content"))
    if "encoding_override" in files.columns:
        named = F.coalesce("encoding_override", detected)
        return files.withColumn("label", computed_once(named)).drop("encoding_override")
    if overrides is None:
        return files.withColumn("label", computed_once(detected))
    return with_label(with_overrides(files, overrides))


def computed_once(value: Column) -> Column:
    """A column that filters above it read instead of computing it again below.

    The optimizer moves filters under a projection together with what they test,
    but not under a generator.
    """
    return F.explode_outer(F.array(value))


def with_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds ``encoding_override`` by path; null where there is none.

    Of several encodings for one path the first in alphabetical order counts.
    """
    named = overrides.groupBy("path").agg(F.min("encoding").alias("encoding_override"))
    return files.join(named, "path", "left")


def with_plan(files: DataFrame) -> DataFrame:
    """Adds ``plan``: how to read each file and write it back."""
    return files.withColumn("plan", decode_plan(F.col("content"), F.col("label")))


def with_text(files: DataFrame) -> DataFrame:
    """Adds ``plan`` and ``text``; malformed input becomes U+FFFD, never an error."""
    planned = with_plan(files)
    text = bind(
        F.struct("content", "plan"),
        lambda file: decode_lossy(
            body_of(file["content"], file["plan"]["skip"]), file["plan"]["family"]
        ),
    )
    return planned.withColumn("text", text)


def to_utf8_bom(content: Column, label: Column) -> Column:
    """Content as UTF-8 with a byte-order mark, null if it does not decode."""
    return bind(
        F.struct(content.alias("content"), decode_plan(content, label).alias("plan")),
        lambda file: F.concat(
            raw(BOM_UTF8),
            F.encode(
                decode_strict(
                    body_of(file["content"], file["plan"]["skip"]), file["plan"]["family"]
                ),
                "UTF-8",
            ),
        ),
    )


def with_converted(files: DataFrame) -> DataFrame:
    """Adds ``converted``: the new content, or null for a file that does not decode."""
    return files.withColumn("converted", to_utf8_bom(F.col("content"), F.col("label")))


def with_round_trip(files: DataFrame) -> DataFrame:
    """Adds ``text`` and ``rewritten``: the text in the original charset and mark."""
    return with_text(files).withColumn("rewritten", encode_file(F.col("text"), F.col("plan")))

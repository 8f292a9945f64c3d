"""Chunk tables: files cut into rows of bounded size, from a tree or from a table of contents."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaudit.functions.chunked import REACH
from encaudit.sources.tree import open_at

# Executors get the functions of this module with the task, so they need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a chunk.
CHUNK_BYTES = 4 << 20


def _checked(chunk_bytes: int) -> int:
    if chunk_bytes < 16 or chunk_bytes % 4:
        raise ValueError("A chunk has a multiple of four bytes, sixteen at least")
    return chunk_bytes


def _places(length, chunk_bytes: int):
    last = F.greatest(F.ceil(length / chunk_bytes) - 1, F.lit(0))
    return F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk_no")


def cut_files(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of files (path, content, and label if there is one) in a table; null contents have none."""
    step = F.lit(_checked(chunk_bytes))
    label = F.col("label") if "label" in files.columns else F.lit(None).cast("string").alias("label")
    placed = files.where("content IS NOT NULL").select(
        "path",
        label,
        F.substring("content", 1, REACH).alias("head"),
        F.octet_length("content").cast("long").alias("length"),
        "content",
        _places(F.octet_length("content"), chunk_bytes),
    )
    start = F.col("chunk_no") * step
    near = F.greatest(start - REACH, F.lit(0))

    def part(first, size):
        return F.substring(F.col("content"), (first + 1).cast("int"), size.cast("int"))

    return placed.select(
        "path",
        "label",
        "head",
        "length",
        "chunk_no",
        start.alias("start"),
        part(near, start - near).alias("before"),
        part(start, step).alias("content"),
        part(start + step, F.lit(REACH)).alias("after"),
    )


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of the files of a manifest (path, length, and label if there is one), read where they lie.

    Each chunk is read by itself, so a large file is read by many tasks. What cannot
    be read is a chunk with null content.
    """
    _checked(chunk_bytes)
    label = F.col("label") if "label" in manifest.columns else F.lit(None).cast("string").alias("label")
    places = manifest.select("path", label, F.col("length").cast("long").alias("length"), _places(F.col("length"), chunk_bytes))
    schema = "path string, label string, head binary, length long, chunk_no long, start long, before binary, content binary, after binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in schema.split(", ")]
        types = [pa.string(), pa.string(), pa.binary(), *[pa.int64()] * 3, *[pa.binary()] * 3]
        for batch in batches:
            for row in batch.to_pylist():
                start = row["chunk_no"] * chunk_bytes
                near = max(start - REACH, 0)
                try:
                    with open_at(row["path"]) as file:
                        head = file.read(REACH)
                        file.seek(near)
                        data = file.read(start - near + chunk_bytes + REACH)
                    parts = [data[: start - near], data[start - near :][:chunk_bytes], data[start - near + chunk_bytes :]]
                except OSError:
                    head, parts = None, [None] * 3
                values = [row["path"], row["label"], head, row["length"], row["chunk_no"], start, *parts]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    spread = places.repartition("path", "chunk_no")
    return spread.mapInArrow(read, schema)

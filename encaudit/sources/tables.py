"""Files that live in tables, and writing contents out again."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterable

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def files_from_table(table: DataFrame, path: Column, content: Column) -> DataFrame:
    """``path``, ``length`` and ``content`` of documents kept in a table.

    ``content`` may be text, which is taken as UTF-8.
    """
    rows = table.select(path.alias("path"), content.cast("binary").alias("content"))
    return rows.select("path", F.octet_length("content").cast("long").alias("length"), "content")


def write_contents(contents: DataFrame, target: str) -> None:
    """Contents keyed by full path, as Parquet. The files they come from stay as they are."""
    contents.select("path", "content").write.mode("overwrite").parquet(target)


def export_files(contents: DataFrame, target_root: str, relative_path: str = "path") -> None:
    """Writes each content as a file below a new root, one task per partition.

    The root is a folder or URI that every executor reaches. Each attempt of a
    task writes under a name of its own and then moves the file into place, so
    a repeated task leaves the same files. Nothing outside the root is touched;
    a path that would leave it is refused.
    """
    root = target_root.rstrip("/")

    def write(rows: Iterable[Row]) -> None:
        from pyarrow import fs

        if "://" in root:
            system, base = fs.FileSystem.from_uri(root)
        else:
            system, base = fs.LocalFileSystem(), os.path.abspath(root)
        attempt = TaskContext.get().taskAttemptId()
        for row in rows:
            target = posixpath.normpath(posixpath.join(base, row["path"].lstrip("/")))
            if not target.startswith(base.rstrip("/") + "/"):
                raise ValueError(f"Path leaves the target folder: {row['path']}")
            system.create_dir(posixpath.dirname(target), recursive=True)
            part = f"{target}.{attempt}.part"
            with system.open_output_stream(part) as stream:
                stream.write(row["content"])
            system.move(part, target)

    contents.select(F.col(relative_path).alias("path"), "content").foreachPartition(write)

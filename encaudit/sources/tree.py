"""Scanning file trees: a distributed walk, and reading contents or heads.

Spark's own ``binaryFile`` reader leaves out names that start with a dot or an
underscore, also when they are asked for. The walk sees every file. It lists one
level of directories per round, each directory in some task, so neither the
driver nor one task ever holds the whole listing.

A path is a plain absolute path, or ``scheme://authority/path`` for a store that
Arrow reaches. Paths are literal: blanks and ``%`` mean themselves. What cannot be
listed is a row of kind ``unreadable``; a root that does not exist, or whose scheme
nobody knows, raises an error at once.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encaudit.functions.kinds import SAMPLE_BYTES
from encaudit.functions.paths import is_pruned, skip_names
from encaudit.operators.encoding import with_overrides
from encaudit.operators.selection import has_extension
from encaudit.session import settle

# Executors get the functions of this module with the task, so they need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modificationTime", T.TimestampType()),
    ]
)
_BATCH_ENTRIES = 10_000
FILE, DIRECTORY, PRUNED, UNREADABLE = "file", "directory", "pruned", "unreadable"
#: Spark holds no longer binary value in a row.
_ROW_BYTES = (1 << 31) - 64


def located(path: str) -> str:
    """The one form of a path: absolute, ``file:`` and closing slashes taken off."""
    local = re.match(r"file:(?://(?:localhost)?(?=/))?(.*)", path, re.S)
    if local:
        path = local[1]
    elif "://" in path:
        return path.rstrip("/")
    return os.path.abspath(path)


def _system(path: str):
    """Arrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    authority, slash, inner = rest.partition("/")
    return fs.FileSystem.from_uri(f"{scheme}://{authority}{slash}{quote(inner)}")


def _kind_of_root(path: str) -> str:
    """``file`` or ``directory``; raises if there is no such path or no way to it."""
    if "://" in path:
        from pyarrow import fs

        try:
            system, inner = _system(path)
        except (ValueError, NotImplementedError) as error:
            scheme = path.partition("://")[0]
            raise ValueError(
                f"No file system for {scheme}:// here; scan_visible_files reads what Spark reaches"
            ) from error
        found = system.get_file_info(inner).type
        if found == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        return FILE if found == fs.FileType.File else DIRECTORY
    os.stat(path)
    return DIRECTORY if os.path.isdir(path) else FILE


def _entries(path: str) -> Iterator[tuple[str, str, int, float]]:
    """Names directly under a directory: (name, kind, length, modified seconds)."""
    if "://" in path:
        from pyarrow import fs

        system, inner = _system(path)
        for info in system.get_file_info(fs.FileSelector(inner)):
            kind = DIRECTORY if info.type == fs.FileType.Directory else FILE
            modified = info.mtime.timestamp() if info.mtime else 0.0
            yield info.base_name, kind, info.size or 0, modified
        return
    with os.scandir(path) as found:
        for entry in found:
            try:
                if entry.is_dir():
                    # a link to a directory is neither followed nor a file
                    if not entry.is_symlink():
                        yield entry.name, DIRECTORY, 0, 0.0
                    continue
                status = entry.stat()
                yield entry.name, FILE, status.st_size, status.st_mtime
            except OSError:
                # a link to nowhere is still a file of the tree; reading it gives an error row
                yield entry.name, FILE, 0, 0.0


def _list_level(skip: list[str]):
    skipped = set(skip)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("path", pa.string()),
                ("relative_path", pa.string()),
                ("kind", pa.string()),
                ("length", pa.int64()),
                ("modificationTime", pa.timestamp("us", "UTC")),
            ]
        )
        for batch in batches:
            for row in batch.select(["path", "relative_path"]).to_pylist():
                rows = []
                try:
                    for name, kind, length, modified in _entries(row["path"]):
                        if kind == DIRECTORY and name in skipped:
                            kind = PRUNED
                        rows.append(
                            {
                                "path": row["path"].rstrip("/") + "/" + name,
                                "relative_path": row["relative_path"] + name,
                                "kind": kind,
                                "length": length,
                                "modificationTime": int(modified * 1_000_000),
                            }
                        )
                        if len(rows) >= _BATCH_ENTRIES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                except OSError:
                    rows.append(
                        {
                            "path": row["path"],
                            "relative_path": row["relative_path"].rstrip("/"),
                            "kind": UNREADABLE,
                            "length": 0,
                        }
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return task


def walk(spark: SparkSession, root: str, skip_dirs: Iterable[str] = ()) -> DataFrame:
    """Every file below ``root``, and every directory that was skipped.

    Columns ``path``, ``relative_path``, ``kind`` (``file``, ``pruned`` or
    ``unreadable``), ``length``, ``modificationTime``. Directories to skip are not
    descended into, so nothing below them is listed; the root itself is never
    skipped. A directory that cannot be listed, or not to its end, is a row of kind
    ``unreadable``. Links to directories are not followed. One round per level of the tree; each level is
    settled, so a lost executor costs one level, not the whole walk.
    """
    names = skip_names(skip_dirs)
    root = located(root)
    if _kind_of_root(root) != DIRECTORY:
        raise NotADirectoryError(root)
    level = spark.createDataFrame([(root, "", DIRECTORY, 0, None)], _ENTRY)
    levels, directories = [], 1
    while True:
        spreaded = level.select("path", "relative_path")
        if levels:
            nested = F.concat("relative_path", F.lit("/")).alias("relative_path")
            spreaded = level.select("path", nested).repartition(
                min(_tasks(spark), directories), "path"
            )
        found = settle(spreaded.mapInArrow(_list_level(names), _ENTRY))
        levels.append(found.where(F.col("kind") != DIRECTORY))
        level = found.where(F.col("kind") == DIRECTORY)
        directories = level.count()
        if directories == 0:
            break
    entries = levels[0]
    for more in levels[1:]:
        entries = entries.unionByName(more)
    return entries


def list_files(spark: SparkSession, root: str, skip_dirs: Iterable[str] = ()) -> DataFrame:
    """The files of ``walk``."""
    return walk(spark, root, skip_dirs).where(F.col("kind") == FILE).drop("kind")


def single_file(spark: SparkSession, path: str) -> DataFrame:
    """Listing of one file. Directories above it are never skipped."""
    path = located(path)
    if _kind_of_root(path) != FILE:
        raise IsADirectoryError(path)
    if "://" in path:
        system, inner = _system(path)
        info = system.get_file_info(inner)
        size, modified = info.size or 0, info.mtime
    else:
        from datetime import UTC, datetime

        status = os.stat(path)
        size, modified = status.st_size, datetime.fromtimestamp(status.st_mtime, UTC)
    row = (path, path.rpartition("/")[2], FILE, size, modified)
    return spark.createDataFrame([row], _ENTRY).drop("kind")


def skipped_directories(entries: DataFrame) -> DataFrame:
    """Directories a walk did not descend into, empty ones included."""
    return entries.where(F.col("kind") == PRUNED).select(
        F.col("relative_path").alias("directory")
    )


def _read(path: str, size: int | None) -> bytes | None:
    try:
        if "://" in path:
            system, inner = _system(path)
            with system.open_input_stream(inner) as stream:
                return stream.read(size) if size else stream.read()
        with open(path, "rb") as stream:
            return stream.read(size) if size else stream.read()
    except OSError:
        return None


def open_at(path: str):
    """An open file that can be read from any place."""
    if "://" in path:
        system, inner = _system(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def _reader(size: int | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1)
                length = row.column("length")[0].as_py()
                fits = size is not None or length <= _ROW_BYTES
                content = _read(row.column("path")[0].as_py(), size) if fits else None
                # one file per batch: a task holds one content at a time
                columns = [*row.columns, pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*row.schema.names, "content"])

    return task


def _with_content(listing: DataFrame, size: int | None) -> DataFrame:
    schema = T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType())])
    return listing.mapInArrow(_reader(size), schema)


def read_contents(listing: DataFrame) -> DataFrame:
    """Adds ``content``. Null for a file that cannot be read, or that no row can hold (2 GiB).

    Filter the listing first: what is filtered out is never opened.
    """
    return _with_content(listing, None)


def read_heads(listing: DataFrame, size: int = SAMPLE_BYTES) -> DataFrame:
    """Adds ``content`` with the first bytes only: all a census needs."""
    return _with_content(listing, size)


def scan_files(
    spark: SparkSession,
    root: str,
    skip_dirs: Iterable[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Every file below ``root`` with its content, hidden names included."""
    listing = list_files(spark, root, skip_dirs)
    return read_contents(balance(listing, partitions))


def listing_of(
    spark: SparkSession, path: str, skip_dirs: Iterable[str] = (), with_unreadable: bool = False
) -> DataFrame:
    """Listing of a directory tree, or of the one file the path names.

    ``with_unreadable`` adds the directories that could not be listed, and a column
    ``unreadable`` that tells them from files.
    """
    path = located(path)
    if _kind_of_root(path) == FILE:
        listing = single_file(spark, path).withColumn("kind", F.lit(FILE))
    else:
        listing = walk(spark, path, skip_dirs).where(F.col("kind") != PRUNED)
    if with_unreadable:
        return listing.withColumn("unreadable", F.col("kind") == UNREADABLE).drop("kind")
    return listing.where(F.col("kind") == FILE).drop("kind")


def files_to_audit(
    spark: SparkSession,
    path: str,
    extensions: Iterable[str],
    skip_dirs: Iterable[str] = (),
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Every file of a tree; only those with a wanted extension are opened.

    Directories that cannot be listed come along with ``unreadable`` set, and end as
    error rows. ``overrides(path, encoding)`` join the listing, so no content is
    shuffled for them, however many there are.
    """
    listing = listing_of(spark, path, skip_dirs, with_unreadable=True)
    if overrides is not None:
        listing = with_overrides(listing, overrides)
    wanted = has_extension(F.col("path"), extensions) & ~F.col("unreadable")
    opened = read_contents(balance(listing.where(wanted)))
    return opened.unionByName(
        listing.where(~wanted).withColumn("content", F.lit(None).cast("binary"))
    )


def balance(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """A listing spread by path so that each task reads about one split of bytes.

    Only paths and sizes are shuffled. Without a number of ``partitions`` the
    total size of the listing gives it.
    """
    spark = listing.sparkSession
    if partitions is None:
        split = F.lit(_bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes")))
        splits = F.ceil(F.coalesce(F.sum("length"), F.lit(0)) / split)
        needed, files = listing.agg(splits, F.count(F.lit(1))).first()
        partitions = max(int(needed), min(_tasks(spark), files), 1)
    return listing.repartition(partitions, "path")


def balance_files(listing: DataFrame, files_per_task: int = 20_000) -> DataFrame:
    """A listing spread by path so that each task opens about so many files."""
    files = listing.count()
    needed = -(-files // files_per_task)
    return listing.repartition(max(needed, min(_tasks(listing.sparkSession), files), 1), "path")


def _bytes_of(setting: str) -> int:
    units = {"b": 1, "k": 2**10, "m": 2**20, "g": 2**30}
    digits = setting.strip().lower().rstrip("b") or "0"
    return int(digits[:-1]) * units[digits[-1]] if digits[-1] in units else int(digits)


def _tasks(spark: SparkSession) -> int:
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )


def scan_visible_files(
    spark: SparkSession, root: str, skip_dirs: Iterable[str] = (), glob: str | None = None
) -> DataFrame:
    """Files below ``root`` by Spark's ``binaryFile`` reader: no hidden names.

    Unlike the walk this reader follows links to directories.
    Directories to skip are tested on the file metadata, which drops whole files
    before they are read; ``glob`` is a further name filter on the listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    return files.where(~is_pruned(_below(spark, root), skip_names(skip_dirs)))


def _below(spark: SparkSession, root: str) -> Column:
    """Path of a file relative to the root, from the reader's file metadata."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    conf = spark._jsc.hadoopConfiguration()
    full = hadoop.getFileSystem(conf).makeQualified(hadoop).toUri()
    depth = len([part for part in (full.getPath() or "").split("/") if part])
    encoded = F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "")
    parts = F.split(F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), "/")
    return F.array_join(F.slice(parts, F.lit(depth + 1), F.size(parts)), "/")

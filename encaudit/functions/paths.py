"""Column functions on file paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_EXTENSION = "(no extension)"


def file_name(path: Column) -> Column:
    """The part of a path after its last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty if there is none.

    Leading dots belong to the name: ``.bashrc`` has no extension, ``a.tar.gz``
    has ``.gz`` and ``a.`` has ``.``.
    """
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def directories(relative_path: Column) -> Column:
    """Directory names of a path given relative to the scan root."""
    parts = F.split(relative_path, "/", -1)
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part: part != "")


def skip_names(names: Iterable[str]) -> list[str]:
    """Directory names to skip: trimmed, without blanks, each once, in order."""
    return list(dict.fromkeys(name.strip() for name in names if name.strip()))


def is_pruned(relative_path: Column, names: Iterable[str]) -> Column:
    """True if any directory above the file has one of the names to skip."""
    wanted = skip_names(names)
    if not wanted:
        return F.lit(False)
    return F.arrays_overlap(directories(relative_path), F.array(*map(F.lit, wanted)))


def pruned_at(relative_path: Column, names: Iterable[str]) -> Column:
    """Topmost directory to skip above the file, null if there is none."""
    wanted = skip_names(names)
    if not wanted:
        return F.lit(None).cast("string")
    parts = directories(relative_path)
    # array_position gives 0 for "absent"; array_min ignores the nulls made of those
    first = F.array_min(
        F.array(*[F.nullif(F.array_position(parts, n), F.lit(0).cast("long")) for n in wanted])
    ).cast("int")
    return F.when(first.isNotNull(), F.array_join(F.slice(parts, F.lit(1), first), "/"))

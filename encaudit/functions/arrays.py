"""Helpers for array columns: binding a value once, and running totals in a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    The optimizer may inline a projected column into every place that reads it,
    also into a lambda, where it would run once per element. A one-element
    ``transform`` keeps an expensive value computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination of a short, non-empty array."""
    rest = F.slice(items, F.lit(2), F.size(items))
    return F.aggregate(
        rest,
        F.slice(items, 1, 1),
        lambda done, item: F.concat(done, F.array(combine(F.element_at(done, -1), item))),
    )


# Appending to an array copies it, so arrays are only grown up to a block.
_LEVELS = 3
_SMALLEST_BLOCK = 16


def running(items: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination of ``items`` under an associative ``combine``.

    Works inside the row, so no shuffle, sort or window is needed. The array is
    cut into blocks, each block is scanned by itself, the block totals are
    scanned the same way, and each block is moved on by the total before it.
    With three levels a block holds the cube root of the array size: 100 elements
    for a million, so the cost stays close to linear.
    """

    def in_blocks(array: Column) -> Column:
        root = F.ceil(F.pow(F.size(array), F.lit(1 / _LEVELS))).cast("int")
        start = F.struct(array.alias("items"), F.greatest(root, F.lit(_SMALLEST_BLOCK)).alias("step"))
        return bind(start, lambda bound: _blocks(bound["items"], bound["step"], combine, _LEVELS))

    return bind(items, lambda array: F.when(F.size(array) <= 1, array).otherwise(in_blocks(array)))


def _blocks(
    items: Column, step: Column, combine: Callable[[Column, Column], Column], levels: int
) -> Column:
    if levels == 1:
        return _scan(items, combine)
    blocks = F.transform(
        F.sequence(F.lit(1), F.size(items), step),
        lambda start: _scan(F.slice(items, start, step), combine),
    )

    def joined(scanned: Column) -> Column:
        totals = F.transform(scanned, lambda block: F.element_at(block, -1))
        before = bind(totals, lambda last: _blocks(last, step, combine, levels - 1))
        rest = F.slice(scanned, F.lit(2), F.size(scanned))
        later = F.zip_with(
            rest,
            F.slice(before, F.lit(1), F.size(scanned) - 1),
            lambda block, total: F.transform(block, lambda item: combine(total, item)),
        )
        return F.flatten(F.concat(F.slice(scanned, 1, 1), later))

    return bind(
        blocks,
        lambda scanned: F.when(
            F.size(scanned) == 1, F.get(scanned, F.lit(0))
        ).otherwise(joined(scanned)),
    )

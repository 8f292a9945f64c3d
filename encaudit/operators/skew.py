"""A lookup join that stays balanced when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many is split; there are fewer such keys than this.
PARTS = 1_000


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: list[str],
    parts: int = PARTS,
) -> DataFrame:
    """Left join of many rows to a lookup with at most one row per key.

    The rows are counted per key first, with partial counts before the shuffle.
    A key with more than one ``parts``-th of all rows is split into salts of about
    that size: its rows spread by a hash of ``spread_by`` and its one lookup row is
    repeated per salt. There are fewer than ``parts`` such keys, however many rows,
    so the table of them can be sent to every task. ``rows`` is read three times:
    pass a settled or written DataFrame.
    """
    size = max(1, rows.count() // parts)
    salts = F.ceil(F.col("n_rows") / F.lit(size)).cast("int")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = counts.select(*keys, salts.alias("salts"))
    hot = F.broadcast(wanted.where(F.col("salts") > 1))
    repeated = (
        lookup.join(wanted, keys, "inner")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("salts")
    )
    salted = (
        rows.join(hot, keys, "left")
        .withColumn("salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("salts", F.lit(1))).cast("int"))
        .drop("salts")
    )
    return salted.join(repeated, [*keys, "salt"], "left").drop("salt")

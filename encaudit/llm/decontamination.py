"""Benchmark decontamination: a broadcast hash set of benchmark windows.

Words are lower-cased runs of letters and digits. Windows of ``n`` words of the
benchmark are hashed into a set that is sent to every task; the windows of each
document probe it, and a hit is verified by its words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaudit.session import settle

WINDOW = 13
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Beyond so many different benchmark windows the set is not broadcast.
MAX_BROADCAST_WINDOWS = 2_000_000


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` does that by itself on pure ASCII, and faster."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(lowered)


def words_of(text: Column) -> Column:
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1)
    return F.array_remove(parts, "")


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Each different window once: its hash, words, length and the items that have it."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    length = F.least(F.size("words"), F.lit(n))
    windows = words.select(
        "item_id",
        "words",
        length.alias("n"),
        F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"),
    ).select("item_id", "n", F.slice("words", F.col("at"), F.col("n")).alias("gram"))
    return (
        windows.select("item_id", "n", F.xxhash64("gram").alias("gram_hash"), F.array_join("gram", " ").alias("gram"))
        .groupBy("gram_hash", "gram", "n")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    max_broadcast_windows: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document (doc_id, text) with what it shares with ``benchmark`` (item_id, text).

    Returns doc_id, n_words, n_hit (words inside any occurrence of a benchmark
    window), items (sorted ids, as strings, of the items with occurring windows),
    spans (first word and end word, exclusive, of each occurrence), and text_hash.
    A window is ``n`` consecutive words of one item; an item with fewer words is
    one window.

    A null or empty text has no words and no hits. Items without words have no
    window; windows of items with a null id hit but are not listed. Rows of
    ``docs`` that repeat doc_id and text are one document; one doc_id with
    different texts gives a row each. Extra columns are not read. Empty tables:
    no documents give no rows, no benchmark gives no hits.

    The windows are counted first. Only ``max_broadcast_windows`` of them are
    broadcast at a time; a larger set is cut by hash, and each part probed in a pass
    of its own over the documents.
    """
    windows = benchmark_windows(benchmark, n)
    # One row: how many windows there are, and their at most n different lengths.
    facts = windows.agg(F.count(F.lit(1)).alias("windows"), F.collect_set("n").alias("lengths")).first()
    lengths = sorted(facts["lengths"]) or [n]
    passes = max(1, -(-facts["windows"] // max_broadcast_windows))
    words = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"),
        words_of(F.col("text")).alias("words"),
    )
    places = words.select(
        "doc_id",
        "text_hash",
        F.size("words").alias("n_words"),
        "words",
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("start"),
    )
    if len(lengths) == 1:
        probes = places.withColumn("length", F.lit(lengths[0]))
    else:
        probes = places.withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
    window = F.slice("words", F.col("start") + 1, F.col("length"))
    probes = probes.withColumn(
        "probe", F.when(F.col("start") + F.col("length") <= F.col("n_words"), F.xxhash64(window))
    )
    same = (F.col("probe") == F.col("gram_hash")) & (F.array_join(window, " ") == F.col("gram"))
    columns = ["doc_id", "text_hash", "n_words", "start", "length", "gram", "items"]

    def probed(part: int, how: str) -> DataFrame:
        held = windows.where(F.pmod("gram_hash", F.lit(passes)) == part) if passes > 1 else windows
        return probes.join(F.broadcast(held), same, how)

    # The first pass also brings one row of every document, whether it is hit or not.
    found = probed(0, "left").where((F.col("start") == 0) | F.col("gram").isNotNull()).select(columns)
    for part in range(1, passes):
        found = found.unionByName(settle(probed(part, "inner").select(columns)))
    span = F.when(F.col("gram").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("end")))
    return (
        found.groupBy("doc_id", "text_hash", "n_words")
        .agg(F.collect_set(span).alias("spans"), F.collect_set("items").alias("items"))
        .select(
            "doc_id",
            "text_hash",
            F.col("n_words").cast("long").alias("n_words"),
            _covered(F.col("spans")).alias("n_hit"),
            F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"),
            F.sort_array("spans").alias("spans"),
        )
    )


def _covered(spans: Column) -> Column:
    """How many words lie in any of the spans."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(state: Column, span: Column) -> Column:
        start = F.greatest(span["start"], state["end"])
        fresh = F.greatest(span["end"] - start, F.lit(0)).cast("long")
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["end"], span["end"]).alias("end"))

    return F.aggregate(F.sort_array(spans), empty, add)["n"]


def is_contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated.

    Null and empty texts have no words and stay, with a null doc_id too. Rows that
    repeat doc_id and text all stay or all go. Columns other than these two are kept as
    they are, whatever their names; an empty benchmark keeps every row.
    """
    bad = contamination(docs, benchmark).where(is_contaminated()).select(
        F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")
    )
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(
        bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (text_hash == bad["_bad_hash"]), "left_anti"
    )


ORACLE = r"""
WITH items AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark
), docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), grams AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n,
         array_to_string(words[i : i + least(len(words), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i
        FROM items WHERE len(words) > 0)
), probes AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM grams))
), hits AS (
  SELECT doc_id, i, p.n AS n, item_id FROM probes p JOIN grams g ON p.gram = g.gram AND p.n = g.n
), covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

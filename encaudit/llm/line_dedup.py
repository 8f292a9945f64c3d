"""Fuzzy repeated lines: MinHash over character shingles, banding, exact checks, union-find.

Every line gets a signature of minimum hashes over its character shingles, cut into
bands; similar lines agree on a band with high probability. Lines that agree on a
band form a bucket. Buckets with the same members in several bands are looked at
once; there the exact Jaccard similarity of shingle sets decides, and a bucket
returns at most one link per member and block. Of each component of links the
first line, by document and place, stays.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaudit.llm.bitmap import bitmap, may_hold
from encaudit.llm.components import components
from encaudit.session import settle

SHINGLE = 8
SIMILARITY = 0.8
#: With 14 bands of 5 rows, lines of similarity 0.8 meet with probability 0.996.
BANDS, ROWS = 14, 5
SEED = 42
#: Lines of a larger bucket are compared block by block.
MAX_BUCKET = 256
#: Characters hashed at a time.
SLICE = 1 << 19
#: Pairs of key and line that a bucket has on average at most, and that a task packs at a time.
BUCKET_KEYS, PACKED_KEYS = 1 << 20, 1 << 19
#: Ids of lines that a task remembers, so as not to repeat their bands.
SEEN = 1 << 20

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def line_id(line: str) -> int:
    """XXH64 of a line, as a signed long."""
    value = xxhash.xxh64_intdigest(line.encode(), SEED)
    return value - (1 << 64) if value >> 63 else value


def _shingle_hashes(text: str) -> np.ndarray:
    """32-bit hashes of the shingles at all places of a text, by doubling their length."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    factor, width = _BASE, 1
    while width < SHINGLE:
        points = points[:-width] * factor + points[width:]
        factor, width = factor * factor, 2 * width
    points ^= points >> np.uint64(33)
    points *= _MIX
    return (points >> np.uint64(32)).astype(np.uint32)


def signatures(lines: list[str]) -> np.ndarray:
    """One row of minimum hashes per line. Lines shorter than a shingle are one shingle."""
    pieces = []
    for line in lines:
        cuts = range(0, max(1, len(line) - SHINGLE + 1), SLICE)
        pieces.append([line[at : at + SLICE + SHINGLE - 1].ljust(SHINGLE, "\0") for at in cuts])
    flat = list(itertools.chain.from_iterable(pieces))
    with np.errstate(over="ignore"):
        found = np.concatenate([_minima(part) for part in _packed(flat)])
    firsts = np.cumsum([0, *map(len, pieces)])[:-1]
    return found if len(flat) == len(lines) else np.minimum.reduceat(found, firsts, axis=0)


def _packed(pieces: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _minima(pieces: list[str]) -> np.ndarray:
    hashes = _shingle_hashes("".join(pieces) + "\0")
    starts = np.cumsum([0, *map(len, pieces)])[:-1]
    ends = starts + np.array([len(piece) for piece in pieces]) - SHINGLE + 1
    bounds = np.stack([starts, ends], axis=1).reshape(-1)
    found = np.empty((len(pieces), BANDS * ROWS), np.uint32)
    for k, factor in enumerate(_FACTORS):
        found[:, k] = np.minimum.reduceat(hashes * factor, bounds)[::2]
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per line and band: the number of the band above 48 bits of a hash of its rows."""
    rows = found.reshape(len(found), BANDS, ROWS).astype(np.uint64)
    keys = np.zeros((len(found), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = (keys ^ rows[:, :, k]) * _MIX
            keys ^= keys >> np.uint64(29)
    return (keys >> np.uint64(16) | np.arange(BANDS, dtype=np.uint64) << np.uint64(48)).astype(np.int64)


def _numbered(text: str | None) -> list[tuple[int, str]]:
    return [(k, line) for k, line in enumerate((text or "").split("\n")) if not line.isspace() and line]


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line; only the first of equal lines of a task carries its bands."""
    seen: set[int] = set()
    names = ["doc_id", "text_hash", "line_no", "line_id", "bands"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            docs, numbers, ids, fresh, lines = [], [], [], [], []
            for k, text in enumerate(part.column(2)):
                for number, line in _numbered(text.as_py()) or [(-1, None)]:
                    one = None if line is None else line_id(line)
                    docs.append(k)
                    numbers.append(number)
                    ids.append(one)
                    fresh.append(one is not None and one not in seen)
                    if fresh[-1]:
                        seen.add(one)
                        lines.append(line)
            if len(seen) > SEEN:
                seen.clear()
            keys = band_keys(signatures(lines)).reshape(-1) if lines else np.zeros(0, np.int64)
            ends = np.cumsum([0, *fresh]) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))
            columns = [part.column(0).take(pa.array(docs)), part.column(1).take(pa.array(docs))]
            columns += [pa.array(numbers, pa.int32()), pa.array(ids, pa.int64()), bands]
            yield pa.RecordBatch.from_arrays(columns, names)


def _hash_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _hash_of(F.col("text")).alias("text_hash"), "text").mapInArrow(
        _line_rows, f"doc_id {kind}, text_hash long, line_no int, line_id long, bands array<long>"
    )


def _shared_keys(lines: DataFrame) -> DataFrame:
    """key and line_id, each pair once, of the keys that several different lines have.

    The pairs go to buckets of keys as packed arrays, and a task sorts one bucket at a time.
    """
    banded = lines.where(F.size("bands") > 0).select("line_id", "bands")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-banded.count() * BANDS // BUCKET_KEYS))

    def packed(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        flat, of = np.concatenate(keys), np.concatenate(ids)
        with np.errstate(over="ignore"):
            bucket = ((flat.view(np.uint64) * _BASE >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = pa.py_buffer((np.r_[starts, len(bucket)] * 8).astype(np.int32).tobytes())
        held = [pa.py_buffer(values[order].tobytes()) for values in (flat, of)]
        columns = [pa.array(bucket[starts])]
        columns += [pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, one]) for one in held]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "ids"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, size = [], [], 0
        for batch in batches:
            keys.append(batch.column(1).flatten().to_numpy())
            ids.append(np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()))
            size += len(keys[-1])
            if size >= PACKED_KEYS:
                yield packed(keys, ids)
                keys, ids, size = [], [], 0
        if size:
            yield packed(keys, ids)

    def of_several(keys: list[bytes], ids: list[bytes]) -> pa.RecordBatch:
        flat, of = (np.frombuffer(b"".join(parts), np.int64) for parts in (keys, ids))
        order = np.argsort(flat)
        flat, of = flat[order], of[order]
        same = np.r_[False, flat[1:] == flat[:-1], False]
        often = np.flatnonzero(same[1:] | same[:-1])
        flat, of = flat[often], of[often]
        order = np.lexsort((of, flat))
        flat, of = flat[order], of[order]
        once = np.ones(len(flat), bool)
        once[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
        flat, of = flat[once], of[once]
        same = np.r_[False, flat[1:] == flat[:-1], False]
        several = (same[1:] | same[:-1])[: len(flat)]
        return pa.RecordBatch.from_arrays([pa.array(flat[several]), pa.array(of[several])], ["key", "line_id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, ids = None, [], []
        for batch in batches:
            for at in range(batch.num_rows):
                bucket, some_keys, some_ids = (column[at].as_py() for column in batch.columns)
                if bucket != held:
                    if keys:
                        yield of_several(keys, ids)
                    held, keys, ids = bucket, [], []
                keys.append(some_keys)
                ids.append(some_ids)
        if keys:
            yield of_several(keys, ids)

    return (
        banded.mapInArrow(dealt, "bucket int, keys binary, ids binary")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(meet, "key long, line_id long")
    )


def _crowded(lines: DataFrame, max_bucket: int) -> DataFrame:
    """key and line_id of buckets with several members, split into blocks of at most two parts."""
    members = settle(_shared_keys(lines))
    ends = [F.min("line_id").alias("least"), F.max("line_id").alias("most")]
    sums = [F.sum(F.hash("line_id", F.lit(k)).cast("long")).alias(f"sum_{k}") for k in range(2)]
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *ends, *sums).where("n > 1")
    alike = buckets.groupBy("n", "least", "most", "sum_0", "sum_1")
    wanted = alike.agg(F.min("key").alias("key")).select("key", "n")
    parts = F.ceil(F.col("n") / max_bucket).cast("int")
    part = F.pmod(F.xxhash64("line_id"), F.col("parts")).cast("int")
    return (
        members.join(wanted, "key")
        .withColumn("parts", parts)
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "line_id")
    )


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """line_id and line for at least the wanted ids."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "line_id"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                lines = [line for text in batch.column(0).slice(at, 256) for _, line in _numbered(text.as_py())]
                ids = np.array([line_id(line) for line in lines], np.int64)
                held = np.flatnonzero(may_hold(sent.value, ids)) if lines else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[held]), pa.array([lines[k] for k in held], pa.string())], ["line_id", "line"]
                )

    rows = docs.select("text").mapInArrow(found, "line_id long, line string")
    return rows.groupBy("line_id").agg(F.min("line").alias("line"))


def _shingles(line: str) -> set[str]:
    return {line[k : k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1))}


def _numbers(line: str) -> np.ndarray | None:
    """The shingles of a line as sorted numbers, if its characters are bytes and eight of them a number."""
    if len(line) < SHINGLE or (not line.isascii() and max(line) > "\xff"):
        return None
    data = line.encode("latin-1")
    found = np.ndarray(len(data) - SHINGLE + 1, np.uint64, data, strides=(1,)).copy()
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def similar(lines: list[str], similarity: float) -> Iterator[tuple[int, int]]:
    """Places of lines that join two groups of similar lines, until none are left apart."""
    numbers = [_numbers(line) for line in lines]
    sets = {k: _shingles(line) for k, line in enumerate(lines) if numbers[k] is None}
    sizes = [len(sets[k]) if one is None else len(one) for k, one in enumerate(numbers)]

    def shared(j: int, k: int) -> int:
        if numbers[j] is not None and numbers[k] is not None:
            both = np.concatenate([numbers[j], numbers[k]])
            both.sort()
            return int(np.count_nonzero(both[1:] == both[:-1]))
        for place in (j, k):
            if place not in sets:
                sets[place] = _shingles(lines[place])
        return len(sets[j] & sets[k])

    group = list(range(len(lines)))
    members = [[k] for k in group]
    for k in range(len(lines)):
        for j in range(k):
            if group[j] == group[k] or min(sizes[j], sizes[k]) < similarity * max(sizes[j], sizes[k]):
                continue
            both = shared(j, k)
            if both >= similarity * (sizes[j] + sizes[k] - both):
                yield j, k
                keep, gone = sorted((group[j], group[k]), key=lambda g: -len(members[g]))
                for moved in members[gone]:
                    group[moved] = keep
                members[keep] += members[gone]
                members[gone] = []


def similar_lines(docs: DataFrame, lines: DataFrame, similarity: float, max_bucket: int) -> DataFrame:
    """Links (a, b) between ids of similar lines."""
    members = settle(_crowded(lines, max_bucket))
    rows = (
        members.join(_texts(docs, members), "line_id")
        .select("key", "low", "high", "line_id", "line")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "line_id")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for _, bucket in itertools.groupby(rows, key=lambda row: row[:3]):
            ids, texts = zip(*((row[3], row[4]) for row in bucket))
            pairs = [(ids[k], ids[j]) for j, k in similar(texts, similarity)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*pairs)], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per document (doc_id, text): its lines, and those that repeat an earlier line.

    Returns doc_id, text_hash, n_lines, n_removed, removed (places of the removed
    lines, from 0) and kept_in (for each of them the doc_id that holds the line that
    stays). Lines are similar when the Jaccard similarity of their shingle sets (8
    characters) is at least ``similarity``; of lines connected by similarity the one
    with the smallest doc_id and place stays.

    A line ends at a line feed. Blank lines are no lines here and always stay. Equal
    lines are found by a 64-bit hash; different lines with equal hashes count as one
    line. A null text is an empty text without lines. Null doc_ids come first in the
    order of documents. Rows that repeat doc_id and text are one document and give
    one row. Extra columns are not read. An empty table gives an empty result.
    """
    lines = settle(_lines(docs))
    roots = components(similar_lines(docs, lines, similarity, max_bucket))
    place = F.struct("doc_id", "line_no", "text_hash")
    known = lines.where(F.col("line_id").isNotNull())
    first = known.groupBy("line_id").agg(F.min(place).alias("first"))
    first = settle(
        first.join(roots, first["line_id"] == roots["node"], "left").select(
            "line_id", "first", F.coalesce("root", "line_id").alias("root")
        )
    )
    stays = first.groupBy("root").agg(F.min("first").alias("stays"))
    judged = lines.select("doc_id", "text_hash", "line_no", "line_id").join(
        first.join(stays, "root").select("line_id", "stays"), "line_id", "left"
    )
    gone = F.col("stays").isNotNull() & ~place.eqNullSafe(F.col("stays"))
    removed = F.collect_set(F.when(gone, F.struct("line_no", F.col("stays.doc_id").alias("kept_in"))))
    return (
        judged.groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.when(F.col("line_id").isNotNull(), F.col("line_no"))).alias("all"), removed.alias("gone"))
        .select(
            "doc_id",
            "text_hash",
            F.size("all").cast("long").alias("n_lines"),
            F.size("gone").cast("long").alias("n_removed"),
            F.sort_array("gone")["line_no"].alias("removed"),
            F.sort_array("gone")["kept_in"].alias("kept_in"),
        )
    )


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, all other columns as they are.

    A document that loses all its lines goes; one that had none stays. Rows that
    repeat doc_id and text come out once.
    """
    found = repeated_lines(docs, similarity).where("n_removed > 0").select(
        F.col("doc_id").alias("_line_doc"),
        F.col("text_hash").alias("_line_hash"),
        F.col("removed").alias("_line_gone"),
        (F.col("n_removed") == F.col("n_lines")).alias("_line_all"),
    )
    joined = docs.dropDuplicates(["doc_id", "text"]).join(
        found,
        docs["doc_id"].eqNullSafe(found["_line_doc"]) & (_hash_of(docs["text"]) == found["_line_hash"]),
        "left",
    )
    kept = joined.where(F.coalesce(~F.col("_line_all"), F.lit(True))).select(
        *(docs[c] for c in docs.columns), "_line_gone"
    )
    text_at = docs.columns.index("text")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, gone = batch.columns[:-1], batch.columns[-1]
            texts = [_without(*pair) for pair in zip(columns[text_at].to_pylist(), gone.to_pylist())]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return kept.mapInArrow(shorten, docs.schema)


def _without(text: str | None, gone: list[int] | None) -> str | None:
    if not gone:
        return text
    dropped = set(gone)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in dropped)

"""Repeated byte strings by column-wise construction of sorted suffixes and common prefixes.

A string of ``length`` bytes that occurs twice holds the same anchor at the same
place: the ``ANCHOR``-byte string with the smallest hash in it. Only anchors that
occur more than once can belong to repeated strings, so only their surroundings
are compared: segments that hold every ``length``-byte string around an anchor.

The segments of one anchor form a collection of short texts of equal alignment.
From the last column to the first, one symbol of every segment is put in front of
its suffix: a stable sort by that symbol gives the new order of the suffixes, and
the places where neighbours differ first follow from the minimum over the
neighbours that came between them. Neighbours that differ only ``length`` columns
on hold the same string there. The state is a few arrays of one entry per segment
of some bounded groups, so no external files are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaudit.llm.bitmap import bitmap, may_hold
from encaudit.session import settle

LENGTH = 100
ANCHOR = 32
#: Segments of an anchor that occurs more often are compared in salted groups first.
MAX_GROUP = 50_000
#: Segments of whole groups that a task sorts together; fewer of them have numbers of 16 bits.
CHUNK = 60_000
#: Bytes in which anchors are looked for at a time.
SLICE = 1 << 18
#: Bytes of texts that are cut into segments together; a longer text is cut alone.
TEXTS = 1 << 21
#: Each class of hot anchors occurs so many times as often as the one before, and has as many times its salts.
CLASS = 4
END = 256

#: Bits of the bitmap of each class of hot anchors.
HOT_BITS = 1 << 23

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A segment: place of its anchor in the text, bounds of the key around that, bytes before it, and its bytes.
_SEGMENT = "place long, low int, high int, before int, segment binary"
_NAMES = ["place", "low", "high", "before", "segment"]


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the strings of ``ANCHOR`` bytes at all places, by doubling their length."""
    with np.errstate(over="ignore"):
        values, factor, width = data.astype(np.uint64) + np.uint64(1), _BASE, 1
        while width < ANCHOR:
            values = values[:-width] * factor + values[width:]
            factor, width = factor * factor, 2 * width
        values ^= values >> np.uint64(33)
        values *= _MIX
    return values ^ values >> np.uint64(29)


def _sliding(values: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """``best`` over every ``width`` values in a row."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, worst, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = best.accumulate(grid, axis=1).reshape(-1)
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = len(values) - width + 1
    return best(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of ``length`` bytes in some bytes."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    width = length - ANCHOR + 1
    for at in range(0, len(data) - length + 1, SLICE):
        values = _hashes(data[at : at + SLICE + length - 1])
        least = _sliding(values, width, np.minimum, np.iinfo(np.uint64).max)
        # A value is the smallest of some string around it if the largest of their minima is the value.
        around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(_sliding(around, width, np.maximum, 0) == values)
        places.append(chosen + at)
        hashes.append(values[chosen])
    found, first = np.unique(np.concatenate(places), return_index=True)
    return found, np.concatenate(hashes)[first]


def _anchored(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, their bounds, and text, place and hash of every anchor inside a text."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    places, hashes = anchors(data, length)
    text = np.searchsorted(bounds, places, side="right") - 1
    inside = (places + ANCHOR <= bounds[text + 1]) & (bounds[text + 1] - bounds[text] >= length)
    return data, bounds, text[inside], places[inside], hashes[inside]


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``TEXTS`` bytes of texts at a time."""
    sizes = np.asarray(pc.binary_length(batch.column(2)), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // TEXTS
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if last > first:
            yield batch.slice(first, last - first)


def _repeated_anchors(texts: DataFrame, length: int) -> DataFrame:
    """hash and n of anchors that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _texts(batch):
                *_, hashes = _anchored(part.column(2), length)
                values, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["hash", "n"])

    counted = texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return settle(counted.where("n > 1"))


def _hot_classes(repeated: DataFrame, max_group: int) -> list[np.ndarray]:
    """Bitmaps of the anchors that occur more than ``max_group`` times, ``CLASS`` times that, and so on."""
    most = repeated.agg(F.max("n")).first()[0] or 0
    limits = []
    while most > max_group * CLASS ** len(limits):
        limits.append(max_group * CLASS ** len(limits))
    return [bitmap(repeated.where(F.col("n") > limit), "hash", HOT_BITS) for limit in limits]


def _segments(texts: DataFrame, repeated: np.ndarray, hot: list[np.ndarray], length: int) -> DataFrame:
    """What lies around every anchor that may be repeated, as (doc_id, text_hash, hash, salt, ...)."""
    context = texts.sparkSession.sparkContext
    sent, sent_hot = context.broadcast(repeated), context.broadcast(hot)
    reach = length - ANCHOR

    def salt(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
        salts = np.zeros(len(hashes), np.int64)
        for number, held in enumerate(sent_hot.value):
            salts[may_hold(held, hashes)] = CLASS ** (number + 1)
        return np.where(salts > 0, (places * 0x9E3779B1 >> 7) % np.maximum(salts, 1), -1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _texts(batch):
                data, bounds, text, places, hashes = _anchored(part.column(2), length)
                keep = may_hold(sent.value, hashes.view(np.int64))
                text, places, hashes = text[keep], places[keep], hashes[keep].view(np.int64)
                first = np.maximum(places - reach, bounds[text])
                last = np.minimum(places + length, bounds[text + 1])
                held = data.tobytes()
                cuts = pa.array([held[a:b] for a, b in zip(first.tolist(), last.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(text)),
                        part.column(1).take(pa.array(text)),
                        pa.array(hashes),
                        pa.array(salt(hashes, places), pa.int64()),
                        pa.array(places - bounds[text], pa.int64()),
                        pa.array(np.zeros(len(text)), pa.int32()),
                        pa.array(np.full(len(text), ANCHOR), pa.int32()),
                        pa.array(places - first, pa.int32()),
                        cuts,
                    ],
                    ["doc_id", "text_hash", "hash", "salt", *_NAMES],
                )

    return texts.mapInArrow(cut, f"doc_id long, text_hash long, hash long, salt long, {_SEGMENT}")


def _stable(group: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Stable order by group, then symbol; numbers of 16 bits are sorted by counting."""
    first = np.argsort(symbols, kind="stable")
    return first[np.argsort(group[first], kind="stable")]


def repeats(
    group: np.ndarray, rank: np.ndarray, before: np.ndarray, segments: pa.Array, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For aligned segments: first and last column where a string starts that another has earlier.

    ``group`` rises from 0 and tells which segments belong together, ``rank`` is
    their order in the corpus. Columns count from ``length - ANCHOR`` bytes before
    the anchor; both are -1 without such a string. The third array tells which
    segments hold a string that no earlier one of the group has.
    """
    reach, n = length - ANCHOR, len(group)
    width = reach + length
    segments = segments.cast(pa.large_binary())
    bounds = np.frombuffer(segments.buffers()[1], np.int64)[segments.offset : segments.offset + n + 1]
    flat = np.frombuffer(segments.buffers()[2], np.uint8)
    starts_at, lengths = bounds[:-1], np.diff(bounds)
    shift = reach - before
    opens, closes = shift, shift + lengths - length
    first, last = np.full(n, -1), np.full(n, -1)
    fresh = np.zeros(n, bool)
    order = np.arange(n)
    if n and int(group[-1]) < 1 << 16:
        group = group.astype(np.uint16)
    differ = np.full(n + 1, width)
    for at in range(width - 1, -1, -1):
        place = at - shift
        held = (place >= 0) & (place < lengths)
        symbol = np.full(n, END, np.uint16)
        symbol[held] = flat[starts_at[held] + place[held]]
        symbol = symbol[order]
        moved = _stable(group[order], symbol)
        order, symbol = order[moved], symbol[moved]
        owner = group[order]
        same = np.flatnonzero((owner[1:] == owner[:-1]) & (symbol[1:] == symbol[:-1]) & (symbol[1:] != END))
        between = np.stack([moved[same] + 1, moved[same + 1] + 1], axis=1).reshape(-1)
        after = np.full(n + 1, at)
        if len(same):
            after[same + 1] = np.minimum.reduceat(differ, between)[::2]
        differ = after
        if at <= reach:
            starts = np.flatnonzero(differ[:n] - at < length)
            earliest = np.repeat(np.minimum.reduceat(rank[order], starts), np.diff(np.r_[starts, n]))
            later = order[rank[order] != earliest]
            first[later] = at
            last[later] = np.maximum(last[later], at)
            here = (opens <= at) & (at <= closes)
            here[later] = False
            fresh |= here
    return first, last, fresh


def _compare(segments: DataFrame, length: int) -> DataFrame:
    """doc_id, text_hash, start, end of repeated parts; segments of salted groups that hold something new come along."""
    reach = length - ANCHOR
    names = ["doc_id", "text_hash", "start", "end", "hash", *_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches):
            docs, hashes, place = (np.asarray(rows.column(k).fill_null(-(1 << 63))) for k in (0, 1, 4))
            rank = _ranks(docs, hashes, place)
            before = np.asarray(rows.column(7)).astype(np.int64)
            first, last, fresh = repeats(group, rank, before, rows.column(8), length)
            salted = np.asarray(rows.column(3)) >= 0
            kept = np.flatnonzero((first >= 0) | (fresh & salted))
            part = rows.take(pa.array(kept))
            gone, again = pa.array(first[kept] >= 0), pa.array((fresh & salted)[kept])
            start, end = place + first - reach, place + last - reach + length
            columns = [part.column(0), part.column(1)]
            columns += [pc.if_else(gone, pa.array(side[kept]), None) for side in (start, end)]
            columns += [pc.if_else(again, part.column(k), None) for k in (2, 4, 5, 6, 7, 8)]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = segments.repartition("hash", "salt").sortWithinPartitions("hash", "salt")
    return rows.mapInArrow(run, f"doc_id long, text_hash long, start long, end long, hash long, {_SEGMENT}")


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Places of rows in the order of some columns, the first one leading; equal rows share theirs."""
    order = np.lexsort(columns[::-1])
    table = np.stack(columns)[:, order]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(np.r_[False, (table[:, 1:] != table[:, :-1]).any(axis=0)])
    return ranks


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of salted groups and groups with several members, some whole groups at a time, and their group numbers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(part.num_rows for part in held) >= CHUNK:
            rows = _one(held)
            keys = np.stack([np.asarray(rows.column(k)) for k in (2, 3)])
            cut = rows.num_rows - int((keys == keys[:, -1:]).all(axis=0).sum())
            if cut:
                yield from _several(rows.slice(0, cut))
                held = [rows.slice(cut)]
    if held:
        yield from _several(_one(held))


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]


def _several(rows: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    if not rows.num_rows:
        return
    keys = np.stack([np.asarray(rows.column(k)) for k in (2, 3)])
    begins = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]
    number = np.cumsum(begins) - 1
    many = (np.bincount(number)[number] > 1) | (keys[1] >= 0)
    if many.any():
        yield rows.take(pa.array(np.flatnonzero(many))), (np.cumsum(begins & many) - 1)[many]


def _extended(segments: DataFrame, core: int, length: int) -> tuple[DataFrame, int]:
    """Each segment under keys that hold more of it: so many bytes before, and after, what the key holds now.

    A string of ``length`` bytes around a core of ``core`` bytes has at least half
    of the others on one side, so one of the two longer cores is in it.
    """
    more = -(-(length - core) // 2)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, keys, lows, highs = [], [], [], []
            rows = zip(*(batch.column(name).to_pylist() for name in ("low", "high", "before", "segment")))
            for k, (low, high, before, segment) in enumerate(rows):
                for a, b in ((low - more, high), (low, high + more)):
                    if before + a >= 0 and before + b <= len(segment):
                        wider = segment[before + a : before + b]
                        keys.append(xxhash.xxh64_intdigest(wider, a & 0xFFFF) - (1 << 63))
                        index.append(k)
                        lows.append(a)
                        highs.append(b)
            part = batch.take(pa.array(index, pa.int64()))
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array(keys, pa.int64()), part.column("place")]
            columns += [pa.array(lows, pa.int32()), pa.array(highs, pa.int32())]
            columns += [part.column("before"), part.column("segment")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "hash", *_NAMES])

    kept = segments.select("doc_id", "text_hash", *_NAMES)
    return kept.mapInArrow(extend, f"doc_id long, text_hash long, hash long, {_SEGMENT}"), core + more


def repeated_parts(texts: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, text_hash, start, end: parts of texts (doc_id, text_hash, data) that consist of repeated strings."""
    repeated = _repeated_anchors(texts, length)
    segments = _segments(texts, bitmap(repeated, "hash"), _hot_classes(repeated, max_group), length)
    found = settle(_compare(segments, length))
    parts, core = [found], ANCHOR
    left = found.where("segment is not null")
    while core < length and not left.isEmpty():
        wider, core = _extended(left, core, length)
        wider = settle(wider)
        crowded = settle(wider.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group))
        # In the end all strings of a group are equal and at most one per salt is left of it.
        salts = F.ceil(F.col("n") / max_group)
        spread = F.pmod(F.xxhash64("doc_id", "place"), salts) if core < length else F.lit(-1)
        keyed = wider.join(crowded, "hash", "left").withColumn(
            "salt", F.when(F.col("n").isNotNull(), spread).otherwise(F.lit(-1)).cast("long")
        )
        found = settle(_compare(keyed.select("doc_id", "text_hash", "hash", "salt", *_NAMES), length))
        parts.append(found)
        left = found.where("segment is not null")
    spans = ["doc_id", "text_hash", "start", "end"]
    every = parts[0].select(spans)
    for part in parts[1:]:
        every = every.unionByName(part.select(spans))
    return every.where("start is not null")


def without_repeats(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per document (doc_id, text): the bytes that stay, and the runs that were removed.

    Texts are UTF-8 bytes. A byte goes when it lies in a string of ``length`` bytes
    that also starts earlier: in a document with a smaller doc_id, or earlier in the
    same one. Strings are judged on the input. Returns doc_id, n_bytes, removed
    (start and end, exclusive, of the maximal removed runs) and kept.

    A null text is an empty text; texts shorter than ``length`` lose nothing. A null
    doc_id is smaller than any other; documents alike in doc_id are ordered by a hash
    of their texts. Rows that repeat doc_id and text are one document and give one
    row. Extra columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.cast("binary").alias("data"),
    )
    spans = (
        repeated_parts(texts, length, max_group)
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
        .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "spans")
    )
    joined = texts.dropDuplicates(["doc_id", "text_hash"]).join(
        spans, texts["doc_id"].eqNullSafe(spans["_doc"]) & (texts["text_hash"] == spans["_hash"]), "left"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged = _merged(spans or [])
                edges = [0, *(edge for run in merged for edge in (run["start"], run["end"])), len(data)]
                sizes.append(len(data))
                removed.append(merged)
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, runs), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "removed", "kept"])

    return joined.select("doc_id", "data", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    )


def _merged(spans: list[dict]) -> list[dict]:
    """Maximal runs of sorted spans that overlap or touch."""
    runs: list[dict] = []
    for span in spans:
        if runs and span["start"] <= runs[-1]["end"]:
            runs[-1]["end"] = max(runs[-1]["end"], span["end"])
        else:
            runs.append(dict(span))
    return runs


def report(docs: DataFrame) -> DataFrame:
    size = F.aggregate(
        "removed", F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["start"]
    )
    return without_repeats(docs).select(
        "doc_id",
        "n_bytes",
        size.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

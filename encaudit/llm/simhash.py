"""SimHash near-duplicates through a hierarchical index over Gray-ordered fingerprints.

Fingerprints that differ in at most ``d`` bits agree on one of ``d + 1`` blocks of
bits, so each is sent to ``d + 1`` buckets. A bucket sorts its fingerprints by Gray
rank, which puts similar ones side by side, and builds a tree over them: a node
keeps the bits its members share. Two nodes are compared on the bits both share
and their ancestors did not; as soon as the accumulated differences exceed ``d``,
all pairs below are dropped. Fingerprints linked in a bucket are joined there, so
a bucket returns at most one link per member.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaudit.llm.components import components
from encaudit.session import settle

BITS = 64
DISTANCE = 2
SHINGLE = 3
SEED = 42
FAN_OUT = 16
#: Buckets with more fingerprints are divided by further blocks of bits.
MAX_BUCKET = 8192
#: Rows of whole buckets that a task looks at together.
CHUNK = 65_536
#: Node pairs that a task holds at once while it descends.
MAX_PAIRS = 1 << 20


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, as a signed long. Zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *itertools.accumulate(len(word) + 1 for word in words)]
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        hashes = digest(joined, SEED)
    else:
        hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), CHUNK):
        ones += np.unpackbits(rows[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprints, f"doc_id {kind}, fingerprint long"
    )


def _gray_rank(code: Column) -> Column:
    """Place of a code in Gray order: each bit is the parity of it and all higher ones."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _blocks(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` blocks of the bits it lacks."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << bit for bit in free[a:b]) for a, b in itertools.pairwise(cuts)]


def _bucketed(prints: DataFrame, distance: int, max_bucket: int) -> DataFrame:
    """fingerprint, mask and key of every bucket, none with more than ``max_bucket`` rows.

    Fingerprints of one bucket are all different and agree on the mask, so a
    bucket whose mask leaves few bits is small, and dividing ends.
    """
    masks = _blocks(0, distance + 1)
    rows = _with_masks(prints.select("fingerprint"), masks)
    done = []
    while True:
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
        hot = settle(sizes.where(F.col("n") > max_bucket).select("mask", "key"))
        masks = [m for m in masks if 1 << (BITS - m.bit_count()) > max_bucket]
        if not masks or hot.isEmpty():
            return _union([*done, rows])
        done.append(rows.join(hot, ["mask", "key"], "left_anti"))
        crowded = rows.join(hot, ["mask", "key"], "left_semi")
        finer = {mask: _blocks(mask, distance + 1) for mask in masks}
        rows = settle(
            _union(
                [
                    _with_masks(crowded.where(F.col("mask") == _signed(mask)).select("fingerprint"), below)
                    for mask, below in finer.items()
                ]
            )
        )
        masks = [one for below in finer.values() for one in below]


def _with_masks(prints: DataFrame, masks: list[int]) -> DataFrame:
    every = F.explode(F.array(*(F.lit(_signed(mask)).cast("long") for mask in masks)))
    rows = prints.select("fingerprint", every.alias("mask"))
    return rows.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask")))


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = (frame.select("mask", "key", "fingerprint") for frame in frames)
    for frame in rest:
        first = first.unionByName(frame)
    return first


def near_links(prints: DataFrame, distance: int = DISTANCE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints whose components are those of all close pairs."""
    rows = (
        _bucketed(prints, distance, max_bucket)
        .withColumn("gray", _gray_rank(F.col("fingerprint")))
        .repartition("mask", "key")
        .sortWithinPartitions("mask", "key", "gray")
        .drop("gray")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, sizes in _whole_buckets(batches):
            a, b = linked(codes, sizes, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.mapInArrow(search, "a long, b long")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and bucket sizes of some buckets at a time, from rows sorted by bucket."""
    held = np.zeros((3, 0), np.int64)
    for batch in batches:
        new = np.stack([np.asarray(batch.column(k)) for k in range(3)])
        held = np.concatenate([held, new], axis=1)
        if held.shape[1] >= CHUNK:
            same = (held[:2] == held[:2, -1:]).all(axis=0)
            cut = held.shape[1] - int(same.sum())
            if cut:
                yield _measured(held[:, :cut])
                held = held[:, cut:]
    if held.shape[1]:
        yield _measured(held)


def _measured(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
    return rows[2].view(np.uint64), np.diff(np.r_[starts, rows.shape[1]])


def linked(codes: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (code, first code of its group) of all codes that are linked inside their bucket."""
    labels = np.arange(len(codes))
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes <= FAN_OUT
    for gap in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero((bucket[gap:] == bucket[:-gap]) & small[bucket[gap:]])
        i = i[np.bitwise_count(codes[i] ^ codes[i + gap]) <= distance]
        _join(labels, i, i + gap)
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(~small):
        start = ends[k] - sizes[k]
        for i, j in _descend(codes[start : ends[k]], distance):
            _join(labels, i + start, j + start)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return codes[moved], codes[labels[moved]]


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give all linked places the smallest place they reach."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != (up := labels[labels])).any():
            labels[:] = up


def _descend(codes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places with close codes, by descending the tree over one bucket."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(codes, np.full(len(codes), full))]
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), FAN_OUT)
        ones = np.bitwise_and.reduceat(pattern & mask, starts)
        zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
        levels.append((ones, ones | zeros))
    top = np.zeros(1, np.int64)
    frontier = [(len(levels) - 1, top, top, np.zeros(1, np.int64), np.zeros(1, np.uint64))]
    while frontier:
        level, i, j, apart, seen = frontier.pop()
        pattern, mask = levels[level - 1]
        step = max(1, MAX_PAIRS // FAN_OUT**2)
        for at in range(0, len(i), step):
            cut = slice(at, at + step)
            left = (i[cut, None] * FAN_OUT + np.arange(FAN_OUT))[:, :, None]
            right = (j[cut, None] * FAN_OUT + np.arange(FAN_OUT))[:, None, :]
            whole = np.broadcast_arrays(left, right, apart[cut, None, None], seen[cut, None, None])
            ok = (right < len(pattern)) & ((left < right) if level == 1 else (left <= right))
            a, b, apart_, seen_ = (part[ok] for part in whole)
            both = mask[a] & mask[b]
            apart_ = apart_ + np.bitwise_count((pattern[a] ^ pattern[b]) & both & ~seen_)
            near = apart_ <= distance
            if level == 1:
                yield a[near], b[near]
            elif near.any():
                frontier.append((level - 1, a[near], b[near], apart_[near], both[near]))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    Fingerprints (64 bits over shingles of three words, as hex digits) link at
    ``distance`` or fewer differing bits; component_id is the smallest doc_id
    reachable over links, the row's own included.

    A null text is an empty text; texts without words have fingerprint zero and
    are linked like any other. A null doc_id takes part and is no component_id,
    unless all of a component are null. Repeated rows give a row each. Extra
    columns are not read. An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    roots = components(near_links(distinct, distance, max_bucket))
    member = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    member = settle(member)
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = member.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id names its component; equal rows once."""
    found = near_duplicates(docs, distance)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id"))
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_kept_id"]), "left_semi").dropDuplicates(
        ["doc_id", "text"]
    )

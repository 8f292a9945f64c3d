"""Hard negatives of anchor vectors by a secondary sort of packed pair scores.

Anchors are scored against all rows, in blocks: a task holds a group of row blocks
and multiplies every block of anchors with it. What it sends on is bounded per
anchor and group: first its best rows of the same label, then, once the anchor's
positives are known, the best rows of other labels in each positive's window.

The pairs that are left get keys of packed bytes, (anchor, descending score, kind,
id), are dealt by anchor and sorted by key within partitions. An iterator reads
each partition once: a positive opens its window of scores, a negative is given to
every open window that it lies in, and a window is closed when it is full or passed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaudit.session import settle

#: Bytes of the vectors in a block of rows, and of the blocks that a task holds.
BLOCK_BYTES, GROUP_BYTES = 1 << 20, 64 << 20
#: Anchors, and rows, that are multiplied at a time.
ANCHORS, ROWS = 256, 8192
#: No score; all others lie above it.
NONE = -(1 << 63)
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)

_BLOCK = "width int, ids binary, labels binary, doubles boolean, vectors binary"
_NAMES = ["width", "ids", "labels", "doubles", "vectors"]
_PAIR = "anchor long, id long, score long"
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)


def packed(rows: DataFrame, scale: float = 1.0, extra: str | None = None) -> DataFrame:
    """Blocks of the rows (id, label, vector) that take part; components become floor(scale * x).

    Left out are rows with a null in any of the three, or with a component that is
    null or not finite (after scaling, as a double). Vectors of one length share a
    block. ``extra`` names an array column of longs that is packed as well.
    """
    names = ["id", "label", "vector", *([extra] if extra else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(
                pa.array(np.logical_and.reduce([batch.column(k).is_valid().to_numpy(False) for k in range(3)]))
            )
            column = whole.column(2)
            lengths = np.asarray(column.value_lengths().cast(pa.int64()))
            values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
            with np.errstate(all="ignore"):
                values = np.floor(values * scale)
            starts = np.cumsum(lengths) - lengths
            good = np.add.accumulate(np.r_[0, np.isfinite(values)])
            kept = good[starts + lengths] - good[starts] == lengths
            for width in np.unique(lengths[kept]).tolist():
                mine = np.flatnonzero(kept & (lengths == width))
                step = max(1, BLOCK_BYTES // (8 * max(1, width)))
                for at in range(0, len(mine), step):
                    some = mine[at : at + step]
                    matrix = values[(starts[some, None] + np.arange(width)).reshape(-1)]
                    doubles = bool(len(matrix) and np.abs(matrix).max() >= 1 << 24)
                    held = [
                        pa.array([width], pa.int32()),
                        *(pa.array([np.asarray(whole.column(k))[some].astype(np.int64).tobytes()]) for k in (0, 1)),
                        pa.array([doubles]),
                        pa.array([matrix.astype(np.float64 if doubles else np.float32).tobytes()], pa.binary()),
                    ]
                    if extra:
                        lists = whole.column(3).take(pa.array(some)).to_pylist()
                        most = max(map(len, lists), default=0)
                        table = np.array([one + [NONE] * (most - len(one)) for one in lists], np.int64)
                        held.append(pa.array([table.tobytes()], pa.binary()))
                    yield pa.RecordBatch.from_arrays(held, [*_NAMES, *(["extra"] if extra else [])])

    return rows.select(*names).mapInArrow(run, _BLOCK + (", extra binary" if extra else ""))


class Block:
    """Ids, labels and vectors of some rows, in the order of label and id."""

    def __init__(self, blocks: list[dict]) -> None:
        width = blocks[0]["width"]
        self.ids, self.labels = (np.concatenate([np.frombuffer(b[name], np.int64) for b in blocks]) for name in ("ids", "labels"))
        kinds = [np.float64 if b["doubles"] else np.float32 for b in blocks]
        parts = [np.frombuffer(b["vectors"], kind) for b, kind in zip(blocks, kinds)]
        self.vectors = np.concatenate(parts).reshape(len(self.ids), width)
        order = np.lexsort([self.ids, self.labels])
        self.ids, self.labels, self.vectors = self.ids[order], self.labels[order], self.vectors[order]
        self.most = float(np.abs(self.vectors).max()) if self.vectors.size else 0.0
        table = [np.frombuffer(b["extra"], np.int64).reshape(-1, len(b["extra"]) // len(b["ids"])) for b in blocks if b.get("extra")]
        self.extra = table[0][order] if table else None

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(int(np.searchsorted(self.labels, label, side)) for side in ("left", "right"))


def products(one: np.ndarray, other: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products; beyond 53 bits by whole numbers, held at the ends of a long."""
    if most < EXACT:
        return (one.astype(np.float64) @ other.astype(np.float64).T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in one], object).reshape(one.shape)
    exact = exact @ np.array([[int(x) for x in row] for row in other], object).reshape(other.shape).T
    return np.array([[max(NONE + 1, min(-NONE - 1, score)) for score in row] for row in exact], np.int64)


def leading(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``count`` highest scores of every row, of equal ones those of the first columns."""
    if scores.shape[1] > count:
        least = np.partition(scores, scores.shape[1] - count, axis=1)[:, -count]
    else:
        least = np.full(len(scores), NONE + 1, np.int64)
    row, column = np.nonzero((scores >= least[:, None]) & (scores > NONE))
    order = np.lexsort([column, -scores[row, column], row])
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < count], column[rank < count]


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], count: int) -> tuple[np.ndarray, ...]:
    """Of (anchor place, id, score) those with the ``count`` highest scores of each anchor, ties by smaller id."""
    place, ids, scores = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort([ids, -scores, place])
    place, ids, scores = place[order], ids[order], scores[order]
    rank = np.arange(len(place)) - np.searchsorted(place, place)
    return place[rank < count], ids[rank < count], scores[rank < count]


def _pairs(blocks: DataFrame, anchors: DataFrame, groups: int, pair: Callable) -> DataFrame:
    """``pair(anchors, rows)`` for every block of anchors and every group of row blocks of the same width."""
    number = F.pmod(F.xxhash64("ids", "labels", "vectors"), F.lit(groups)).cast("int")
    nothing = F.lit(None).cast("binary").alias("extra")
    of_rows = blocks.select(*_NAMES, nothing, F.lit(0).alias("kind"), number.alias("number"))
    extra = F.col("extra") if "extra" in anchors.columns else nothing
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("number")
    of_anchors = anchors.select(*_NAMES, extra, F.lit(1).alias("kind"), every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows = None, [], None
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1).to_pylist()[0]
                if (block["width"], block["number"]) != key:
                    key, held, rows = (block["width"], block["number"]), [], None
                if block["kind"] == 0:
                    held.append(block)
                    continue
                if held:
                    rows, held = Block(held), []
                if rows is not None:
                    mine = Block([block])
                    place, ids, scores = pair(mine, rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mine.ids[place]), pa.array(ids), pa.array(scores)], ["anchor", "id", "score"]
                    )

    dealt = of_rows.unionByName(of_anchors).repartitionById(groups, "number")
    return dealt.sortWithinPartitions("width", "number", "kind").mapInArrow(run, _PAIR)


_NOBODY = tuple(np.zeros(0, np.int64) for _ in range(3))


def _same_label(count: int) -> Callable:
    """The best rows of an anchor's own label, other than those with its id."""

    def pair(anchors: Block, rows: Block) -> tuple[np.ndarray, ...]:
        found = [_NOBODY]
        most = max(anchors.vectors.shape[1], 1) * anchors.most * rows.most
        for label in np.unique(anchors.labels).tolist():
            (a, b), (first, last) = anchors.of_label(label), rows.of_label(label)
            for at in range(first, last, ROWS):
                end = min(at + ROWS, last)
                scores = products(anchors.vectors[a:b], rows.vectors[at:end], most)
                scores[anchors.ids[a:b, None] == rows.ids[None, at:end]] = NONE
                row, column = leading(scores, count)
                found.append((a + row, rows.ids[at + column], scores[row, column]))
        return _best(found, count)

    return pair


def _windows(positives: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and highest score in the window of each positive score, without leaving 64 bits."""
    hundreds, rest = positives // 100, positives % 100
    return hundreds * low - (-rest * low) // 100, hundreds * high + (rest * high) // 100


def _other_labels(count: int, low: int, high: int) -> Callable:
    """The best rows of other labels in each window of an anchor."""

    def pair(anchors: Block, rows: Block) -> tuple[np.ndarray, ...]:
        most = max(anchors.vectors.shape[1], 1) * anchors.most * rows.most
        slots = anchors.extra.shape[1]
        found = [[_NOBODY] for _ in range(slots)]
        least, highest = _windows(np.maximum(anchors.extra, 0), low, high)
        closed = anchors.extra < 0
        for at in range(0, len(rows.ids), ROWS):
            end = min(at + ROWS, len(rows.ids))
            scores = products(anchors.vectors, rows.vectors[at:end], most)
            scores[anchors.labels[:, None] == rows.labels[None, at:end]] = NONE
            # Columns follow the ids, so that of equal scores the smaller ids come first.
            order = np.argsort(rows.ids[at:end], kind="stable")
            scores, ids = scores[:, order], rows.ids[at:end][order]
            for slot in range(slots):
                inside = (scores >= least[:, slot, None]) & (scores <= highest[:, slot, None]) & (scores > NONE)
                inside &= ~closed[:, slot, None]
                row, column = leading(np.where(inside, scores, NONE), count)
                found[slot].append((row, ids[column], scores[row, column]))
        best = [_best(one, count) for one in found]
        place, ids, scores = (np.concatenate(part) for part in zip(*best)) if best else _NOBODY
        # A row may lie in several windows; it is sent as often as it is in one of them at most.
        order = np.lexsort([ids, scores, place])
        place, ids, scores = place[order], ids[order], scores[order]
        window = np.repeat(np.arange(len(best)), [len(one[0]) for one in best])[order] if best else place
        table = np.stack([place, ids, scores, window])
        begins = np.r_[True, (table[:, 1:] != table[:, :-1]).any(axis=0)][: len(place)]
        starts = np.flatnonzero(begins)
        times = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
        first = np.lexsort([window, times, ids, scores, place])
        same = np.stack([place, ids, scores, times])[:, first]
        kept = first[np.r_[True, (same[:, 1:] != same[:, :-1]).any(axis=0)][: len(place)]]
        return place[kept], ids[kept], scores[kept]

    return pair


def _keyed(pairs: DataFrame, kind: int) -> DataFrame:
    """anchor and the packed key of each pair: (anchor, descending score, kind, id), in the order of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, ids, scores = (np.asarray(batch.column(k)).view(np.uint64) for k in range(3))
            keys = np.zeros(batch.num_rows, _KEY)
            keys["anchor"], keys["score"], keys["kind"], keys["id"] = anchor ^ _SIGN, ~(scores ^ _SIGN), kind, ids ^ _SIGN
            column = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(_KEY.itemsize), batch.num_rows, [None, pa.py_buffer(keys.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), column.cast(pa.binary())], ["anchor", "key"])

    return pairs.select("anchor", "id", "score").mapInArrow(run, "anchor long, key binary")


def _mined(keyed: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Reads the sorted keys of each partition once; holds the open windows of one anchor."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, opened, windows = None, 0, []
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), _KEY)
            anchors, ids = ((keys[name].astype(np.uint64) ^ _SIGN).view(np.int64).tolist() for name in ("anchor", "id"))
            scores = (~keys["score"].astype(np.uint64) ^ _SIGN).view(np.int64).tolist()
            found: list[tuple] = []
            for anchor, score, kind, one in zip(anchors, scores, keys["kind"].tolist(), ids):
                if anchor != current:
                    current, opened, windows = anchor, 0, []
                if kind == 0:
                    if opened < positives:
                        opened += 1
                        windows.append([one, score, 0])
                    continue
                for window in windows:
                    _, of_positive, given = window
                    if given < negatives and low * of_positive <= 100 * score <= high * of_positive:
                        window[2] += 1
                        found.append((anchor, window[0], window[2], one, of_positive, score))
                windows = [w for w in windows if w[2] < negatives and 100 * score >= low * w[1]]
            columns = zip(*found) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return keyed.repartition("anchor").sortWithinPartitions("key").mapInArrow(run, schema)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    scale: float = 1.0,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    groups: int | None = None,
) -> DataFrame:
    """Hard negatives for every anchor and positive: anchor_id, positive_id, rank, negative_id and both scores.

    ``rows`` has columns id, label (whole numbers) and vector (an array of numbers);
    ``is_anchor`` is a condition on them. Components become floor(scale * x), a score
    is the integer inner product with the anchor. Its positives are the first
    ``positives`` other rows of its label, highest score first, ties by smaller id;
    for each, the first ``negatives`` rows of other labels count whose score is
    between ``low`` and ``high`` hundredths of the positive's.

    Rows with a null, or a component that is null or not finite, take no part. An
    empty vector has the score 0 with any other; vectors of different lengths have
    none. Repeated rows are candidates once each; rows with the anchor's id are never
    its positives, and of several anchor rows with one id that with the least label,
    then vector, is taken. Scores beyond 64 bits are held at the ends of a long. A
    positive with a score below 0 has no negatives. Extra columns are not read.
    Without rows, anchors or negatives there are no rows.
    """
    spark = rows.sparkSession
    rows = rows.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", is_anchor.alias("chosen")
    )
    blocks = settle(packed(rows, scale))
    size = blocks.agg(F.count(F.lit(1)), F.sum(F.octet_length("vectors"))).first()
    if groups is None:
        parallel = min(spark.sparkContext.defaultParallelism, size[0])
        groups = max(1, parallel, math.ceil((size[1] or 0) / GROUP_BYTES))
    doubles = F.transform("vector", lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: F.coalesce(F.abs(x * scale) < float("inf"), F.lit(False)))
    anchors = settle(
        rows.where("chosen AND label IS NOT NULL AND id IS NOT NULL")
        .where(sound)
        .groupBy("id")
        .agg(F.min(F.struct("label", "vector")).alias("one"))
        .select("id", "one.label", "one.vector")
    )
    first = _pairs(blocks, _small(packed(anchors, scale)), groups, _same_label(positives))
    chosen = settle(
        first.select("*", F.expr("row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id)").alias("place"))
        .where(F.col("place") <= positives)
        .select("anchor", "id", "score")
    )
    scores = chosen.groupBy(F.col("anchor").alias("id")).agg(F.array_distinct(F.collect_list("score")).alias("scores"))
    asked = _small(packed(anchors.join(scores, "id"), scale, "scores"))
    second = _pairs(blocks, asked, groups, _other_labels(negatives, low, high))
    keyed = _keyed(chosen, 0).unionByName(_keyed(second, 1))
    return _mined(keyed, positives, negatives, low, high)


def _small(blocks: DataFrame) -> DataFrame:
    """Blocks of at most ``ANCHORS`` rows, so that a product of one with some rows stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                count = len(block["ids"]) // 8
                for at in range(0, count, ANCHORS):
                    last = min(at + ANCHORS, count)
                    cut = {
                        name: value[at * len(value) // count : last * len(value) // count]
                        if isinstance(value, bytes)
                        else value
                        for name, value in block.items()
                    }
                    yield pa.RecordBatch.from_pylist([cut], batch.schema)

    return blocks.mapInArrow(run, blocks.schema)


#: The registered query in SQL: all anchors against all rows.
ORACLE = """
    WITH rows AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT a.id AS anchor, r.id, a.label = r.label AS same,
               CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
        FROM rows a JOIN rows r ON a.id % 100 = 0 AND len(a.q) = len(r.q)
    ), positives AS (
        SELECT anchor, id, score FROM pairs WHERE same AND id <> anchor
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
    ), found AS (
        SELECT p.anchor, p.id AS positive, n.id AS negative, p.score AS of_positive, n.score AS of_negative,
               row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS rank
        FROM positives p JOIN pairs n ON p.anchor = n.anchor AND NOT n.same
         AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    )
    SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id,
           of_positive AS positive_score, of_negative AS negative_score
    FROM found WHERE rank <= 10
"""

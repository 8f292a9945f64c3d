"""Document quality by regularised quadratic discriminant analysis of text statistics.

Every whole text becomes a row of transformed statistics: shares of kinds of
characters, words and lines (square roots), sizes and ratios (logarithms), and
the entropy of its bytes. Both classes are normal densities over them: means and
covariances of all labelled rows outside the held-out fold, each covariance shrunk
towards a multiple of the identity. The score is the posterior of class 1, from
the difference of the Mahalanobis distances and log determinants, with a Cholesky
factor per class that is computed once.

Moments are sums over all labelled rows, combined per task; the driver receives
one row of sums per class and task group, never a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaudit.session import settle

THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
#: Log-odds are divided by this: densities of many dependent statistics are too sure of themselves.
TEMPERATURE = 4.0
#: Least share of the identity in a covariance: statistics that hardly vary among the taught rows decide nothing alone.
LEAST_SHRINKAGE = 0.02
#: Bytes of texts that are measured together; a longer text is measured alone.
TEXTS = 1 << 21
#: Rows of features that a task multiplies at a time.
ROWS = 1 << 14

#: Kinds of bytes.
LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, COMMA, QUOTE, SIGN, CONTROL, LEAD, TAIL = range(12)
KINDS = 12

NAMES = [
    "bytes", "words", "lines", "word_length", "word_spread", "line_length",
    "upper", "digit", "blank", "newline", "stop", "comma", "quote", "sign", "control", "beyond_ascii",
    "words_of_signs", "words_end_in_sign", "words_in_capitals", "words_with_digit", "words_again",
    "lines_again", "lines_stopped", "lines_of_one_word", "entropy",
]


def _kinds() -> np.ndarray:
    table = np.full(256, CONTROL, np.uint8)
    table[0x21:0x7F] = SIGN
    table[ord("a") : ord("z") + 1] = LOWER
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("0") : ord("9") + 1] = DIGIT
    for kind, signs in ((SPACE, b" \t\r\x0b\x0c"), (NEWLINE, b"\n"), (STOP, b".!?"), (COMMA, b",;:"), (QUOTE, b"'\"()-")):
        table[list(signs)] = kind
    table[0x80:0xC0] = TAIL
    table[0xC0:] = LEAD
    return table


def _weights(count: int) -> np.ndarray:
    """Odd 64-bit numbers, one per place in a word or a line."""
    with np.errstate(over="ignore"):
        places = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        places = (places ^ places >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return places | np.uint64(1)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of every run of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    return edges[::2], edges[1::2]


def _hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of every run of bytes: the sum of its bytes, each times the number of its place."""
    if not len(first):
        return np.zeros(0, np.uint64)
    sizes = end - first
    at = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    place = at - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        products = (data[at].astype(np.uint64) + np.uint64(1)) * _weights(int(sizes.max()))[place]
        return np.add.reduceat(products, np.r_[0, np.cumsum(sizes)[:-1]])


def _again(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many runs of each document equal an earlier one of it."""
    order = np.lexsort([hashes, owner])
    owner, hashes = owner[order], hashes[order]
    same = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    return np.bincount(owner[1:][same], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics (``NAMES``) per text; null is an empty text. All are finite."""
    column = texts.fill_null("").cast(pa.large_binary())
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    table = _kinds()
    kind = table[data]
    counts = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    spread = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(sizes, 1)[:, None]
    entropy = -(spread * np.log2(np.where(spread > 0, spread, 1))).sum(axis=1)

    # Words end at white space and lines at line feeds; both end with their document.
    starts = np.zeros(len(data) + 1, bool)
    starts[bounds[:-1]] = True

    def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, end = _runs(inside)
        cut = np.flatnonzero(starts[:-1] & inside & np.r_[False, inside[:-1]])
        first, end = np.sort(np.r_[first, cut]), np.sort(np.r_[end, cut])
        return first, end, owner[first]

    def share(flags: np.ndarray, holder: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.bincount(holder[flags], minlength=n) / np.maximum(total, 1)

    lowered = np.where(kind == UPPER, data | 0x20, data)
    first, end, holder = runs((kind != SPACE) & (kind != NEWLINE))
    lengths, words = end - first, np.bincount(holder, minlength=n)
    mean = np.bincount(holder, lengths, minlength=n) / np.maximum(words, 1)
    square = np.bincount(holder, lengths.astype(float) ** 2, minlength=n) / np.maximum(words, 1)

    def within(*kinds: int) -> np.ndarray:
        """How many bytes of these kinds each word has."""
        total = np.r_[0, np.cumsum(np.isin(kind, kinds))]
        return total[end] - total[first]

    letters = within(LOWER, UPPER, LEAD)
    parts = [
        share(letters + within(DIGIT) == 0, holder, words),
        share((kind[end - 1] == SIGN) & (letters > 0), holder, words),
        share((within(UPPER) > 1) & (within(LOWER) == 0), holder, words),
        share(within(DIGIT) > 0, holder, words),
        _again(holder, _hashes(lowered, first, end), n) / np.maximum(words, 1),
    ]
    line, line_end, line_holder = runs(kind != NEWLINE)
    lines = np.bincount(line_holder, minlength=n)
    per_line = np.bincount(np.searchsorted(line, first, side="right") - 1, minlength=len(line)) if len(line) else np.zeros(0)
    parts += [
        _again(line_holder, _hashes(data, line, line_end), n) / np.maximum(lines, 1),
        share(np.isin(kind[line_end - 1], (STOP, QUOTE)), line_holder, lines),
        share(per_line <= 1, line_holder, lines),
    ]
    shares = counts / np.maximum(sizes, 1)[:, None]
    of_bytes = [UPPER, DIGIT, SPACE, NEWLINE, STOP, COMMA, QUOTE, SIGN, CONTROL, LEAD]
    return np.stack(
        [
            *(np.log1p(total) for total in (sizes, words, lines)),
            np.log1p(mean),
            np.log1p(np.sqrt(np.maximum(square - mean**2, 0))),
            np.log1p(sizes / np.maximum(lines, 1)),
            *(np.sqrt(shares[:, k]) for k in of_bytes),
            *(np.sqrt(part) for part in parts),
            entropy,
        ],
        axis=1,
    )


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of rows with about ``TEXTS`` bytes of text in all."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // TEXTS
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(sizes)]
    yield from ((a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b > a)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics as doubles, one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(1)):
                part = batch.slice(first, last - first)
                rows = statistics(part.column(1))
                flat = pa.array(rows.reshape(-1))
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "x"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES)))


class Discriminant:
    """Two normal densities; ``score`` is the posterior of class 1."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Fits from the number, the sum and the sum of outer products of the rows of each class."""
        self.share = None
        total = sum(n for n, _, _ in sums.values())
        if any(sums.get(k, (0,))[0] < 2 for k in (0, 1)):
            self.share = sums[1][0] / total if total and 1 in sums else 0.0
            return
        self.centre = sum(s for _, s, _ in sums.values()) / total
        every = sum(q for _, _, q in sums.values()) / total
        self.scale = np.sqrt(np.maximum(np.diag(every) - self.centre**2, 0))
        self.scale[self.scale < 1e-9] = 1.0
        self.classes = []
        for k in (0, 1):
            n, s, q = sums[k]
            mean = (s / n - self.centre) / self.scale
            covariance = (q / n - np.outer(s / n, s / n)) / np.outer(self.scale, self.scale)
            factor = np.linalg.cholesky(shrunk(covariance, n))
            log_determinant = 2 * np.log(np.diag(factor)).sum()
            self.classes.append((mean, np.linalg.inv(factor), log_determinant - 2 * np.log(n / total)))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        distances = [((z - mean) @ whitener.T) ** 2 for mean, whitener, _ in self.classes]
        (none, one), ((*_, d0), (*_, d1)) = (d.sum(axis=1) for d in distances), self.classes
        return ((none + d0) - (one + d1)) / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), float(self.share))
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / TEMPERATURE, -700, 700)))


def shrunk(covariance: np.ndarray, n: int) -> np.ndarray:
    """The covariance of n rows, shrunk to a multiple of the identity as far as its own spread tells (OAS)."""
    p = len(covariance)
    trace, square = np.trace(covariance), (covariance**2).sum()
    above = (1 - 2 / p) * square + trace**2
    below = (n + 1 - 2 / p) * (square - trace**2 / p)
    share = 1.0 if below <= 0 else min(1.0, above / below)
    share = max(share, LEAST_SHRINKAGE)
    return (1 - share) * covariance + share * max(trace / p, 1e-6) * np.eye(p)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits on all of ``rows`` (doc_id, x) that have a label outside the held-out fold."""
    taught = (
        labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("quality") > 0).cast("int").alias("quality"))
    )
    width = len(NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: [0, np.zeros(width), np.zeros((width, width))] for k in (0, 1)}
        for batch in batches:
            x, quality = _matrix(batch.column(1)), np.asarray(batch.column(0))
            for k, sums in held.items():
                part = x[quality == k]
                for at in range(0, len(part), ROWS):
                    some = part[at : at + ROWS]
                    sums[0] += len(some)
                    sums[1] += some.sum(axis=0)
                    sums[2] += some.T @ some
        numbers = pa.array([held[k][0] for k in held], pa.int64())
        sums = pa.array([np.r_[held[k][1], held[k][2].reshape(-1)].tolist() for k in held], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), numbers, sums], ["quality", "n", "sums"])

    partial = rows.join(taught, "doc_id").select("quality", "x").mapInArrow(add, "quality int, n long, sums array<double>")
    totals = (
        partial.where("n > 0")
        .select("quality", "n", F.posexplode("sums").alias("place", "value"))
        .groupBy("quality", "place")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        .orderBy("quality", "place")
        .collect()
    )
    sums = {}
    for k in sorted({row["quality"] for row in totals}):
        mine = [row for row in totals if row["quality"] == k]
        values = np.array([row["value"] for row in mine])
        sums[k] = (mine[0]["n"], values[:width], values[width:].reshape(width, width))
    return Discriminant(sums)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` (doc_id, quality) teaches the two densities, without the rows whose
    crc32(doc_id) leaves 0 modulo 5 (``held_out``); all other labelled rows count,
    without a bound. Only the text of a document is scored. ``predicted`` is 1 from
    a score of 0.3 on.

    A null or empty text is a row of zeros and gets a score like any other. A null
    doc_id is not held out and has no label; labels with a null id or a null label
    teach nothing, of repeated labels the highest counts, and any above 0 is 1.
    Repeated rows of ``docs`` give a row each and each teach. Extra columns are not
    read. If a class has fewer than two rows, all scores are the share of label 1
    among the taught rows, 0 without any. No documents give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = settle(measured(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

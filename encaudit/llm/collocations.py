"""Collocations of two to four words by direct-address tiling of frequency-ranked ids.

The words of each language that occur often enough are ranked by frequency; their
ranks are ids. Ids of neighbouring words are a cell of a square matrix, which is cut
into tiles of ``SIDE`` by ``SIDE`` cells. Frequent words meet in the first tiles, so
these are dense: each chunk counts them with ``bincount`` and sends them on as one row
per tile, to be added to an array with an address for every cell. The cells of all
other tiles are sorted lists of (pair, count), which Spark adds up. Frequent pairs are
ranked in turn, and two pairs that overlap by a word are a cell of the next matrix:
three words, then four.

Texts become chunks, rows that hold the ids of some text of one language as one packed
array. No dictionary is broadcast, and the driver sees no word: ids come to a chunk by
a join of its different words, or from tasks that hold the frequent pairs of a bucket
and answer packed lists of pairs. A bitmap of fixed size drops most pairs that are not
frequent before that. Dense tiles are counted in two steps, salted by chunk, as all
chunks share them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaudit.llm.bitmap import bitmap, may_hold
from encaudit.session import settle

#: Ids on each side of a tile; cells of a tile.
SIDE_BITS = 10
SIDE = 1 << SIDE_BITS
CELLS = SIDE * SIDE
#: Tiles whose places along both sides (from 1 on) have at most this product are dense; ids are ranks, and cells thin out so.
DENSE = 16
#: Fewer entries of a tile in a chunk are sorted; an address for every cell would cost more than they do.
FEW = CELLS >> 4
#: Bytes of texts in the chunks that a task makes at a time.
CHUNK_BYTES = 16 << 20
#: Frequent pairs that a bucket has on average at most.
BUCKET_PAIRS = 1 << 18
#: The mark between ids that are no neighbours.
GAP = -1
NO_LANGUAGE = "und"
LONGEST = 4

_WORD, _BLANK, _END = 0, 1, 2


def _kinds() -> np.ndarray:
    table = np.full(256, _WORD, np.uint8)
    table[[0x20, 0x09]] = _BLANK
    table[[*b".,;:!?", *range(0x0A, 0x0E)]] = _END
    return table


def _packed(ids: np.ndarray) -> bytes:
    """Ids (or gaps) as 32-bit numbers where they fit, else as 64-bit ones; the last byte tells."""
    narrow = not len(ids) or int(ids.max()) < 1 << 31
    return ids.astype("<i4" if narrow else "<i8").tobytes() + (b"\4" if narrow else b"\10")


def _unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held[:-1], f"<i{held[-1]}").astype(np.int64)


def _closed_up(ids: np.ndarray) -> np.ndarray:
    """The ids with one gap in place of several, and none at the ends."""
    kept = ids != GAP
    kept[:-1] |= kept[1:]
    return ids[kept]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, lang, n, codes, words, counts: packed codes of the words, gaps between pieces, and each code's word and count."""
    made = _schema(
        chunk=pa.int64(), lang=pa.string(), n=pa.int64(), codes=pa.binary(), words=pa.list_(pa.string()), counts=pa.list_(pa.int64())
    )
    kinds = _kinds()

    def chunk(number: int, lang: str, texts: list[bytes]) -> tuple:
        data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        kind = kinds[data]
        edges = np.flatnonzero(np.diff(np.r_[False, kind == _WORD, False].view(np.int8)))
        first, end = edges[::2], edges[1::2]
        offsets = np.r_[0, np.cumsum(end - first)].astype(np.int64)
        held = np.ascontiguousarray(data[kind == _WORD])
        said = pa.Array.from_buffers(
            pa.large_string(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(held.tobytes())]
        ).dictionary_encode()
        codes = np.asarray(said.indices).astype(np.int64)
        pieces = np.searchsorted(np.flatnonzero(kind == _END), first)
        apart = np.flatnonzero(np.diff(pieces)) + 1
        return number, lang, len(codes), _packed(np.insert(codes, apart, GAP)), said.dictionary, np.bincount(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, texts = TaskContext.get().partitionId() << 32, 0, defaultdict(list)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang in sorted(texts):
                *plain, words, counts = chunk(number, lang, texts[lang])
                number += 1
                offsets = pa.array([0, len(words)], pa.int32())
                columns = [pa.array([value], kind.type) for value, kind in zip(plain, made)]
                columns.append(pa.ListArray.from_arrays(offsets, words.cast(pa.string())))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema=made)
            texts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                data = text.as_buffer().to_pybytes()
                texts[lang].append(data)
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return rows.mapInArrow(run, "chunk long, lang string, n long, codes binary, words array<string>, counts array<long>")


def ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with ``id``, their place by falling n, then ``keys``. Sorted in ranges; a task holds no more than one."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = settle(
        rows.orderBy(F.desc("n"), *keys).select("*", F.spark_partition_id().alias("part"), place.alias("place"))
    )
    parts = held.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # as many rows as partitions
    before = F.expr("coalesce(sum(rows) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    offsets = parts.select("part", before.alias("before"))
    return held.join(F.broadcast(offsets), "part").withColumn("id", F.col("before") + F.col("place")).drop(
        "part", "place", "before"
    )


def _first_ids(texts: DataFrame, dictionary: DataFrame, words: DataFrame) -> DataFrame:
    """chunk and its packed ids, from local codes by way of the words they stand for."""
    known = (
        dictionary.join(words.select("lang", "phrase", "id"), ["lang", "phrase"])
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("code", "id")).alias("known"))  # as many as a chunk has words
        .select("chunk", F.col("known.code").alias("code"), F.col("known.id").alias("id"))
    )
    made = _schema(chunk=pa.int64(), ids=pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chunk, codes, code, known_ids = (column[at] for column in batch.columns)
                codes = _unpacked(codes.as_py())
                table = np.full(int(codes.max()) + 2, GAP)
                table[np.asarray(code.values)] = np.asarray(known_ids.values)
                yield _batch([(chunk.as_py(), _packed(_closed_up(table[codes])))], made)

    return texts.select("chunk", "codes").join(known, "chunk").select("chunk", "codes", "code", "id").mapInArrow(
        run, "chunk long, ids binary"
    )


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and count of the different neighbours in a sequence, sorted."""
    beside = (ids[:-1] != GAP) & (ids[1:] != GAP)
    return _counted(ids[:-1][beside], ids[1:][beside])


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs, sorted, and how often each occurs."""
    if not len(a) or max(int(a.max()), int(b.max())) < 1 << 31:
        keys, counts = np.unique(a << 32 | b, return_counts=True)
        return keys >> 32, keys & 0xFFFFFFFF, counts
    used, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys, counts = np.unique(codes[: len(a)] * len(used) + codes[len(a) :], return_counts=True)
    return used[keys // len(used)], used[keys % len(used)], counts


class _Known:
    """Ids of pairs (a, b), found by place in sorted arrays."""

    def __init__(self, pairs: list[bytes], ids: list[bytes]) -> None:
        a, b = np.concatenate([_unpacked(one).reshape(2, -1) for one in pairs], axis=1)
        self.firsts, self.seconds = np.unique(a), np.unique(b)
        keys = np.searchsorted(self.firsts, a) * len(self.seconds) + np.searchsorted(self.seconds, b)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.concatenate([_unpacked(one) for one in ids])[order]

    def ids_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each pair, or a gap."""

        def placed(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = np.minimum(np.searchsorted(known, values), len(known) - 1)
            return place, known[place] == values

        (x, has_a), (y, has_b) = placed(a, self.firsts), placed(b, self.seconds)
        place, has_pair = placed(x * len(self.seconds) + y, self.keys)
        return np.where(has_a & has_b & has_pair, self.ids[place], GAP)


def _is_dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a >> SIDE_BITS) + 1) * ((b >> SIDE_BITS) + 1) <= DENSE


def _dense_tiles(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """tile, cells that occur and their counts, for the dense tiles; by direct addresses where many cells are hit."""
    a, b = ids[:-1], ids[1:]
    kept = (a != GAP) & (b != GAP)
    kept[kept] = _is_dense(a[kept], b[kept])
    a, b = a[kept], b[kept]
    tiles = (a >> SIDE_BITS) << 32 | b >> SIDE_BITS
    cells = (a & SIDE - 1) << SIDE_BITS | b & SIDE - 1
    order = np.argsort(((tiles >> 32) * DENSE + (tiles & 0xFFFFFFFF)).astype(np.int16), kind="stable")  # both places are below DENSE
    tiles, cells = tiles[order], cells[order]
    cuts = np.flatnonzero(np.diff(tiles)) + 1
    for first, end in zip(np.r_[0, cuts], np.r_[cuts, len(tiles)]) if len(tiles) else ():
        if end - first < FEW:
            yield int(tiles[first]), *np.unique(cells[first:end], return_counts=True)
            continue
        counts = np.bincount(cells[first:end], minlength=CELLS)
        found = np.flatnonzero(counts)
        yield int(tiles[first]), found, counts[found]


def _added_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """tile, cells and counts, added up over rows (tile, salt, cells, counts) in the order of tile and salt."""
    key, held = None, None

    def counted() -> tuple[int, np.ndarray, np.ndarray]:
        cells = np.flatnonzero(held)
        return key[0], cells, held[cells]

    for batch in batches:
        for at in range(batch.num_rows):
            tile, salt, cells, counts = (column[at].as_py() for column in batch.columns)
            if (tile, salt) != key:
                if key is not None:
                    yield counted()
                key, held = (tile, salt), np.zeros(CELLS, np.int64)
            held[np.frombuffer(cells, "<u4")] += _unpacked(counts)  # the cells of a row are different ones
    if key is not None:
        yield counted()


def frequent_pairs(sequences: DataFrame, least: int, salts: int) -> DataFrame:
    """a, b, n: the neighbours in packed id sequences (chunk, ids) that occur at least ``least`` times."""
    entry = _schema(tile=pa.int64(), salt=pa.int32(), cells=pa.binary(), counts=pa.binary())
    types = "tile long, salt int, cells binary, counts binary"

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                salt = (chunk * 0x9E3779B97F4A7C15 >> 32) % salts
                for tile, cells, counts in _dense_tiles(_unpacked(ids.as_py())):
                    yield _batch([(tile, salt, cells.astype("<u4").tobytes(), _packed(counts))], entry)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, cells, counts in _added_tiles(batches):
            yield _batch([(tile, 0, cells.astype("<u4").tobytes(), _packed(counts))], entry)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, cells, counts in _added_tiles(batches):
            kept = counts >= least
            cells, counts = cells[kept], counts[kept]
            a = (tile >> 32) << SIDE_BITS | cells >> SIDE_BITS
            b = (tile & 0xFFFFFFFF) << SIDE_BITS | cells & SIDE - 1
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(counts)], ["a", "b", "n"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in batch.column(0):
                ids = _unpacked(ids.as_py())
                a, b = ids[:-1], ids[1:]
                kept = (a != GAP) & (b != GAP)
                kept[kept] = ~_is_dense(a[kept], b[kept])
                columns = [pa.array(values) for values in _counted(a[kept], b[kept])]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    parts = sequences.select("chunk", "ids").mapInArrow(dense, types)
    salted = parts.repartition("tile", "salt").sortWithinPartitions("tile", "salt").mapInArrow(combine, types)
    of_tiles = salted.repartition("tile").sortWithinPartitions("tile").mapInArrow(finish, "a long, b long, n long")
    listed = sequences.select("ids").mapInArrow(sparse, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return of_tiles.unionByName(listed.where(F.col("n") >= least))


def _slot(a, b):
    """Number by which the bitmap knows a pair; columns or arrays."""
    return a * 1_000_003 + b


_REQUEST = _schema(bucket=pa.int32(), chunk=pa.int64(), pairs=pa.binary(), ids=pa.binary())
_REQUEST_TYPES = "bucket int, chunk long, pairs binary, ids binary"


def _requests(chunk: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """One row per bucket that has some of the pairs."""
    bucket = _slot(a, b) % buckets
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    rows = [
        (int(bucket[part[0]]), chunk, _packed(np.r_[a[part], b[part]]), None if ids is None else _packed(ids[part]))
        for part in parts
    ]
    return _batch(rows, _REQUEST)


def _next_ids(sequences: DataFrame, pairs: DataFrame) -> DataFrame:
    """chunk and packed ids of the frequent pairs (a, b, id) in its sequence, at the places of their first member.

    Chunks ask each bucket of pairs once, with a packed list. A bucket's pairs sort
    before what is asked of it, so the task that answers holds one bucket at a time.
    """
    spark = sequences.sparkSession
    held = bitmap(pairs.select(_slot(F.col("a"), F.col("b")).alias("slot")), "slot")
    sent = spark.sparkContext.broadcast(held)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // BUCKET_PAIRS))
    made = _schema(chunk=pa.int64(), ids=pa.binary())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (np.asarray(column) for column in batch.columns)
            yield _requests(-1, a, b, ids, buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b, _ = _pairs(_unpacked(ids.as_py()))
                kept = may_hold(sent.value, _slot(a, b))
                yield _requests(chunk, a[kept], b[kept], None, buckets)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held_pairs, held_ids, known = None, [], [], None
        for batch in batches:
            for at in range(batch.num_rows):
                bucket, chunk, asked, ids = (column[at].as_py() for column in batch.columns)
                if bucket != key:
                    key, held_pairs, held_ids, known = bucket, [], [], None
                if chunk < 0:
                    held_pairs.append(asked)
                    held_ids.append(ids)
                elif held_pairs:
                    known = known or _Known(held_pairs, held_ids)
                    a, b = _unpacked(asked).reshape(2, -1)
                    found = known.ids_of(a, b)
                    hit = found != GAP
                    row = (bucket, chunk, _packed(np.r_[a[hit], b[hit]]), _packed(found[hit]))
                    yield _batch([row] if hit.any() else [], _REQUEST)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chunk, ids, pairs, new = (column[at].as_py() for column in batch.columns)
                ids = _unpacked(ids)
                after = _Known(pairs, new).ids_of(ids[:-1], ids[1:])
                yield _batch([(chunk, _packed(_closed_up(after)))], made)

    known_pairs = pairs.select("a", "b", "id").mapInArrow(told, _REQUEST_TYPES)
    asked = sequences.select("chunk", "ids").mapInArrow(ask, _REQUEST_TYPES)
    answered = (
        known_pairs.unionByName(asked)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "chunk")
        .mapInArrow(answer, _REQUEST_TYPES)
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("pairs", "ids")).alias("known"))  # as many pairs as a chunk has neighbours
        .select("chunk", F.col("known.pairs").alias("pairs"), F.col("known.ids").alias("new"))
    )
    return sequences.join(answered, "chunk").select("chunk", "ids", "pairs", "new").mapInArrow(replace, "chunk long, ids binary")


def phrases(docs: DataFrame, least: int = 30, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... words, and lang and n, the number of its words.

    A phrase has id, lang, phrase, last (its last word), n, and the counts of its
    first (``fore``) and last (``aft``) 1, 2, ... words. Phrases of more than one word
    have a and b, the ids of the phrases without their last, and first, word.
    """
    texts = settle(chunks(docs))
    dictionary = texts.select(
        "chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "entry")
    ).select("chunk", "lang", "code", F.col("entry.words").alias("phrase"), F.col("entry.counts").alias("n"))
    totals = texts.groupBy("lang").agg(F.sum("n").alias("total"))
    salts = max(1, math.isqrt(texts.count()))
    counted = dictionary.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = F.array("n")
    words = settle(
        ranked(counted, "lang", "phrase").select(
            "id", "lang", "phrase", F.col("phrase").alias("last"), "n", counts.alias("fore"), counts.alias("aft")
        )
    )
    levels = [words]
    sequences = settle(_first_ids(texts, dictionary, words))
    while len(levels) < longest:
        shorter = levels[-1]
        pairs = settle(ranked(frequent_pairs(sequences, least, salts), "a", "b"))
        left = shorter.select(F.col("id").alias("a"), "lang", "phrase", "fore")
        right = shorter.select(F.col("id").alias("b"), "last", "aft")
        joined = pairs.join(left, "a").join(right, "b")
        levels.append(
            settle(
                joined.select(
                    "id",
                    "lang",
                    F.concat_ws(" ", "phrase", "last").alias("phrase"),
                    "last",
                    "n",
                    F.concat("fore", counts).alias("fore"),
                    F.concat("aft", counts).alias("aft"),
                    "a",
                    "b",
                )
            )
        )
        if len(levels) < longest:
            sequences = settle(_next_ids(sequences, pairs))
    return levels, totals


def collocations(
    docs: DataFrame, least: int = 30, longest: int = LONGEST, first: int = 2000, share: int = 80
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (lang, text) are lower-cased (A-Z) and split at ``.,;:!?`` and line ends
    into pieces, and these at blanks and tabs into words. Candidates are phrases of 2
    to ``longest`` words within pieces that occur at least ``least`` times (``a``).
    Cut in two, with counts ``l`` and ``r`` of the parts, a phrase scores
    floor(2000000 * a / (l + r)); its lowest-scoring cut counts, ties to the shortest
    first part. Candidates inside a longer one that occurs at least ``share``
    hundredths as often are dropped. Kept are the ``first`` of each language by score
    and count, descending, then phrase in byte order; ``n`` counts its words.

    A null or empty text has no words; a null language is ``und``. Repeated rows
    count as often as they occur. Extra columns are not read. No candidates, or an
    empty table, give no rows. Arithmetic is in whole numbers of any size needed.
    """
    levels, totals = phrases(docs, least, longest)
    found = None
    for size, level in enumerate(levels[1:], 2):
        cuts = F.expr(
            f"""array_min(transform(sequence(1, {size} - 1), k -> struct(
                cast(2000000 as decimal(7, 0)) * cast(n as decimal(19, 0))
                    div (cast(fore[k - 1] as decimal(19, 0)) + cast(aft[{size} - k - 1] as decimal(19, 0))) as score,
                k as k, fore[k - 1] as l, aft[{size} - k - 1] as r)))"""
        )
        scored = level.select("id", "lang", "phrase", F.col("n").alias("a"), cuts.alias("cut"))
        if size < len(levels):
            longer = levels[size].select("n", F.explode(F.array("a", "b")).alias("id"))
            inside = longer.groupBy("id").agg(F.max("n").alias("above"))
            scored = scored.join(inside, "id", "left").where(
                F.coalesce(F.expr(f"cast(above as decimal(19, 0)) * 100 < cast(a as decimal(19, 0)) * {share}"), F.lit(True))
            )
        rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        found = rows if found is None else found.unionByName(rows)
    place = F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")
    return (
        found.withColumn("rank", place.cast("long"))
        .where(F.col("rank") <= first)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
    )


#: The registered query in SQL.
ORACLE = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), said AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), grams AS MATERIALIZED (
        SELECT lang, k, array_to_string(gram, ' ') AS phrase, count(*) AS f
        FROM (
            SELECT lang, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)),
                                                  lambda i: list_slice(w, i, i + k - 1))) AS gram
            FROM said, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
        ) GROUP BY ALL
    ), totals AS (
        SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
    ), candidates AS MATERIALIZED (
        SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 30
    ), dropped AS (
        SELECT DISTINCT s.lang, s.phrase
        FROM candidates s
        JOIN (SELECT lang, k, f, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) AS inner1,
                     unnest([array_to_string(w[1 : greatest(k - 2, 1)], ' '), array_to_string(w[3 : k], ' ')]) AS inner2,
                     array_to_string(w[2 : k - 1], ' ') AS inner3
              FROM candidates WHERE k > 2) b
          ON s.lang = b.lang AND s.phrase IN (b.inner1, b.inner2, b.inner3)
         AND s.k < b.k AND 100 * b.f >= 80 * s.f
    ), parts AS MATERIALIZED (
        SELECT lang, phrase, f AS a, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 : k], ' ') AS tail
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
    ), heads AS MATERIALIZED (
        SELECT parts.*, g.f AS l FROM parts JOIN grams g ON g.lang = parts.lang AND g.phrase = head
    ), cuts AS MATERIALIZED (
        SELECT heads.*, g.f AS r, CAST((2000000::HUGEINT * a) // (l + g.f) AS BIGINT) AS score
        FROM heads JOIN grams g ON g.lang = heads.lang AND g.phrase = tail
    ), lowest AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
    ), numbered AS (
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
               phrase, a, l, r, score
        FROM lowest ANTI JOIN dropped USING (lang, phrase)
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM numbered JOIN totals USING (lang) WHERE rank <= 2000
"""

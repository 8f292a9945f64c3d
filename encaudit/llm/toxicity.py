"""Toxicity of restored text: a noisy channel, a character model and word beginnings.

Disguised words (``1d10t``, ``m o r o n``, ``looooser``) are read as the output of a
channel that swaps, separates and repeats letters. Every character opens a few
readings; the Viterbi path through this lattice under a character trigram model of
the whole corpus is the restored word. Words are then scored by their beginnings:
each has bounds for the share of toxic documents among the labelled documents that
contain it, and longer beginnings overrule shorter ones.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encaudit.functions.arrays import bind
from encaudit.llm.components import components
from encaudit.session import settle

#: Letters that look like another character.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c",
}
#: Costs of the channel, in nats: a swapped, a separating and a repeated character, and a separator that ends a word.
SWAPPED, SEPARATOR, REPEATED, BREAK = 1.0, 0.5, 0.5, 1.0
#: Letters, as code points, that a trigram's number is made of; bits of each.
LETTER_BITS = 21
#: The language model has all letter trigrams of the corpus, up to so many different ones (64 MB), the most frequent first.
MOST_TRIGRAMS = 1 << 22
SMOOTHING = 0.1
ALPHABET = 64
#: Letters of the longest word beginning that is a feature.
LONGEST = 7
#: At most so many labelled documents, in the order of a hash of their ids, fit the word scores.
FIT_DOCUMENTS = 20_000
#: Standard deviations that a share of toxic documents is taken below, and above, the observed one.
BELOW, ABOVE = 4.0, 1.0
#: Near copies with the same label count once: shingle sets of this Jaccard similarity, among those that share one of
#: so many minimum hashes (at 0.8 all but 0.2% do).
COPY_SIMILARITY, COPY_HASHES = 0.8, 4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Entries after which a table of a task is emptied.
TABLE = 1 << 18
SLICE = 1 << 18

REPEATS = re.compile(r"(.)\1\1").search
STRIPPED = "\"'.,;:!?()[]{}<>*#%&/\\=~^`-_|+"
#: Single characters with white space between them; signs may touch the first and the last.
SPACED = re.compile(rf"(?<!\S)[{re.escape(STRIPPED)}]*\S(?:\s+\S){{2,}}[{re.escape(STRIPPED)}]*(?!\S)").findall


_LETTERS: list[np.ndarray] = []


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, zero for all but letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where(_LETTERS[0][points], points, 0)


_BREAK = re.compile(r"[\W\d_]")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """The texts in strings of about ``SLICE`` characters, cut where no word goes on, two breaks between them."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            whole, at = text.as_py() or "", 0
            while at < len(whole):
                found = _BREAK.search(whole, at + SLICE)
                end = found.start() if found else len(whole)
                held.append(whole[at:end])
                size, at = size + end - at, end
                if size >= SLICE:
                    yield "\n\n".join(held)
                    held, size = [], 0
    yield "\n\n".join(held)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in rising order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letter trigrams of a text, zero for no letter, and how often they occur."""
    points = np.concatenate([[0, 0], _letters(text), [0]])
    used, codes = np.unique(points, return_inverse=True)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]  # code 0 is no letter
    said = (b > 0) | (c > 0)
    a, b, c = np.where(b > 0, a, 0)[said], b[said], c[said]
    cells = (a * len(used) + b) * len(used) + c
    if len(used) ** 3 <= 1 << 21:
        counts = np.bincount(cells)
        cells = np.flatnonzero(counts)
        counts = counts[cells]
    else:
        cells, counts = np.unique(cells, return_counts=True)
    rest, c = np.divmod(cells, len(used))
    a, b = np.divmod(rest, len(used))
    return (used[a] << 2 * LETTER_BITS) | (used[b] << LETTER_BITS) | used[c], counts


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for text in _slices(batches):
        more, often = _trigrams(text)
        keys, counts = _counted(np.r_[keys, more], np.r_[counts, often])
        if len(keys) > TABLE:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
            keys, counts = keys[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])


def letter_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letter trigrams of all texts in rising order, and how often they occur."""
    counted = docs.select("text").mapInArrow(_count_letters, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    table = counted.orderBy(F.desc("n"), "key").limit(MOST_TRIGRAMS).toArrow()
    return _counted(table.column("key").to_numpy(), table.column("n").to_numpy())


class Restorer:
    """Reads disguised words by the Viterbi path through their lattice."""

    def __init__(self, counts: tuple[np.ndarray, np.ndarray]) -> None:
        """``counts`` are those of ``letter_counts``; of the two letters before the third they are sums."""
        self.threes = counts
        self.twos = _counted(counts[0] >> LETTER_BITS, counts[1])
        self.costs: dict[tuple[int, int, int], float] = {}

    @staticmethod
    def _often(table: tuple[np.ndarray, np.ndarray], key: int) -> int:
        at = int(np.searchsorted(table[0], key))
        return int(table[1][at]) if at < len(table[0]) and table[0][at] == key else 0

    def cost(self, a: int, b: int, c: int) -> float:
        """Nats of letter c after a and b; zero stands for the edge of a word."""
        known = self.costs.get((a, b, c))
        if known is None:
            two = ((a if b else 0) << LETTER_BITS) | b
            often, n = self._often(self.threes, (two << LETTER_BITS) | c), self._often(self.twos, two)
            known = -math.log((often + SMOOTHING) / (n + SMOOTHING * ALPHABET))
            if len(self.costs) >= TABLE:
                self.costs.clear()
            self.costs[a, b, c] = known
        return known

    def readings(self, seen: str, at: int) -> list[tuple[str, float]]:
        """What one character may stand for, with the cost of the channel; none: it was put in; a space: a word ends."""
        sign = seen[at]
        if sign.isalpha():
            drawn_out = at > 0 and sign == seen[at - 1] and 3 * sign in seen[max(0, at - 2) : at + 2]
            return [(sign, 0.0), ("", REPEATED)] if drawn_out else [(sign, 0.0)]
        if sign in LOOKALIKES:
            return [(letter, SWAPPED) for letter in LOOKALIKES[sign]]
        return [("", SEPARATOR), (" ", BREAK)]

    def read(self, seen: str) -> list[str]:
        """The likeliest words behind a lower-case string of characters."""
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for at in range(len(seen)):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (total, said) in paths.items():
                for letter, extra in self.readings(seen, at):
                    if letter == " ":
                        if not b:
                            continue
                        state, now = (0, 0), total + extra + self.cost(a, b, 0)
                    else:
                        state = (b, ord(letter)) if letter else (a, b)
                        now = total + extra + (self.cost(a, b, state[1]) if letter else 0.0)
                    if state not in after or now < after[state][0]:
                        after[state] = (now, said + letter)
            paths = after
        return min((total + self.cost(a, b, 0), said) for (a, b), (total, said) in paths.items())[1].split()

    def words(self, token: str) -> list[str]:
        """The words in one lower-case token: itself, or what it is read as."""
        core = token.strip(STRIPPED)
        if core.isalpha():
            return [core, *self.read(core)] if REPEATS(core) else [core]
        parts = [part for part in re.split(r"[\W\d_]+", core) if part]
        shown = token.rstrip(STRIPPED).lstrip("\"'.,;:?()[]{}<>*#%&/\\=~^`-_")
        return [*parts, *self.read(shown)] if _spells(shown) else parts


def _spells(shown: str) -> bool:
    """False for what cannot spell a word: numbers with their signs, and strings without letters or lookalikes."""
    if any(map(str.isalpha, shown)):
        return True
    return any(map(LOOKALIKES.__contains__, shown)) and ("@" in shown or not any(map(str.isdecimal, shown)))


def _beginnings(word: str) -> Iterable[str]:
    """The features of a word: its beginnings, and the whole of it."""
    yield from (word[:n] for n in range(3, min(len(word), LONGEST) + 1))
    yield f"{word}$"


def document_tokens(text: str) -> set[str]:
    """The different tokens of a text in lower case, with runs of spaced-out words in one piece as well."""
    lowered = text.lower()
    return {*lowered.split(), *(" ".join(spaced.split()) for spaced in SPACED(lowered))}


def document_words(text: str, words: Callable[[str], Iterable]) -> set:
    """Union of ``words(token)`` over the tokens of a text."""
    return set(itertools.chain.from_iterable(map(words, document_tokens(text))))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def word_scores(
    docs: DataFrame, labels: DataFrame, counts: tuple[np.ndarray, np.ndarray]
) -> tuple[dict[str, tuple[float, float]], float]:
    """Features with bounds of the share of toxic documents among those that have them, and the overall share.

    Kept are beginnings that surely stand for more than the overall share, and
    longer ones that deny it; no more than the fitted documents have words.

    Fitted on a bounded sample: the first ``FIT_DOCUMENTS`` labelled documents
    outside the held-out fold, in the order of a hash of their ids. Of texts that
    are copies or near copies one counts, or their words would seem to be toxic.
    Equal texts have the highest of their labels; near copies with different labels
    all count.
    """
    sample = (
        labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_DOCUMENTS)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy(F.coalesce("text", F.lit("")).alias("text"))
        .agg(F.max("toxic").alias("toxic"))
    )
    rows = one_of_copies(rows)
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Restorer(sent.value).words, (Counter(), Counter())

        def features(token: str) -> Iterable[str]:
            return itertools.chain.from_iterable(map(_beginnings, words(token)))

        def table(kind: int) -> pa.RecordBatch:
            counts = pa.array(list(found[kind].values()), pa.int64())
            none = pa.array(np.zeros(len(counts), np.int64))
            pair = [none, counts] if kind else [counts, none]
            names = pa.array(list(found[kind]), pa.string())
            found[kind].clear()
            return pa.RecordBatch.from_arrays([names, *pair], ["feature", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                kind = int(toxic.as_py() > 0)
                found[kind][""] += 1
                found[kind].update(document_words(text.as_py(), features))
                if len(found[kind]) > TABLE:
                    yield table(kind)
        yield table(0)
        yield table(1)

    counted = settle(
        rows.mapInArrow(count, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    share = F.col("toxic") / (F.col("clean") + F.col("toxic"))
    shares = counted.select("feature", share.alias("share"), *_bounds(F.col("clean"), F.col("toxic")))
    overall = shares.where("feature = ''").first()
    base = overall["share"] if overall else 0.0
    shares = shares.where("feature <> ''").select("feature", "low", "high")
    sure = shares.where(F.col("low") > base)
    shorter = F.transform(F.sequence(F.lit(3), F.lit(LONGEST)), lambda n: F.substring("feature", 1, n))
    denied = (
        shares.where(F.col("low") <= base)
        .select("*", F.explode(shorter).alias("start"))
        .join(sure.select(F.col("feature").alias("start")), "start", "left_semi")
        .where(F.col("start") != F.col("feature"))
        .groupBy("feature")
        .agg(F.first("low").alias("low"), F.first("high").alias("high"))
    )
    kept = sure.unionByName(denied).collect()
    return {row["feature"]: (row["low"], row["high"]) for row in kept}, base


def one_of_copies(rows: DataFrame) -> DataFrame:
    """Of different texts (text, toxic) those that stay: of near copies with the same label the smallest text."""
    leasts = bind(
        _shingles(),
        lambda found: F.array(
            *(F.array_min(F.transform(found, lambda one: F.xxhash64(one, F.lit(k)))) for k in range(COPY_HASHES))
        ),
    )
    rows = settle(rows.select(F.xxhash64("text").alias("id"), "text", "toxic", leasts.alias("leasts")))
    spread = rows.select("id", "toxic", F.posexplode("leasts").alias("number", "least"))
    bucket = ["toxic", "number", "least"]
    crowded = spread.groupBy(*bucket).count().where("count > 1").select(*bucket)
    links = (
        spread.join(crowded, bucket)
        .join(rows.select("id", _shingles().alias("shingles")), "id")
        .groupBy(*bucket)
        .applyInArrow(_copies, "a long, b long")
    )
    roots = components(links)
    return (
        rows.join(roots, rows["id"] == roots["node"], "left")
        .groupBy(F.coalesce("root", "id").alias("root"))
        .agg(F.min(F.struct("text", "toxic")).alias("one"))
        .select("one.text", "one.toxic")
    )


def _shingles() -> Column:
    """The different five-word shingles of a text, as 64-bit hashes."""
    def found(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda at: F.xxhash64(F.slice(words, at, F.lit(5)))))

    return bind(F.split(F.lower("text"), r"\s+"), found)


def _copies(bucket: pa.Table) -> pa.Table:
    """Links (a, b) that join the near copies of a bucket.

    Similar sets share one of their rarest members, as many as they may differ by and
    one more, so texts that have only a common passage are not compared.
    """
    ids, column = bucket.column("id").to_pylist(), bucket.column("shingles").combine_chunks()
    sizes = column.value_lengths().to_numpy()
    _, places, often = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
    ranks = np.empty(len(often), np.int64)
    ranks[np.argsort(often, kind="stable")] = np.arange(len(often))
    sets = [np.sort(part) for part in np.split(ranks[places], np.cumsum(sizes)[:-1])]
    least = COPY_SIMILARITY - 1e-9
    group, holders, pairs = list(range(len(ids))), defaultdict(list), []

    def find(k: int) -> int:
        while group[k] != k:
            group[k] = k = group[group[k]]
        return k

    for k in sorted(range(len(ids)), key=lambda k: (sizes[k], ids[k])):
        rarest = sets[k][: sizes[k] - math.ceil(least * sizes[k]) + 1].tolist()
        for j in {j for one in rarest for j in holders[one]}:
            if sizes[j] < least * sizes[k] or find(j) == find(k):
                continue
            both = len(np.intersect1d(sets[j], sets[k], assume_unique=True))
            if both >= least * (sizes[j] + sizes[k] - both):
                pairs.append((ids[j], ids[k]))
                group[find(j)] = find(k)
        for one in rarest:
            holders[one].append(k)
    sides = list(zip(*pairs)) or [[], []]
    return pa.table([pa.array(side, pa.int64()) for side in sides], ["a", "b"])


def _bounds(clean: Column, toxic: Column) -> tuple[Column, Column]:
    """Lower and upper bound of the share behind two counts, by Wilson's score."""
    n = clean + toxic
    share = toxic / n

    def bound(deviations: float) -> Column:
        square = deviations**2
        spread = F.sqrt(share * (1 - share) / n + square / (4 * n * n))
        return (share + square / (2 * n) + deviations * spread) / (1 + square / n)

    return bound(-BELOW).alias("low"), bound(ABOVE).alias("high")


def word_risk(word: str, scores: dict[str, tuple[float, float]], base: float) -> float:
    """The overall share, moved into the bounds of ever longer beginnings of the word."""
    risk = base
    for feature in _beginnings(word):
        if feature in scores:
            low, high = scores[feature]
            risk = min(max(risk, low), high)
    return max(risk, base)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` (doc_id, toxic) teaches the word scores, without the rows whose
    crc32(doc_id) leaves 2 modulo 4 (``held_out``). The character model counts all
    texts. Only the text of a document is scored: by the highest of its word scores,
    at least the overall share of toxic documents. ``predicted`` is 1 from 0.3 on.

    A null or empty text has the overall share as its score. A null doc_id is not
    held out; labels with a null id or a null label teach nothing, of repeated
    labels the highest counts. Repeated rows give a row each, extra columns are
    not read. Without any labels all scores are 0; no documents give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batch: pa.RecordBatch, scores: list[float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_scorer(docs, labels, 1, scored), f"doc_id {kind}, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted to be toxic.

    Scores, and what null, empty, repeated and unlabelled rows have as theirs, are
    those of ``toxicity``: rows without text stay unless the overall share reaches
    the threshold. Repeated rows all stay or all go; columns other than doc_id and
    text are kept as they are, whatever their names.
    """

    def kept(batch: pa.RecordBatch, scores: list[float]) -> pa.RecordBatch:
        return batch.filter(pa.array([score < THRESHOLD for score in scores], pa.bool_()))

    return docs.mapInArrow(_scorer(docs, labels, docs.columns.index("text"), kept), docs.schema)


def _scorer(docs: DataFrame, labels: DataFrame, column: int, made: Callable) -> Callable:
    """Learns from ``docs`` and ``labels``; gives a function that scores the texts of batches."""
    counts = letter_counts(docs)
    scores, base = word_scores(docs, labels, counts)
    context = docs.sparkSession.sparkContext
    sent_counts, sent_scores = context.broadcast(counts), context.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Restorer(sent_counts.value).words, sent_scores.value
        seen: dict[str, float] = {}

        def risk(token: str) -> float:
            found = seen.get(token)
            if found is None:
                found = max((word_risk(word, known, base) for word in words(token)), default=base)
                if len(seen) >= TABLE:
                    seen.clear()
                if len(token) <= 64:
                    seen[token] = found
            return found

        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(column))
            yield made(batch, [max(map(risk, document_tokens(text)), default=base) for text in texts])

    return run

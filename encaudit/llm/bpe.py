"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens: a state stands for the token read last, and there is
an arc from state x to state y, labelled with the bytes of y, exactly if the
encoder can put y right after x. It starts with one arc per byte from every state
and takes the merges in order. The gadget of merge (u, v) -> w

* adds an arc w wherever an arc u leads to an arc v,
* gives the new state w the arcs that state v has at that moment,
* takes the arc v away from state u.

With 50,000 merges the arcs would be billions, so they are not stored: whether the
gadgets leave an arc in place follows from the merges alone (``arc``), and arcs
that occur are kept in a transition table. A word has one path through the
automaton that spells it; the encoder finds it from left to right.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the characters with the property White_Space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that the regex library takes for letters or digits by a later
#: Unicode version than the one in which vocabularies of this kind are read (16.0).
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F "
    "12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Characters of a text that are split into words at a time.
SLICE = 1 << 20
#: Entries after which a table of runs, words or arcs is started anew: what an executor holds.
MAX_RUNS, MAX_PIECES, MAX_ARCS = 1 << 18, 1 << 19, 1 << 18
#: A larger vocabulary file is refused instead of sent to every executor.
MAX_VOCABULARY_BYTES = 64 << 20
#: Texts that a task returns together.
ROWS = 512


def pieces_pattern() -> str:
    """How byte-level vocabularies split a text into words: a fixed value, with the Unicode version spelled out."""
    later = "".join("-".join(f"\\U{int(end, 16):08X}" for end in span.split("-")) for span in LATER.split())
    letter, digit, space = f"[\\p{{L}}--[{later}]]", f"[\\p{{N}}--[{later}]]", r"\p{White_Space}"
    other = f"[^{space}{letter}{digit}]"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|{space}+(?!{other}|{letter}|{digit})|{space}+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Automaton:
    """The automaton of one byte-level vocabulary, given as the JSON of its file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or splitter.get("type") != "ByteLevel":
            raise ValueError("Only byte-level BPE vocabularies without a normalizer are supported")
        if splitter["add_prefix_space"] or not splitter["use_regex"] or model.get("ignore_merges"):
            raise ValueError("The vocabulary asks for options that are not supported")
        byte_of = byte_letters()
        vocab = {bytes(byte_of[c] for c in token): n for token, n in model["vocab"].items()}
        self.labels = {n: token for token, n in vocab.items()}
        self.special = {one["content"]: one["id"] for one in spec["added_tokens"]}
        self.labels |= {n: content.encode() for content, n in self.special.items()}
        self.born = dict.fromkeys(self.labels, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        alive = {token: n for token, n in vocab.items() if len(token) == 1}
        if len(alive) != 256:
            raise ValueError("The vocabulary must have a token for every byte")
        for step, pair in enumerate(model["merges"]):
            left, right = (bytes(byte_of[c] for c in half) for half in (pair.split(" ") if isinstance(pair, str) else pair))
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            self.merged.setdefault((u, v), step)
            # The gadget finds something to do only where v can follow u by now.
            if left in alive and right in alive and w not in self.halves and self._arc(u, v, step):
                self.born[w], self.halves[w] = step, (u, v)
                alive[left + right] = w
        self.tokens = alive
        self.reach: dict[bytes, int] = {}
        for token in alive:
            self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self.packed = {n: n.to_bytes(4, "little") for n in self.labels}
        self.arcs: dict[int, bool] = {}
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(pieces_pattern(), regex.V1).findall
        self.split_runs = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.border = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])").search
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def _arc(self, x: int, y: int, before: int) -> bool:
        """Whether the arc x -> y stands just before a step, by going back through the gadgets.

        An arc is there unless its own merge took it away. It came with the later
        of its two tokens: from state x to y because x led to the left half of y,
        or from the new state x because the right half of x led to y. A merge of
        equal halves goes from left to right, so it has taken away the arc to the
        left half of its own result, but not the one from the right half.
        """
        while True:
            step = self.merged.get((x, y))
            if step is not None and step < before:
                return False
            if self.born[x] > self.born[y]:
                before = self.born[x]
                x = self.halves[x][1]
            elif self.born[y] >= 0:
                before = self.born[y] + 1
                y = self.halves[y][0]
            else:
                return True

    def forget(self) -> None:
        """Empty the tables of runs, words and arcs."""
        for table in (self.runs, self.pieces, self.arcs):
            table.clear()

    def arc(self, x: int, y: int) -> bool:
        """Whether y can follow x, by the transition table."""
        key = x << 32 | y
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= MAX_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._arc(x, y, len(self.merged))
        return found

    def spell(self, word: bytes) -> list[int]:
        """The tokens on the one path that spells a word; long tokens are tried first."""
        path: list[tuple[int, int, int]] = []
        ended: set[tuple[int, int]] = set()
        tokens, reach, at, state = self.tokens, self.reach, 0, -1
        size = min(len(word), reach.get(word[:3], 2))
        while at < len(word):
            while size:
                token = tokens.get(word[at : at + size])
                if token is not None and (state < 0 or self.arc(state, token)) and (at + size, token) not in ended:
                    break
                size -= 1
            if size:
                path.append((token, state, size))
                at, state = at + size, token
                size = min(len(word) - at, reach.get(word[at : at + 3], 2))
            else:
                ended.add((at, state))
                _, state, size = path.pop()
                at, size = at - size, size - 1
        return [token for token, _, _ in path]

    def _run(self, run: str) -> bytes:
        """Packed ids of one run: white space and what follows it up to the next white space."""
        known = self.pieces
        packed = b"".join([known.get(piece) or self._piece(piece) for piece in self.split(run)])
        return self._kept(self.runs, MAX_RUNS, run, packed)

    def _piece(self, piece: str) -> bytes:
        return self._kept(self.pieces, MAX_PIECES, piece, b"".join(map(self.packed.__getitem__, self.spell(piece.encode()))))

    @staticmethod
    def _kept(table: dict[str, bytes], most: int, key: str, packed: bytes) -> bytes:
        if len(table) >= most:
            table.clear()
        if len(key) <= 64:
            table[key] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers.

        Words never reach across a change to white space, so runs cut there are
        encoded one by one, each kind of run once.
        """
        packed, at = [], 0
        for found in self.specials.finditer(text):
            packed += [*self._plain(text, at, found.start()), self.packed[self.special[found[0]]]]
            at = found.end()
        return b"".join([*packed, *self._plain(text, at, len(text))])

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        known = self.runs
        while start < end:
            found = self.border(text, start + SLICE, end) if end - start > SLICE else None
            cut = found.start() if found else end
            yield b"".join([known.get(run) or self._run(run) for run in self.split_runs(text, start, cut)])
            start = cut

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: arc labels one after the other, read as UTF-8."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        ids, label, parts = np.frombuffer(packed, "<u4"), self.labels.__getitem__, []
        for at in range(0, len(ids), SLICE):
            parts.append(reader.decode(b"".join(map(label, ids[at : at + SLICE].tolist()))))
        return "".join([*parts, reader.decode(b"", final=True)])


_BUILT: dict[int, Automaton] = {}


def _automaton(source: str) -> Automaton:
    """The automaton of a vocabulary, built once per Python worker."""
    key = hash(source)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(source)
    return _BUILT[key]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def read_vocabulary(path: str) -> str:
    """The vocabulary file at ``path``, which only the driver has to reach."""
    with open(path, encoding="utf-8") as file:
        source = file.read()
    if len(source) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"The vocabulary has more than {MAX_VOCABULARY_BYTES} bytes")
    return source


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row of ``docs`` (doc_id, text).

    ``ids`` holds the token ids as little-endian unsigned 32-bit integers.
    ``vocabulary`` is the content of a vocabulary file (``read_vocabulary``).
    Strings of special tokens are encoded as those tokens; none are added.

    A null text is an empty text and has no tokens. Null and repeated doc_ids are
    carried along, each row for itself. Extra columns are not read. An empty table
    gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for batch in _parts(batches):
            ids = [automaton.encode(text.as_py() or "") for text in batch.column(1)]
            counts = pa.array([len(one) // 4 for one in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )
        automaton.forget()  # the Python worker lives on with other tasks

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``tokens`` (doc_id, n_tokens, ids) with the text that the ids stand for.

    Null ids give an empty text. An id the vocabulary lacks raises an error.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for batch in _parts(batches):
            texts = [automaton.decode(ids.as_py() or b"") for ids in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"]
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary, text string"
    )


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``decode`` of ``encode`` in one pass: doc_id, n_tokens, ids, and the text that the ids stand for.

    A null or empty text has no ids and decodes to the empty text. Every row gives one,
    null and repeated doc_ids too; extra columns are not read, and an empty table gives
    an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value)
        for batch in _parts(batches):
            ids = [automaton.encode(text.as_py() or "") for text in batch.column(1)]
            counts = pa.array([len(one) // 4 for one in ids], pa.int64())
            texts = pa.array(map(automaton.decode, ids), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), counts, pa.array(ids, pa.binary()), texts], ["doc_id", "n_tokens", "ids", "text"]
            )
        automaton.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, text string")

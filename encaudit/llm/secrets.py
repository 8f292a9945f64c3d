"""Secret scan: all rules in one pass over the bytes, by one minimised automaton.

The patterns are compiled together: nondeterministic automata per pattern, the
subset construction over classes of equal bytes, minimisation, and a flat
transition array. Scanning is one array lookup per byte; a state past the border
``accepting`` says which rules have a match ending there. From those ends the mirrored
automaton of the rule runs back over the bytes of its matches and marks where they
begin, so that the time grows with the length of a text and not with its square.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A secret is ``value`` right after ``lead``; shorter values than ``least`` are dropped."""

    kind: str
    lead: str
    value: str
    least: int


#: The base rules.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "", "[0-9a-f]{24,}", 24),
)
#: Published formats of credentials, added to the base rules.
ADDED = (
    Rule("git", "", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", "", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("payment", "", "[rs]k_live_[A-Za-z0-9]+", 32),
    Rule("web_token", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("private_key", "", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
RULES = BASE + ADDED
SPANS = "array<struct<kind:string,start:long,end:long>>"


class Pattern:
    """Nondeterministic automata of patterns: literals, classes, groups, |, ?, *, + and {m,n}."""

    def __init__(self) -> None:
        self.jumps: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.jumps.append([])
        self.steps.append([])
        return len(self.jumps) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        """First and last state of a pattern."""
        self.rest, self.any_case = pattern, False
        first, last = self._choice()
        if self.rest:
            raise ValueError(f"Cannot read the pattern from {self.rest!r}")
        return first, last

    def _take(self, n: int = 1) -> str:
        taken, self.rest = self.rest[:n], self.rest[n:]
        if len(taken) < n:
            raise ValueError("The pattern ends too early")
        return taken

    def _choice(self) -> tuple[int, int]:
        first, last = self.state(), self.state()
        while True:
            a, b = self._sequence()
            self.jumps[first].append(a)
            self.jumps[b].append(last)
            if not self.rest.startswith("|"):
                return first, last
            self._take()

    def _sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.rest and self.rest[0] not in "|)":
            before = self.rest
            a, b = self._one()
            read = before[: len(before) - len(self.rest)]
            for a, b in self._repeated(read, a, b):
                self.jumps[last].append(a)
                last = b
        return first, last

    def _repeated(self, read: str, a: int, b: int) -> list[tuple[int, int]]:
        """The automata in a row that stand for one with its quantifier."""
        least, most = self._quantifier()
        parts = [(a, b)] if most != 0 else []
        while len(parts) < max(least, most or least or 1):
            parts.append(self._copy(read))
        for k, (x, y) in enumerate(parts):
            if k >= least:
                self.jumps[x].append(y)
        if most is None:
            x, y = parts[-1]
            self.jumps[y].append(x)
        return parts

    def _copy(self, read: str) -> tuple[int, int]:
        rest, self.rest = self.rest, read
        one = self._one()
        self.rest = rest
        return one

    def _quantifier(self) -> tuple[int, int | None]:
        if self.rest[:1] in ("?", "*", "+"):
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[self._take()]
        if self.rest[:1] != "{":
            return 1, 1
        bounds, _, self.rest = self.rest[1:].partition("}")
        least, comma, most = bounds.partition(",")
        return int(least), int(most) if most else None if comma else int(least)

    def _one(self) -> tuple[int, int]:
        sign = self._take()
        if sign == "(":
            before = self.any_case
            if self.rest.startswith("?i:"):
                self._take(3)
                self.any_case = True
            found = self._choice()
            if self._take() != ")":
                raise ValueError("A group is not closed")
            self.any_case = before
            return found
        if sign == "[":
            return self._step(self._class())
        return self._step({self._escaped() if sign == "\\" else ord(sign)})

    def _escaped(self) -> int:
        sign = self._take()
        return int(self._take(2), 16) if sign == "x" else ord(sign)

    def _class(self) -> set[int]:
        found: set[int] = set()
        negated = self.rest.startswith("^")
        if negated:
            self._take()
        while not self.rest.startswith("]"):
            sign = self._take()
            low = high = self._escaped() if sign == "\\" else ord(sign)
            if self.rest[0] == "-" and self.rest[1] != "]":
                self._take()
                sign = self._take()
                high = self._escaped() if sign == "\\" else ord(sign)
            found.update(range(low, high + 1))
        self._take()
        return set(range(256)) - found if negated else found

    def _step(self, wanted: set[int]) -> tuple[int, int]:
        if self.any_case:
            letters = {chr(b) for b in wanted if chr(b) in string.ascii_letters}
            wanted = wanted | {ord(c.swapcase()) for c in letters}
        first, last = self.state(), self.state()
        self.steps[first].append((frozenset(wanted), last))
        return first, last

    def mirrored(self) -> Pattern:
        """The same states with all ways turned round: it reads what this one reads, from its end."""
        turned = Pattern()
        for _ in self.jumps:
            turned.state()
        for one, jumps in enumerate(self.jumps):
            for target in jumps:
                turned.jumps[target].append(one)
            for wanted, target in self.steps[one]:
                turned.steps[target].append((wanted, one))
        return turned


@dataclass
class Automaton:
    """Transitions as a flat array: the next state is ``table[state + byte]``.

    States are multiples of 256, the start is 0, and those from ``accepting`` on
    accept the rules in ``accepts``. ``dead`` is the state without a way on.
    """

    table: list[int]
    accepting: int
    accepts: dict[int, tuple[int, ...]]
    dead: int


def compiled(patterns: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """One automaton for all patterns; ``anywhere`` lets a match begin at every byte.

    With ``backwards`` it reads matches from their last byte to their first.
    """
    nfa = Pattern()
    ends = [nfa.add(pattern) for pattern in patterns]
    if backwards:
        nfa, ends = nfa.mirrored(), [(last, first) for first, last in ends]
    final = {last: k for k, (_, last) in enumerate(ends)}

    def closed(states: Iterator[int]) -> frozenset[int]:
        found, open_ = set(), list(states)
        while open_:
            one = open_.pop()
            if one not in found:
                found.add(one)
                open_ += nfa.jumps[one]
        return frozenset(one for one in found if nfa.steps[one] or one in final)

    sets = sorted({wanted for steps in nfa.steps for wanted, _ in steps}, key=sorted)
    kinds: dict[tuple, int] = {}
    kind_of = [kinds.setdefault(tuple(b in wanted for wanted in sets), len(kinds)) for b in range(256)]
    member = {wanted: {kind_of[b] for b in wanted} for wanted in sets}
    start = closed(first for first, _ in ends)
    number, rows, at = {start: 0}, [], 0
    order = [start]
    while at < len(order):
        reached: list[set[int]] = [set() for _ in kinds]
        for one in order[at]:
            for wanted, target in nfa.steps[one]:
                for kind in member[wanted]:
                    reached[kind].add(target)
        row = []
        for targets in reached:
            after = closed(targets) | (start if anywhere else frozenset())
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        rows.append(row)
        at += 1
    accepts = [tuple(sorted(final[one] for one in states if one in final)) for states in order]
    return _laid_out(*_minimal(np.array(rows), accepts), kind_of)


def _minimal(rows: np.ndarray, accepts: list[tuple[int, ...]]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """States that no input tells apart become one; the start stays first."""
    names = {accept: k for k, accept in enumerate(dict.fromkeys(accepts))}
    block, count = np.array([names[accept] for accept in accepts]), len(names)
    while True:
        _, first, block_ = np.unique(np.c_[block, block[rows]], axis=0, return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))
        block = rank[block_.reshape(-1)]
        if len(first) == count:
            keep = np.sort(first)
            return block[rows[keep]], [accepts[k] for k in keep]
        count = len(first)


def _laid_out(rows: np.ndarray, accepts: list[tuple[int, ...]], kind_of: list[int]) -> Automaton:
    """Accepting states last, and one entry per state and byte."""
    order = sorted(range(len(rows)), key=lambda k: bool(accepts[k]))
    if order[0] != 0:
        raise ValueError("A pattern must not match the empty text")
    place = np.argsort(order)
    table = (place[rows[order]][:, kind_of] * 256).reshape(-1).tolist()
    plain = sum(not accept for accept in accepts)
    dead = next((k * 256 for k in range(plain) if k and set(table[k * 256 : k * 256 + 256]) == {k * 256}), -1)
    return Automaton(table, plain * 256, {int(place[k]) * 256: accepts[k] for k in order[plain:]}, dead)


class Scanner:
    """Finds the spans of rules in UTF-8 texts."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.search = compiled([rule.lead + rule.value for rule in rules], anywhere=True)
        self.back = [compiled([rule.lead + rule.value], anywhere=True, backwards=True) for rule in rules]
        self.whole = [compiled([rule.lead + rule.value], anywhere=False) for rule in rules]
        self.lead = [compiled([rule.lead], anywhere=False) if rule.lead else None for rule in rules]

    def ends(self, data: bytes) -> dict[int, list[int]]:
        """For each rule with a match, the last bytes of its matches: the one pass over a text."""
        table, accepting, state, found = self.search.table, self.search.accepting, 0, []
        for at, byte in enumerate(data):
            state = table[state + byte]
            if state >= accepting:
                found.append((at, state))
        ends: dict[int, list[int]] = {}
        for at, state in found:
            for rule in self.search.accepts[state]:
                ends.setdefault(rule, []).append(at)
        return ends

    def spans(self, data: bytes) -> list[dict]:
        """kind, start and end (in characters) of all secrets, by start and then kind as listed."""
        found = [
            (start, k, end) for k, ends in self.ends(data).items() for start, end in self._matches(k, data, ends)
        ]
        spans, seen, at = [], 0, 0
        for start, k, end in sorted(found):
            seen, at = seen + len(data[at:start].decode()), start
            spans.append({"kind": self.rules[k].kind, "start": seen, "end": seen + end - start})
        return spans

    def _starts(self, k: int, data: bytes, ends: list[int]) -> bytearray:
        """A mark at every byte where a match of rule ``k`` begins.

        Read backwards, a match begins where it ends. Between a byte that leaves no
        match open and the end before it there is nothing to read.
        """
        table, accepting, marks = self.back[k].table, self.back[k].accepting, bytearray(len(data))
        unread = len(data)
        for last in reversed(ends):
            if last >= unread:
                continue
            state = 0
            for at in range(last, -1, -1):
                state = table[state + data[at]]
                if state >= accepting:
                    marks[at] = 1
                elif state == 0:
                    break
            unread = at
        return marks

    def _matches(self, k: int, data: bytes, ends: list[int]) -> Iterator[tuple[int, int]]:
        """Leftmost, longest matches that do not overlap; short values are dropped after that."""
        whole, lead, stop = self.whole[k], self.lead[k], ends[-1] + 1
        marks = self._starts(k, data, ends)
        at = marks.find(1)
        while at >= 0:
            end = _longest(whole, data, at, stop)
            value = _longest(lead, data, at, stop) if lead else at
            if end - value >= self.rules[k].least:
                yield at, end
            at = marks.find(1, end)


def _longest(one: Automaton, data: bytes, at: int, stop: int) -> int:
    """End of the longest match that begins at ``at`` and ends by ``stop``, or ``at`` itself."""
    state, end = 0, at
    for place in range(at, stop):
        state = one.table[state + data[place]]
        if state == one.dead:
            break
        if state >= one.accepting:
            end = place + 1
    return end


@functools.lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row of ``docs`` (doc_id, text).

    Positions count characters, the end is exclusive. Spans of one kind do not
    overlap; those of different kinds may. A match whose value is too short is
    dropped, but nothing else of its kind is found inside it.

    A null text is an empty text; without secrets the list is empty. Null and
    repeated doc_ids are carried along, each row for itself. Extra columns are not
    read. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        fields = [pa.field("kind", pa.string()), pa.field("start", pa.int64()), pa.field("end", pa.int64())]
        for batch in batches:
            spans = [scanner.spans(text.as_py() or b"") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct(fields)))], ["doc_id", "spans"]
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, spans {SPANS}"
    )


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    return F.array_join(
        F.transform(spans, lambda one: F.concat_ws(":", one["kind"], one["start"], one["end"])), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base rules, the digest of their spans and all spans, for every row of ``docs``.

    Null and empty texts have no spans: counts of zero and the digest of the empty
    string. Repeated rows and doc_ids are reported each for themselves; columns other
    than doc_id and text are not read. An empty table gives an empty result.
    """
    base = F.filter("spans", lambda one: one["kind"].isin(*(rule.kind for rule in BASE)))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda one: one["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(docs).select(
        "doc_id",
        *(count(rule.kind) for rule in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

"""Personal data replaced by keyed surrogates that keep type, gender, script and format.

Entities are found in the texts and brought to a normal form, so different
spellings of one number or address are one entity. Every different entity of the
corpus draws one surrogate from a keyed hash; a draw that another entity has, or
that is itself an entity of the corpus, is drawn again. The surrogates then take
the place of all mentions, each in the spelling of its mention.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encaudit.session import settle

#: Draws after which the form of a surrogate gets wider with each draw.
MAX_DRAWS = 16

#: What stands before a person's name, by gender.
TITLES = {
    "male": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Don Signor господин г-н κύριος κ.",
    "female": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Señorita Doña Signora госпожа г-жа κυρία κα",
    "given": "Dr Prof Doctor Professor Dra доктор профессор Δρ",
}
#: Lower-case words inside a name, and what follows a name without being part of it.
PARTICLES = set("van von der den de del della di da du la le los las dos das ter ten zu af av".split())
SUFFIXES = set("Jr Sr II III IV".split())
#: Given names and family names of the surrogates.
NAMES = {
    ("male", "LATIN"): "Adam Bruno Carl David Emil Felix Gabriel Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Ralph Simon Thomas Victor",
    ("female", "LATIN"): "Alice Bianca Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Marta Nora Olivia Paula Rosa Sofia Teresa Vera",
    ("family", "LATIN"): "Abel Bauer Carter Dupont Ender Fischer Garcia Hansen Iversen Jansen Keller Lambert Moreno Novak Ortega Petersen Quinn Rossi Schmitt Taylor Ulrich Vidal Weber Young Zeller",
    ("male", "CYRILLIC"): "Алексей Борис Виктор Глеб Дмитрий Егор Захар Игорь Кирилл Леонид Максим Никита Олег Павел Роман",
    ("female", "CYRILLIC"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Марина Нина Ольга Полина Раиса",
    ("family", "CYRILLIC"): "Белых Гончар Дмитрук Заяц Коваль Лисенко Мельник Носенко Осипенко Пономарь Руденко Савченко Ткач Федоренко Шевченко",
    ("male", "GREEK"): "Αλέξανδρος Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Σταύρος",
    ("female", "GREEK"): "Άννα Βασιλική Γεωργία Δέσποινα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία",
    ("family", "GREEK"): "Αθανασίου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παπαδάκη Στεφάνου Χριστοδούλου",
}

NAMES |= {("given", writing): f"{NAMES['male', writing]} {NAMES['female', writing]}" for kind, writing in list(NAMES) if kind == "male"}

_LOCAL = re.compile(r"[\w.%+-]").match
_DOMAIN = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}").match
_NUMBER = re.compile(
    r"(?<![\w.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\w])(?!\.\d)"
    r"|(?<!\w)(?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w)"
    r"|(?<!\w)(?P<social>\d{3}-\d{2}-\d{4})(?!\w)"
    r"|(?<!\w)(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
).finditer
_TITLED = re.compile(
    "(?<!\\w)(?:" + "|".join(f"(?P<{kind}>{'|'.join(map(re.escape, titles.split()))})" for kind, titles in TITLES.items())
    + r")\.?[ \xa0]"
)
_NAME = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*").match
#: No names after a title: the next title. Don is a name as well.
_NO_NAMES = {title for titles in TITLES.values() for title in titles.split()} - {"Don"} | SUFFIXES
_FIELDS = [("kind", pa.string()), ("entity", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
MENTIONS = "array<struct<kind:string,entity:string,start:long,end:long>>"


def _is_ip(found: str) -> bool:
    return all(int(part) <= 255 for part in found.split("."))


def _digits(found: str) -> str:
    return "".join(c for c in found if c.isdecimal())


def _name_parts(text: str, place: int) -> tuple[list[re.Match], list[re.Match]]:
    """The names and the initials of the person whose title ends at a place, particles and further titles left out."""
    parts, initials = [], []
    while more := _TITLED.match(text, place):
        if more.lastgroup != "given":
            break
        place = more.end()
    while name := _NAME(text, place):
        after = name.end()
        if name[0] in _NO_NAMES or name[0] not in PARTICLES and not (name[0][0].isupper() or name[0][1:2] in ("'", "’") and name[0][2].isupper()):
            break
        elif len(name[0]) == 1:
            initials.append(name)
            after += text[after : after + 1] == "."
            if _NAME(text, after):  # the next one without a space
                place = after
                continue
        elif name[0] not in PARTICLES:
            parts.append(name)
        if text[after : after + 1] not in (" ", "\xa0"):
            break
        place = after + 1
    return parts, initials


def mentions(text: str) -> list[dict]:
    """Mentions of entities in a text, in order, none inside another: kind, entity, start and end."""
    found: dict[int, tuple[int, str, str]] = {}
    at = text.find("@")
    while at >= 0:
        first, right = at, _DOMAIN(text, at)
        while right and first and _LOCAL(text, first - 1):
            first -= 1
        if right and first < at:
            found[first] = (right.end(), "email", text[first : right.end()].lower())
        at = text.find("@", at + 1)
    for one in _NUMBER(text):
        kind = one.lastgroup
        if kind != "ip" or _is_ip(one[0]):
            found.setdefault(one.start(), (one.end(), kind, one[0] if kind == "ip" else _digits(one[0])))
    names: dict[str, str] = {}
    for title in _TITLED.finditer(text):
        parts, initials = _name_parts(text, title.end())
        for k, name in enumerate(parts):
            kind = "family" if k == len(parts) - 1 else title.lastgroup
            names.setdefault(name[0].casefold(), kind)
            found.setdefault(name.start(), (name.end(), names[name[0].casefold()], name[0].casefold()))
        for name in initials:
            found.setdefault(name.start(), (name.end(), "initial", name[0].casefold()))
    if names:  # the same person without a title
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)", re.I)
        for name in again.finditer(text):
            entity = name[0].casefold()
            if name[0] != name[0].lower() and entity in names:
                found.setdefault(name.start(), (name.end(), names[entity], entity))
    rows, free = [], 0
    for start, (end, kind, entity) in sorted(found.items(), key=lambda one: (one[0], -one[1][0])):
        if start >= free:
            rows.append({"kind": kind, "entity": entity, "start": start, "end": end})
            free = end
    return rows


class Draw:
    """Numbers from a keyed hash of one entity and the number of the draw."""

    def __init__(self, key: bytes, kind: str, entity: str, number: int) -> None:
        self.state = hmac.digest(key, f"{kind}\0{entity}\0{number}".encode(), "sha256")
        self.left = int.from_bytes(self.state, "big")

    def below(self, n: int) -> int:
        if self.left < n << 64:
            self.state = hashlib.sha256(self.state).digest()
            self.left = int.from_bytes(self.state, "big")
        self.left, found = divmod(self.left, n)
        return found

    def like(self, sign: str) -> str:
        """Another character of the same kind and script; signs stay."""
        if sign.isdecimal():
            zero = ord(sign) - unicodedata.decimal(sign)
            return chr(zero + self.below(10))
        if not sign.isalpha():
            return sign
        if script(sign) == "LATIN":
            letter = chr(ord("a") + self.below(26))
            return letter.upper() if sign.isupper() else letter
        block, kind = ord(sign) & ~0x1F, unicodedata.category(sign)
        return (near := [c for c in map(chr, range(block, block + 32)) if unicodedata.category(c) == kind])[
            self.below(len(near))
        ]


def script(text: str) -> str:
    """Script of the first letter, as its Unicode name begins."""
    letter = next((c for c in text if c.isalpha()), "a")
    return unicodedata.name(letter, "LATIN").split(" ")[0]


def _luhn(digits: str) -> bool:
    doubled = (int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def surrogate(key: bytes, kind: str, entity: str, number: int) -> str:
    """Normal form of the surrogate that an entity draws."""
    draw = Draw(key, kind, entity, number)
    wider = max(0, number - MAX_DRAWS + 1)
    if kind == "email":
        name, _, place = entity.partition("@")
        labels, _, top = place.rpartition(".")
        return "".join(map(draw.like, f"{name}{'a' * wider}@{labels}")) + f".{top}"
    if kind == "ip":
        return ".".join(_octet(draw, 3 if wider else len(part)) for part in entity.split("."))
    if kind in ("card", "phone", "social"):
        digits = entity[0] + "".join(map(draw.like, entity[1:] + "0" * wider))
        if kind == "card":
            checked = (digits[:-1] + d for d in "0123456789")
            return next(one for one in checked if _luhn(one) == _luhn(entity))
        return digits
    if kind == "initial":  # more letters when there are more initials than letters
        return "".join(draw.like(entity) for _ in range(1 + number // 2))
    known = NAMES.get((kind, script(entity)), "").split()
    if not known:
        return "".join(map(draw.like, entity + entity[-1] * wider))
    parts = [known[draw.below(len(known))] for _ in range(1 + number // 2)]
    return "-".join(parts).casefold()


def _octet(draw: Draw, width: int) -> str:
    low = 10 ** (width - 1) if width > 1 else 0
    return str(low + draw.below(min(256, 10**width) - low))


def rendered(kind: str, normal: str, shown: str) -> str:
    """A surrogate in the spelling of the mention it replaces."""
    if kind in ("card", "phone", "social") and len(normal) >= len(_digits(shown)):
        digits = iter(normal)
        return "".join([*(next(digits) if c.isdecimal() else c for c in shown), *digits])
    if kind in ("male", "female", "given", "family", "initial"):
        return normal.upper() if shown.isupper() and len(shown) > 1 else normal.title()
    return normal.upper() if shown.isupper() else normal


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.list_(pa.struct([pa.field(*field) for field in _FIELDS]))
    for batch in batches:
        found = [mentions(text.as_py() or "") for text in batch.column(2)]
        texts = [text.as_py() if one else None for text, one in zip(batch.column(2), found)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(found, rows)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "text", "mentions"])


def find_entities(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text (null without mentions) and mentions of every row of ``docs`` (doc_id, text)."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash.alias("text_hash"), "text").mapInArrow(
        _found, f"doc_id {kind}, text_hash long, text string, mentions {MENTIONS}"
    )


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity and surrogate: one surrogate each, all different, none an entity itself.

    ``entities`` has each (kind, entity) once. Entities that draw the same surrogate
    draw again, all but the smallest; so do those whose draw is taken or real. From
    draw ``MAX_DRAWS`` on the forms get wider, so that all find a free one.
    """

    def drawn(number: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                found = pa.array([surrogate(key, *pair, number) for pair in pairs], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], ["kind", "entity", "surrogate"])

        return pending.mapInArrow(run, "kind string, entity string, surrogate string")

    real = entities.select("kind", F.col("entity").alias("surrogate"))
    pending, accepted = entities.select("kind", "entity"), None
    for number in itertools.count():
        firsts = drawn(number).groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        free = firsts.join(real, ["kind", "surrogate"], "left_anti")
        if accepted is not None:
            free = free.join(accepted, ["kind", "surrogate"], "left_anti")
        free = settle(free.select("kind", "entity", "surrogate"))
        accepted = free if accepted is None else accepted.unionByName(free)
        pending = settle(pending.join(free, ["kind", "entity"], "left_anti"))
        if pending.isEmpty():
            break
    return accepted


def replace_entities(found: DataFrame, key: bytes) -> DataFrame:
    """Documents with mentions (as of ``find_entities``) after replacement.

    Returns doc_id, text_hash, text and replaced (kind, start and end in the old
    text, and the surrogate shown). Rows that repeat doc_id and text come out once.
    Documents without mentions, null and empty texts among them, are left out, and an
    empty table gives none. A null doc_id is a doc_id of its own. Extra columns are not
    read.
    """
    named = found.where(F.size("mentions") > 0).dropDuplicates(["doc_id", "text_hash"])
    each = named.select("doc_id", "text_hash", F.inline("mentions"))
    entities = settle(each.select("kind", "entity").distinct())
    surrogates = assign_surrogates(entities, key)
    given = (
        each.join(surrogates, ["kind", "entity"])
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("given"))
        .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "given")
    )
    joined = named.join(
        given, named["doc_id"].eqNullSafe(given["_doc"]) & (named["text_hash"] == given["_hash"])
    ).select("doc_id", "text_hash", "text", "given")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("shown", pa.string())]
        rows = pa.list_(pa.struct([pa.field(*field) for field in fields]))
        for batch in batches:
            texts, replaced = [], []
            for text, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                parts, at, spans = [], 0, []
                for one in given:
                    shown = rendered(one["kind"], one["surrogate"], text[one["start"] : one["end"]])
                    parts += [text[at : one["start"]], shown]
                    spans.append({"kind": one["kind"], "start": one["start"], "end": one["end"], "shown": shown})
                    at = one["end"]
                texts.append("".join([*parts, text[at:]]))
                replaced.append(spans)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(replaced, rows)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "text", "replaced"])

    kind = found.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:long,end:long,shown:string>>"
    return joined.mapInArrow(write, f"doc_id {kind}, text_hash long, text string, replaced {spans}")


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with surrogates for all personal data.

    Emails, network addresses, card and account numbers, social security and phone
    numbers, and names after a title (with their later mentions in the document)
    are entities. A name goes on to the last capitalised part, over particles and
    initials with a dot; the last part is the family name. Persons without one of
    the ``TITLES`` in their document are not found. One entity has one surrogate in the whole corpus, different
    entities have different ones, and no surrogate is an entity of the corpus.

    A null text stays null; texts without entities stay as they are. Null doc_ids
    and repeated rows are carried along, each row for itself. An empty table gives
    an empty result.
    """
    found = settle(find_entities(docs))
    new = replace_entities(found, key).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("text").alias("_text")
    )
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(new, docs["doc_id"].eqNullSafe(new["_doc"]) & (text_hash == new["_hash"]), "left")
    text = F.coalesce(new["_text"], docs["text"])
    return joined.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns))


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: its mentions, what replaced them, and the text after that (null if it is the same).

    Null and empty texts have no mentions, an empty ``replaced`` and a null text. Rows
    that repeat doc_id and text come out once, a null doc_id is a doc_id of its own,
    extra columns are not read, and an empty table gives no rows.
    """
    found = settle(find_entities(docs).dropDuplicates(["doc_id", "text_hash"]))
    new = replace_entities(found, key).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "text", "replaced"
    )
    rows = found.select("doc_id", "text_hash", F.size("mentions").cast("long").alias("n_mentions"))
    span = F.transform("replaced", lambda one: F.concat_ws(":", one["kind"], one["start"], one["end"], one["shown"]))
    return rows.join(
        new, rows["doc_id"].eqNullSafe(new["_doc"]) & (rows["text_hash"] == new["_hash"]), "left"
    ).select("doc_id", "n_mentions", F.coalesce(F.array_join(span, ","), F.lit("")).alias("replaced"), "text")

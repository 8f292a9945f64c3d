"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def components(nodes, linked) -> dict:
    """Smallest node reachable from each, when ``linked`` tells which pairs are."""
    root = {node: node for node in nodes}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in itertools.combinations(sorted(root), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {node: find(node) for node in root}


def line_rows(docs) -> dict:
    """For each doc_id its number of lines and the (place, doc of the line that stays) of removed ones."""
    lines = [
        (doc, k, line)
        for doc, text in sorted(docs)
        for k, line in enumerate((text or "").split("\n"))
        if line and not line.isspace()
    ]
    grams = {line: {line[i : i + 8] for i in range(max(1, len(line) - 7))} for _, _, line in lines}
    owner = defaultdict(set)
    for line, found in grams.items():
        for gram in found:
            owner[gram].add(line)
    close = set()
    for line, found in grams.items():
        for other in set().union(*(owner[gram] for gram in found)):
            shared = len(found & grams[other])
            if line < other and shared >= 0.8 * (len(found) + len(grams[other]) - shared):
                close.add((line, other))
    root = {line: line for line in grams}

    def find(line):
        while root[line] != line:
            line = root[line]
        return line

    for a, b in close:
        root[find(a)] = find(b)
    first, rows = {}, {doc: (0, []) for doc, _ in docs}
    for doc, k, line in lines:
        stays = first.setdefault(find(line), (doc, k))
        n, gone = rows[doc]
        rows[doc] = (n + 1, gone if stays == (doc, k) else [*gone, (k, stays[0])])
    return rows


def fingerprint(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(one.encode(), seed=42).intdigest() for one in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash_rows(docs) -> list:
    prints = {doc: fingerprint(text) for doc, text in docs}
    roots = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    return sorted((doc, f"{one:016x}", roots[doc]) for doc, one in prints.items())


def words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination_rows(docs, items) -> list:
    grams = defaultdict(set)
    for item, text in items:
        said = words(text)
        n = min(13, len(said))
        for i in range(len(said) - n + 1 if n else 0):
            grams[tuple(said[i : i + n])].add(str(item))
    rows = []
    for doc, text in docs:
        said, hit, found = words(text), set(), set()
        for n in {len(gram) for gram in grams}:
            for i in range(len(said) - n + 1):
                if owners := grams.get(tuple(said[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        bad = bool(hit) and 20 * len(hit) >= len(said)
        rows.append((doc, len(said), len(hit), len(found), sha(",".join(sorted(found))), bad))
    return sorted(rows)


def secret_rows(docs) -> list:
    kinds = ["assign", "access", "hex"]
    assign = re.compile(
        r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    rows = []
    for doc, text in docs:
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        spans = ",".join(f"{kinds[k]}:{start}:{end}" for start, k, end in sorted(found))
        rows.append((doc, *(sum(k == n for _, k, _ in found) for n in range(3)), sha(spans)))
    return sorted(rows)


def repeat_rows(docs, length=100) -> list:
    seen, rows = set(), []
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            one = data[i : i + length]
            if one in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(one)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rows.append((doc, len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return rows


def five_word_shingles(text: str) -> set:
    said = re.split(r"[ \t\n\x0b\f\r]+", text.lower())
    return {tuple(said[at : at + 5]) for at in range(max(1, len(said) - 4))}


def without_copies(texts: dict) -> dict:
    """Of texts with labels, the smallest text of every group of near copies with the same label, by comparing all pairs."""
    sets = {text: five_word_shingles(text) for text in texts}
    group = {text: text for text in texts}
    for one, other in itertools.combinations(texts, 2):
        both = len(sets[one] & sets[other])
        if texts[one] == texts[other] and 10 * both >= 8 * (len(sets[one]) + len(sets[other]) - both):
            old, new = group[one], group[other]
            group = {text: new if of == old else of for text, of in group.items()}
    members = defaultdict(list)
    for text, of in group.items():
        members[of].append(text)
    return {min(same): texts[min(same)] for same in members.values()}


class PlainReader:
    """What a disguised word may stand for: every way to read it from each place on, the cheapest first."""

    SEEMS = {
        "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c",
    }
    EDGES = "\"'.,;:!?()[]{}<>*#%&/\\=~^`-_|+"

    def __init__(self, texts) -> None:
        self.three, self.two = Counter(), Counter()
        for text in texts:
            letters = ["", "", *(c if c.isalpha() else "" for c in (text or "").lower()), ""]
            for a, b, c in zip(letters, letters[1:], letters[2:]):
                if b or c:
                    a = a if b else ""
                    self.three[a, b, c] += 1
                    self.two[a, b] += 1

    def cost(self, a: str, b: str, c: str) -> float:
        a = a if b else ""
        return -math.log((self.three[a, b, c] + 0.1) / (self.two[a, b] + 6.4))

    def read(self, seen: str) -> list[str]:
        @functools.cache
        def best(at: int, a: str, b: str) -> tuple[float, str]:
            if at == len(seen):
                return self.cost(a, b, ""), ""
            sign, ways = seen[at], []
            if sign.isalpha() or sign in self.SEEMS:
                for letter in sign if sign.isalpha() else self.SEEMS[sign]:
                    rest, said = best(at + 1, b, letter)
                    ways.append((self.cost(a, b, letter) + (not sign.isalpha()) + rest, letter + said))
                if sign.isalpha() and at and sign == seen[at - 1] and 3 * sign in seen[max(0, at - 2) : at + 2]:
                    rest, said = best(at + 1, a, b)
                    ways.append((0.5 + rest, said))
            else:
                rest, said = best(at + 1, a, b)
                ways.append((0.5 + rest, said))
                if b:
                    rest, said = best(at + 1, "", "")
                    ways.append((1.0 + self.cost(a, b, "") + rest, " " + said))
            return min(ways)

        return best(0, "", "")[1].split()

    def words(self, token: str) -> list[str]:
        core = token.strip(self.EDGES)
        if core.isalpha():
            return [core, *(self.read(core) if any(3 * c in core for c in core) else [])]
        shown = token.rstrip(self.EDGES)
        while shown and shown[0] in self.EDGES and shown[0] not in "!|+":
            shown = shown[1:]
        letters, signs, figures = (
            any(test(c) for c in shown) for test in (str.isalpha, self.SEEMS.__contains__, str.isdecimal)
        )
        spells = letters or (signs and ("@" in shown or not figures))
        return [*re.findall(r"[^\W\d_]+", core), *(self.read(shown) if spells else [])]

    def of_text(self, text: str) -> set:
        lowered, edge = text.lower(), f"[{re.escape(self.EDGES)}]*"
        tokens = set(lowered.split())
        tokens |= {" ".join(m.split()) for m in re.findall(rf"(?<!\S){edge}\S(?:\s+\S){{2,}}{edge}(?!\S)", lowered)}
        return {word for token in tokens for word in self.words(token)}


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(3, min(len(word), 7) + 1)] + [word + "$"]


def toxic_scores(docs, labels) -> dict:
    """Scores by counting letters, word beginnings and documents one by one."""
    reader = PlainReader(text for _, text in docs)
    marked = {doc: toxic for doc, toxic in labels if zlib.crc32(str(doc).encode()) % 4 != 2}
    texts = defaultdict(int)
    for doc, text in docs:
        if doc in marked:
            texts[text or ""] = max(texts[text or ""], marked[doc])
    table = defaultdict(lambda: [0, 0])
    for text, toxic in without_copies(texts).items():
        for feature in {"", *(f for word in reader.of_text(text) for f in beginnings(word))}:
            table[feature][toxic] += 1
    clean, toxic = table[""]
    base = toxic / (clean + toxic) if texts else 0.0

    def bound(pair, z):
        n, p = sum(pair), pair[1] / sum(pair)
        return (p + z * abs(z) / 2 / n * (1 if z > 0 else -1) + z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (
            1 + z * z / n
        )

    scores = {}
    for doc, text in docs:
        risks = set()
        for word in reader.of_text(text or ""):
            risk, sure = base, False
            for feature in beginnings(word):
                if feature in table:
                    low, high = bound(table[feature], -4.0), bound(table[feature], 1.0)
                    sure = sure or low > base
                    if low > base or sure:
                        risk = min(max(risk, low), high)
            risks.add(max(risk, base))
        scores[doc] = max(risks, default=base)
    return scores

"""Small independent models the Spark results are compared with."""

from __future__ import annotations

import random

MARK = "�"


def contexts_by_scanning(text: str, comment_starts: dict[str, str], triple: bool) -> list[str]:
    """Context of every U+FFFD by jumping from opener to opener.

    ``comment_starts`` maps an opener to what closes it; an unknown closer ends the file.
    """
    found: list[str] = []
    here = 0
    while here < len(text):
        opener = next((o for o in comment_starts if text.startswith(o, here)), None)
        quote = text[here] if text[here] in "\"'" else None
        if opener:
            end = text.find(comment_starts[opener], here + len(opener))
            stop = len(text) if end < 0 else end + len(comment_starts[opener])
            kind = "comment"
        elif quote and triple and text.startswith(quote * 3, here):
            end = text.find(quote * 3, here + 3)
            stop = len(text) if end < 0 else end + 3
            kind = "code"
        elif quote:
            stop = here + 1
            while stop < len(text) and text[stop] != quote:
                stop += 2 if text[stop] == "\\" else 1
            stop = min(stop + 1, len(text))
            kind = "code"
        else:
            stop, kind = here + 1, "code"
        found += [kind] * text.count(MARK, here, stop)
        here = stop
    return found


def c_contexts(text: str) -> list[str]:
    return contexts_by_scanning(text, {"//": "\n", "/*": "*/"}, triple=False)


def python_contexts(text: str) -> list[str]:
    return contexts_by_scanning(text, {"#": "\n"}, triple=True)


# label -> (codec, searched bytes, is the damage visible, unit size)
CODECS = {
    "utf-8": ("utf-8", "efbfbd", True, 1),
    "utf-8-sig": ("utf-8", "efbfbd", True, 1),
    "utf-16": ("utf-16-le", "fdff", True, 2),
    "utf-16be": ("utf-16-be", "fffd", True, 2),
    "utf-32": ("utf-32-le", "fdff0000", True, 4),
    "iso-8859-1": ("latin-1", "efbfbd", False, 1),
    "windows-1252": ("cp1252", "efbfbd", False, 1),
    "ascii": ("ascii", "efbfbd", True, 1),
}
BOMS = {"utf-8-sig": b"\xef\xbb\xbf", "utf-16": b"\xff\xfe", "utf-32": b"\xff\xfe\x00\x00"}


def findings_by_prefix(content: bytes, label: str) -> list[tuple]:
    """(byte position, index, line, position, visible) by decoding every prefix anew."""
    codec, pattern, visible, unit = CODECS[label]
    searched = bytes.fromhex(pattern)
    bom = BOMS.get(label, b"")
    skip = len(bom) if bom and content.startswith(bom) else 0
    rows, offset = [], content.find(searched, skip)
    while offset >= 0:
        if (offset - skip) % unit == 0:
            before = content[skip:offset].decode(codec, "replace")
            column = len(before) - (before.rfind("\n") + 1)
            rows.append(
                (
                    offset,
                    len(before) if visible else None,
                    before.count("\n") + 1,
                    column if visible else -1,
                    visible,
                )
            )
            offset = content.find(searched, offset + len(searched))
        else:
            offset = content.find(searched, offset + 1)
    return rows


def random_text(seed: random.Random, alphabet: str, size: int) -> str:
    return "".join(seed.choice(alphabet) for _ in range(seed.randrange(size)))

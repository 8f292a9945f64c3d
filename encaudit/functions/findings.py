"""Damaged characters of one file as an array column.

Everything is computed inside the row that holds the file: the text is split at
the damaged characters, the parts are measured, and a running combination of
the measures gives byte offset, index, line and position of each. So finding
them is a map over the files without a shuffle, and the text never leaves the
task that read it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from encaudit.functions.arrays import bind, running
from encaudit.functions.charsets import (
    REPLACEMENT,
    body_of,
    decode_lossy,
    decode_plan,
    from_single_byte,
    is_jvm,
    is_single_byte,
    latin1_view,
    scan_pattern,
    utf8_view,
)
from encaudit.functions.contexts import COMMENT, marker_contexts, marker_count

# The UTF-8 bytes of U+FFFD as a single-byte charset shows them.
_HIDDEN = "\xef\xbf\xbd"

# Letters and marks make up a word; a damaged character may have been one.
LETTER = r"[\p{L}\p{M}]"
UP_TO_LAST_NOT_LETTER = r"(?s)\A.*[^\p{L}\p{M}]"
# A word is tried at its first letter only: the time stays linear in the text.
DAMAGED_WORD = rf"(?<!{LETTER}){LETTER}*+{REPLACEMENT}[\p{{L}}\p{{M}}{REPLACEMENT}]*+"

FINDING_FIELDS = [
    "finding_no",
    "line",
    "char_position",
    "char_found",
    "byte_sequence_file_pos",
    "absolute_char_index",
    "comment_context",
    "is_commented",
]


LINES = "array<struct<line: int, string: string, line_text: string>>"


def has_damage(content: Column, plan: Column) -> Column:
    """Cheap test on the raw bytes that every file with findings passes."""
    pattern = bind(plan["family"], scan_pattern)
    return F.coalesce(F.contains(content, pattern), F.lit(False))


def scan_text(body: Column, family: Column) -> Column:
    """Text in which U+FFFD stands exactly where the searched bytes are.

    One U+FFFD also where a legacy charset shows the bytes as other characters. Input that does not decode becomes ``?``.
    """
    hidden = F.lit(_HIDDEN)
    visible = F.lit(REPLACEMENT)
    mended = decode_lossy(body, family, "?")
    between = F.transform(
        _raw_parts(body, family),
        lambda part: decode_lossy(F.encode(part, "ISO-8859-1"), family, "?"),
    )
    marked = F.replace(latin1_view(body), hidden, visible)
    return (
        F.when(family == "ascii", F.regexp_replace(marked, "[\x80-\xff]", "?"))
        .when(is_single_byte(family), from_single_byte(marked, family, "?"))
        .when(is_jvm(family), F.array_join(between, REPLACEMENT))
        .otherwise(mended)
    )


def _raw_parts(body: Column, family: Column) -> Column:
    """What lies between the searched bytes of a multi-byte charset, one character per byte."""
    view = latin1_view(body)
    own = "\x84\x31\xa4\x37"
    return F.when(family == "jvm:GB18030", F.split(view, own, -1)).otherwise(F.split(view, _HIDDEN, -1))


def is_hidden(family: Column) -> Column:
    """True where the charset has no U+FFFD and shows its UTF-8 bytes as something else."""
    return is_single_byte(family) | (is_jvm(family) & (family != "jvm:GB18030"))


def part_bytes(body: Column, family: Column, parts: Column) -> Column:
    """Byte length of every part between damaged characters."""
    well_formed = F.is_valid_utf8(utf8_view(body))
    return (
        F.when((family == "utf8") & well_formed, F.transform(parts, F.octet_length))
        .when(family == "utf8", F.transform(F.split(latin1_view(body), _HIDDEN, -1), F.length))
        .when(
            family.isin("utf16le", "utf16be"),
            F.transform(parts, lambda part: F.octet_length(F.encode(part, "UTF-16LE"))),
        )
        .when(
            family.isin("utf32le", "utf32be"), F.transform(parts, lambda part: F.length(part) * 4)
        )
        .when(is_jvm(family), F.transform(_raw_parts(body, family), F.length))
        .otherwise(F.transform(parts, F.length))
    )


def measure(
    part: Column, n_bytes: Column, number: Column, chars: Column, width: Column, with_word: bool
) -> Column:
    """Measures of one part together with the damaged character before it."""
    follows = number > 0
    lines = marker_count(part, "\n")
    length = F.length(part) + F.when(follows, chars).otherwise(0)
    fields = [
        length.cast("long").alias("chars"),
        (n_bytes + F.when(follows, width).otherwise(0)).cast("long").alias("bytes"),
        lines.alias("lines"),
        F.when(lines == 0, length)
        .otherwise(F.length(F.substring_index(part, "\n", -1)))
        .alias("tail"),
    ]
    if not with_word:
        return F.struct(*fields)
    # everything up to the last character that is no letter
    closed_part = F.length(F.regexp_extract(part, UP_TO_LAST_NOT_LETTER, 0))
    return bind(
        closed_part,
        lambda closed: F.struct(
            *fields,
            (closed > 0).alias("closed"),
            (
                F.length(part) - closed + F.when(follows & (closed == 0), 1).otherwise(0)
            ).alias("run"),
        ),
    )


def combine_measures(with_word: bool):
    def combine(before: Column, item: Column) -> Column:
        fields = [
            (before["chars"] + item["chars"]).alias("chars"),
            (before["bytes"] + item["bytes"]).alias("bytes"),
            (before["lines"] + item["lines"]).alias("lines"),
            F.when(item["lines"] > 0, item["tail"])
            .otherwise(before["tail"] + item["tail"])
            .alias("tail"),
        ]
        if with_word:
            fields += [
                (before["closed"] | item["closed"]).alias("closed"),
                F.when(item["closed"], item["run"])
                .otherwise(before["run"] + item["run"])
                .alias("run"),
            ]
        return F.struct(*fields)

    return combine


def raw_offsets(content: Column, label: Column) -> Column:
    """Byte offset of every searched byte sequence, mark included."""
    return F.transform(
        finding_array(content, label, F.lit("")), lambda f: f["byte_sequence_file_pos"]
    )


def finding_array(
    content: Column,
    label: Column,
    extension: Column,
    with_word: bool = False,
) -> Column:
    """Findings of a file in document order, as an array of structs.

    ``with_word`` adds the damaged word around each damaged character and the
    offset inside it; the lines are a table of their own (``line_array``). A file
    without findings, or whose charset is not supported, gives an empty array.
    """
    none = F.array().cast(_array_type(with_word))

    def planned(bound: Column) -> Column:
        start = F.struct(
            bound["content"].alias("content"),
            decode_plan(bound["content"], bound["label"]).alias("plan"),
            F.lower(bound["extension"]).alias("extension"),
        )
        return bind(
            start,
            lambda file: F.when(
                has_damage(file["content"], file["plan"]), scanned(file)
            ).otherwise(none),
        )

    def scanned(bound: Column) -> Column:
        family = bound["plan"]["family"]
        skip = bound["plan"]["skip"]
        return bind(
            F.struct(
                body_of(bound["content"], skip).alias("body"),
                family.alias("family"),
                skip.alias("skip"),
                bound["extension"].alias("extension"),
            ),
            lambda part: bind(
                F.struct(
                    part["body"].alias("body"),
                    part["family"].alias("family"),
                    part["skip"].alias("skip"),
                    scan_text(part["body"], part["family"]).alias("text"),
                    part["extension"].alias("extension"),
                ),
                measured,
            ),
        )

    def measured(bound: Column) -> Column:
        contexts = marker_contexts(bound["text"], bound["extension"])
        return bind(
            F.split(bound["text"], REPLACEMENT, -1),
            lambda parts: bind(
                F.struct(
                    bound["family"].alias("family"),
                    bound["skip"].alias("skip"),
                    parts.alias("parts"),
                    part_bytes(bound["body"], bound["family"], parts).alias("sizes"),
                    contexts.alias("contexts"),
                    _words(bound["text"], with_word).alias("words"),
                ),
                numbered,
            ),
        )

    def numbered(bound: Column) -> Column:
        family = bound["family"]
        single = is_single_byte(family) | (family == "ascii")
        chars = F.when(single, 3).otherwise(1)
        width = F.octet_length(scan_pattern(family))
        pairs = F.arrays_zip(bound["parts"].alias("part"), bound["sizes"].alias("size"))
        items = F.transform(
            F.slice(pairs, F.lit(1), F.size(pairs) - 1),
            lambda pair, number: measure(
                pair["part"], pair["size"], number, chars, width, with_word
            ),
        )
        visible = ~is_hidden(family)
        return bind(
            F.struct(
                running(items, combine_measures(with_word)).alias("states"),
                bound["contexts"].alias("contexts"),
                bound["words"].alias("words"),
                visible.alias("visible"),
                bound["skip"].alias("skip"),
            ),
            rows,
        )

    def rows(bound: Column) -> Column:
        def row(state: Column, number: Column) -> Column:
            context = F.get(bound["contexts"], number)
            fields = [
                (number + 1).alias("finding_no"),
                (state["lines"] + 1).alias("line"),
                F.when(bound["visible"], state["tail"]).otherwise(-1).alias("char_position"),
                bound["visible"].alias("char_found"),
                (bound["skip"] + state["bytes"]).alias("byte_sequence_file_pos"),
                F.when(bound["visible"], state["chars"]).alias("absolute_char_index"),
                context.alias("comment_context"),
                (context == COMMENT).alias("is_commented"),
            ]
            if with_word:
                fields += [
                    F.get(bound["words"], number).alias("word"),
                    state["run"].alias("word_offset"),
                ]
            return F.struct(*fields)

        return F.transform(bound["states"], row)

    given = F.struct(
        content.alias("content"), label.alias("label"), extension.alias("extension")
    )
    return bind(given, planned)


def line_array(content: Column, label: Column) -> Column:
    """The lines of a file that hold damage, each once: ``line``, ``string`` and ``line_text``.

    The text is as its charset shows it, without a closing CR; ``string`` is also
    without the indent.
    """
    none = F.array().cast(LINES)

    def shown(file: Column) -> Column:
        family = file["plan"]["family"]
        return bind(
            F.struct(
                body_of(file["content"], file["plan"]["skip"]).alias("body"), family.alias("family")
            ),
            lambda part: F.arrays_zip(
                F.split(scan_text(part["body"], part["family"]), "\n", -1).alias("scanned"),
                F.split(decode_lossy(part["body"], part["family"]), "\n", -1).alias("text"),
            ),
        )

    def numbered(pair: Column, number: Column) -> Column:
        text = F.regexp_replace(pair["text"], r"\r\z", "")
        damaged = F.contains(pair["scanned"], F.lit(REPLACEMENT))
        row = F.struct(
            (number + 1).alias("line"),
            F.regexp_replace(text, r"^[ \t]+", "").alias("string"),
            text.alias("line_text"),
        )
        return F.when(damaged, row)

    start = F.struct(content.alias("content"), decode_plan(content, label).alias("plan"))
    return bind(
        start,
        lambda file: F.when(
            has_damage(file["content"], file["plan"]),
            F.array_compact(F.transform(shown(file), numbered)),
        ).otherwise(none),
    )


def _words(text: Column, wanted: bool) -> Column:
    """The damaged word of every damaged character, in order."""
    if not wanted:
        return F.lit(None).cast("array<string>")
    words = F.regexp_extract_all(text, F.lit(DAMAGED_WORD), F.lit(0))
    return F.flatten(
        F.transform(
            words,
            lambda word: F.array_repeat(word, marker_count(word)),
        )
    )


def _array_type(with_word: bool) -> str:
    fields = (
        "finding_no: int, line: int, char_position: int, char_found: boolean, "
        "byte_sequence_file_pos: bigint, absolute_char_index: bigint, "
        "comment_context: string, is_commented: boolean"
    )
    if with_word:
        fields += ", word: string, word_offset: int"
    return f"array<struct<{fields}>>"

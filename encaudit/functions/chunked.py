"""Parts of a file that can be read on their own: where they may be cut, and what each adds up to.

A file of any size is a table of chunks of equal length, each with a few bytes of its
neighbours. A cut is moved to the next place where a decoder starts anew, which both
neighbours work out from the same bytes. What a chunk measures (characters, lines, the
end of its last line) and how it changes the state of the comment scanner are values
that combine along the file, so its findings need only the totals before them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from encaudit.functions.arrays import bind, running
from encaudit.functions.charsets import REPLACEMENT, is_single_byte, latin1_view, scan_pattern
from encaudit.functions.contexts import (
    C_LIKE_EXTENSIONS,
    C_TOKENS,
    PYTHON_EXTENSIONS,
    PYTHON_TOKENS,
    is_c_comment,
    is_python_comment,
    token_flags,
)
from encaudit.functions.findings import combine_measures, is_hidden, measure, part_bytes, scan_text

#: Bytes of its neighbours that a chunk knows, before and after it.
REACH = 4

# What a scanner that is inside a token has to see again to go on with it: the states between chunks.
# A quoted string is shown with its quote (and one letter, where bare quotes may still become three).
C_STATES = ["", "/", "//", "/*", "/**", '"', '"\\', "'", "'\\"]
PYTHON_STATES = ["", "#"] + [
    state.replace('"', quote)
    for quote in "\"'"
    for state in ('"', '""', '"a', '"\\', '"""', '""""', '"""""')
]


def cut_shift(before: Column, after: Column, family: Column) -> Column:
    """How many bytes later than between ``before`` and ``after`` a file of the family may be cut: 0 to 3.

    UTF-8 may be cut in front of every byte that cannot continue a character, and of a
    fourth continuing byte in a row. Surrogates stay together, and so do the three bytes
    that stand for damage where a charset has no sign for it.
    """
    left = F.lpad(F.substring(latin1_view(before), -3, 3), 3, " ")
    seen = F.concat(left, F.rpad(latin1_view(F.substring(after, 1, REACH)), REACH, " "))
    kinds = F.regexp_replace(F.regexp_replace(seen, "[^\x80-\xbf]", "x"), "[\x80-\xbf]", "c")
    utf8 = F.length(F.regexp_extract(kinds, "^(.{0,3}?)(?:...x|ccc)", 1))
    hidden = F.when(seen.rlike("(?s)^..\xef\xbf\xbd"), 2).when(seen.rlike("(?s)^.\xef\xbf\xbd"), 1)
    # half a unit at the end of a file is one mistake with half a character before it
    last = F.octet_length(after) == 1

    def surrogates(high: str, low: str) -> Column:
        return F.when(seen.rlike(high + low), 2).when(last & seen.rlike(high), 1)

    return (
        F.when(family == "utf8", utf8)
        .when(family == "utf16le", surrogates("(?s)^..[\xd8-\xdb]", ".[\xdc-\xdf]"))
        .when(family == "utf16be", surrogates("(?s)^.[\xd8-\xdb].", "[\xdc-\xdf]"))
        .when(is_single_byte(family) | (family == "ascii"), hidden)
    )


def chunk_body(chunk: Column, family: Column, skip: Column) -> Column:
    """``start`` and ``body`` of a chunk between its moved cuts, the mark of the file left out.

    ``chunk`` has chunk_no, start, before, content and after.
    """
    content, after = chunk["content"], chunk["after"]
    edges = F.struct(
        F.when(chunk["chunk_no"] == 0, skip)
        .otherwise(F.coalesce(cut_shift(chunk["before"], content, family), F.lit(0)))
        .alias("first"),
        F.coalesce(cut_shift(content, after, family), F.lit(0)).alias("more"),
    )
    return bind(
        edges,
        lambda edge: F.struct(
            (chunk["start"] + edge["first"]).alias("start"),
            F.concat(
                F.substring(content, edge["first"] + 1, F.octet_length(content)),
                F.substring(after, F.lit(1), edge["more"]),
            ).alias("body"),
        ),
    )


def chunk_scan(body: Column, family: Column, extension: Column, first: Column) -> Column:
    """What a chunk holds: ``found``, the measures up to each damaged character, ``total``, and ``steps``.

    ``steps`` has, for every state the scanner may be in before the chunk, its state
    after it and whether each damaged character is in a comment. The first chunk of a
    file begins in the state ``""``; so do files without comments to scan for.
    """
    start = F.struct(body.alias("body"), family.alias("family"), extension.alias("extension"), first.alias("first"))

    def shown(part: Column) -> Column:
        return bind(
            F.struct(
                *(part[name].alias(name) for name in ("body", "family", "extension", "first")),
                scan_text(part["body"], part["family"]).alias("text"),
            ),
            split,
        )

    def split(part: Column) -> Column:
        parts = F.split(part["text"], REPLACEMENT, -1)
        return bind(
            F.struct(part["body"].alias("body"), part["family"].alias("family"), parts.alias("parts")),
            lambda held: F.struct(
                _states(held).alias("states"), _steps(part["text"], part["extension"], part["first"]).alias("steps")
            ),
        )

    def result(part: Column) -> Column:
        states = part["states"]
        return F.struct(
            F.slice(states, F.lit(1), F.size(states) - 1).alias("found"),
            F.element_at(states, -1).alias("total"),
            part["steps"].alias("steps"),
        )

    return bind(bind(start, shown), result)


def _states(held: Column) -> Column:
    """Running measures at the end of every part between damaged characters."""
    family = held["family"]
    chars = F.when(is_single_byte(family) | (family == "ascii"), 3).otherwise(1)
    width = F.octet_length(scan_pattern(family))
    pairs = F.arrays_zip(
        held["parts"].alias("part"), part_bytes(held["body"], family, held["parts"]).alias("size")
    )
    items = F.transform(
        pairs, lambda pair, number: measure(pair["part"], pair["size"], number, chars, width, False)
    )
    return running(items, combine_measures(False))


def _steps(text: Column, extension: Column, first: Column) -> Column:
    nothing = F.array(F.lit(""))

    def stepped(states: list[str], pattern: str, is_comment, state_after) -> Column:
        starts = F.when(first, nothing).otherwise(F.array(*map(F.lit, states)))

        def step(state: Column) -> Column:
            tokens = F.regexp_extract_all(F.concat(state, text), F.lit(pattern), F.lit(0))
            return bind(
                tokens,
                lambda found: F.struct(
                    state.alias("before"),
                    state_after(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))).alias("after"),
                    token_flags(found, is_comment).alias("flags"),
                ),
            )

        return F.transform(starts, step)

    plain = F.array(
        F.struct(F.lit("").alias("before"), F.lit("").alias("after"), F.array().cast("array<boolean>").alias("flags"))
    )
    return (
        F.when(extension.isin(C_LIKE_EXTENSIONS), stepped(C_STATES, C_TOKENS, is_c_comment, _after_c))
        .when(extension.isin(PYTHON_EXTENSIONS), stepped(PYTHON_STATES, PYTHON_TOKENS, is_python_comment, _after_python))
        .otherwise(plain)
    )


def _after_quoted(token: Column, quote: str, inside: str) -> Column:
    whole = rf"(?s)^{quote}[^{quote}\\]*+(?:\\.[^{quote}\\]*+)*+"
    return (
        F.when(token.rlike(whole + rf"{quote}\z"), "").when(token.rlike(whole + r"\\\z"), quote + "\\").otherwise(inside)
    )


def _after_c(token: Column) -> Column:
    """The state after a last token: of one that has ended, ``""``."""
    long = F.length(token)
    block = F.when((long >= 4) & token.endswith("*/"), "").when((long >= 3) & token.endswith("*"), "/**")
    return (
        F.when(token.startswith("//"), F.when(token.endswith("\n"), "").otherwise("//"))
        .when(token.startswith("/*"), block.otherwise("/*"))
        .when(token == "/", "/")
        .when(token.startswith('"'), _after_quoted(token, '"', '"'))
        .when(token.startswith("'"), _after_quoted(token, "'", "'"))
        .otherwise("")
    )


def _after_python(token: Column) -> Column:
    after = F.when(token.startswith("#"), F.when(token.endswith("\n"), "").otherwise("#"))
    for quote in "\"'":
        body = F.substring(token, F.lit(4), F.length(token))
        open_triple = (
            F.when(body.endswith(2 * quote), 5 * quote).when(body.endswith(quote), 4 * quote).otherwise(3 * quote)
        )
        triple = F.when((F.length(token) >= 6) & token.endswith(3 * quote), "").otherwise(open_triple)
        after = (
            after.when(token.startswith(3 * quote), triple)
            .when(token.isin(quote, 2 * quote), token)
            .when(token.startswith(quote), _after_quoted(token, quote, quote + "a"))
        )
    return after.otherwise("")


def is_visible(family: Column) -> Column:
    """True where the charset has a sign for damage of its own."""
    return ~is_hidden(family)

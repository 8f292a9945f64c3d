"""Is a place in a source file code or comment?

A regular expression cuts the text into tokens that cover it without a gap:
comments, quoted strings and runs of other text. A token is a comment or it is
not, so every place inside it has the context of its token. Quotes follow the
usual backslash rule and may run over line ends; a comment or string that never
ends runs to the end of the file. Possessive quantifiers keep the matcher from
recursing on long files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from encaudit.functions.charsets import REPLACEMENT

# Context names and the extensions each comment syntax covers.
CODE = "code"
COMMENT = "comment"
UNSUPPORTED = "unsupported"
C_LIKE_EXTENSIONS = [".c", ".cs", ".cpp", ".h", ".hpp"]
PYTHON_EXTENSIONS = [".py"]

_QUOTED = (
    r""""[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)"""
    r"""|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z)"""
)
C_TOKENS = rf"""(?s)//[^\n]*+\n?|/\*.*?(?:\*/|\z)|{_QUOTED}|[^/"']++|/"""
PYTHON_TOKENS = (
    rf"""(?s)#[^\n]*+\n?|"{{3}}.*?(?:"{{3}}|\z)|'{{3}}.*?(?:'{{3}}|\z)|{_QUOTED}|[^#"']++"""
)

# Characters that count as blank when looking for the first one of a line (no newline).
BLANK = r"[\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def marker_count(text: Column, marker: str = REPLACEMENT) -> Column:
    """How often a one-character marker occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))


def is_c_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def is_python_comment(token: Column) -> Column:
    return token.startswith("#")


def token_flags(tokens: Column, is_comment) -> Column:
    """For every U+FFFD in the tokens of a text, in order: is its token a comment?"""
    damaged = F.filter(tokens, lambda token: F.contains(token, F.lit(REPLACEMENT)))
    return F.flatten(F.transform(damaged, lambda token: F.array_repeat(is_comment(token), marker_count(token))))


def _token_contexts(text: Column, pattern: str, is_comment) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        token_flags(tokens, is_comment), lambda flag: F.when(flag, COMMENT).otherwise(CODE)
    )


def c_like_contexts(text: Column) -> Column:
    """Context of every U+FFFD, in order, in C, C++ or C# text."""
    return _token_contexts(text, C_TOKENS, is_c_comment)


def python_contexts(text: Column) -> Column:
    """Context of every U+FFFD, in order, in Python text. Docstrings are code."""
    return _token_contexts(text, PYTHON_TOKENS, is_python_comment)


def marker_contexts(text: Column, extension: Column) -> Column:
    """Context of every U+FFFD of the text, in order, by file extension."""
    return (
        F.when(extension.isin(C_LIKE_EXTENSIONS), c_like_contexts(text))
        .when(extension.isin(PYTHON_EXTENSIONS), python_contexts(text))
        .otherwise(F.array_repeat(F.lit(UNSUPPORTED), marker_count(text)))
    )


def line_flags(text: Column, extension: Column) -> Column:
    """Per line of the text: does its first non-blank character lie in a comment?

    A marker put before that character takes the state the text has there. It
    follows a newline or a blank, so it never splits a two-character token.
    Lines that begin with a comment opener count too, ``//`` and ``/*`` in any
    language and ``#`` in Python; blank lines never do.
    """
    clean = F.translate(text, REPLACEMENT, "?")
    marked = F.regexp_replace(clean, rf"(?<![^\n]){BLANK}*+", f"$0{REPLACEMENT}")
    python = extension.isin(PYTHON_EXTENSIONS)
    opener = F.when(python, rf"^{BLANK}*\ufeff*(?://|/\*|#)").otherwise(
        rf"^{BLANK}*\ufeff*(?://|/\*)"
    )
    return F.zip_with(
        F.split(text, "\n", -1),
        marker_contexts(marked, extension),
        lambda line, context: F.regexp_like(line, opener)
        | ((context == COMMENT) & F.regexp_like(line, F.lit(rf"^{BLANK}*+[^\n]"))),
    )

"""Reading one replacement character out of a scorer's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from encaudit.functions.charsets import REPLACEMENT

# The keys an answer may use, in order of preference.
ANSWER_KEYS = ["character", "replacement", "char"]

_EDGE_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def sanitize_suggestion(answer: Column) -> Column:
    """The one character an answer proposes, null if it proposes none.

    The answer is a JSON object with one of the known keys, a JSON string, or
    plain text. Other JSON values, more than one character and U+FFFD give null.
    """
    text = F.regexp_replace(answer, rf"^{_EDGE_BLANK}++|{_EDGE_BLANK}++\z", "")
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    values = F.array(
        *[F.try_variant_get(parsed, f"$.{key}", "variant") for key in ANSWER_KEYS]
    )
    strings = F.filter(values, lambda value: F.schema_of_variant(value) == "STRING")
    first = F.try_variant_get(F.get(strings, F.lit(0)), "$", "string")
    chosen = (
        F.when(parsed.isNull(), text)
        .when(kind.startswith("OBJECT"), first)
        .when(kind == "STRING", F.try_variant_get(parsed, "$", "string"))
    )
    return F.when((F.length(chosen) == 1) & (chosen != REPLACEMENT), chosen)

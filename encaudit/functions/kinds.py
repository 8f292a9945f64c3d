"""Text or binary, judged by the first bytes of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from encaudit.functions.arrays import bind
from encaudit.functions.charsets import detect_label, latin1_view, raw, utf8_view

# Sample size, allowed share of control bytes, kind names.
SAMPLE_BYTES = 4096
CONTROL_SHARE = 0.30
TEXT = "text"
BINARY = "binary"

# Control bytes other than tab, newline, form feed and carriage return.
_CONTROLS = "".join(chr(code) for code in range(32) if code not in (9, 10, 12, 13))
# A UTF-8 character that the end of the sample cuts off.
_CUT = r"(?:[\xc2-\xf4]|[\xe0-\xf4][\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{2})\z"


def head_sample(content: Column) -> Column:
    """The first bytes of the content."""
    return F.substring(content, 1, SAMPLE_BYTES)


def file_kind(head: Column, length: Column) -> Column:
    """``text`` or ``binary`` from the first bytes and the length of a file.

    A character cut by the end of the sample is left out before the test.
    """
    sample = head_sample(head)
    cut = F.encode(F.regexp_replace(latin1_view(sample), _CUT, ""), "ISO-8859-1")
    # a sample with NUL is not UTF-8 text, and must keep the byte pairs of UTF-16
    pure = ~F.contains(sample, raw("00"))
    kept = F.when((length > SAMPLE_BYTES) & pure, cut).otherwise(sample)

    def judge(bound: Column) -> Column:
        data, label = bound["sample"], bound["label"]
        controls = F.octet_length(data) - F.length(F.translate(latin1_view(data), _CONTROLS, ""))
        return (
            F.when(data.isNull(), None)
            .when(F.octet_length(data) == 0, TEXT)
            .when(label.isin("utf-16", "utf-16le", "utf-16be", "utf-32"), TEXT)
            .when(F.contains(data, raw("00")), BINARY)
            .when(controls / F.octet_length(data) > CONTROL_SHARE, BINARY)
            .when(label == "utf-8-sig", F.when(F.is_valid_utf8(utf8_view(data)), TEXT).otherwise(BINARY))
            .when(label.isNotNull(), TEXT)
            .otherwise(BINARY)
        )

    return bind(
        kept,
        lambda data: bind(
            F.struct(data.alias("sample"), detect_label(data).alias("label")), judge
        ),
    )

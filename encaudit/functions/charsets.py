"""Column functions for byte-order marks, labels, decoding and encoding.

Everything here is built from Spark SQL functions. ``decode`` and ``encode``
raise on malformed or unmappable input, so each use stands behind a validity
test in a ``when`` branch and a bad file costs its own row, not the job.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from encaudit.functions.arrays import bind
from encaudit.functions.legacy import escape_label, legacy_label

REPLACEMENT = "\ufffd"

# Byte-order marks and the UTF-8 bytes of U+FFFD.
BOM_UTF8 = "EFBBBF"
BOM_UTF16_LE = "FFFE"
BOM_UTF16_BE = "FEFF"
BOM_UTF32_LE = "FFFE0000"
BOM_UTF32_BE = "0000FEFF"
UTF8_REPLACEMENT = "EFBFBD"

# Labels of files that need no conversion.
UNICODE_LABELS = ["utf-8", "utf-8-sig", "utf-16", "utf-16le", "utf-16be"]

# Labels of encodings whose files are checked but not decoded.
SEVEN_BIT_LABELS = ["utf-7", "utf7"]

# Spellings of a label (after normalisation) that mean the same charset.
FAMILIES = {
    "utf8": ["utf-8", "utf8", "utf-8-sig"],
    "utf16le": ["utf-16", "utf16", "utf-16le", "utf-16-le"],
    "utf16be": ["utf-16be", "utf-16-be"],
    "utf32le": ["utf-32", "utf32", "utf-32le", "utf-32-le"],
    "utf32be": ["utf-32be", "utf-32-be"],
    "ascii": ["ascii", "us-ascii"],
}
UNICODE_FAMILIES = ["utf8", "utf16le", "utf16be", "utf32le", "utf32be"]

# Charsets of one byte per character, by codec name, with the spellings of their
# labels. Their families are named "single:" and the codec.
SINGLE_BYTE = {
    "latin-1": ["iso-8859-1", "latin-1", "latin1"],
    **{f"iso8859-{n}": [f"iso-8859-{n}", f"iso8859-{n}"] for n in range(2, 17) if n != 12},
    **{f"cp{n}": [f"windows-{n}", f"cp{n}"] for n in range(1250, 1259)},
    **{f"cp{n}": [f"ibm{n}", f"cp{n}"] for n in (437, 850, 852, 855, 866)},
    "koi8-r": ["koi8-r"],
    "koi8-u": ["koi8-u"],
    "mac-roman": ["macroman", "mac-roman"],
    "mac-cyrillic": ["maccyrillic", "mac-cyrillic"],
    "tis-620": ["tis-620"],
}
# Charsets of several bytes per character that the JVM decodes, with the spellings
# of their labels. Their families are named "jvm:" and the charset.
MULTI_BYTE = {
    "Shift_JIS": ["shift-jis", "sjis"],
    "EUC-JP": ["euc-jp"],
    "ISO-2022-JP": ["iso-2022-jp"],
    "GB2312": ["gb2312"],
    "GBK": ["gbk", "cp936"],
    "GB18030": ["gb18030"],
    "Big5": ["big5"],
    "EUC-KR": ["euc-kr"],
    "x-windows-949": ["cp949"],
}
# Spark refuses these charsets, and raises on malformed input, unless both are set.
_JVM_SETTINGS = ["spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"]

LATIN1, CP1252 = "single:latin-1", "single:cp1252"
_HIGH = "".join(chr(code) for code in range(0x80, 0x100))
_UPPER_HALVES = {
    f"single:{codec}": bytes(range(0x80, 0x100)).decode(codec, "replace") for codec in SINGLE_BYTE
}
# Control bytes that no text holds.
_CONTROLS = r"\x00-\x08\x0b\x0e-\x1f"

# One well-formed unit in upper-case hex (big-endian), and what a decoder replaces.
_UNIT16 = "(?:(?:[0-9A-CEF][0-9A-F]|D[0-7])[0-9A-F]{2}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})"
_BAD16 = r"(?:D[89AB][0-9A-F]{4}\z|[0-9A-F]{4}|[0-9A-F]{2}\z)"
_UNIT32 = "(?:0000(?:[0-9A-CEF][0-9A-F]|D[0-7])[0-9A-F]{2}|00(?:0[1-9A-F]|10)[0-9A-F]{4})"
_BAD32 = r"(?:[0-9A-F]{8}|[0-9A-F]{2,6}\z)"

# Well-formed contents, one character per byte.
_SOUND16_LE = r"(?s)^(?:.[^\xd8-\xdf]|.[\xd8-\xdb].[\xdc-\xdf])*+\z"
_SOUND16_BE = r"(?s)^(?:[^\xd8-\xdf].|[\xd8-\xdb].[\xdc-\xdf].)*+\z"
_SOUND32_LE = r"(?s)^(?:.[^\xd8-\xdf]\x00\x00|..[\x01-\x10]\x00)*+\z"
_SOUND32_BE = r"(?s)^(?:\x00\x00[^\xd8-\xdf].|\x00[\x01-\x10]..)*+\z"


def raw(hex_text: str) -> Column:
    """Binary literal."""
    return F.lit(bytearray.fromhex(hex_text))


def latin1_view(content: Column) -> Column:
    """Bytes as a string with one character per byte."""
    return F.decode(content, "ISO-8859-1")


def utf8_view(content: Column) -> Column:
    """Bytes as a string without any check."""
    return content.cast("string")


def _swap16(digits: Column) -> Column:
    return F.regexp_replace(digits, "(..)(..)", "$2$1")


def _swap32(digits: Column) -> Column:
    return F.regexp_replace(digits, "(..)(..)(..)(..)", "$4$3$2$1")


# ---------------------------------------------------------------- labels


def normalize_label(label: Column) -> Column:
    """Trimmed, lower case, with ``-`` for ``_``."""
    trimmed = F.regexp_replace(label, r"^\s+|\s+$", "")
    return F.translate(F.lower(trimmed), "_", "-")


def is_unicode_label(label: Column) -> Column:
    """True for the labels whose files are left as they are when converting."""
    return F.lower(label).isin(UNICODE_LABELS)


def bom_name(content: Column) -> Column:
    """Name of the byte-order mark at the start, null if there is none."""
    return bind(
        F.substring(content, 1, 4),
        lambda head: F.when(F.startswith(head, raw(BOM_UTF32_LE)), "utf-32-le")
        .when(F.startswith(head, raw(BOM_UTF32_BE)), "utf-32-be")
        .when(F.startswith(head, raw(BOM_UTF8)), "utf-8")
        .when(F.startswith(head, raw(BOM_UTF16_LE)), "utf-16-le")
        .when(F.startswith(head, raw(BOM_UTF16_BE)), "utf-16-be"),
    )


def bom_bytes(name: Column) -> Column:
    """Bytes of the mark that ``bom_name`` names; empty for null."""
    return (
        F.when(name == "utf-8", raw(BOM_UTF8))
        .when(name == "utf-16-le", raw(BOM_UTF16_LE))
        .when(name == "utf-16-be", raw(BOM_UTF16_BE))
        .when(name == "utf-32-le", raw(BOM_UTF32_LE))
        .when(name == "utf-32-be", raw(BOM_UTF32_BE))
        .otherwise(raw(""))
    )


def detect_label(content: Column) -> Column:
    """Encoding label of a whole file from its bytes, null if none fits.

    Cheap byte scans come first. The one-character-per-byte view is only built
    for bytes that hold NUL or are not UTF-8.
    """
    return bind(content, _label_of)


def _label_of(content: Column) -> Column:
    bom = bom_name(content)
    text = utf8_view(content)
    view = latin1_view(content)
    nul = "\x00"
    even = F.octet_length(content) % 2 == 0
    # a pair with NUL on one side has to be a character a text may hold; the test
    # ends at the first pair that is none, so most binary files cost no more than that
    big = rf"(?s)^(?:[^\x00].|\x00[^{_CONTROLS}])*+\z"
    little = rf"(?s)^(?:.[^\x00]|[^{_CONTROLS}]\x00)*+\z"

    def utf16(shown: Column) -> Column:
        pairs = F.length(shown) / 2
        low = F.length(F.translate(F.regexp_replace(shown, "(?s)(.)(.)", "$1"), nul, ""))
        high = F.length(F.translate(F.regexp_replace(shown, "(?s)(.)(.)", "$2"), nul, ""))
        shares = F.struct(
            ((pairs - low) / pairs >= 0.30).alias("first"), ((pairs - high) / pairs >= 0.30).alias("second")
        )
        fits = F.struct(shown.rlike(big).alias("big"), shown.rlike(little).alias("little"))
        return bind(
            fits,
            lambda fit: F.when(
                fit["big"] | fit["little"],
                bind(
                    shares,
                    lambda nuls: F.when(nuls["second"] & ~nuls["first"] & fit["little"], "utf-16le").when(
                        nuls["first"] & ~nuls["second"] & fit["big"], "utf-16be"
                    ),
                ),
            ),
        )

    return (
        F.when(content.isNull(), None)
        .when(bom.isin("utf-32-le", "utf-32-be"), "utf-32")
        .when(bom == "utf-8", "utf-8-sig")
        .when(bom.isNotNull(), "utf-16")
        .when(F.octet_length(content) == 0, None)
        .when(
            F.contains(content, raw("00")),
            F.when(even, bind(view, utf16)),
        )
        .when(
            F.is_valid_utf8(text),
            F.when(F.length(text) != F.octet_length(content), "utf-8")
            .otherwise(F.coalesce(escape_label(text), F.lit("ascii"))),
        )
        .otherwise(bind(view, lambda shown: legacy_label(shown)))
    )


def decode_plan(content: Column, label: Column) -> Column:
    """How to read a file and write it back.

    A byte-order mark wins over the label; ``utf-8-sig`` always writes one back;
    ``utf-16`` without a mark is little-endian and written without one.

    Fields: ``decode_charset``, ``write_charset``, ``bom`` (written back),
    ``skip`` (bytes of the mark that are there), ``family``.
    """
    return bind(
        F.struct(normalize_label(label).alias("name"), bom_name(content).alias("mark")),
        lambda known: bind(_charsets(known["name"], known["mark"]), _plan),
    )


def _charsets(name: Column, mark: Column) -> Column:
    decode_charset = (
        F.when(mark == "utf-8", "utf-8-sig")
        .when(mark.startswith("utf-16"), "utf-16")
        .when(mark.startswith("utf-32"), "utf-32")
        .otherwise(name)
    )
    write_charset = (
        F.when(mark.isNotNull(), mark)
        .when(name == "utf-8-sig", "utf-8")
        .when(name == "utf-16", "utf-16-le")
        .when(name == "utf-32", "utf-32-le")
        .otherwise(name)
    )
    promised = mark.isNull() & (name == "utf-8-sig")
    return F.struct(
        decode_charset.alias("decode_charset"),
        write_charset.alias("write_charset"),
        bom_bytes(mark).alias("present"),
        F.when(promised, raw(BOM_UTF8)).otherwise(bom_bytes(mark)).alias("bom"),
    )


def _plan(known: Column) -> Column:
    return F.struct(
        known["decode_charset"].alias("decode_charset"),
        known["write_charset"].alias("write_charset"),
        known["bom"].alias("bom"),
        F.octet_length(known["present"]).alias("skip"),
        family_of(known["write_charset"]).alias("family"),
    )


def family_of(charset: Column) -> Column:
    """Charset family of a normalised name, null for one that is not supported."""
    names = {name: family for family, spellings in FAMILIES.items() for name in spellings}
    for codec, spellings in SINGLE_BYTE.items():
        names.update({name: f"single:{codec}" for name in spellings})
    if _jvm_charsets_allowed():
        for charset_name, spellings in MULTI_BYTE.items():
            names.update({name: f"jvm:{charset_name}" for name in spellings})
    return F.try_element_at(_literal_map(names), charset)


def _jvm_charsets_allowed() -> bool:
    session = SparkSession.getActiveSession()
    if session is None:
        return False
    return all(session.conf.get(name, "false").lower() == "true" for name in _JVM_SETTINGS)


def is_jvm(family: Column) -> Column:
    """True for multi-byte charsets that the JVM decodes."""
    return family.startswith("jvm:")


def _jvm_text(body: Column, family: Column) -> Column:
    return F.call_function("decode", body, F.substring(family, 5, 100))


def is_single_byte(family: Column) -> Column:
    """True for charsets of one byte per character other than ASCII."""
    return family.startswith("single:")


def has_chunks(family: Column) -> Column:
    """True for charsets whose files can be cut and read in parts: all but the multi-byte ones without marks."""
    return F.coalesce(family.isin(*UNICODE_FAMILIES, "ascii") | is_single_byte(family), F.lit(False))


def _literal_map(entries: dict[str, str]) -> Column:
    pairs = ", ".join(f"'{key}', '{value}'" for key, value in entries.items())
    return F.expr(f"map({pairs})")


def _upper_half(family: Column) -> Column:
    """What the bytes 80-FF mean in a single-byte family; U+FFFD where undefined."""
    return F.try_element_at(_literal_map(_UPPER_HALVES), family)


def _translate(text: Column, matching: Column, replacement: Column) -> Column:
    return F.call_function("translate", text, matching, replacement)


def body_of(content: Column, skip: Column) -> Column:
    """Content after its byte-order mark."""
    return F.when(skip == 0, content).otherwise(
        F.substring(content, skip + 1, F.octet_length(content))
    )


# ---------------------------------------------------------------- decoding


def _hex_be(body: Column, family: Column) -> Column:
    digits = F.hex(body)
    return (
        F.when(family == "utf16le", _swap16(digits))
        .when(family == "utf32le", _swap32(digits))
        .otherwise(digits)
    )


def is_decodable(body: Column, family: Column) -> Column:
    """True if strict decoding of the bytes succeeds. Null family gives false."""
    return bind(
        F.struct(body.alias("body"), family.alias("family")),
        lambda bound: _is_decodable(bound["body"], bound["family"]),
    )


def _is_decodable(body: Column, family: Column) -> Column:
    view = latin1_view(body)
    size = F.octet_length(body)
    valid8 = F.is_valid_utf8(utf8_view(body))
    # without a byte of the surrogate range no unit can be a surrogate
    plain = ~view.rlike("[\xd8-\xdf]")
    return F.coalesce(
        F.when(family == "utf8", valid8)
        .when(family == "ascii", valid8 & (F.length(utf8_view(body)) == size))
        .when(family == LATIN1, F.lit(True))
        .when(
            is_single_byte(family),
            ~F.contains(
                _translate(view, F.lit(_HIGH), _upper_half(family)), F.lit(REPLACEMENT)
            ),
        )
        .when(is_jvm(family), ~F.contains(_jvm_text(body, family), F.lit(REPLACEMENT)))
        .when(family == "utf16le", (size % 2 == 0) & (plain | view.rlike(_SOUND16_LE)))
        .when(family == "utf16be", (size % 2 == 0) & (plain | view.rlike(_SOUND16_BE)))
        .when(family == "utf32le", (size % 4 == 0) & view.rlike(_SOUND32_LE))
        .when(family == "utf32be", (size % 4 == 0) & view.rlike(_SOUND32_BE)),
        F.lit(False),
    )


def _mend(digits: Column, unit: str, bad: str, substitute: str) -> Column:
    return F.regexp_replace(digits, rf"\G(?<good>{unit}*+){bad}", "${good}" + substitute)


def decode_lossy(body: Column, family: Column, substitute: str = REPLACEMENT) -> Column:
    """Text of the bytes after the mark; malformed input becomes ``substitute``.

    ``substitute`` other than U+FFFD must be one ASCII character; it serves to
    tell malformed bytes from a real U+FFFD and keeps every index the same.
    """
    return bind(
        F.struct(body.alias("body"), family.alias("family")),
        lambda bound: _decode(bound["body"], bound["family"], substitute),
    )


def _decode(body: Column, family: Column, substitute: str) -> Column:
    code = f"{ord(substitute):04X}"
    digits = _hex_be(body, family)
    view = latin1_view(body)
    if substitute == REPLACEMENT:
        mended8 = F.make_valid_utf8(utf8_view(body))
    else:
        mended8 = F.array_join(
            F.transform(
                F.split(view, "\xef\xbf\xbd", -1),
                lambda part: F.translate(
                    F.make_valid_utf8(utf8_view(F.encode(part, "ISO-8859-1"))),
                    REPLACEMENT,
                    substitute,
                ),
            ),
            REPLACEMENT,
        )
    sound = _is_decodable(body, family)
    mended16 = F.decode(F.unhex(_mend(digits, _UNIT16, _BAD16, code)), "UTF-16BE")
    mended32 = F.unhex(_mend(digits, _UNIT32, _BAD32, "0000" + code))
    return (
        F.when(family == "utf8", F.when(sound, utf8_view(body)).otherwise(mended8))
        .when(family == LATIN1, view)
        .when(is_single_byte(family), from_single_byte(view, family, substitute))
        .when(family == "ascii", F.regexp_replace(view, "[\x80-\xff]", substitute))
        .when(is_jvm(family), F.translate(_jvm_text(body, family), REPLACEMENT, substitute))
        .when(
            family == "utf16le",
            F.when(sound, F.decode(body, "UTF-16LE")).otherwise(mended16),
        )
        .when(
            family == "utf16be",
            F.when(sound, F.decode(body, "UTF-16BE")).otherwise(mended16),
        )
        .when(
            family.isin("utf32le", "utf32be"),
            F.decode(F.concat(raw(BOM_UTF32_BE), mended32), "UTF-32"),
        )
    )


def from_single_byte(view: Column, family: Column, substitute: str = REPLACEMENT) -> Column:
    """Text of a one-character-per-byte view in a single-byte family."""
    meanings = F.translate(_upper_half(family), REPLACEMENT, substitute)
    return _translate(view, F.lit(_HIGH), meanings)


def decode_strict(body: Column, family: Column) -> Column:
    """Text of the bytes after the mark, null if they do not decode."""
    return bind(
        F.struct(body.alias("body"), family.alias("family")),
        lambda bound: F.when(
            _is_decodable(bound["body"], bound["family"]),
            _decode(bound["body"], bound["family"], REPLACEMENT),
        ),
    )


# ---------------------------------------------------------------- encoding


def is_encodable(text: Column, family: Column) -> Column:
    """True if every character of the text exists in the charset."""
    return bind(
        F.struct(text.alias("text"), family.alias("family")),
        lambda bound: _is_encodable(bound["text"], bound["family"]),
    )


def _is_encodable(text: Column, family: Column) -> Column:
    ascii_characters = "".join(chr(code) for code in range(0x80))
    defined = F.concat(F.lit(ascii_characters), F.translate(_upper_half(family), REPLACEMENT, ""))
    return F.coalesce(
        F.when(family.isin(UNICODE_FAMILIES), F.lit(True))
        .when(family == "ascii", ~text.rlike("[^\x00-\x7f]"))
        .when(family == LATIN1, ~text.rlike("[^\x00-\xff]"))
        .when(is_single_byte(family), _translate(text, defined, F.lit("")) == ""),
        F.lit(False),
    )


def encode_text(text: Column, family: Column) -> Column:
    """Bytes of the text without a mark, null if a character does not exist there."""
    return bind(
        F.struct(text.alias("text"), family.alias("family")),
        lambda bound: _encode(bound["text"], bound["family"]),
    )


def _encode(text: Column, family: Column) -> Column:
    utf32 = F.hex(F.encode(text, "UTF-32"))
    return F.when(
        _is_encodable(text, family),
        F.when(family == "utf8", F.encode(text, "UTF-8"))
        .when(family == "utf16le", F.encode(text, "UTF-16LE"))
        .when(family == "utf16be", F.encode(text, "UTF-16BE"))
        .when(family == "utf32le", F.unhex(_swap32(utf32)))
        .when(family == "utf32be", F.unhex(utf32))
        .when(family.isin("ascii", LATIN1), F.encode(text, "ISO-8859-1"))
        .when(
            is_single_byte(family),
            F.encode(_translate(text, _upper_half(family), F.lit(_HIGH)), "ISO-8859-1"),
        ),
    )


def encode_file(text: Column, plan: Column) -> Column:
    """Bytes of a whole file as its plan writes them, mark included."""
    return with_bom(encode_text(text, plan["family"]), plan)


def with_bom(encoded: Column, plan: Column) -> Column:
    """Encoded text with the mark of its plan in front, unless it is there."""
    return bind(
        F.struct(encoded.alias("encoded"), plan["bom"].alias("bom")),
        lambda known: F.when(
            F.startswith(known["encoded"], known["bom"]), known["encoded"]
        ).otherwise(F.concat(known["bom"], known["encoded"])),
    )


def byte_offset(text: Column, plan: Column, index: Column) -> Column:
    """Byte offset of a character index in the file as its plan writes it."""
    prefix = encode_text(F.substring(text, F.lit(1), index), plan["family"])
    return F.octet_length(plan["bom"]) + F.octet_length(prefix)


def scan_pattern(family: Column) -> Column:
    """Bytes that stand for one damaged character in a file of this family.

    Where the charset has no U+FFFD, its UTF-8 bytes are looked for instead.
    """
    return (
        F.when(family == "utf16le", raw("FDFF"))
        .when(family == "utf16be", raw("FFFD"))
        .when(family == "utf32le", raw("FDFF0000"))
        .when(family == "utf32be", raw("0000FFFD"))
        .when(family == "jvm:GB18030", raw("8431A437"))
        .when(family.isNotNull(), raw(UTF8_REPLACEMENT))
    )

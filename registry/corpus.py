"""A file corpus made from the test tables.

Every row of ``documents`` becomes one file. Folder, name, extension and charset
follow from its id; the text is wrapped as source code where the extension asks
for it. In the damaged corpus every file has lost its non-ASCII characters (in
the single-byte charsets all but a few, or nothing would tell them from UTF-8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encaudit.functions.charsets import CP1252, LATIN1, encode_text
from encaudit.session import settle
from encaudit.sources.tables import files_from_table

FOLDERS = ["src", "lib", ".git", "node_modules", "docs"]
INNER = ["", "deep/", "node_modules/"]
SUFFIXES = [".py", ".cpp", ".cs", ".h", ".txt", ".MD", ""]
CHARSETS = [
    "utf-8",
    "utf-8-sig",
    "utf-16",
    "iso-8859-1",
    "windows-1252",
    "ascii",
    "utf-16be",
    "binary",
]
BINARY_HEAD = "89504E470D0A1A0A00"
SKIP_DIRS = [" .git ", "", "node_modules", ".git"]
EXTENSIONS = [".PY", ".cpp", ".h", ".txt", ".md"]
MARK = "�"
HIDDEN = "\xef\xbf\xbd"
ELLIPSIS = "…"
NOT_ASCII = "[^\x00-\x7f]"
# In single-byte charsets these characters survive the damage.
LOST_IN_SINGLE_BYTE = "[^\x00-\x7f\xe9\xf6\xf3…]"


def _pick(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a test table, dealt over the shuffle partitions by a hash of the row.

    The tables come as single files of few row groups, whatever work their rows are.
    """
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(tasks, F.xxhash64(*columns))


def c_code(text: Column) -> Column:
    """The text as C-like source: in a string, a line comment and a block comment."""
    first, second, rest = _pieces(text)
    return F.concat(
        F.lit('int a = "'), first, F.lit('"; // '), second, F.lit("\n\t/* "), rest, F.lit(" */ int b;\n")
    )


def python_code(text: Column) -> Column:
    """The text as Python source: in a string, a comment and a docstring."""
    first, second, rest = _pieces(text)
    return F.concat(
        F.lit('a = "'), first, F.lit('"  # '), second,
        F.lit('\n    """'), rest, F.lit('"""\n  # end '), first, F.lit("\n"),
    )


def _pieces(text: Column) -> tuple[Column, Column, Column]:
    first = F.split_part(text, F.lit("\n"), F.lit(1))
    second = F.split_part(text, F.lit("\n"), F.lit(2))
    start = F.length(first) + F.length(second) + 3
    return first, second, F.substring(text, start, F.length(text))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, suffix, charset and source text of every document."""
    table = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    doc = F.col("doc_id")
    suffix = _pick(SUFFIXES, doc)
    name = F.concat(F.when(doc % 11 == 0, ".").otherwise(""), F.lit("doc_"), doc, suffix)
    path = F.concat(
        F.lit("/"), "source", F.lit("/"), _pick(FOLDERS, doc), F.lit("/"), _pick(INNER, doc), name
    )
    code = (
        F.when(suffix.isin(".cpp", ".cs", ".h"), c_code(F.col("text")))
        .when(suffix == ".py", python_code(F.col("text")))
        .otherwise(F.col("text"))
    )
    return table.select(
        "doc_id", path.alias("path"), _pick(CHARSETS, doc).alias("charset"), code.alias("code")
    )


def shown_text(damaged: bool) -> Column:
    """Text of a file in its charset; U+FFFD marks damage in every charset."""
    code, charset = F.col("code"), F.col("charset")
    dotted = F.replace(code, F.lit("."), F.lit(ELLIPSIS))
    ascii_only = F.regexp_replace(code, NOT_ASCII, "")
    if not damaged:
        return (
            F.when(charset == "windows-1252", dotted)
            .when(charset == "ascii", ascii_only)
            .otherwise(code)
        )
    return (
        F.when(charset == "iso-8859-1", F.regexp_replace(code, LOST_IN_SINGLE_BYTE, MARK))
        .when(charset == "windows-1252", F.regexp_replace(dotted, LOST_IN_SINGLE_BYTE, MARK))
        .when(charset == "ascii", ascii_only)
        .otherwise(F.regexp_replace(code, NOT_ASCII, MARK))
    )


def stored(text: Column, charset: Column) -> Column:
    """Bytes of a text in a charset. Damage in a single-byte charset is EF BF BD."""
    single = F.replace(text, F.lit(MARK), F.lit(HIDDEN))
    utf8 = F.encode(text, "UTF-8")
    return (
        F.when(charset == "utf-8-sig", F.concat(F.lit(b"\xef\xbb\xbf"), utf8))
        .when(
            charset == "utf-16",
            F.concat(F.lit(b"\xff\xfe"), encode_text(text, F.lit("utf16le"))),
        )
        .when(charset == "utf-16be", encode_text(text, F.lit("utf16be")))
        .when(charset == "iso-8859-1", encode_text(single, F.lit(LATIN1)))
        .when(charset == "windows-1252", encode_text(single, F.lit(CP1252)))
        .when(charset == "binary", F.concat(F.lit(bytes.fromhex(BINARY_HEAD)), utf8))
        .otherwise(utf8)
    )


def corpus(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """``path``, ``length`` and ``content`` of every document as a file.

    Written as a table of files, which the plan of the query then reads.
    """
    return settle(made_corpus(spark, sf_dir, damaged))


def made_corpus(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """The corpus as a plan over the documents, not yet written."""
    table = documents(spark, sf_dir).select("path", "charset", shown_text(damaged).alias("text"))
    content = stored(F.col("text"), F.col("charset"))
    return files_from_table(table, F.col("path"), content)


# Latin letters from the commonest to the rarest, and what stands for them in other alphabets.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
_CYRILLIC = "оеаинтсрвлкмдпуяыьгзбчйхжш"
_UKRAINIAN = "оанітиврелсмкдупязьгйчбхїц"
_KANA = "いのんかしとたにるをはすもこれてなきあさまくちりせけ"
_FRENCH, _LITHUANIAN = "étàoinshrdlçumwfgypbvkjxqz", "ėtaoįnšhrdlčųmwfgypbvkjxqž"
_TURKISH, _POLISH = "etaöınşhrdlçümwfğypbvkjxqz", "ętąóińśhrdłćumwfgypbvkjxqż"
_GREEK, _ARABIC = "αοιετσνηυρπκμλςωδγχθφώόβξζ", "اليمنوترةبعدسفهكقأحجىشصطخض"
_HEBREW, _THAI = "יוהלארמתבשנםעדקחפכטגצןסזךף", "านรกเอวลมยงทสติปดหุคะพบใจแ"
LEGACY = {
    "windows-1251": ("cp1251", _CYRILLIC),
    "koi8-r": ("koi8-r", _CYRILLIC),
    "iso-8859-5": ("iso8859-5", _CYRILLIC),
    "ibm866": ("cp866", _CYRILLIC),
    "koi8-u": ("koi8-u", _UKRAINIAN),
    "iso-8859-1": ("latin-1", _FRENCH),
    "macroman": ("mac-roman", _FRENCH),
    "ibm850": ("cp850", _FRENCH),
    "iso-8859-2": ("iso8859-2", _POLISH),
    "windows-1250": ("cp1250", _POLISH),
    "ibm852": ("cp852", _POLISH),
    "iso-8859-9": ("iso8859-9", _TURKISH),
    "windows-1257": ("cp1257", _LITHUANIAN),
    "iso-8859-4": ("iso8859-4", _LITHUANIAN),
    "iso-8859-7": ("iso8859-7", _GREEK),
    "iso-8859-6": ("iso8859-6", _ARABIC),
    "windows-1256": ("cp1256", _ARABIC),
    "windows-1255": ("cp1255", _HEBREW),
    "tis-620": ("tis-620", _THAI),
    "shift_jis": ("shift_jis", _KANA),
    "euc-jp": ("euc-jp", _KANA),
    "euc-kr": ("euc-kr", "이다는에의을가하고를지은한도로기사리어인서대자나해시"),
    "gb18030": ("gb18030", "的一是在不了有和人这中大为上个国我以要他时来用们生到"),
    "big5": ("big5", "的一是在不了有和人這中大為上個國我以要他時來用們生到"),
}
#: Texts from this length on, with so many different letters, tell their charset.
LONG, DIFFERENT = 200, 12


def legacy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of the charsets: ``doc_id``, ``charset``, ``plain`` and ``content``, and whether it is ``long``.

    Letters are put into the script of the charset, common for common; ``legacy_text`` gives the
    text from ``plain``.
    """
    rows = read_table(spark, sf_dir, "documents", "doc_id", "text")
    plain = F.regexp_replace(F.lower("text"), NOT_ASCII, "o")
    charset = _pick(list(LEGACY), F.col("doc_id"))

    codes = {name: _codes(codec, letters) for name, (codec, letters) in LEGACY.items()}
    different = sum((F.contains("plain", F.lit(letter)).cast("int") for letter in LETTERS), F.lit(0))
    # two bytes for each character; those of other characters than the letters begin with 00
    doubled = F.decode(F.encode(_written(codes), "UTF-16BE"), "ISO-8859-1")
    pairs = _of_charset({name: max(shown) > "\xff" for name, shown in codes.items()})
    content = F.when(pairs, F.regexp_replace(doubled, r"(?s)\x00(.)", "$1")).otherwise(_written(codes))
    return rows.select("doc_id", charset.alias("charset"), plain.alias("plain")).select(
        "doc_id",
        "charset",
        "plain",
        F.encode(content, "ISO-8859-1").alias("content"),
        ((F.length("plain") >= LONG) & (different >= DIFFERENT)).alias("long"),
    )


def legacy_text() -> Column:
    """Text of a file of ``legacy_files`` in the script of its charset."""
    return _written({name: _padded(letters) for name, (_, letters) in LEGACY.items()})


def _of_charset(values: dict[str, str | bool]) -> Column:
    held = F.create_map(*(F.lit(part) for pair in values.items() for part in pair))
    return F.element_at(held, F.col("charset"))


def _written(letters: dict[str, str]) -> Column:
    """``plain`` with those of the charset for the letters; as it is where there is no charset."""
    return F.call_function("translate", "plain", F.lit(LETTERS), F.coalesce(_of_charset(letters), F.lit(LETTERS)))


def _padded(letters: str) -> str:
    """One for each of ``LETTERS``: those that nothing stands for stay."""
    return letters[: len(LETTERS)] + LETTERS[len(letters) :]


def _codes(codec: str, letters: str) -> str:
    """A character for each letter whose number is that of its byte, or of its two bytes, in the codec."""
    return "".join(chr(int.from_bytes(letter.encode(codec))) for letter in _padded(letters))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without damage: the conversations and the web pages."""
    said = read_table(spark, sf_dir, "conversations", "text")
    pages = read_table(spark, sf_dir, "pages", "html").withColumnRenamed("html", "text")
    return said.unionByName(pages)

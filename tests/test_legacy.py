"""Legacy charsets: the right label or none, and never a conversion to another text."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from encaudit import audit
from encaudit.functions.charsets import SINGLE_BYTE, detect_label, latin1_view
from encaudit.functions.legacy import (
    _ODD_RUN, CANDIDATES, CODECS, LABELS, LATIN, ODD, ONLY_ODD, PREFERENCE, _listed, choice_of_counts, high_counts,
)
from registry import corpus

RUSSIAN = "Маяк стоит на высоком берегу, и свет его виден далеко в море. Рыбаки возвращаются домой поздно вечером."
GREEK = "Ο φάρος στέκεται στον ψηλό βράχο και το φως του φαίνεται μακριά στη θάλασσα κάθε νύχτα του χειμώνα."
POLISH = "Latarnia stoi na wysokim brzegu, a jej światło widać daleko na morzu. Żółte łodzie śpią wśród gęstej mgły."
CZECH = "Maják stojí na vysokém břehu a jeho světlo je vidět daleko na moři. Žluté čluny už spí v přístavišti."
FRENCH = "Le phare s'élève sur la côte; sa lumière éclaire la mer très loin, où les pêcheurs rentrent à la tombée du soir."
GERMAN = "Der Leuchtturm überragt die Küste; größere Schiffe hören das Nebelhorn, während die Möwen schlafen."
JAPANESE = "灯台は高い岸の上に立ち、その光は遠くの海からも見えます。漁師たちは夜おそくに家へ帰ります。"
CHINESE = "灯塔矗立在高高的海岸上，它的光芒在很远的海面上也能看见，渔民们很晚才回家。"
TAIWANESE = "燈塔矗立在高高的海岸上，它的光芒在很遠的海面上也能看見，漁民們很晚才回家。"
KOREAN = "등대는 높은 해안 위에 서 있고 그 불빛은 먼 바다에서도 보입니다. 어부들은 늦은 밤에 집으로 돌아옵니다."

STORED = [
    (RUSSIAN, "cp1251", "windows-1251"), (RUSSIAN, "koi8-r", "koi8-r"), (RUSSIAN, "iso8859-5", "iso-8859-5"),
    (RUSSIAN, "cp866", "ibm866"), (GREEK, "iso8859-7", "iso-8859-7"), (POLISH, "iso8859-2", "iso-8859-2"),
    (POLISH, "cp1250", "windows-1250"), (CZECH, "iso8859-2", "iso-8859-2"), (FRENCH, "latin-1", "iso-8859-1"),
    (FRENCH, "mac-roman", "macroman"), (FRENCH, "cp850", "ibm850"), (GERMAN, "latin-1", "iso-8859-1"),
    (GERMAN, "mac-roman", "macroman"), (JAPANESE, "shift_jis", "shift_jis"), (JAPANESE, "euc-jp", "euc-jp"),
    (JAPANESE, "iso2022_jp", "iso-2022-jp"), (CHINESE, "gb18030", "gb18030"), (TAIWANESE, "big5", "big5"),
    (KOREAN, "euc-kr", "euc-kr"),
]


# Own sentences about a lighthouse by night, each stored in every charset that its language may be found in.
OTHERS = {
    "ประภาคารตั้งอยู่บนฝั่งสูงและแสงของมันมองเห็นได้ไกลในทะเล ชาวประมงกลับบ้านตอนดึก": ["tis-620"],
    "تقف المنارة على شاطئ مرتفع ويرى ضوؤها من بعيد في البحر ويعود الصيادون إلى بيوتهم ليلا": ["iso8859-6", "cp1256"],
    "המגדלור עומד על חוף גבוה ואורו נראה למרחוק בים והדייגים חוזרים הביתה מאוחר בערב": ["iso8859-8", "cp1255"],
    "Deniz feneri yüksek bir kıyıda duruyor ve ışığı çok uzaktan görünüyor. Balıkçılar eve geç dönüyor.": ["iso8859-9", "cp1254"],
    "Švyturys stovi ant aukšto kranto, o jo šviesa matoma toli jūroje. Žvejai grįžta namo vėlai vakare.": ["cp1257", "iso8859-13", "iso8859-4"],
    "Bāka stāv augstā krastā, un tās gaisma ir redzama tālu jūrā. Zvejnieki atgriežas mājās vēlu vakarā.": ["cp1257", "iso8859-13", "iso8859-4"],
    "Tuletorn seisab kõrgel kaldal ja selle valgus paistab kaugele. Kalurid jõuavad koju hilja õhtul, öö on käes.": ["cp1257", "iso8859-15", "latin-1"],
    "Маяк стоїть на високому березі, і його світло видно далеко в морі. Рибалки повертаються пізно ввечері.": ["cp1251", "koi8-u", "iso8859-5"],
    "A világítótorony magas parton áll, fénye messze látszik. A halászok késő este térnek haza, hűvös idő van.": ["cp1250", "iso8859-2", "cp852"],
    "O farol está na costa alta e a sua luz vê-se ao longe; os pescadores não voltam senão à noite, com a maré.": ["latin-1", "cp850"],
    "Fyret står på en høj kyst, og lyset ses langt ude på havet; fiskerne kommer sent hjem, når blæsten lægger sig.": ["latin-1", "cp850"],
    RUSSIAN: ["mac-cyrillic"], GREEK: ["cp1253"], POLISH: ["cp852"], CZECH: ["cp1250", "cp852"], FRENCH: ["cp437", "iso8859-15"],
}
#: Too little, or too much alike in two charsets, to be sure of: no label, or one that gives the same text.
UNSURE = {
    "int tide; // см. да\nint ebb; // нет\n": ["cp1251", "koi8-r", "cp866"], RUSSIAN: ["cp855"], "łódź": ["iso8859-2", "cp1250"],
    "Farul stă pe un țărm înalt și lumina lui se vede departe. Pescarii se întorc târziu.": ["iso8859-16"], "été": ["latin-1", "cp850"],
    "Farul stă pe un ţărm înalt şi lumina lui se vede departe. Pescarii se întorc târziu.": ["iso8859-2", "cp1250"],
}


def same_text(content: bytes, label: str, text: str) -> bool:
    codec = {spelling: name for name, spellings in SINGLE_BYTE.items() for spelling in spellings}.get(label, label)
    return content.decode(codec, "replace") == text


@pytest.mark.parametrize(("texts", "sure"), [(OTHERS, True), (UNSURE, False)])
def test_other_languages(spark, texts, sure):
    rows = [(text, bytearray(text.encode(codec))) for text, codecs in texts.items() for codec in codecs]
    frame = spark.createDataFrame(rows, "text string, content binary")
    for row in frame.select("*", detect_label(F.col("content")).alias("label")).collect():
        assert row["label"] or not sure, row["text"]
        assert row["label"] is None or same_text(bytes(row["content"]), row["label"], row["text"]), (row["label"], row["text"])


@pytest.mark.parametrize(
    ("content", "label"),
    [("등대".encode("iso2022_kr"), "iso-2022-kr"), ("灯塔在海岸上".encode("hz"), "hz-gb-2312"), (b"cd ~{tmp}", "ascii")],
)
def test_escape_codes(spark, content, label):
    row = spark.createDataFrame([(bytearray(content), "/a.txt")], "content binary, path string")
    assert row.select(detect_label(F.col("content")).alias("l")).first()["l"] == label


def test_counts_of_parts_add_up(spark):
    """What is counted in the lines of a text, added up, gives the label of the text."""
    content = (RUSSIAN.replace(".", ".\n") * 3).encode("cp1251")
    parts = [content, *content.split(b"\n")]
    frame = spark.createDataFrame([(k, bytearray(part)) for k, part in enumerate(parts)], "k int, content binary")
    counted = frame.select("k", high_counts(latin1_view(F.col("content"))).alias("counts")).select("k", F.inline("counts"))
    sums = counted.where("k > 0").groupBy("byte").agg(F.sum("mixed").alias("mixed"), F.sum("alone").alias("alone"), F.sum("capital").alias("capital"))
    whole = counted.where("k = 0").select("byte", "mixed", "alone", "capital")
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, whole.collect()))
    joined = sums.agg(F.collect_list(F.struct("byte", "mixed", "alone", "capital")).alias("counts"))
    assert joined.select(choice_of_counts(F.col("counts"), F.lit(0))["label"]).first()[0] == "windows-1251"


def plain_label(content: bytes):
    """The best single-byte charset by adding up the letters one by one."""
    seen = content.replace(b"\xef\xbf\xbd", b" ").decode("latin-1")
    latin, scores, kept = sum(map(len, LATIN.values())), {}, {}
    words = [word for word in re.findall("[A-Za-z\x80-\xff]+", seen) if max(word) > "\x7f"]
    high = sum(ord(sign) > 127 for sign in seen)
    alone = sum(len(word) for word in words if not re.search("[A-Za-z]", word))
    capital = sum(ord(sign) > 127 for word in words if re.search("[A-Z]", word) and not re.search("[a-z]", word) for sign in word)
    odd = len(re.findall(ODD, seen))
    best_of_all = -math.inf
    for at, (label, codec, *weights) in enumerate(CANDIDATES):
        total = 0.0
        for word in words:
            kind = 1 if not re.search("[A-Za-z]", word) else 0 if re.search("[a-z]", word) else 2
            total += sum(weights[kind][ord(sign) - 128] for sign in word if ord(sign) > 127)
        best_of_all = max(best_of_all, total)
        if label in ONLY_ODD and (odd < 2 or odd < 0.2 * (high - alone - capital)):
            continue
        if at >= latin and 2 * alone < high:
            continue
        floor = -5.5 if label in ("iso-8859-1", "windows-1252") else -4.0 if at < latin else -4.4
        score = total + PREFERENCE.get(label, 0.0)
        if score > scores.get(label, -math.inf):
            scores[label], kept[label] = score, (total, score >= floor * high)
    texts = {label: content.decode(CODECS[label], "replace") for label in scores}
    best = max(scores, key=lambda label: scores[label])
    rivals = [scores[label] for label in scores if texts[label] != texts[best]]
    same = [label for label in LABELS if texts.get(label) == texts[best]]
    likely = kept[best][1] and kept[best][0] >= best_of_all - 3 - 0.9 * high
    return same[0] if likely and scores[best] - max(rivals, default=-math.inf) >= 4.5 else None


def test_labels_against_plain_sums(spark):
    rows = [(text, bytearray(text.encode(codec))) for texts in (OTHERS, UNSURE) for text, codecs in texts.items() for codec in codecs]
    rows += [(text, bytearray(text.encode(codec))) for text, codec, _ in STORED[:13]]
    found = spark.createDataFrame(rows, "text string, content binary").select("*", detect_label(F.col("content")).alias("label"))
    for row in found.collect():
        plain = plain_label(bytes(row["content"]))
        assert row["label"] == plain or (row["label"] == "iso-8859-1" and same_text(bytes(row["content"]), "iso-8859-1", row["text"]))


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(f"/{k}.txt", bytearray(text.encode(codec))) for k, (text, codec, _) in enumerate(STORED)]
    return spark.createDataFrame(rows, "path string, content binary")


def test_labels(stored):
    rows = stored.select("path", detect_label(F.col("content")).alias("label")).collect()
    assert {r["path"]: r["label"] for r in rows} == {f"/{k}.txt": label for k, (_, _, label) in enumerate(STORED)}


def test_no_conversion_to_another_text(stored):
    done = audit(stored, [".txt"], convert=True)
    converted = {r["path"]: bytes(r["content"]).decode("utf-8-sig") for r in done.converted.collect()}
    assert all(text == STORED[int(path[1:-4])][0] for path, text in converted.items())
    assert len(converted) >= 13


@pytest.mark.parametrize(
    ("content", "label"),
    [
        (bytes(range(0xC0, 0x100)) * 20, None),
        ("ruined tower, 3 m³ of sand".encode("latin-1"), "iso-8859-1"),
        ("¿Dónde está la canción?".encode("latin-1"), "iso-8859-1"),
        ("“déjà” … 5 €".encode("cp1252"), "windows-1252"),
        (b"\x81\x8d", None),
    ],
)
def test_doubtful_bytes(spark, content, label):
    row = spark.createDataFrame([(bytearray(content),)], "content binary")
    assert row.select(detect_label(F.col("content")).alias("l")).first()["l"] == label


@pytest.fixture
def multi_byte(spark):
    """A session that lets the JVM decode its own charsets."""
    names = ["spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"]
    for name in names:
        spark.conf.set(name, "true")
    yield spark
    for name in names:
        spark.conf.unset(name)


def test_damage_in_multi_byte_files_is_reported(multi_byte):
    sea = JAPANESE[:12].encode("shift_jis")
    rows = [
        ("/a.c", b"// " + sea + b"\n/* " + b"\xef\xbf\xbd" + b" */", "shift_jis"),
        ("/b.txt", CHINESE.encode("gb18030") + b"\n" + "x\ufffdy".encode("gb18030"), "gb18030"),
        ("/c.cpp", b"int tide = 3; // +AOk-", "utf-7"),
    ]
    files = multi_byte.createDataFrame([(p, bytearray(c)) for p, c, _ in rows], "path string, content binary")
    named = multi_byte.createDataFrame([(p, e) for p, _, e in rows], "path string, encoding string")
    done = audit(files, [".c", ".txt", ".cpp"], overrides=named)
    assert done.results.where("error_skipped").count() == 0
    found = {r["path"]: r for r in done.findings.collect()}
    hidden, shown = found["/a.c"], found["/b.txt"]
    assert (hidden["char_found"], hidden["absolute_char_index"], hidden["line"]) == (False, None, 2)
    assert (hidden["byte_sequence_file_pos"], hidden["comment_context"]) == (3 + len(sea) + 4, "comment")
    assert (shown["char_found"], shown["line"], shown["char_position"]) == (True, 2, 1)
    assert shown["byte_sequence_file_pos"] == len(CHINESE.encode("gb18030")) + 2
    assert set(found) == {"/a.c", "/b.txt"}


def test_multi_byte_texts_convert_to_themselves(multi_byte, stored):
    done = audit(stored, [".txt"], convert=True)
    converted = {r["path"]: bytes(r["content"]).decode("utf-8-sig") for r in done.converted.collect()}
    assert converted == {f"/{k}.txt": text for k, (text, _, _) in enumerate(STORED)}


def test_long_lines_are_kept_once(spark):
    """Very many findings in one very long line: the line is held once, not once per finding."""
    content = ("wave \ufffd " * 50_000).encode() + b"x" * 2_000_000
    files = spark.createDataFrame([("/long.js", bytearray(content))], "path string, content binary")
    done = audit(files, [".js"], with_string=True)
    assert done.findings.count() == 50_000
    assert done.lines.selectExpr("sum(length(line_text))").first()[0] == 50_000 * 7 + 2_000_000


def test_every_part_of_a_label_is_in_the_plan_once(spark):
    """Words are looked for in two patterns, and the candidates scored in one step, however often the results are read."""
    files = spark.createDataFrame([(1, bytearray(RUSSIAN.encode("cp1251")))] * 2, "k int, content binary").repartition(2, "k")
    plan = files.select(detect_label(F.col("content")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2
    assert plan.count("zip_with(") == 1


def test_classes_one_by_one():
    """Patterns rewritten for speed find the same."""
    signs = "".join(map(chr, range(0x100)))
    for pattern in (r"[A-Za-z\x80-\xff]", r"[^A-Za-z]", r"[\x40-\x7e\xa1-\xfe]{2}", r"[^ ]{3,}", r"[\x80-\xdf]"):
        assert re.findall(_listed(pattern), signs) == re.findall(pattern, signs)
    texts = [*map(str, OTHERS), *UNSURE, FRENCH.upper(), signs * 2]
    for text in texts:
        for codec in ("cp1251", "koi8-r", "latin-1", "cp850", "mac-roman", "cp866", "tis-620"):
            shown = text.encode(codec, "replace").decode("latin-1")
            assert sum(map(len, re.findall(_ODD_RUN, shown))) == len(re.findall(ODD, shown))


def test_legacy_files_hold_the_text_in_the_charset(spark, tmp_path):
    """As Python encodes it, with signs outside the letters, NUL and nulls; in every charset."""
    texts = ["", "The Quick\x00 brown föx — 3 m²\n", "\x00\x00e\x00", "zjxq " * 50, None]
    rows = [(k * len(corpus.LEGACY) + n, text) for k, text in enumerate(texts) for n in range(len(corpus.LEGACY))]
    spark.createDataFrame([*rows, (None, "see")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus.legacy_files(spark, str(tmp_path)).select("*", corpus.legacy_text().alias("shown")).collect()
    assert len(found) == len(rows) + 1
    given = dict([*rows, (None, "see")])
    for row in found:
        codec, letters = corpus.LEGACY.get(row["charset"], ("ascii", corpus.LETTERS))
        text = given[row["doc_id"]]
        if text is None:
            assert row["shown"] is row["content"] is None
            continue
        plain = re.sub("[^\x00-\x7f]", "o", text.lower())
        expected = plain.translate({ord(a): b for a, b in zip(corpus.LETTERS, letters)})
        assert row["shown"] == expected
        assert bytes(row["content"]) == b"".join(sign.encode("ascii" if sign < "\x80" else codec) for sign in expected)
        assert row["long"] == (len(plain) >= corpus.LONG and len(set(plain) & set(corpus.LETTERS)) >= corpus.DIFFERENT)

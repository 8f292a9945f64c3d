"""Telling charsets without a mark apart, by the letters that they make of the bytes above 7F.

Input is a string with one character per byte that is no well-formed UTF-8. A double-byte
charset has to fit as a whole. A single-byte one gives each byte above 7F a letter or sign,
and each language has its letters in the order of their frequency; so every pair of charset
and language has a log-probability per byte, and a text the sum of them. Languages in the
Latin alphabet have these letters among ASCII ones, others in words of their own. The best
charset is the label if it lies clearly above every other that would give another text, and
its letters are likely at all; otherwise there is no label, and no conversion.

The sums only need how often each byte occurs in either kind of word, so counts of parts of
a file add up to those of the file (``high_counts``).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from encaudit.functions.arrays import bind

# Small letters outside ASCII of some languages, commonest first, and the charsets they are stored in.
_WESTERN = {
    "iso-8859-1": "latin-1", "windows-1252": "cp1252", "iso-8859-15": "iso8859-15", "macroman": "mac-roman", "ibm850": "cp850",
}
_CENTRAL = {"iso-8859-2": "iso8859-2", "windows-1250": "cp1250", "ibm852": "cp852"}
_BALTIC = {"windows-1257": "cp1257", "iso-8859-13": "iso8859-13", "iso-8859-4": "iso8859-4"}
_CYRILLIC = {
    "windows-1251": "cp1251", "koi8-r": "koi8-r", "koi8-u": "koi8-u", "iso-8859-5": "iso8859-5", "ibm866": "cp866",
    "maccyrillic": "mac-cyrillic",
}
LATIN = {
    # English and others with typographic signs
    "’…“”–—‘é•€™": {"windows-1252": "cp1252", "macroman": "mac-roman"},
    "éàèêçôîûùâëïüœæÿ": _WESTERN, "üäößé": _WESTERN, "óíáéñúüª": _WESTERN, "ãçáéíóêõúâàôº": _WESTERN,
    "èàùòìéí": _WESTERN, "äöåé": _WESTERN, "åøæé": _WESTERN, "áðíóéþæöúý": _WESTERN, "àéèíçóòïúü": _WESTERN, "ëéïóè": _WESTERN,
    "ąęłóśżćńź": _CENTRAL, "íáéěžřýščůúťňďó": _CENTRAL, "áíéčžýšúľťňôäďóĺŕ": _CENTRAL, "áéőíöóüűú": _CENTRAL, "čšžćđ": _CENTRAL,
    "ăîţşâ": _CENTRAL, "ăîțșâ": {"iso-8859-16": "iso8859-16"},
    "ıüşçğöİâî": {"iso-8859-9": "iso8859-9", "windows-1254": "cp1254"},
    "ėšųžįąūčę": _BALTIC, "āīēšūļņžģķč": _BALTIC, "äõüöšž": _BALTIC,
}
OTHER_SCRIPTS = {
    "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё": _CYRILLIC, "оанітиврелсмкдупязьгйчбхїцюжщшєфґ": _CYRILLIC,
    "αοιετσνηυρπκμλςάωόίέδήγχθφύώβξζψϊϋΐΰ": {"iso-8859-7": "iso8859-7", "windows-1253": "cp1253"},
    "اليمنوترةبعدسفهكقأحجىشصطخضذزثئغإءظآؤ": {"windows-1256": "cp1256", "iso-8859-6": "iso8859-6"},
    "יוהלארמתבשנםעדקחפכטגצןסזךףץ": {"windows-1255": "cp1255", "iso-8859-8": "iso8859-8"},
    "านรกเ่อวัลม้ยงทีสติปดหุคะพบใจแไชขำโผื์ถซ็ธูึศฐณญภฟษฎฝฉฮฤฆฬฏฒฌ๊": {"tis-620": "tis-620"},
}
_SIGNS, _RARE_SIGNS = "“”‘’–—…«»„‚¿¡°·\xa0، ", "€§©®™²³½¼¾ªº£¥¢±×µ•†‹›؛؟ฯๆ´¶¨¸"

#: Shares of capitals, and of signs, and what is left for anything else and for bytes that mean nothing.
CAPITALS, SIGN, RARE_SIGN, OTHER, UNDEFINED = 0.04, 0.02, 0.005, 1e-4, 1e-7
#: Nats: a letter of the Latin alphabet that stands in a word without ASCII letters, and another letter in one with them.
ALONE, MIXED = math.log(0.3), math.log(0.02)
#: Nats that some charsets are given over others, as they are met more often, or less.
PREFERENCE = {
    "iso-8859-1": 4.0, "windows-1252": 4.0, "macroman": -3.0, "ibm850": -3.0, "ibm852": -3.0, "maccyrillic": -6.0,
}
#: Charsets of other systems, and what tells them: signs and capitals of windows-1252 between small letters.
ONLY_ODD, NEAR = ["macroman", "ibm850", "ibm852"], 0.9
# The sign comes first in the pattern: most characters are passed over by one test of a class.
_ODD_SIGN, _BESIDE_ODD = r"[\x80-\x84\x86-\x91\x93-\x95\x98-\x9f\xa1-\xaa\xac-\xba\xbc-\xdf]", r"[a-z\x80-\xff]"
ODD = rf"{_ODD_SIGN}(?<={_BESIDE_ODD}[\x80-\xff])(?={_BESIDE_ODD})"
#: As many characters as ``ODD`` finds, neighbours in one match.
_ODD_RUN = rf"{_ODD_SIGN}(?<={_BESIDE_ODD}[\x80-\xff]){_ODD_SIGN}*(?={_BESIDE_ODD})"
#: Nats of the best charset above any that would give another text, and least per byte: of letters among ASCII ones,
#: of others, and of a text that might be in a double-byte charset as well.
LEAD, LEAST_WESTERN, LEAST_LATIN, LEAST, LEAST_OF_RUNS = 4.5, -5.5, -4.0, -4.4, -4.0
#: Nats per byte from which a Western language explains a text so well that no other is tried.
SURELY_WESTERN = -2.0


def _weights(letters: str, codec: str, capitals: bool = False) -> list[float]:
    """Log-probability of each byte from 80 on in a language and a charset; in words in capitals, of these."""
    shares = [1 / (place + 2) for place in range(len(letters))]
    known = {sign: SIGN for sign in _SIGNS} | {sign: RARE_SIGN for sign in _RARE_SIGNS}
    for letter, share in zip(letters, shares):
        large = letter.upper() if len(letter.upper()) == 1 else letter
        first, second = (large, letter) if capitals else (letter, large)
        known[first] = share / sum(shares)
        known.setdefault(second, CAPITALS * share / sum(shares))
    shown = bytes(range(0x80, 0x100)).decode(codec, "replace")
    return [
        math.log(UNDEFINED if one == "\ufffd" or 0x80 <= ord(one) < 0xA0 else known.get(one, OTHER)) for one in shown
    ]


def _letter_flags(codec: str) -> list[bool]:
    return [one.isalpha() for one in bytes(range(0x80, 0x100)).decode(codec, "replace")]


#: label, codec, and log-probabilities of bytes in words with ASCII letters, in others, and in words of ASCII capitals.
CANDIDATES = [
    (
        label,
        codec,
        [w + (0 if latin else MIXED) for w in _weights(letters, codec)],
        [
            # a single letter may well be a capital
            max(small, large) + ALONE if latin and is_letter else small
            for small, large, is_letter in zip(
                _weights(letters, codec), _weights(letters, codec, capitals=True), _letter_flags(codec)
            )
        ],
        [w + (0 if latin else MIXED) for w in _weights(letters, codec, capitals=True)],
    )
    for latin, scripts in ((True, LATIN), (False, OTHER_SCRIPTS))
    for letters, charsets in scripts.items()
    for label, codec in charsets.items()
]
#: In the order of preference; earlier labels win where they give the same text.
LABELS = list(dict.fromkeys([*_WESTERN, *(label for label, *_ in CANDIDATES)]))
CODECS = {label: codec for label, codec, *_ in CANDIDATES}

# Double-byte charsets: what is well-formed, and the pairs that common text is made of.
_EUC = r"[\x00-\x7f]|[\xa1-\xfe]{2}"
_KANA_EUC = r"[\xa4\xa5][\xa1-\xf6]"
_SOUND = {
    "euc": rf"(?s)^(?:{_EUC})*+\z",
    "euc-jp": rf"(?s)^(?:{_EUC}|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{{2}})*+\z",
    "shift_jis": r"(?s)^(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\x00-\x7f\xa1-\xdf])*+\z",
    "big5": r"(?s)^(?:[\x81-\xfe][\x40-\x7e\xa1-\xfe]|[\x00-\x7f])*+\z",
    "gb18030": r"(?s)^(?:[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][0-9][\x81-\xfe][0-9]|[\x00-\x7f])*+\z",
}
_KANA_SHIFT = r"\x82[\x9f-\xf1]|\x83[\x40-\x96]"
_HANGUL = r"[\xb0-\xc8][\xa1-\xfe]"
_HANZI_GB = r"[\xb0-\xd7][\xa1-\xfe]"
_HANZI_BIG5 = r"[\xa4-\xc6][\x40-\x7e\xa1-\xfe]"
_LEAD_PAIR = r"[\x81-\xfe][\x40-\x7e\x80-\xfe]"

#: Share of the bytes above 7F that stand in runs of three and more, from which a text may be in a double-byte charset.
RUNS = 0.3
#: Fewer pairs say nothing about a double-byte charset.
LEAST_PAIRS = 8
#: Share of the pairs that are common in a double-byte charset.
PAIRS = 0.2

# Square and cubic metres: with nothing else above 7F the text is in ISO-8859-1.
_UNITS = r"(?<![A-Za-z\x80-\xff])[kcdm]?m[\xb2\xb3](?![A-Za-z\x80-\xff])"

_HIDDEN_DAMAGE = "\xef\xbf\xbd"

#: The counts of a byte, in the order of the weights of a candidate.
KINDS = ["mixed", "alone", "capital"]


def escape_label(text: Column) -> Column:
    """Label of seven-bit text that switches charsets by escape sequences, null for plain ASCII."""
    return (
        F.when(text.rlike(r"\x1b\$[@B]"), "iso-2022-jp")
        .when(text.rlike(r"\x1b\$\)C"), "iso-2022-kr")
        .when(text.rlike(r"~\{(?:[\x21-\x77][\x21-\x7e])+~\}"), "hz-gb-2312")
    )


def legacy_label(view: Column) -> Column:
    """Label of a text that is neither Unicode nor ASCII, null where the bytes leave it open."""

    def by_shape(text: Column) -> Column:
        every = F.regexp_replace(text, "[\x00-\x7f]+", "")
        runs = _n_removed(text, "[\x80-\xff]{3,}+")
        return bind(F.struct(text.alias("text"), every.alias("every"), runs.alias("runs")), by_letters)

    def by_letters(shape: Column) -> Column:
        text, runs, total = shape["text"], shape["runs"], F.length(shape["every"])
        in_runs = (total > 0) & (runs >= RUNS * total)
        single = choice_of_counts(_counts_of(text, shape["every"]), _n_removed(text, _ODD_RUN))

        def of_runs(double: Column) -> Column:
            kana = double.isin("euc-jp", "shift_jis")

            def of_single(one: Column) -> Column:
                # letters in runs are not those of one of the charsets that have some among ASCII letters
                latin = F.when(~(one["label"].isin(*ONLY_ODD) & (runs >= 2 * RUNS * total)), one["label"])
                either = F.when(one["average"] >= LEAST_OF_RUNS, one["label"]).otherwise(double)
                return F.when(~in_runs, one["label"]).when(double.isNull(), latin).otherwise(either)

            return F.when(kana, double).otherwise(bind(single, of_single))

        return bind(F.when(in_runs, _double_byte(text)), of_runs)

    def without_units(undamaged: Column) -> Column:
        rest = F.regexp_replace(undamaged, _UNITS, " ")
        only_units = undamaged.rlike("m[\xb2\xb3]") & undamaged.rlike(_UNITS) & ~rest.rlike("[\x80-\xff]")
        return F.when(only_units, "iso-8859-1").otherwise(bind(undamaged, by_shape))

    return bind(F.replace(view, F.lit(_HIDDEN_DAMAGE), F.lit(" ")), without_units)


def _n_removed(text: Column, pattern: str) -> Column:
    """Characters in the matches of a pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, _listed(pattern), ""))


def _listed(pattern: str) -> str:
    """The pattern with the characters of its classes of several ranges one by one: Java looks these up in a table."""

    def one_by_one(found: re.Match) -> str:
        held = re.compile(found[0].replace("[^", "["))
        codes = [code for code in range(0x100) if held.match(chr(code))]
        return f"[{found[1]}{''.join(f'\\x{code:02x}' for code in codes)}]"

    return re.sub(r"\[(\^?)(?:[^\]-]+-[^\]-]{1,4}){2,}\]", one_by_one, pattern)


def high_counts(view: Column) -> Column:
    """byte, mixed, alone and capital: how often each byte above 7F occurs in words with ASCII letters, without, and of capitals."""
    return bind(view, lambda text: _counts_of(text, F.regexp_replace(text, "[\x00-\x7f]+", "")))


def _counts_of(view: Column, every: Column) -> Column:
    """``high_counts`` of a view, where the string of its bytes above 7F is known."""
    word = "A-Za-z\x80-\xff"

    def in_words(first: str, pattern: str) -> Column:
        # the first character, then that none of the word stands before it: one test for most characters
        words = rf"{first}(?<![{word}]{first}){pattern}(?![{word}])"
        return F.array_join(F.regexp_extract_all(view, F.lit(_listed(words)), F.lit(0)), "")

    capitals = in_words(
        "[A-Z\x80-\xff]", "(?:(?<=[A-Z])[A-Z\x80-\xff]++|(?<=[\x80-\xff])[\x80-\xff]*+[A-Z][A-Z\x80-\xff]++)"
    )
    beside_capital = view.rlike(r"[A-Z](?:(?<=[\x80-\xff][A-Z])|(?=[\x80-\xff]))")
    strings = F.struct(
        every.alias("every"),
        in_words("[\x80-\xff]", "[\x80-\xff]*+").alias("pure"),
        F.when(beside_capital, F.regexp_replace(capitals, "[A-Z]+", "")).otherwise("").alias("capital"),
    )
    return bind(strings, _often)


def _often(strings: Column) -> Column:
    """The counts of the bytes above 7F, in the order of their first places in the string of them all.

    The first character that is left is taken out of the strings, which get shorter; what
    their sizes were before is kept.
    """
    names = ["every", "pure", "capital"]
    sizes = F.struct(F.lit(0).alias("byte"), *(F.lit(0).alias(name) for name in names))
    # where all words are pure their bytes are counted once
    only_pure = strings["pure"] == strings["every"]
    start = F.struct(
        strings["every"].alias("every"),
        F.when(only_pure, "").otherwise(strings["pure"]).alias("pure"),
        strings["capital"].alias("capital"),
        F.filter(F.array(sizes), lambda _: F.lit(False)).alias("before"),
    )

    def taken_out(left: Column) -> Column:
        sign = F.substring(left["every"], 1, 1)
        now = F.struct(F.ascii(sign).alias("byte"), *(F.octet_length(left[name]).alias(name) for name in names))
        return F.struct(
            *(F.when(left[name] == "", "").otherwise(F.regexp_replace(left[name], sign, F.lit(""))).alias(name) for name in names),
            F.concat(left["before"], F.array(now)).alias("before"),
        )

    def counted(before: Column) -> Column:
        def gone(one: Column, at: Column, name: str) -> Column:
            # each of them takes two bytes in a string
            after = F.coalesce(F.get(before, at + 1)[name], F.lit(0))
            return F.shiftright(one[name] - after, 1).cast("long")

        def of_sign(one: Column, at: Column) -> Column:
            every, capital = gone(one, at, "every"), gone(one, at, "capital")
            pure = F.when(only_pure, every).otherwise(gone(one, at, "pure"))
            return F.struct(
                one["byte"].alias("byte"), (every - pure - capital).alias("mixed"), pure.alias("alone"), capital.alias("capital")
            )

        return F.transform(before, of_sign)

    def some_out(left: Column, rounds: int, one_round: Callable[[Column], Column]) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)),
            left,
            lambda done, _: F.when(done["every"] == "", done).otherwise(one_round(done)),
        )

    # 128 at most, by sixteens: most texts are done after one or two of these
    taken = some_out(start, 8, lambda left: some_out(left, 16, taken_out))["before"]
    return bind(taken, counted)


#: Charsets by codec, each once, for what the bytes of a text are in them.
_CODECS = list(dict.fromkeys(codec for _, codec, *_ in CANDIDATES))


def _candidates() -> Column:
    """What there is to know of each candidate but its weights, as an array of literals."""
    n_latin = sum(len(charsets) for charsets in LATIN.values())
    rows = [
        {
            "preferred": -LABELS.index(label),
            "at": at,
            "preference": PREFERENCE.get(label, 0.0),
            "label": label,
            "codec": _CODECS.index(codec),
            "least": LEAST_WESTERN if label in ("iso-8859-1", "windows-1252") else LEAST_LATIN if at < n_latin else LEAST,
            "only_odd": label in ONLY_ODD,
            "latin": at < n_latin,
        }
        for at, (label, codec, *_) in enumerate(CANDIDATES)
    ]
    return F.from_json(
        F.lit(json.dumps(rows)),
        "array<struct<preferred: int, at: int, preference: double, label: string, codec: int, least: double, "
        "only_odd: boolean, latin: boolean>>",
    )


def _scores(entries: Column) -> Column:
    """Nats of every candidate for the counts of a text."""
    by_candidate = [[weight for kind in weights for weight in kind] for _, _, *weights in CANDIDATES]
    by_place = F.from_json(F.lit(json.dumps([*zip(*by_candidate)])), "array<array<double>>")
    return F.aggregate(
        entries,
        F.from_json(F.lit(json.dumps([0.0] * len(CANDIDATES))), "array<double>"),
        lambda totals, one: F.zip_with(totals, by_place[one["place"]], lambda total, weight: total + one["n"] * weight),
    )


def _entries(counts: Column) -> Column:
    """place among the weights of all ``KINDS``, one after the other, and n, of the counts that are not zero."""

    def of_byte(one: Column) -> Column:
        kinds = (
            F.struct((one["byte"] + (128 * k - 128)).alias("place"), one[name].cast("double").alias("n"))
            for k, name in enumerate(KINDS)
        )
        return F.filter(F.array(*kinds), lambda entry: entry["n"] != 0)

    return F.flatten(F.transform(counts, of_byte))


def choice_of_counts(counts: Column, odd: Column) -> Column:
    """``label`` that ``high_counts`` speak for, null if none does clearly, and its nats per byte.

    ``odd`` is how often a text has what ``ODD`` finds. Charsets that have letters where
    others have signs are only taken if it has many: a few signs can always be read as letters.
    If they would be far better than any other without that, there is no label.
    """
    return bind(counts, lambda known: _choice(known, odd))


def _choice(counts: Column, odd: Column) -> Column:
    def total(part: str) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda done, one: done + one[part])

    sums = F.struct(*(total(part).alias(part) for part in KINDS))

    def of_sums(n: Column) -> Column:
        held = F.struct(
            counts.alias("counts"),
            F.array_join(F.transform(counts, lambda one: F.char(one["byte"])), "").alias("signs"),
            _scores(_entries(counts)).alias("scores"),
            n["mixed"].alias("mixed"),
            (n["mixed"] + n["capital"]).alias("n_mixed"),
            (n["mixed"] + n["alone"] + n["capital"]).alias("n"),
        )
        return bind(held, lambda known: bind(_western(known), lambda best: F.when(
            (best >= SURELY_WESTERN * known["n"]) & (2 * known["n_mixed"] > known["n"]) & ~known["signs"].rlike("[\x80-\x9f]"),
            F.struct(F.lit("iso-8859-1").alias("label"), (best / known["n"]).alias("average")),
        ).otherwise(_of_all(known, odd))))

    return bind(sums, of_sums)


def _western(held: Column) -> Column:
    """Nats of the best Western language in ISO-8859-1, far too few if there are bytes that are signs in windows-1252."""
    places = [at for at, (label, *_) in enumerate(CANDIDATES) if label == "iso-8859-1"]
    return F.array_max(F.array(*(held["scores"][at] for at in places)))


def _of_all(held: Column, odd: Column) -> Column:
    candidates = _candidates()
    halves = F.from_json(
        F.lit(json.dumps([list(bytes(range(0x80, 0x100)).decode(codec, "replace")) for codec in _CODECS])),
        "array<array<string>>",
    )
    seen = F.struct(
        bind(odd, lambda n: (n >= 2) & (n >= 0.2 * held["mixed"])).alias("odd"),
        (2 * held["n_mixed"] <= held["n"]).alias("in_own_words"),
    )

    def ranked(known: Column) -> Column:
        return F.transform(
            candidates,
            lambda one: F.struct(
                (held["scores"][one["at"]] + one["preference"]).alias("score"),
                one["preferred"].alias("preferred"),
                one["at"].alias("at"),
                one["codec"].alias("codec"),
                one["preference"].alias("preference"),
                ((known["odd"] | ~one["only_odd"]) & (one["latin"] | known["in_own_words"])).alias("taken"),
            ),
        )

    def unbiased(one: Column) -> Column:
        return one["score"] - one["preference"]

    def chosen(every: Column) -> Column:
        ranks = F.filter(every, lambda one: one["taken"])
        highest = F.array_max(F.transform(every, unbiased))
        return bind(F.struct(ranks.alias("ranks"), highest.alias("highest")), lambda known: bind(
            F.array_max(known["ranks"]), lambda best: bind(
                same_text(best["codec"]), lambda agree: among(known["ranks"], best, known["highest"], agree)
            )
        ))

    def same_text(codec: Column) -> Column:
        """For each codec, whether it makes the same of the bytes of this text: charsets that agree on them are no rivals."""

        def agrees(half: Column, other: Column) -> Column:
            return ~F.exists(held["counts"], lambda one: half[one["byte"] - 128] != other[one["byte"] - 128])

        return bind(halves[codec], lambda other: F.transform(halves, lambda half: agrees(half, other)))

    def among(ranks: Column, best: Column, highest: Column, agree: Column) -> Column:
        same = F.filter(ranks, lambda one: agree[one["codec"]])
        rivals = F.filter(ranks, lambda one: ~agree[one["codec"]])
        rival = F.array_max(F.transform(rivals, lambda one: one["score"]))
        lead = best["score"] - F.coalesce(rival, best["score"] - LEAD)
        first = F.array_max(F.transform(same, lambda one: F.struct(one["preferred"].alias("p"), one["at"].alias("at"))))
        least = candidates[best["at"]]["least"]
        likely = (best["score"] >= least * held["n"]) & (unbiased(best) >= highest - 3 - NEAR * held["n"])
        clear = (held["n"] > 0) & (lead >= LEAD) & likely
        return F.struct(
            F.when(clear, candidates[first["at"]]["label"]).alias("label"), (best["score"] / held["n"]).alias("average")
        )

    return bind(seen, lambda known: bind(ranked(known), chosen))


def _double_byte(view: Column) -> Column:
    def count(pattern: str) -> Column:
        """Pairs: runs of them are taken out at once."""
        return _n_removed(view, f"(?:{pattern})++") / 2

    def judged(pairs: Column, euc_jp: Column) -> Column:
        kana_euc, kana_shift, hanzi = (
            count(pattern) >= PAIRS * pairs for pattern in (_KANA_EUC, _KANA_SHIFT, _HANZI_BIG5)
        )
        only_hangul = bind(count(_HANGUL), lambda n: (n >= PAIRS * pairs) & (n >= 0.8 * pairs))
        common_hanzi = count(_HANZI_GB) >= 0.5 * pairs
        # Kana are unmistakable; other pairs may be chance where most letters are ASCII.
        mostly = _n_removed(view, "[\x80-\xff]++") >= _n_removed(view, "[A-Za-z]++")
        return F.when(pairs < LEAST_PAIRS, None).otherwise(
            F.when(euc_jp & kana_euc, "euc-jp")
            .when(view.rlike(_listed(_SOUND["shift_jis"])) & kana_shift, "shift_jis")
            .when(~mostly, None)
            .when(
                euc_jp & view.rlike(_listed(_SOUND["euc"])),
                F.when(only_hangul, "euc-kr").when(common_hanzi, "gb18030"),
            )
            .when(view.rlike(_listed(_SOUND["big5"])) & hanzi & (count(_HANZI_BIG5) >= 0.6 * pairs), "big5")
            .when(view.rlike(_listed(_SOUND["gb18030"])) & common_hanzi, "gb18030")
        )

    def of_sound(euc_jp: Column) -> Column:
        sound = euc_jp
        for name in ("shift_jis", "big5", "gb18030"):
            sound = sound | view.rlike(_listed(_SOUND[name]))
        return F.when(sound, bind(count(_LEAD_PAIR), lambda pairs: judged(pairs, euc_jp)))

    return bind(view.rlike(_listed(_SOUND["euc-jp"])), of_sound)

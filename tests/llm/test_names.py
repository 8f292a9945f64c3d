"""Names after titles: how far they go, and which part is the family name."""

from __future__ import annotations

import pytest

from encaudit.llm import pii


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Mr. Juan Carlos Garcia Lopez left. Lopez", "male:Juan male:Carlos male:Garcia family:Lopez family:Lopez"),
        ("Mr. John Q. Public left. Public", "male:John initial:Q family:Public family:Public"),
        ("Herr Ludwig van Beethoven, Beethoven", "male:Ludwig family:Beethoven family:Beethoven"),
        ("Herr van Beethoven", "family:Beethoven"),
        ("Señora María de la Cruz", "female:María family:Cruz"),
        ("Dr. Ada Novak and Prof Quinn", "given:Ada family:Novak family:Quinn"),
        ("Frau Prof. Dr. Erika Muster", "female:Erika family:Muster"),
        ("Mr. J.R.R. Tolkien", "initial:J initial:R initial:R family:Tolkien"),
        ("Mr. Charles d'Artagnan, d'Artagnan", "male:Charles family:d'Artagnan family:d'Artagnan"),
        ("Mr. John Smith Mrs Anna Smith Jr", "male:John family:Smith female:Anna family:Smith"),
        ("Mr. Smith. Then he went. A dog.", "family:Smith"),
        ("Mr. John Q Public; Q and I", "male:John initial:Q family:Public"),
        ("Mr. of the house", ""),
    ],
)
def test_all_parts_of_a_name_are_found(text, expected):
    found = [f"{one['kind']}:{text[one['start']:one['end']]}" for one in pii.mentions(text)]
    assert " ".join(found) == expected


def test_no_part_of_a_name_stays(spark):
    texts = ["Mr. Juan Carlos Garcia Lopez, Mr. John Q. Public, Herr Ludwig van Beethoven", "Dr. Ada Novak. Beethoven"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = {row["doc_id"]: row["text"] for row in pii.with_surrogates(table, b"key").collect()}
    for real in "Juan Carlos Garcia Lopez John Public Ludwig Ada Novak".split():
        assert not any(real in text for text in new.values())
    assert "Q." not in new[0] and " van " in new[0] and "Beethoven" not in new[0]


@pytest.mark.parametrize(
    "shown", ["1.2.3.4", "555-123-4567", "(017) 555-7713", "+1 017 555", "123-45-6789", "4539578763621486", "a@b.example"]
)
def test_late_draws_are_wider_forms_of_the_same_type(shown):
    (one,) = pii.mentions(shown)
    kind, entity = one["kind"], one["entity"]
    late = [pii.surrogate(b"key", kind, entity, pii.MAX_DRAWS + k) for k in range(3)]
    assert len(set(late)) == 3 and not any(name.startswith(kind) for name in late)
    for normal in late:
        new = pii.rendered(kind, normal, shown)
        signs = [c for c in shown if not c.isalnum()]
        assert [c for c in new if not c.isalnum()] == signs
        assert new.replace(".", "").isdecimal() and pii._is_ip(new) if kind == "ip" else len(new) > len(shown)
    if kind == "card":
        assert all(map(pii._luhn, late))


@pytest.mark.parametrize("n", [1, 64, 65, 70, 100_000])
def test_addresses_are_found_from_their_first_character(n):
    text = "to " + "a" * n + "@example.com, " + "b" * n
    (found,) = pii.mentions(text)
    assert (found["kind"], found["start"], found["end"]) == ("email", 3, 3 + n + len("@example.com"))
    assert [one["kind"] for one in pii.mentions("@example.com x @ y a@b.org@c.org")] == ["email"]

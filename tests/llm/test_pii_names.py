"""Names with inner capitals, apostrophes and hyphens, and lone mentions of names found in a text."""

import pytest

from stellarframe.llm import pii

KEY = b"k"


@pytest.mark.parametrize(
    ("text", "hidden"),
    [
        ("Then John McDonald came.", ["McDonald", "John"]),
        ("Mary O'Brien and Mary O’Brien", ["Brien", "Mary"]),
        ("Mr. MacArthur", ["MacArthur", "Arthur"]),
        ("Anna Schmidt-Müller", ["Schmidt", "Müller", "Anna"]),
        ("Anna-Maria Schmidt", ["Anna", "Maria", "Schmidt"]),
        ("Herr SCHMIDT", ["SCHMIDT"]),
        ("Later Schmidt left. Anna Schmidt said so, and Anna, Schmidt's friend, SCHMIDT and Schmidt-Müller", ["Anna", "Schmidt", "SCHMIDT"]),
    ],
)
def test_names_are_replaced_whole(text, hidden):
    new, *_ = pii.replace(text, KEY)
    assert not [h for h in hidden if h in new], new


def test_lone_mentions_keep_the_reference():
    new, n, _ = pii.replace("Anna Schmidt met Frau Weber. Schmidt's car, Weber and Anna; Webers schmidt Carla", KEY)
    given, surname, other = (pii.surrogate(KEY, *x) for x in (("given", "Anna"), ("surname", "schmidt"), ("surname", "weber")))
    assert new == f"{given} {surname.capitalize()} met Frau {other.capitalize()}. {surname.capitalize()}'s car, {other.capitalize()} and {given}; Webers schmidt Carla"
    assert n == {"given": 2, "surname": 4}


def test_lone_words_without_a_full_name_stay():
    text = "Schmidt and Anna; mail anna.Schmidt@x.example.com"
    assert [k for k, *_ in pii.entities(text)] == ["email"]
    spans = [(s, e) for *_, s, e in pii.entities(text + " Anna Schmidt")]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) == 5

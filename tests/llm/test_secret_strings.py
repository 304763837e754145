"""Secrets that no known form tells."""

import random
import string

import pytest

from tallyvine.llm.secret_scan import base_spans, entropy_spans, redact

KEY = "wJalrXUtnFEMI7MDENGbPxRfiCYzK9qT"


def blanked(text):
    return redact(text, (base := base_spans(text)) + entropy_spans(text, base), "*")


@pytest.mark.parametrize(
    ("text", "left"),
    [
        (f"private_key={KEY}", "private_key=*"),
        (f"export SIGNING={KEY}==\nx", "export SIGNING=*\nx"),
        (f"https://h.io/x?sig={KEY}&y=1", "https://h.io/x?sig=*&y=1"),
        (f"?{KEY}=1", "?*=1"),
        (f"AWS_SESSION_SIGNING_VALUE={KEY}", "AWS_SESSION_SIGNING_VALUE=*"),
        ("organisation_of_the_harvest=internationalization-of-things", "organisation_of_the_harvest=internationalization-of-things"),
    ],
)
def test_values_after_an_equals_sign(text, left):
    assert blanked(text) == left


@pytest.mark.parametrize("size", [20, 32, 40])
@pytest.mark.parametrize("alphabet", ["digits", "hexdigits", "ascii_lowercase", "ascii_uppercase", "ascii_letters", "base64"])
def test_random_strings_are_found(alphabet, size):
    rng = random.Random(size)
    letters = string.ascii_letters + string.digits + "+/" if alphabet == "base64" else getattr(string, alphabet)
    letters = letters[:16] if alphabet == "hexdigits" else letters
    made = ["".join(rng.choices(letters, k=size)) for _ in range(500)]
    assert sum(blanked(f"use {x} here") == "use * here" for x in made) >= 0.97 * len(made)


def test_words_are_left():
    calm = """internationalization-of-things Donaudampfschifffahrtsgesellschaft anticonstitutionnellement Geschwindigkeitsbegrenzung
    getUserAccountBalanceFromServer electroencefalografista documents/archive/2024/report-final counterrevolutionaries"""
    assert [calm[a:b] for a, _, b in entropy_spans(calm, [])] == []


def test_the_rest_of_a_candidate_is_measured():
    access = "AKIA" + "Q7ZT" * 4
    assert blanked(f"x {access}/{KEY}YEKab12+ y") == "x ** y"
    assert blanked(f"{KEY[:12]}{'0123456789abcdef' * 2}-{KEY[12:26]} y") == "*** y"
    assert blanked(f"{access}/documents/archive/of-the-harvest") == "*/documents/archive/of-the-harvest"

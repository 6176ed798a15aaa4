import random

import pytest

from speechgrid.llm import secrets

NOVELTY = secrets.Novelty(secrets.default_identifiers(), 2048, 80, 0.75)
KINDS = {"upper hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": secrets.ALPHABETS[-1] + "+/"}


def found(text):
    return [text[s:e] for s, _, e in NOVELTY.spans(text, secrets.base_spans(text))]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("length", [32, 64, 128, 256, 512])
def test_random_strings_of_every_alphabet(kind, length):
    rng = random.Random(length)
    keys = ["".join(rng.choices(KINDS[kind], k=length)) for _ in range(40)]
    keys = [k for k in keys if any(c.isdigit() for c in k) and any(c.isalpha() for c in k)]
    assert [found(f"the signing key is {k} and more text") for k in keys] == [[k] for k in keys]


def test_names_are_no_secrets():
    for name in ("client_secret_default_value_1_" * 8, "abcd1234" * 16, "A1B2C3D4" * 32):
        assert found(f"the key is {name} here") == []


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\\n"])
def test_key_block(newline):
    rng = random.Random(3)
    lines = ["".join(rng.choices(KINDS["base64"], k=64)) for _ in range(12)] + ["".join(rng.choices(KINDS["base64"], k=9)) + "=="]
    body = newline.join(lines)
    text = f"before{newline}-----BEGIN RSA PRIVATE KEY-----{newline}{body}{newline}-----END RSA PRIVATE KEY-----{newline}after"
    assert found(text) == [body]


def test_value_on_the_next_line():
    rng = random.Random(9)
    one, two, three = ("".join(rng.choices(secrets.ALPHABETS[-1], k=40)) for _ in range(3))
    assert found(f"credential\n\n  {one}\nother {two}") == [one]
    assert found(f"secret:\n{one}\n{two}\n{three}\n") == [one, two, three]
    assert found(f"colour\n{one}\nsecret") == []
    assert found(f"-----BEGIN PRIVATE KEY-----\n{one}\n{two}") == [one, two]
    assert found(f"signature {one}\n{two}") == [one]

"""Secrets that touch a dot or hold few digits."""

from __future__ import annotations

import base64
import random
import string
import uuid

import pytest

from pressroom.llm import secret_scan


def novel(text):
    return [text[a:b] for a, b, kind in secret_scan.find_spans(text, 4.5)[1] if kind == "novel"]


def test_secrets_before_and_around_dots():
    key = "q8Zr2LmX7vTb4KpW9sYd3HfG"
    assert novel(f"the private key is {key}. Keep it") == novel(f"the private key is {key}, keep it") == [key]
    rng = random.Random(8)
    parts = [base64.urlsafe_b64encode(text).decode().rstrip("=") for text in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"1234567890","name":"J. Doe"}', rng.randbytes(32))]
    token = ".".join(parts)
    assert novel(f"Authorization: Bearer {token}") == novel(f"Authorization: Bearer {token}...") == [token]
    text = f"Authorization: Bearer {token}. Then"
    assert secret_scan.redact(text, secret_scan.find_spans(text, 4.5)[1], "[SECRET]") == "Authorization: Bearer [SECRET]. Then"


def test_random_keys_of_few_digits():
    rng = random.Random(5)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=20)) for _ in range(300)]
    few = [k for k in keys if sum(c.isdigit() for c in k) < 3]
    assert len(few) > 60 and all(novel(f"webhook signature {k} here") == [k] for k in few)


def test_known_words_are_not_secrets():
    for text in ("session com.example.service.AuthenticationTokenProvider", "key Donaudampfschifffahrtsgesellschaft.", "token 12345678901234567890123", "auth a...b"):
        assert novel(text) == []


RNG = random.Random(1)
BASE62 = string.ascii_letters + string.digits
NAMES = (
    "river stone bridge morning quiet market engine signal harbor window garden planet silver basket thunder copper meadow lantern "
    "orchard compass village captain pepper shadow winter summer letter object handler manager factory builder socket thread "
    "fluss morgen fenster garten planung brücke lumière maison fenêtre ventana puente jardín"
).split()


def named(n, joint, title=False):
    words = [RNG.choice(NAMES).encode("ascii", "ignore").decode() for _ in range(n)]
    return joint.join(w.title() if title else w for w in words)


def drawn(letters, n):
    return "".join(RNG.choices(letters, k=n))


SECRETS = {
    "base62 of 20": lambda: drawn(BASE62, 20), "base62 of 32": lambda: drawn(BASE62, 32), "base62 of 64": lambda: drawn(BASE62, 64),
    "base64 of 40": lambda: base64.b64encode(RNG.randbytes(30)).decode(), "hex of 24": lambda: drawn("0123456789abcdef", 24),
    "base64 for urls": lambda: base64.urlsafe_b64encode(RNG.randbytes(32)).decode().rstrip("="),
    "small letters and digits": lambda: drawn(string.ascii_lowercase + string.digits, 32),
    "capitals and digits": lambda: drawn(string.ascii_uppercase + string.digits, 24), "named prefix": lambda: "sk_live_" + drawn(BASE62, 24),
}
NO_SECRETS = {
    "paths": lambda: f"{RNG.choice(['src', 'usr', 'var', 'opt'])}/{named(4, '/')}/{named(2, '', True)}{RNG.randint(1, 99)}.java",
    "identifiers": lambda: named(4, "", True) + str(RNG.randint(1, 2024)), "snake case": lambda: f"{named(4, '_')}_{RNG.randint(1, 99)}",
    "hosts": lambda: f"{named(1, '')}{RNG.randint(1, 9)}.{named(3, '.')}.com", "uuids": lambda: str(uuid.UUID(int=RNG.getrandbits(128), version=4)),
    "versions": lambda: f"python3.11/site-packages/{named(2, '_')}-{RNG.randint(1, 9)}.{RNG.randint(0, 30)}.{RNG.randint(0, 9)}",
    "dated names": lambda: f"backup-2024-{RNG.randint(1, 12):02}-{RNG.randint(1, 28):02}T{RNG.randint(0, 23):02}-{named(1, '')}",
}


@pytest.mark.parametrize("kind", SECRETS)
def test_labelled_secrets_are_found(kind):
    keys = [SECRETS[kind]() for _ in range(200)]
    assert sum([a for a in novel(f"webhook signature {k} is used here, in the code")] == [k] for k in keys) >= 198


@pytest.mark.parametrize("kind", NO_SECRETS)
def test_labelled_names_are_left_alone(kind):
    names = [NO_SECRETS[kind]() for _ in range(200)]
    assert sum(bool(novel(f"webhook signature {k} is used here, in the code")) for k in names) <= 6

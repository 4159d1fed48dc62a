"""Pseudonyms against a plain Feistel network, and on hostile texts."""

from __future__ import annotations

import datetime
import random
import re
import time
from hashlib import sha256

import pytest

from clustrial.llm import pii
from tests.llm.helpers import AWKWARD, documents

KEY = "a key"
DAY0 = datetime.date(1800, 1, 1)


def stream(*parts):
    return sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()


def feistel(text, alphabet, tweak):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for turn in range(1, 9):
        bytes_ = bytes.fromhex(stream(tweak, turn, b))
        a, b = b, "".join(alphabet[(alphabet.index(c) + bytes_[i % 32]) % len(alphabet)] for i, c in enumerate(a))
    return a + b


def moved_day(day):
    a, b = day % 189, day // 189
    for turn in range(1, 9):
        if turn % 2:
            a = (a + int(stream("day", turn, b)[:12], 16)) % 189
        else:
            b = (b + int(stream("day", turn, a)[:12], 16)) % 773
    return b * 189 + a


def put_back(text, new, own):
    fresh = iter(new)
    return "".join(next(fresh) if c in own else c for c in text)


def check_digit(payload):
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def plain(match):
    kind = next(k for k, p in pii.PATTERNS.items() if re.fullmatch(p, match, re.A))
    digits = re.sub("[^0-9]", "", match)
    if kind == "email":
        local, domain = match.split("@")
        own = re.sub("[^a-z0-9]", "", local.lower())
        return put_back(local.lower(), feistel(own, pii.ALNUM, kind), pii.ALNUM) + "@" + domain
    if kind == "token":
        new = feistel(match.lower(), pii.HEX, kind)
        return new.upper() if match == match.upper() else new
    if kind == "ip":
        new = feistel("".join(f"{int(o):02x}" for o in match.split(".")), pii.HEX, kind)
        return ".".join(str(b) for b in bytes.fromhex(new))
    if kind.endswith("date"):
        form = "%Y-%m-%d" if kind == "iso_date" else "%d/%m/%Y"
        try:
            day = datetime.datetime.strptime(match, form).date()
        except ValueError:
            return match
        return (DAY0 + datetime.timedelta(moved_day((day - DAY0).days))).strftime(form)
    if kind == "phone":
        country = (re.match(r"\+\d{1,3}(?=[ .(-])", match) or [""])[0]
        own = match[len(country) :]
        return country + put_back(own, feistel(re.sub("[^0-9]", "", own), pii.DIGITS, kind), pii.DIGITS)
    if kind == "ssn":
        for _ in range(64):
            digits = feistel(digits, pii.DIGITS, kind)
            if re.fullmatch("(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}", digits):
                break
        return put_back(match, digits, pii.DIGITS)
    if check_digit(digits[:-1]) != digits[-1]:
        return match
    body = feistel(digits[:-1], pii.DIGITS, kind)
    return put_back(match, body + check_digit(body), pii.DIGITS)


def plain_text(text):
    return text if text is None else re.sub(pii.COMBINED, lambda m: plain(m[0]), text, flags=re.A)


def some_values(rnd):
    digit = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    payload = digit(rnd.choice([12, 15, 18]))
    return [
        f"{rnd.choice(['a.b', 'X_y9', 'q', '...', 'Long-Name+tag'])}@{rnd.choice(['x.com', 'm.x-1.co.uk', 'a.b9', 'x.y.z9.de.'])}",
        "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice([31, 32, 41]))),
        "".join(rnd.choice("0123456789ABCDEF") for _ in range(40)),
        f"{rnd.randrange(300)}.{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(256)}",
        f"{rnd.randrange(1750, 2230)}-{rnd.randrange(1, 14):02d}-{rnd.randrange(1, 33):02d}",
        f"{rnd.randrange(1, 33):02d}/{rnd.randrange(1, 14):02d}/{rnd.randrange(1790, 2210)}",
        f"+{rnd.randrange(1, 999)} ({digit(3)}) {digit(3)}-{digit(4)}", f"({digit(3)}) {digit(3)} {digit(4)}",
        f"{digit(3)}-{digit(2)}-{digit(4)}", payload + check_digit(payload), payload + digit(1),
        " ".join(digit(4) for _ in range(4)), "plain words", "5.0", "@", "x@",
    ]


def test_same_as_a_plain_feistel_network(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        values = [v for _ in range(2) for v in some_values(rnd)]
        rnd.shuffle(values)
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(values)))
    rows += AWKWARD
    found = pii.pseudonymise(documents(spark, rows), KEY).select("doc_id", "text").collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(str((i, plain_text(t))) for i, t in rows)
    changed = {x for i, t in rows if t for x in [plain_text(t) != t]}
    assert changed == {True, False}


HOSTILE = {
    "dotted labels": "a@" + "b." * 1_000_000,
    "longer labels": "a@" + "bb." * 300_000 + "com",
    "hexadecimal": "0123456789abcdef" * 62_500,
    "long local part": "a1." * 300_000 + "@x.com",
    "at signs": "a@" * 300_000,
    "digits": "1234567890" * 100_000,
    "dotted digits": "1.2.3." * 150_000,
    "many values": "a.b@x.com 2021-03-04 " * 3_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_take_linear_time(spark, name):
    text = HOSTILE[name]
    started = time.monotonic()
    row = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first()
    assert time.monotonic() - started < 60
    if name in ("hexadecimal", "long local part", "many values"):
        assert row.text == plain_text(text)
    else:
        assert len(row.text) == len(text)


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([("x@y.com", 1, 2, 3, 4)], "text string, _hits int, _new int, hits int, New int")
    row = pii.pseudonymise(df, KEY).first()
    assert row.asDict() | {"text": "", "pii_found": ""} == {"text": "", "_hits": 1, "_new": 2, "hits": 3, "New": 4, "pii_found": ""}

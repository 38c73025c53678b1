"""Personal data and secrets planted in the given documents: what is found, and what is added elsewhere."""

import collections
import os
import random

import pytest

from ledgerloom.llm import pii, secrets
from llm_fixtures import documents, workers_find_the_package  # noqa: F401

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "letters and digits": LOWER + UPPER + DIGITS, "base64": LOWER + UPPER + DIGITS + "+/", "url": LOWER + UPPER + DIGITS + "_-",
    "base32": UPPER + "234567", "lower and digits": LOWER + DIGITS, "letters": LOWER + UPPER, "upper": UPPER, "lower": LOWER,
}


@pytest.fixture(scope="module")
def plain(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect()
    return [(r.doc_id, r.text) for r in rows]


def planted(plain, make, seed):
    """Each text with one string in place of a blank; the strings' kinds and places by id."""
    draw, out, places = random.Random(seed), [], {}
    for key, text in plain:
        gaps = [i for i, c in enumerate(text) if c == " "]
        if not gaps:
            continue
        at = draw.choice(gaps)
        kind, string = make(draw)
        out.append((key, f"{text[:at]} {string} {text[at + 1:]}"))
        places[key] = kind, at + 1, at + 1 + len(string)
    return out, places


def test_planted_secrets_are_found(documents, plain):  # noqa: F811
    def make(draw):
        kind = draw.choice(list(ALPHABETS))
        return kind, "".join(draw.choices(ALPHABETS[kind], k=draw.randint(20, 40)))

    seen, hit = collections.Counter(), collections.Counter()
    for seed in range(3):
        texts, places = planted(plain, make, seed)
        for r in secrets.find(documents(texts)).collect():
            kind, s, e = places[r.id]
            seen[kind] += 1
            hit[kind] += 10 * sum(min(e, x.end) - max(s, x.start) for x in r.spans if x.start < e and s < x.end) >= 9 * (e - s)
    print({k: (hit[k], seen[k]) for k in seen})
    assert all(hit[k] >= 0.9 * seen[k] for k in seen) and sum(hit.values()) >= 0.95 * sum(seen.values())


def test_texts_without_secrets_gain_none(documents, plain):  # noqa: F811
    assert sum(len(r.spans) - len(r.base) for r in secrets.find(documents(plain)).collect()) == 0


def test_redaction_of_odd_tables(documents):  # noqa: F811
    assert secrets.redact(documents([])).count() == 0
    long = "plain words " * 200_000 + "x7Kd93hQpZ2mVt81LcRw04bN end"
    rows = [(1, None), (2, ""), (3, "token=abcdef123"), (3, "token=abcdef123"), (None, "no id"), (4, long)]
    found = sorted((r.doc_id or 0, r.text or "", r.text is None) for r in secrets.redact(documents(rows)).collect())
    assert found == [(0, "no id", False), (1, "", True), (2, "", False), *2 * [(3, "[secret]", False)], (4, long[:2_400_000] + "[secret] end", False)]


def luhn(draw, size):
    digits = [draw.randrange(10) for _ in range(size - 1)]
    twice = [2 * d - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(digits))]
    return "".join(map(str, digits)) + str(-sum(twice) % 10)


def personal(draw):
    kind = draw.choice(("email", "ip", "card", "phone"))
    name = "".join(draw.choices(LOWER, k=6))
    if kind == "email":
        return kind, f"{name}.{draw.choice(['ann', 'bob'])}{draw.randrange(99)}@{name[::-1]}.{draw.choice(['com', 'org', 'co.uk'])}"
    if kind == "ip":
        return kind, ".".join(str(draw.randrange(1, 255)) for _ in range(4))
    if kind == "card":
        number = luhn(draw, 16)
        return kind, draw.choice(["", " ", "-"]).join(number[i : i + 4] for i in range(0, 16, 4))
    a, b, c = draw.randrange(200, 999), draw.randrange(200, 999), draw.randrange(1000, 9999)
    return kind, draw.choice([f"+1 {a} {b} {c}", f"+44 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"])


def test_planted_personal_data_is_found(documents, plain):  # noqa: F811
    seen, hit = collections.Counter(), collections.Counter()
    for seed in range(3):
        texts, places = planted(plain, personal, seed)
        by = {key: text for key, text in texts}
        for r in pii.find(documents(texts)).collect():
            kind, s, e = places[r.id]
            name = kind if kind != "phone" else "phone with +" if by[r.id][s] == "+" else "phone without +"
            seen[name] += 1
            hit[name] += any(x.kind == kind and x.start <= s and x.end >= e for x in r.spans)
    print({k: (hit[k], seen[k]) for k in seen})
    assert all(hit[k] >= 0.9 * seen[k] for k in seen)

"""Secrets go whole, with data of the base kinds inside; recall and precision on planted data."""

import random
import string

import pytest

from postlens.llm import pii


@pytest.fixture(scope="module")
def booster(spark):
    return pii.train(spark)


def masked(spark, booster, texts):
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), booster)
    rows = found.select("doc_id", "base", "spans", pii.redacted(found["text"], found["spans"]).alias("masked")).collect()
    return sorted(rows, key=lambda r: r["doc_id"])


SETTINGS = {
    "login with password=hunter2!foo@bar.com now": ["hunter2", "foo", "bar.com"],
    "use api_key: k9x8w7v6u5t4.10.1.2.3zz9 here": ["k9x8", "10.1", "zz9"],
    'the token="abc+14155551234567zz" is old': ["abc", "1415", "67zz"],
    "password   =   s3cretvalue": ["s3cret"],
    "password\t=\ts3cretvalue": ["s3cret"],
    "pwd=12ab": ["12ab"],
    'client_secret = "correct horse 7 staple"': ["correct", "staple"],
    "key QmFzZUtleVdpdGhOb0RpZ2l0c0lu in the file": ["QmFz"],
}


def test_settings_go_whole(spark, booster):
    for (text, gone), r in zip(SETTINGS.items(), masked(spark, booster, SETTINGS), strict=True):
        assert not [g for g in gone if g in r["masked"]], (text, r["masked"])


def test_base_spans_stay_inside_wider_ones(spark, booster):
    r = masked(spark, booster, ["password=hunter2!foo@bar.com"])[0]
    kinds = {s["kind"] for s in r["spans"]}
    assert {"email", "secret"} <= kinds and set(r["base"]) <= set(r["spans"])


PROSE = ["", None, "the token: of thanks was a password : required field", "version 2.10.33 of 2024-11-12, pages 120-134", "room 12, table 9, 3456 items at 19.99", "a" * 5000, "Donaudampfschifffahrtsgesellschaft sails", "INTERNATIONALISATIONALISM", "word " * 3000]


def test_prose_stays(spark, booster):
    for text, r in zip(PROSE, masked(spark, booster, PROSE), strict=True):
        assert r["masked"] == (text or ""), text


def planted(n):
    r = random.Random(99)  # another seed and other words than the examples'
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    words = ["harbour", "window", "yellow", "marching", "under", "of", "the", "quietly", "seven"]
    secrets = [
        lambda: f"passwd={pick(string.ascii_letters + string.digits, 10)}",
        lambda: f"access_key: {pick(string.ascii_uppercase + string.digits, 20)}",
        lambda: pick("0123456789abcdef", 32),
        lambda: f"password = {pick(string.ascii_lowercase, 5)}{pick(string.digits, 3)}",
        lambda: f"{pick(string.digits, 3)}-{pick(string.digits, 2)}-{pick(string.digits, 4)}",
        lambda: f"DE{pick(string.digits, 20)}",
        lambda: pick(string.ascii_letters + string.digits, 36),
    ]
    clean = [lambda: f"19{pick(string.digits, 2)}", lambda: f"{r.randint(1, 28)}.{r.randint(10, 12)}.2023", lambda: f"item{r.randint(1, 9)}", lambda: f"{r.randint(2, 99)}.{r.randint(10, 99)}", lambda: f"B{pick(string.digits, 4)}", lambda: f"token: {r.choice(words)}"]
    out = []
    for k in range(n):
        one = secrets[k % len(secrets)]() if k % 2 else clean[k // 2 % len(clean)]()
        out.append((" ".join(r.choices(words, k=12)) + f" {one} " + " ".join(r.choices(words, k=12)), one, k % 2))
    return out


def test_recall_and_precision_on_planted_data(spark, booster):
    cases = planted(560)
    rows = masked(spark, booster, [t for t, _, _ in cases])
    hit = [one.split("=")[-1].split(": ")[-1].strip() not in r["masked"] for (_, one, _), r in zip(cases, rows, strict=True)]
    found = sum(h for h, (_, _, y) in zip(hit, cases, strict=True) if y)
    false = sum(len(r["spans"]) > 0 for r, (_, _, y) in zip(rows, cases, strict=True) if not y)
    total = sum(y for _, _, y in cases)
    assert found / total >= 0.9 and found / (found + false) >= 0.9

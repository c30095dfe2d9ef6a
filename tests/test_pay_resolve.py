"""Pay to store: kept, given a period, replaced by the text's, or marked; and the same again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from postlens.functions import pay, pay_resolve

PLACE = [("Toronto, Ontario, Canada", "Canada")]
TEXT = "<p>The base salary range for this role is $120,000 CAD - $150,000 CAD per year.</p>"
TWO = "<p>Base salary:</p><p>United States: $120,000 USD - $150,000 USD per year</p><p>Canada: $100,000 CAD - $130,000 CAD per year</p>"

CASES = {
    "nothing": (None, None, None),
    "kept": ('{"min":100000,"max":120000,"currency":"USD","interval":"year","extra":{"a":[1]}}', "<p>no pay here</p>", {"min": 100000, "max": 120000, "currency": "USD", "interval": "year", "extra": {"a": [1]}}),
    "period": ('{"min":120000,"max":150000,"currency":"CAD"}', TEXT, {"min": 120000, "max": 150000, "currency": "CAD", "interval": "year", "interval_source": "posting_text"}),
    "marked": ('{"min":1,"max":2,"currency":"USD","interval":"year"}', "<p>no pay</p>", {"min": 1, "max": 2, "currency": "USD", "interval": "year", "validation": {"status": "placeholder"}}),
    "no amount": ('{"compensationTierSummary":"Competitive"}', "<p>no pay</p>", {"compensationTierSummary": "Competitive"}),
    "empty": ("{}", "", None),
    "no object": ("[1]", "", None),
}


@pytest.fixture(scope="module")
def run(spark):
    def of(rows):
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, pay string, html string")
        places = F.array(*[F.struct(F.lit(a).alias("location"), F.lit(b).alias("country")) for a, b in PLACE])
        return [r["x"] for r in df.select("k", pay_resolve.resolved(F.col("pay"), F.col("html"), places).alias("x")).orderBy("k").collect()]

    return of


def test_kinds_of_stored_pay(run):
    got = run([(p, h) for p, h, _ in CASES.values()])
    assert [None if x is None else json.loads(x) for x in got] == [w for _, _, w in CASES.values()]


def test_text_replaces_what_cannot_be_pay(run):
    stored = '{"min":1,"max":2,"currency":"USD","interval":"year","compensationTierSummary":"$1 – $2 • Offers equity"}'
    x = json.loads(run([(stored, TEXT)])[0])
    assert (x["source"], x["min"], x["max"], x["currency"], x["interval"]) == ("posting_text", 120000, 150000, "CAD", "year")
    assert x["compensationTierSummary"] == "CA$120K – CA$150K · Offers equity" and x["source_structured"] == json.loads(stored)
    assert "120,000" in x["evidence"]


def test_ranges_of_places_are_not_blended(run):
    x = json.loads(run([(None, TWO)])[0])
    assert "min" not in x and x["compensationTierSummary"] == "$120K – $150K · CA$100K – CA$130K · Multiple ranges"
    assert [(r["qualifier"], r["scope"]) for r in x["ranges"]] == [("United States", "none"), ("Canada", "all")]


def test_usable_ranges_read_what_was_resolved(spark, run):
    x = run([(None, TWO), ('{"min":1,"max":2,"currency":"USD","interval":"year"}', "")])
    df = spark.createDataFrame([(v,) for v in x], "p string")
    got = [[(r["currency"], r["min_annual"]) for r in row[0]] for row in df.select(pay.usable_ranges(F.col("p"))).collect()]
    assert got == [[("CAD", 100000.0)], []]


def test_resolving_again_changes_nothing(run):
    r = random.Random(4)
    number = lambda: r.choice([0, 1, 2, 45.5, 120000, 150000, 90_000_000, "x", None])
    part = lambda: {k: v for k, v in (("min", number()), ("max", number()), ("currency", r.choice(["USD", "CAD", "", None])), ("interval", r.choice(["year", "1 YEAR", "per-hour-wage", "NONE", None])), ("compensationType", r.choice(["Salary", "EquityPercentage", None]))) if r.random() < 0.8}
    rows = []
    for _ in range(60):
        stored = part() | r.choice([{}, {"ranges": [part() for _ in range(r.randint(0, 3))]}, {"summaryComponents": [part(), 3]}, {"compensationTiers": [{"components": [part()]}, "x"]}, {"validation": {"status": "old"}}, {"interval": "year", "interval_source": "posting_text"}])
        rows.append((r.choice([json.dumps(stored), None, "{}"]), r.choice([TEXT, TWO, "", None, "<p>2 days a week</p>", "<p>Pay: $45.50 - $60 an hour</p>"])))
    once = run(rows)
    again = run([(x, h) for x, (_, h) in zip(once, rows, strict=True)])
    parse = lambda xs: [None if x is None else json.loads(x) for x in xs]
    assert parse(once) == parse(again)


def test_money(spark):
    amounts = [45.0, 45.5, 999.99, 1000.0, 2250.0, 2350.0, 2450.0, 2550.0, 2650.0, 52650.0, 154000.0, 179300.152, 1_234_567.0, 1_500_000.0, 12_000_000.0, *[float(k * 50) for k in range(21, 400)]]

    def want(a):
        if a >= 1_000_000:
            return f"${a / 1_000_000:.2f}".rstrip("0").rstrip(".") + "M"
        if a >= 1000:
            return "$" + (f"{a / 1000:.1f}".rstrip("0").rstrip(".")) + "K"
        return "$" + (f"{a:.2f}".rstrip("0").rstrip(".") if a != int(a) else str(int(a)))

    df = spark.createDataFrame([(a,) for a in amounts], "a double")
    assert [r[0] for r in df.select(pay_resolve.money(F.col("a"), F.lit("USD"))).collect()] == [want(a) for a in amounts]
    other = df.limit(1).select(pay_resolve.money(F.col("a"), F.lit("chf")), pay_resolve.money(F.col("a"), F.lit("SEK")), pay_resolve.money(F.col("a"), F.lit(None).cast("string"), F.lit("$"))).first()
    assert tuple(other) == ("CHF 45", "SEK 45", "$45")


def test_built(spark):
    df = spark.createDataFrame([("cad", 150000.0, 120000.0, "year"), ("USD", 0.0, 45.0, "hour"), ("", 1.0, 2.0, None), (None, 1.0, 2.0, None), ("USD", -1.0, None, None)], "c string, a double, b double, i string")
    got = [r[0] and json.loads(r[0]) for r in df.select(pay_resolve.built(F.col("c"), F.col("a"), F.col("b"), F.col("i"), F.lit("lever"), F.lit(None).cast("string"))).collect()]
    assert got == [{"compensationTierSummary": "CA$120K – CA$150K", "currency": "CAD", "min": 120000, "max": 150000, "source": "lever", "interval": "year"}, {"compensationTierSummary": "$45 / hour", "currency": "USD", "min": 45, "max": 45, "source": "lever", "interval": "hour"}, None, None, None]


@pytest.mark.parametrize("text, amount, want", [("from 120,000 to", 120000.0, True), ("12 0000", 120000.0, True), ("45 an hour", 45.0, False), ("$45.50 an hour", 45.0, True), ("$455", 45.0, False), (None, 45.0, False)])
def test_mentions_amount(spark, text, amount, want):
    df = spark.createDataFrame([(text, amount)], "t string, a double")
    assert df.select(pay_resolve.mentions_amount(F.col("t"), F.col("a"))).first()[0] is want

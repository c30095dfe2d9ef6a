"""Place labels, places in texts, structured data and small clean-ups."""

import json

import pytest
from pyspark.sql import functions as F

from postlens.functions import markup, places


def one(spark, expression, schema, *values):
    return spark.createDataFrame([values], schema).select(expression.alias("x")).first()["x"]


CANONICAL_LABEL = [
    ("Toronto", None, "Toronto, Ontario, Canada"),
    ("toronto, ON, CA", "Unknown", "Toronto, Ontario, Canada"),
    ("Montréal, Quebec", "Canada", "Montréal, Quebec, Canada"),
    ("San Francisco, California, USA", "", "San Francisco, CA, United States"),
    ("New York City, NY.", "United States", "New York, NY, United States"),
    ("Richmond", None, None),
    ("Richmond, BC", "Canada", "Richmond, British Columbia, Canada"),
    ("Toronto", "United States", None),
    ("Toronto, Toronto", None, None),
    ("Toronto, Canada, ON", None, None),
    ("Toronto HQ", None, None),
    ("Toronto,,Canada", None, None),
    ("", None, None),
    (None, None, None),
]


def test_canonical_label(spark):
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(CANONICAL_LABEL)], "k int, l string, c string, want string")
    got = df.select("l", "c", "want", places.canonical_label(F.col("l"), F.col("c")).alias("got")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []


NAMED_PLACES = [
    ("for candidates in the United States", {("country", "United States")}),
    ("in the Bay Area or Denver, CO", {("city", "san francisco"), ("city", "denver"), ("state", "CO")}),
    ("New York City", {("city", "new york")}),
    ("in Washington D.C.", {("state", "DC")}),
    ("Virginia", {("state", "VA")}),
    ("join us", {("country", "United States")}),
    ("in CA", set()),
    (None, set()),
]


def test_named_places(spark):
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(NAMED_PLACES)], "k int, t string")
    got = {r["k"]: {(p["kind"], p["name"]) for p in r["got"]} for r in df.select("k", places.named_places(F.col("t")).alias("got")).collect()}
    assert [got[k] for k in range(len(NAMED_PLACES))] == [want for _, want in NAMED_PLACES]


SCOPE = [
    ("United States", [("Boston, MA", "United States"), ("Toronto, ON", "Canada")], "some"),
    ("Canada", [("Toronto", "Canada")], "all"),
    ("Toronto area", [("Vancouver, BC", "Canada")], "none"),
    ("California", [("San Francisco", "United States")], "all"),
    ("Level 4", [("Toronto", "Canada")], "unclear"),
    ("Toronto", [], "unclear"),
    ("", [("Toronto", "Canada")], None),
    (None, None, None),
]


def test_scope(spark):
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(SCOPE)], "k int, q string, x array<struct<location:string,country:string>>, want string")
    got = df.select("q", "x", "want", places.scope(F.col("q"), F.col("x")).alias("got")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []


def test_postal_address(spark):
    of = lambda v: tuple(one(spark, places.postal_address(F.col("l"), F.lit("Canada")), "l string", v))
    assert of("Canada") == (None, None, None, "Canada")
    assert of("Toronto") == (None, "Toronto", None, "Canada")
    assert of("Toronto, ON") == (None, "Toronto", "ON", "Canada")
    assert of("London, United Kingdom") == (None, "London", None, "United Kingdom")
    assert of("1 Main St, Suite 2, Toronto, ON, Canada") == ("1 Main St, Suite 2", "Toronto", "ON", "Canada")
    assert of("") == (None, None, None, None)


@pytest.mark.parametrize("text, want", [("🚀 Join us", "Join us"), ("We 🎉 hire", "We hire"), ("Great 🎉!", "Great!"), ("ok ✓ → ©", "ok ✓ → ©"), ("a👍🏽b", "ab"), ("plain", "plain"), ("", ""), (None, None)])
def test_without_emoji(spark, text, want):
    assert one(spark, markup.without_emoji(F.col("t")), "t string", text) == want


def test_background(spark):
    page = "<meta property='og:description' content='The other text that is long enough'><META name=\"description\" content=\"We build &amp; sell  &lt;b&gt;maps&lt;/b&gt; of towns\">"
    of = lambda v: one(spark, markup.site_background(F.col("t")), "t string", v)
    assert of(page) == "We build & sell maps of towns"
    assert of("<meta name=description content=short>") is None and of("") is None and of(None) is None


def test_units(spark):
    assert [one(spark, markup.salary_unit(F.col("t")), "t string", v) for v in ("per year", "Monthly", "wk", "daily", "per hr", "once", None)] == ["YEAR", "MONTH", "WEEK", "DAY", "HOUR", None, None]
    assert one(spark, markup.employment_type(F.col("t")), "t string", " Co_Op ") == "INTERN"


def test_markup_needs_place_and_date(spark):
    schema = "id long, title string, company string, posted string, is_active boolean, workplace_type string, location string, locations array<struct<location:string>>, applicant_countries array<string>, role_type string, country string, pay_ranges array<struct<currency:string,min_annual:double,max_annual:double,period:string>>"
    rows = [
        (1, "Engineer", "Acme", "2001-08-01", True, "hybrid", "Toronto, ON", [], None, "internship", "Canada", [("CAD", 1.0, 2.0, "year")]),
        (2, "Engineer", "Acme", "2001-08-01", True, "remote", "Toronto, ON", [], None, "full_time", "Canada", None),
        (3, "Engineer", "Acme", "2001-08-01", True, "Remote", None, None, ["Europe", " canada "], "full_time", "Canada", []),
        (4, "Engineer", "Acme", None, True, "hybrid", "Toronto, ON", [], None, "full_time", "Canada", None),
        (5, " ", "Acme", "2001-08-01", True, "hybrid", "Toronto, ON", [], None, "full_time", "Canada", None),
        (6, "Engineer", "Acme", "2001-08-01", False, "hybrid", "Toronto, ON", [], None, "full_time", "Canada", None),
        (7, "Engineer", "Acme", "2001-08-01", None, None, "", [(" ",)], None, "full_time", "Canada", None),
    ]
    jobs = spark.createDataFrame(rows, schema).withColumn("posted_at", F.to_timestamp("posted"))
    got = {r["id"]: json.loads(r["json"]) for r in markup.structured_data(jobs).collect()}
    assert set(got) == {1, 3}
    assert got[1]["employmentType"] == "INTERN" and got[1]["jobLocation"]["address"]["addressRegion"] == "ON" and got[1]["baseSalary"]["value"]["maxValue"] == 2.0
    assert got[3]["jobLocationType"] == "TELECOMMUTE" and got[3]["applicantLocationRequirements"] == [{"@type": "Country", "name": "canada"}] and "jobLocation" not in got[3]
    assert markup.sitemap_entries(jobs, "https://x.example/").where("id = 1").first()["entry"] == "<url><loc>https://x.example/jobs/1</loc><lastmod>2001-08-01</lastmod></url>"


def test_skills_are_resolved(spark):
    wanted = spark.createDataFrame([("Python",), ("python ",), ("golang",), ("COBOL",), ("",), (None,)], "skill string")
    offered = spark.createDataFrame([("Python",), ("Go",)], "name string")
    got = {r["skill"]: (r["status"], r["resolved"]) for r in markup.resolved_skills(wanted, offered, {"golang": "Go"}).collect()}
    assert got["Python"] == ("supported", "Python") and got["python "] == ("canonicalized", "Python") and got["golang"] == ("canonicalized", "Go")
    assert got["COBOL"] == ("unknown", "COBOL") and got[""] == ("unchecked", "")
    assert {r["status"] for r in markup.resolved_skills(wanted.where("skill > ''"), offered.limit(0), {}).collect()} == {"unchecked"}


def test_functions_for_sql(spark):
    names = markup.register_functions(spark, "t_")
    assert "t_fold" in names and "t_html_text" in names
    row = spark.sql("SELECT t_fold('Café–X') AS a, t_strip_tags('<b>x</b>') AS b, t_annualize(10.0D, 'month') AS c, t_html_text('<p>hi</p>') AS d, t_page_url('http://a/b/#c') AS e, t_squeeze(' a  b ') AS f").first()
    assert tuple(row) == ("cafe x", " x ", 120.0, "hi", "http://a/b", "a b")


JOB_PLACES = [
    ("Toronto, ON; toronto, Canada; Toronto; Berlin, Germany", [("Toronto, Ontario, Canada", "Canada", "Toronto, ON", ["toronto, Canada", "Toronto"]), ("Berlin, Germany", "Germany", None, None)]),
    ("Toronto HQ", [("Toronto HQ", "Canada", None, None)]),
    ("Home; Vancouver, BC", [("Vancouver, British Columbia, Canada", "Canada", "Vancouver, BC", None)]),
    ("Offsite", [("Offsite", "Unknown", None, None)]),
    ("San Francisco, California / New York, NY", [("San Francisco, CA, United States", "United States", "San Francisco, California", None), ("New York, NY, United States", "United States", "New York, NY", None)]),
    ("", [("Unknown", "Unknown", None, None)]),
    (None, [("Unknown", "Unknown", None, None)]),
]


def shown(found):
    return [(x["location"], x["country"], x["raw_location"], x["also_published"]) for x in found]


def test_job_places_keep_every_published_label(spark):
    df = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(JOB_PLACES)], "k int, raw string").withColumn("got", places.job_places(F.col("raw")))
    again = places.job_places(F.array_join(places.published_labels(F.col("got")), "; "))
    rows = df.select("k", "got", again.alias("again")).orderBy("k").collect()
    assert [shown(r["got"]) for r in rows] == [want for _, want in JOB_PLACES]
    assert [shown(r["again"]) for r in rows] == [want for _, want in JOB_PLACES]


def test_stated_countries_overrule_labels(spark):
    stated = [("London", "CA", "London", "ON"), ("Paris", "France", None, None), ("Toronto", "", None, None), ("Remote", "US", None, None), ("Home; Boston", "CA", None, None)]
    df = spark.createDataFrame([(stated,)], f"s {places.STATED}")
    got = df.select(places.job_places(F.lit(None).cast("string"), F.col("s")).alias("got")).first()["got"]
    assert [(x["location"], x["country"], x["source_location"]) for x in got] == [
        ("London, ON, Canada", "Canada", "London"),
        ("Paris", "France", None),
        ("Toronto, Ontario, Canada", "Canada", None),
        ("Remote", "United States", None),
        ("Boston, MA, United States", "United States", None),
    ]

"""Classification, pay, places, skills, HTML."""

import pytest
from pyspark.sql import functions as F

from postlens.functions import classify, geo, pay, pay_text, skills, text, urls
from postlens.functions.html import cleaned, to_blocks, to_text


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


L = F.lit


def none():
    return F.lit(None).cast("string")


@pytest.mark.parametrize(
    "title,job_type,want",
    [
        ("Software Developer Co-op", None, "co_op"),
        ("Internal Tools Engineer", None, "unknown"),
        ("Software Engineering Intern", None, "internship"),
        ("New Grad Software Engineer", None, "new_grad"),
        ("Junior Developer", None, "entry_level"),
        ("Senior Software Engineer", "Intern", "full_time"),
        ("Something", "Full-Time", "full_time"),
        ("Something", "contract", "unknown"),
        ("Backend Engineer", None, "full_time"),
        ("  ", None, "unknown"),
    ],
)
def test_role_type(value, title, job_type, want):
    assert value(classify.role_type(L(title), none(), L(job_type).cast("string"))) == want


@pytest.mark.parametrize(
    "title,want",
    [("Software Engineer, Finance", True), ("Sales Engineer", False), ("Product Designer", False), ("Product Manager", False), ("Staff SRE", True), ("Recruiter", False), ("Technical Support Engineer", False), ("Data Scientist", True)],
)
def test_software_role(value, title, want):
    assert value(classify.is_software_role(L(title), none())) is want


def test_ambiguous_title_needs_evidence(value):
    assert not value(classify.is_software_role(L("Engineering Student"), L("mechanical drawings")))
    assert value(classify.is_software_role(L("Engineering Student"), L("Python and Java programming")))


@pytest.mark.parametrize(
    "args,want",
    [
        ((None, "Hybrid - 3 days", None, None, None), "hybrid"),
        (("Toronto", None, True, None, None), "remote"),
        (("Remote, Canada", None, None, None, None), "remote"),
        (("Toronto", None, None, "Engineer", "This position is hybrid."), "hybrid"),
        (("Toronto", None, None, "Engineer", "#LI-Remote #LI-Onsite"), "unspecified"),
        (("Toronto", None, None, "Engineer", "x #LI-On-site"), "onsite"),
        (("Toronto", None, None, None, None), "unspecified"),
    ],
)
def test_workplace(value, args, want):
    place, kind, remote, title, body = args
    assert value(classify.workplace(L(place).cast("string"), L(kind).cast("string"), L(remote).cast("boolean"), L(title).cast("string"), L(body).cast("string"))) == want


@pytest.mark.parametrize(
    "title,role,want",
    [("Developer Intern, Summer 2027", "internship", ("summer", 2027)), ("Intern Fall/Winter 2027", "internship", (None, None)), ("Intern 2026 Autumn", "internship", ("fall", 2026)), ("Intern Winter '27", "co_op", ("winter", 2027)), ("Spring 2027 Intern", "internship", (None, None)), ("Engineer", "full_time", (None, None))],
)
def test_academic_term(value, title, role, want):
    got = value(classify.academic_term(L(title), F.lit(None).cast("array<string>"), L("Summer 2030") if role == "full_time" else none(), L(role)))
    assert (got["season"], got["year"]) == want


@pytest.mark.parametrize(
    "title,role,body,want",
    [
        ("Software Engineer", "full_time", "<p>8+ years of experience</p>", "senior"),
        ("Software Engineer", "full_time", "<li>3 plus years in Python</li>", "mid"),
        ("Software Engineer", "full_time", "<li>2 years of experience or 5 years of work experience</li>", "entry"),
        ("Software Engineer", "full_time", "<h3>Nice to have</h3><p>9 years of experience</p>", "unknown"),
        ("Software Engineer", "full_time", "<p>5 years of experience preferred</p>", "unknown"),
        ("Software Engineer", "full_time", "<p>You mentor junior engineers</p>", "mid"),
        ("Engineering Intern", "full_time", "", "internship"),
        ("Lead Engineer", "full_time", "", "senior"),
        ("Consultant", "full_time", "", "mid"),
        ("Engineer", "new_grad", "", "entry"),
        ("Intermediate Engineer", "full_time", "", "mid"),
        ("Engineer", "full_time", None, "unknown"),
    ],
)
def test_experience(value, title, role, body, want):
    assert value(classify.experience_level(L(title), L(role), L(body).cast("string"))) == want


@pytest.mark.parametrize(
    "low,high,currency,period,want",
    [(100000, 150000, "USD", "year", None), (1, 2, "USD", "year", "placeholder"), (38, 58, "USD", "year", "below_floor"), (1000, 179300152, "USD", "year", "above_ceiling"), (20000, 300000, "USD", "year", "extreme_spread"), (5, 2, "USD", "hour", "inverted"), (None, None, "USD", "year", "no_amount"), (0, 50, "USD", "hour", None), (1, 2, "JPY", "year", None), (3, 4, None, None, "placeholder")],
)
def test_pay_problem(value, low, high, currency, period, want):
    assert value(pay.range_problem(L(low).cast("double"), L(high).cast("double"), L(currency).cast("string"), L(period).cast("string"))) == want


@pytest.mark.parametrize(
    "source,want",
    [
        ('{"min": 50, "max": 60, "currency": "usd", "interval": "per-hour-wage"}', [("USD", 104000.0, 124800.0)]),
        ('{"currency": "CAD", "interval": "year", "ranges": [{"min": 90000, "max": 100000}, {"min": "120000", "max": 130000, "currency": "USD"}]}', [("CAD", 90000.0, 100000.0), ("USD", 120000.0, 130000.0)]),
        ('{"summaryComponents": [{"compensationType": "Salary", "minValue": 100000, "maxValue": 120000, "currencyCode": "USD", "interval": "1 YEAR"}, {"compensationType": "Equity", "minValue": 1000, "maxValue": 2000, "currencyCode": "USD", "interval": "1 YEAR"}]}', [("USD", 100000.0, 120000.0)]),
        ('{"min": 1, "max": 2, "currency": "USD", "interval": "year"}', []),
        ('{"min": 90000, "max": 100000, "currency": "USD", "interval": "year", "validation": null}', []),
        ('{"min": "9e4", "max": -5, "currency": "USD", "interval": "year"}', []),
        ('{"min": 90000, "currency": "USD", "interval": "year", "kind": "ote"}', []),
        ("[1]", []),
        ("{bad", []),
        (None, []),
    ],
)
def test_usable_ranges(value, source, want):
    got = value(pay.usable_ranges(L(source).cast("string")))
    assert [(r["currency"], r["min_annual"], r["max_annual"]) for r in got] == want


def test_pay_in_text(value):
    found = lambda t: value(pay_text.pay_in_text(L(t)))
    one = found("The base salary range is $120,000 - $150,000 per year. Equity of $10,000 - $20,000.")
    assert [(r["min"], r["max"], r["interval"], r["kind"]) for r in one] == [(120000.0, 150000.0, "year", "base")]
    assert found("From 2020 - 2025 we raised $10M - $20M in funding") == [] and found("") == []
    two = found("Annual base salary\nUSD 100k to 120k\nIn Canada\nCAD 90k - 95k")
    assert [(r["min"], r["currency"], r["interval"]) for r in two] == [(100000.0, "USD", "year"), (90000.0, "CAD", None)]
    three = found("Pay: Level 2: $100,000 - $120,000 per year, Level 3: $130,000 - $150,000 per year and $40 to $60 an hour for contractors")
    assert [(r["label"], r["interval"]) for r in three] == [("Level 2", "year"), ("Level 3", "year"), (None, "hour")]
    places = found("The salary range is $90,000 - $100,000 in Canada and US$110,000 - US$120,000 in the United States. A signing bonus of $5,000 - $9,000 may apply")
    assert [(r["min"], r["currency"], r["qualifier"]) for r in places] == [(90000.0, None, "Canada"), (110000.0, "USD", "United States")]
    assert [r["kind"] for r in found("Pay range, on-target earnings: $200k - $220k")] == ["ote"]
    assert found("Salary range below\nWe have 12 offices\n$5 - $9") == []


def test_pay_in_html(spark):
    rows = spark.createDataFrame([("<p>Salary range</p><p>$90,000 &ndash; $100,000</p>",), (None,), ("<p>none</p>",)], "html string")
    assert [[r["min"] for r in row["x"]] for row in rows.select(pay_text.pay_in_html(F.col("html")).alias("x")).collect()] == [[90000.0], [], []]


@pytest.mark.parametrize(
    "raw,want",
    [("Toronto, ON", "Canada"), ("San Francisco, CA", "United States"), ("Toronto, CA", "Canada"), ("London, UK", "United Kingdom"), ("Remote - Canada", "Canada"), ("Berlin, Germany", "Germany"), ("Europe", "Unknown"), ("", "Unknown"), ("New York", "United States"), ("Springfield", "Unknown"), ("London HQ", "United Kingdom")],
)
def test_located(value, raw, want):
    assert value(geo.located(L(raw)))["country"] == want


@pytest.mark.parametrize("place,country,want", [("Toronto, ON", "Canada", True), ("Remote", "Canada", True), ("Remote", "Germany", False), ("Anywhere in North America", "United States", False), ("Austin, TX", "United States", True), ("Canada", "Canada", True), ("Somewhere", "Canada", False), (None, "Canada", False)])
def test_eligible_places(value, place, country, want):
    assert value(geo.eligible(L(place).cast("string"), L(country))) is want


def test_several_places(value):
    got = value(geo.job_locations(L("Toronto, ON; Vancouver, BC or toronto, on")))
    assert [(x["location"], x["country"]) for x in got] == [("Toronto, ON", "Canada"), ("Vancouver, BC", "Canada")]


@pytest.mark.parametrize("raw,want", [(" usa ", "United States"), ("EMEA", "Unknown"), ("", "Unknown"), ("new zealand", "New Zealand"), ("CANADA", "Canada")])
def test_country_field(value, raw, want):
    assert value(geo.normalized_country(L(raw))) == want


def test_skills(value):
    found = value(skills.in_text(L("C++, C#, Node.js and .NET; experience with Go; not JavaScripting. Trust. React to change.")))
    assert found == [".NET", "C#", "C++", "Go", "Node.js"]
    assert value(skills.in_field(L(" python;Python; node.js ;made up;"))) == ["Made Up", "Node.js", "Python"]
    assert value(text.title_case(L("node.js o'neil"))) == "Node.Js O'Neil"


def test_language(value):
    assert value(classify.language(L("Nous sommes une équipe qui travaille pour vous avec les meilleurs"))) == "fr"
    assert value(classify.language(L("We are the team that works for you with the best of tools"))) == "en"
    assert value(classify.language(L("123"))) == "unknown"


def test_html():
    source = "<div><p>A &amp; <b>b</b></p><ul><li>one</li></ul><script>x<y</script></div>"
    assert to_blocks(source) == "A & b\none"
    assert "- one" in to_text(source) and "x<y" not in to_text(source)
    assert cleaned('<p onclick="x">a<a href="javascript:x">b</a><i>c') == "<p>a<a>b</a><i>c</i></p>"
    assert to_text(None) == cleaned("  ") == ""


def test_urls(value):
    assert value(urls.canonical_apply_url(L("https://A.com/x/?utm_source=y&id=3&e=#f"))) == "https://a.com/x?id=3"
    assert value(urls.provider(L("https://boards.greenhouse.io/acme/jobs/12"))).asDict() == {"provider": "greenhouse", "token": "acme"}
    assert value(urls.is_linkedin_job(L("https://www.linkedin.com/jobs/view/1"))) and not value(urls.is_linkedin_job(L("https://www.linkedin.com/company/x")))
    assert not value(urls.is_http(L("ftp://x.y/abcdef")))

"""Visibility, identity, search, filters and orders on small boards."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postlens.operators import dedup, search, visibility
from postlens.plans import jobs

NOW = datetime(2026, 10, 1, 12)
SCHEMA = """id long, company_id long, company string, title string, location string, country string,
 locations array<struct<location:string,country:string>>, description string, workplace_type string, role_type string, experience_level string,
 pay_ranges array<struct<currency:string,min_annual:double,max_annual:double,period:string>>, skills array<string>, source_name string, source_job_id string,
 source_url string, term_season string, term_year smallint, posted_at timestamp, created_at timestamp, last_seen_at timestamp, is_active boolean, is_eligible_role boolean"""


def posting(k, days=1.0, created=None, seen_hours=1, **more):
    row = {
        "id": k, "company_id": k, "company": f"Company {k}", "title": "Software Engineer", "location": "Toronto, ON", "country": "Canada", "locations": [], "description": "", "workplace_type": "onsite",
        "role_type": "full_time", "experience_level": "mid", "pay_ranges": [], "skills": [], "source_name": "lever", "source_job_id": f"j{k}", "source_url": f"https://x.example/{k}", "term_season": None, "term_year": None,
        "posted_at": None if days is None else NOW - timedelta(days=days), "created_at": NOW - timedelta(days=created if created is not None else (days or 0)), "last_seen_at": NOW - timedelta(hours=seen_hours), "is_active": True, "is_eligible_role": True,
    }
    return row | more


def board(spark, *rows):
    return spark.createDataFrame([tuple(r[c.name] for c in board.fields) for r in rows], SCHEMA)


@pytest.fixture(autouse=True)
def fields(spark):
    board.fields = spark.createDataFrame([], SCHEMA).schema.fields


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


def test_visibility_window(spark):
    rows = board(spark, posting(0, 0), posting(29, 29), posting(30, 30), posting(31, 31), posting(270, 270), posting(10, -10, created=0), posting(1, None, created=0, seen_hours=2), posting(2, None, created=0, seen_hours=240), posting(3, None, created=90, seen_hours=2))
    assert set(ids(rows.where(visibility.publicly_visible(NOW)))) == {0, 29, 30, 10, 1}
    assert ids(rows.where(visibility.posted_today(NOW))) == [0]
    assert ids(rows.where(visibility.posted_within(NOW, 7))) == [0]


def test_window_edge_is_inclusive(spark):
    exact = NOW - timedelta(days=30)
    rows = board(spark, posting(1, posted_at=exact), posting(2, posted_at=exact - timedelta(microseconds=1)), posting(3, posted_at=exact + timedelta(microseconds=1)))
    assert set(ids(rows.where(visibility.publicly_visible(NOW)))) == {1, 3}


def test_later_duplicate_suppresses_even_when_invisible(spark):
    rows = board(
        spark,
        posting(1, 2, source_job_id="a"),
        posting(5, 200, source_job_id="a"),
        posting(2, 2, source_url="https://u.example/p#x"),
        posting(3, 2, source_url="https://u.example/p#y"),
        posting(4, 2, source_job_id=None, source_url=None),
        posting(6, 2, source_job_id=None, source_url=None),
        posting(7, 2, source_job_id="z", source_name="greenhouse"),
        posting(8, 2, source_job_id="z", is_active=False),
    )
    assert set(ids(jobs.target_postings(rows, NOW))) == {3, 4, 6, 7}


def test_two_forms_of_keep_latest_agree(spark):
    rows = spark.createDataFrame([(k, k % 5 if k % 3 else None, k % 7) for k in range(60)], "id long, a int, b int")
    keys = [["a"], ["b"]]
    assert sorted(ids(dedup.keep_latest(rows, "id", keys))) == sorted(ids(dedup.keep_latest_by_window(rows, "id", keys)))


def test_recommended_order(spark):
    us = {"location": "Austin, TX", "country": "United States"}
    rows = board(spark, posting(1, 2, **us), posting(2, 20), posting(3, 200, created=200), posting(4, 300, role_type="co_op"))
    first = jobs.page(rows, jobs.JobQuery(), NOW)
    assert ids(first) == [2, 1]
    assert ids(jobs.page(rows, jobs.JobQuery(freshness="all"), NOW)) == [2, 3, 4, 1]
    assert ids(jobs.page(rows, jobs.JobQuery(sort="newest"), NOW)) == [1, 2]
    assert jobs.total(rows, jobs.JobQuery(), NOW).first()["total"] == 2


def test_country_shares_are_of_pairs(spark):
    both = [("Toronto, ON", "Canada"), ("Austin, TX", "United States")]
    rows = board(spark, posting(1, locations=both), posting(2), posting(3, location="Austin, TX", country="United States"))
    got = {r["country"]: (r["postings"], r["share_pct"]) for r in jobs.country_shares(jobs.target_postings(rows, NOW)).collect()}
    assert got == {"Canada": (2, 50.0), "United States": (2, 50.0)}


@pytest.mark.parametrize(
    "query,want",
    [
        ("developpeur", {1}),
        ("C++", {2}),
        ("c#", {3}),
        ("node.js", {4}),
        ("go", {5}),
        ("co-op", {6}),
        ('"machine learning"', {7}),
        ("machine learning", {7, 8}),
        ("intern", {9}),
        ("java", {10}),
        ("back-end", {11}),
        ("100%", set()),
    ],
)
def test_search(spark, query, want):
    titles = {1: "Développeur Logiciel", 2: "C++ Engineer", 3: "C# Developer", 4: "Node.js Developer", 5: "Engineer (Go)", 6: "Developer Co-op", 7: "Machine Learning Engineer", 8: "ML Engineer", 9: "Software Intern", 10: "Java Developer", 11: "Backend Developer", 12: "Government JavaScript Internal Go-to-market"}
    rows = board(spark, *[posting(k, title=t, company="Acme", role_type="internship" if k == 9 else "full_time") for k, t in titles.items()])
    assert set(ids(rows.where(search.matches(query)))) == want


def test_parse_keeps_phrases_and_trims_edges():
    assert search.parse('("Data  Science") python. .NET "open') == [search.Term("data science", True), search.Term("python"), search.Term(".net"), search.Term("open")]
    assert search.parse("   ") == []


def test_filters(spark):
    pay = [("CAD", 80000.0, 120000.0, "year")]
    rows = board(
        spark,
        posting(1, pay_ranges=pay, skills=["Python"], location="Markham, ON"),
        posting(2, workplace_type="remote", location="New York, NY", country="United States", description="We offer visa sponsorship."),
        posting(3, experience_level="senior", location="York, ON", description="We do not offer visa sponsorship."),
    )
    run = lambda **q: set(ids(jobs.matching(rows, jobs.JobQuery(**q), NOW)))
    assert run(min_pay=120000, countries=["canada"]) == {1}
    assert run(min_pay=120001, currency="cad") == set()
    assert run(skill="PYTHON") == {1}
    assert run(locations=["Toronto (GTA)"]) == {1, 3}
    assert run(locations=["new york"]) == {2}
    assert run(workplaces=["Remote"]) == {2}
    assert run(experience=["lead"]) == {3}
    assert run(sponsorship="available") == {2}
    assert run(sponsorship="not_required") == {3}
    for bad in ({"workplaces": ["moon"]}, {"min_pay": 5.0}, {"sponsorship": "maybe"}):
        with pytest.raises(ValueError):
            run(**bad)
    for bad in ({"freshness": "45d"}, {"limit": 101}, {"offset": -1}, {"search": "a\x00"}):
        with pytest.raises(ValueError):
            jobs.JobQuery(**bad)


def test_statistics_cover_the_same_rows(spark):
    rows = board(spark, posting(1, skills=["Python", "Go"]), posting(2, skills=["Python"]), posting(3, 90, created=90))
    total = jobs.overview(rows, NOW).first()
    assert (total["total_postings"], total["total_skills"]) == (2, 2)
    assert [(r["rank"], r["skill"], r["mentions"]) for r in jobs.skill_shares(jobs.target_postings(rows, NOW)).collect()] == [(1, "Python", 2), (2, "Go", 1)]
    assert [r["location"] for r in jobs.location_options(jobs.target_postings(rows, NOW)).collect()] == ["Toronto (GTA)"]


def test_urls_and_keys(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(dedup.canonical_url(F.lit(" HTTPS://Ex.COM/Jobs/1/?a=1#frag "))) == "https://ex.com/Jobs/1?a=1"
    assert value(dedup.canonical_url(F.lit(" "))) == ""
    assert value(dedup.company_key(F.lit("Acme, Inc."))) == "acme"
    assert value(dedup.title_key(F.lit("C++ – Engineer/II"))) == "c++ engineer ii"
    assert value(dedup.dates_close(F.lit(None).cast("timestamp"), F.current_timestamp()))


def test_similar_descriptions_by_text_code_and_tokens(spark):
    from postlens.operators.similarity import similar_pairs

    many = " ".join(f"word{k}" for k in range(40))
    rows = [(1, "<p>短い  文</p>"), (2, "短い 文"), (3, "Apply under P-160 here"), (4, "quite another text, p-160"), (5, many), (6, many + " word41"), (7, f"<b>{many}</b> " + "<i></i>" * 200), (8, None), (9, " "), (10, "P-161")]
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {(1, 2, "text"), (3, 4, "requisition"), (5, 6, "tokens"), (5, 7, "text")}

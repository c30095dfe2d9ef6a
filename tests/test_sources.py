"""Adapters over landed pages, the CSV source, bronze to silver."""

import json

import pytest

from postlens.plans.silver import silver
from postlens.sources import adapters, csv_postings


def pages(spark, *payloads):
    return spark.createDataFrame([(k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)], "page_no int, value string")


def read(spark, name, *payloads, company="Acme"):
    batch = adapters.read_batch(pages(spark, *payloads), adapters.ADAPTERS[name], company)
    return {r["source_job_id"]: r for r in batch.rows.collect()}, batch.metrics.first()


def test_greenhouse(spark):
    job = {
        "id": 7, "title": "Software Engineer", "location": {"name": "Toronto, ON"}, "absolute_url": "https://boards.greenhouse.io/acme/jobs/7", "content": "&lt;p&gt;Hi&lt;/p&gt;", "first_published": "2026-09-01T10:00:00-04:00",
        "metadata": [{"name": "Job Posting Location", "value": ["Ottawa"]}], "pay_input_ranges": [{"currency_type": "USD", "min_cents": 10000000, "max_cents": 12000000, "title": "Annual pay", "blurb": "plus bonus"}],
    }
    rows, metrics = read(spark, "greenhouse", {"jobs": [job, {"id": None, "title": "x"}, {"id": 1, "title": " "}, "odd", {"id": 8, "title": 5}]})
    assert set(rows) == {"7"} and metrics["total_raw_records"] == 5 and metrics["parse_error_count"] == 4 and metrics["fetch_complete"]
    r = rows["7"]
    assert r["raw_description"] == "<p>Hi</p>\n\nplus bonus" and r["raw_locations"] == ["Ottawa"]
    assert r["posted_at"].isoformat() == "2026-09-01T14:00:00"
    assert json.loads(r["compensation"])["max"] == 120000.0


def test_lever_over_pages(spark):
    job = {"id": "a", "text": "Engineer", "categories": {"location": "NYC", "allLocations": ["NYC", "SF"], "commitment": "Intern"}, "hostedUrl": "https://jobs.lever.co/x/a", "description": "<p>d</p>", "lists": [{"text": "Need", "content": "<li>x</li>"}], "createdAt": 1790000000000, "salaryRange": {"currency": "usd", "min": 1, "max": 2, "interval": "per-hour-wage"}}
    rows, metrics = read(spark, "lever", [job, {"id": "b", "text": None}], [job])
    assert set(rows) == {"a"} and metrics["repeats"] == 1 and metrics["parse_error_count"] == 1
    assert "<ul>\n<li>x</li>\n</ul>" in rows["a"]["raw_description"] and rows["a"]["raw_job_type"] == "Intern"
    assert json.loads(rows["a"]["compensation"])["interval"] == "hour"


def test_other_shapes(spark):
    rows, _ = read(spark, "ashby", {"jobs": [{"id": "x", "title": "T", "locationName": None, "isRemote": True, "publishedAt": "2026-01-02T03:04:05Z", "isListed": False, "secondaryLocations": [{"location": "B"}]}]})
    assert rows["x"]["raw_workplace_type"] == "Remote" and rows["x"]["is_listed"] is False and rows["x"]["raw_locations"] == ["B"]
    rows, m = read(spark, "amazon", {"hits": 3, "jobs": [{"id_icims": "1", "title": "SDE", "job_path": "/en/jobs/1", "locations": ['{"city": "Toronto", "region": "ON"}', "bad"], "posted_date": "September 5, 2026", "is_intern": True}]})
    assert rows["1"]["raw_locations"] == ["Toronto, ON"] and str(rows["1"]["posted_at"].date()) == "2026-09-05" and not m["fetch_complete"]
    rows, _ = read(spark, "jobicy", {"jobs": [{"id": 1, "jobTitle": "T", "companyName": "C", "jobType": ["Full-Time", "x"], "jobGeo": "", "pubDate": "bad"}, {"id": 2, "jobTitle": "T", "companyName": "C", "jobType": "Contract"}]})
    assert rows["1"]["raw_job_type"] == "Full-Time, x" and rows["1"]["raw_location"] == "Remote" and rows["1"]["posted_at"] is None and rows["2"]["raw_job_type"] == "Contract"
    rows, m = read(spark, "arbeitnow", {"data": [{"slug": "s", "title": "T", "company_name": "C", "remote": True, "created_at": 1790000000}]}, {"data": [{"slug": "s", "title": "T2", "company_name": "C"}]})
    assert rows["s"]["title"] == "T" and rows["s"]["raw_location"] == "Remote" and m["repeats"] == 1


def test_page_that_is_no_feed_is_incomplete(spark):
    rows, metrics = read(spark, "remotive", "{broken", {"jobs": []})
    assert not rows and not metrics["fetch_complete"]


def test_workday_needs_every_page_to_agree(spark):
    page = lambda total, *paths: {"total": total, "jobPostings": [{"title": "T", "externalPath": p, "locationsText": "X"} for p in paths]}
    details = spark.createDataFrame([("/job/a_1", json.dumps({"jobPostingInfo": {"jobDescription": "<p>d</p>", "startDate": "2026-05-01"}}))], "path string, value string")
    run = lambda *p: adapters.workday_batch(pages(spark, *p), details, "Acme")
    good = run(page(2, "/job/a_1"), page(2, "/job/b_2"))
    assert good.metrics.first()["fetch_complete"] and good.rows.count() == 2
    for bad in ([page(3, "/job/a_1"), page(3, "/job/b_2")], [page(2, "/job/a_1"), page(3, "/job/b_2")], [page(2, "/job/a_1", "/job/a_1")], [page(1, None)]):
        assert not run(*bad).metrics.first()["fetch_complete"]


def test_workday_slices_and_details(spark):
    page = lambda total, *paths, title="T": json.dumps({"total": total, "jobPostings": [{"title": title, "externalPath": p} for p in paths]})
    detail = json.dumps({"jobPostingInfo": {"jobDescription": "<p>d</p>"}})

    def run(rows, *known):
        lists = spark.createDataFrame(rows, "slice string, page_no int, value string")
        batch = adapters.workday_batch(lists, spark.createDataFrame([(k, v) for k, v in known], "path string, value string"), "Acme", ceiling=4)
        return tuple(batch.metrics.first()), {r["source_job_id"] for r in batch.rows.collect()}

    # A board at the ceiling is complete once its slices are.
    slices = [(None, 0, page(4)), ("a", 0, page(3, "/a1", "/a2")), ("a", 1, page(3, "/a3")), ("b", 0, page(2, "/b1", "/b2"))]
    assert run(slices) == ((5, 0, 0, True), {"a1", "a2", "a3", "b1", "b2"})
    assert run([(None, 0, page(4)), ("a", 0, page(3, "/a1", "/a2", "/a3"))])[0][3] is False
    assert run([(None, 0, page(3)), ("a", 0, page(2, "/a1", "/a2")), ("b", 0, page(2, "/b1", "/b2"))])[0][3] is False
    assert run([("a", 0, page(4, "/a1", "/a2", "/a3", "/a4"))])[0][3] is False
    assert run([("a", 0, page(1, "/a1", "/a1"))])[0][3] is False
    assert run([(None, 0, page(2))])[0][3] is False
    # A software role needs its detail; without one it is left out and counts as an error.
    role = [("a", 0, page(1, "/a1", title="Software Engineer")), ("b", 0, page(1, "/b1"))]
    assert run(role, ("/a1", detail)) == ((2, 0, 0, True), {"a1", "b1"})
    assert run(role) == ((2, 1, 0, False), {"b1"})
    assert run(role, ("/a1", "{")) == ((2, 1, 0, False), {"b1"})


def test_landed_files(spark, tmp_path):
    (tmp_path / "page-1.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "A"}]}))
    (tmp_path / "page-2.json").write_text(json.dumps({"jobs": [{"id": 2, "title": "B"}]}))
    batch = adapters.read_source(spark, "greenhouse", str(tmp_path), "Acme")
    assert sorted(r["source_job_id"] for r in batch.rows.collect()) == ["1", "2"]


def test_silver(spark):
    rows, _ = read(spark, "lever", [{"id": "a", "text": "Software Engineering Intern - Summer 2027", "categories": {"location": "Toronto, ON", "workplaceType": "hybrid"}, "hostedUrl": "https://jobs.lever.co/x/a", "description": "<p>We use Python and Go.</p><p>2 years of experience</p>"}])
    bronze = adapters.read_batch(pages(spark, [{"id": "a", "text": "Software Engineering Intern - Summer 2027", "categories": {"location": "Toronto, ON", "workplaceType": "hybrid"}, "hostedUrl": "https://jobs.lever.co/x/a", "description": "<p>We use Python and Go.</p>"}]), adapters.ADAPTERS["lever"], "Acme").rows
    r = silver(bronze).first()
    assert (r["job_id"], r["country"], r["workplace_type"], r["role_type"], r["experience_level"], r["term_season"], r["term_year"]) == ("lever:a", "Canada", "hybrid", "internship", "internship", "summer", 2027)
    assert r["is_eligible_role"] and "Python" in r["skills"]


def test_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('﻿Job_ID, company ,Title,location,country,SKILLS,extra\n1,A,"T, x",Toronto,canada,python; Python;go,e\n,,,,,,\n2,B,T,X,EMEA,,\n', encoding="utf-8")
    rows = {r["job_id"]: r for r in csv_postings.read_postings(spark, str(good)).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["country"] == "Canada" and rows["1"]["skill_names"] == ["Go", "Python"] and rows["2"]["country"] == "Unknown"
    for name, content in {"missing": "job_id,company\n1,A\n", "ragged": "job_id,company,title,location,country,skills\n1,A,T,X,C,s,too,many\n", "empty": "job_id,company,title,location,country,skills\n"}.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(content)
        with pytest.raises(ValueError):
            csv_postings.read_postings(spark, str(path))


def test_workday_labels_reach_silver_by_their_grammar(spark):
    page = {"total": 3, "jobPostings": [{"title": "Software Engineer", "externalPath": f"/job/{p}", "locationsText": "2 Locations"} for p in ("a_1", "b_2", "c_3")]}
    info = {
        "/job/a_1": {"location": "16 YORK ST:TORONTO", "additionalLocations": ["US, CA, Remote", "Building 4"], "country": {"descriptor": "Canada"}},
        "/job/b_2": {"location": "US, TX", "country": {"descriptor": "Canada"}},
        "/job/c_3": {"location": "US, CA, Santa Clara", "country": {"descriptor": "United States of America"}},
    }
    details = spark.createDataFrame([(k, json.dumps({"jobPostingInfo": {"jobDescription": "<p>d</p>"} | v})) for k, v in info.items()], "path string, value string")
    rows = silver(adapters.workday_batch(pages(spark, page), details, "Acme").rows)
    got = {r["source_job_id"]: [(x["location"], x["country"], x["raw_location"]) for x in r["locations"]] for r in rows.collect()}
    assert got["a_1"] == [
        ("Toronto, Ontario, Canada", "Canada", "16 YORK ST:TORONTO"),
        ("Remote - California, United States", "United States", "US, CA, Remote"),
        ("Building 4", "Unknown", None),
    ]
    assert got["b_2"] == [("US, TX", "Canada", None)]  # the label contradicts the vendor's country, so it stays as published
    assert got["c_3"] == [("Santa Clara, CA, United States", "United States", "US, CA, Santa Clara")]

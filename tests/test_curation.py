"""Upkeep of stored tables and the reports of a run."""

import json

import pytest
from pyspark.sql import functions as F

from postlens.operators import curation

AS_OF = "2001-08-02 00:00:00"


def tally(df):
    return {(r["kind"], r["value"]): r["n"] for r in df.collect()}


def test_dry_run(spark):
    schema = "role_type string, workplace_type string, country string, term_season string, term_year int, posted string, is_listed boolean, is_eligible_role boolean"
    rows = [("internship", "remote", "Canada", "summer", 2002, "2001-08-01", True, True), ("internship", None, "Canada", None, None, "2001-01-01", True, True), ("full_time", "remote", None, None, None, None, True, True), ("co_op", "remote", "Canada", None, None, "1999-01-01", False, True)]
    got = tally(curation.dry_run(spark.createDataFrame(rows, schema).withColumn("posted_at", F.to_timestamp("posted")), AS_OF))
    assert got == {("role_type", "internship"): 2, ("role_type", "full_time"): 1, ("workplace_type", "remote"): 2, ("country", "Canada"): 2, ("term", "summer 2002"): 1, ("dated", "yes"): 2, ("stale", "yes"): 1, ("oldest", "2001-01-01 00:00:00"): 1, ("newest", "2001-08-01 00:00:00"): 1}
    assert tally(curation.dry_run(spark.createDataFrame([], schema).withColumn("posted_at", F.to_timestamp("posted")), AS_OF)) == {}


def test_reports(spark):
    schema = "company_name string, provider string, token string, target string, status string, outcome string, reason string, role_type string, term_season string, term_year int, has_canada boolean"
    rows = [("A", "lever", "a", None, "discovered", "verified", None, "internship", "fall", 2001, True), ("A", "lever", "a", None, "discovered", "verified", None, "co_op", None, None, False), ("B", "ashby", "b", "B", "discovered", "known", None, "internship", None, None, None), ("C", "taleo", "c", None, "discovered", "verified", None, "internship", None, None, True), ("D", None, None, None, "invalid", "invalid", "hidden", "internship", None, None, True)]
    resolved = spark.createDataFrame(rows, schema)
    got = tally(curation.discovery_report(resolved))
    assert got[("in_scope", "yes")] == 4 and got[("canadian", "yes")] == 2 and got[("verified", "yes")] == 4 and got[("verified_canadian", "yes")] == 2
    assert got[("role_type", "internship")] == 3 and got[("term", "fall 2001")] == 1 and got[("reason", "hidden")] == 1 and got[("company_configured", "yes")] == 1
    assert [tuple(r) for r in curation.recommended_boards(resolved).collect()] == [("A", "lever", "a", 2, 1)]


def test_source_audit(spark):
    schema = "company_name string, source_name string, title string, raw_location string, raw_locations array<string>, posted string, compensation string, is_listed boolean"
    rows = [("A", "lever", "Software Engineer", "Toronto, ON, Canada", ["Vancouver, BC, Canada"], "2001-08-01", "{}", True), ("A", "lever", "Software Engineer", "Berlin, Germany", None, None, None, True), ("A", "lever", "Chef", "Toronto, ON, Canada", [], "2001-08-01", None, True), ("A", "lever", "Software Engineer", None, None, None, None, False)]
    row = curation.source_audit(spark.createDataFrame(rows, schema).withColumn("posted_at", F.to_timestamp("posted"))).first()
    assert row.asDict() == {"company_name": "A", "source_name": "lever", "records": 4, "software": 2, "eligible": 1, "dated": 1, "paid": 1, "multiple_locations": 1}


def test_configuration_and_export(spark, tmp_path):
    path = tmp_path / "targets.json"
    path.write_text(json.dumps([{"name": "Acme", "ats": " Lever ", "identifier": "ACME"}, {"company": "Beta", "provider": "ashby", "token": "beta", "enabled": False}, {"ats": "lever"}]))
    got = curation.read_targets(spark, str(path)).orderBy("name").collect()
    assert [(r["name"], r["ats"], r["identifier"], r["enabled"]) for r in got] == [("Acme", "lever", "acme", True), ("Beta", "ashby", "beta", False)]
    broken = tmp_path / "broken.json"
    broken.write_text('[{"name": ')
    with pytest.raises(Exception, match="no JSON array"):
        curation.read_targets(spark, str(broken)).collect()
    found = spark.createDataFrame([("Acme", "found", "lever", "acme"), ("Beta", "known", "ashby", "beta")], "company string, status string, provider string, token string")
    watch = spark.createDataFrame([("Acme", "https://acme.example/careers", ["Canada"])], "name string, careers_url string, priority_countries array<string>")
    assert [tuple(r) for r in curation.new_boards(found, watch).collect()] == [("Acme", "lever", "acme", "https://acme.example/careers", ["Canada"])]


def test_candidates_of_several_lists(spark):
    a = spark.createDataFrame([("x", 5)], "candidate_key string, ordinal long")
    b = spark.createDataFrame([("y", 0, 1)], "candidate_key string, ordinal long, extra int")
    got = curation.all_candidates([a, b]).orderBy("ordinal").collect()
    assert [(r["candidate_key"], r["extra"]) for r in got] == [("x", None), ("y", 1)]


def test_last_of_repeats_wins(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, None), ("k", 2, "b"), ("m", 1, "c")], "k string, ordinal long, v string")
    assert {r["k"]: r["v"] for r in curation.last_of(rows, ["k"]).collect()} == {"k": None, "m": "c"}


def test_repair_is_idempotent(spark):
    schema = "id long, title string, description string, location string, country string, locations array<struct<location:string,country:string,raw_location:string>>, skills array<string>"
    rows = [(1, "Python developer", "<p>We use Kubernetes</p>", "Toronto, ON, Canada", "Unknown", None, ["Python"]), (2, "Chef", None, "Berlin, Germany", "Germany", [("Berlin, Germany", "Germany", "Berlin, Germany")], []), (3, None, None, None, None, None, None)]
    once = curation.repaired(spark.createDataFrame(rows, schema))
    got = {r["id"]: r for r in once.collect()}
    assert got[1]["changed"] and got[1]["country"] == "Canada" and set(got[1]["skills"]) == {"Python", "Kubernetes"}
    assert not got[2]["changed"] and got[3]["country"] is None
    again = {r["id"]: r["changed"] for r in curation.repaired(once.drop("changed")).collect()}
    assert not any(again.values())

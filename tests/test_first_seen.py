"""First seen over several keys against the rule read from a list; long ids, titles and rows without an id."""

import random

from pyspark.sql import functions as F

from postlens.operators import dedup, discovery, state


def by_list(rows):
    seen, out = [{}, {}], {}
    for at, *keys in rows:
        prior = next((seen[n][k] for n, k in enumerate(keys) if k is not None and k in seen[n]), None)
        out[at] = prior
        if prior is None:
            for n, k in enumerate(keys):
                if k is not None:
                    seen[n][k] = at
    return out


def test_first_seen_agrees_with_the_list(spark):
    r = random.Random(3)
    rows = [(k, r.choice([None, f"u{k // 9}-{r.randint(1, 4)}"]), r.choice([None, f"i{k // 9}-{r.randint(1, 4)}"])) for k in range(900)] + [(k, "hot", f"own{k}") for k in range(900, 1200)] + [(k, f"a{k // 2}", f"b{(k + 1) // 2}") for k in range(1200, 1212)]
    got = {x["at"]: x["duplicate_of"] for x in dedup.first_seen(spark.createDataFrame(rows, "at long, u string, i string"), "at", ["u", "i"]).collect()}
    assert got == by_list(rows)
    assert dedup.first_seen(spark.createDataFrame([], "at long, u string"), "at", ["u"]).collect() == []


def test_candidates_name_their_earlier_twin(spark):
    url = "https://boards.greenhouse.io/acme/jobs/"
    rows = [("c1", url + "1234567", 1), ("c2", url + "1234567?gh_src=x", 2), ("c3", url + "7654321", 3), ("c4", None, 4)]
    found = spark.createDataFrame([(k, "repo", k, "Acme", "Engineer", u, o, "discovered" if u else "invalid") for k, u, o in rows], "candidate_key string, source_repo string, source_id string, company_name string, title string, discovered_url string, ordinal long, status string")
    found = found.withColumn("has_canada", F.lit(True))
    targets = spark.createDataFrame([("Acme", "greenhouse", "acme")], "name string, ats string, identifier string")
    boards = spark.createDataFrame([("greenhouse", "acme", "1234567", True)], "provider string, token string, job_id string, complete boolean")
    known = spark.createDataFrame([], "source_name string, source_job_id string")
    got = {r["candidate_key"]: (r["outcome"], r["duplicate_of"]) for r in discovery.resolve_candidates(found, targets, boards, known).collect()}
    assert got == {"c1": ("verified", None), "c2": ("duplicate", "c1"), "c3": ("closed", None), "c4": ("invalid", None)}


def test_ids_and_titles(spark):
    import hashlib

    df = spark.createDataFrame([("lever", "1"), ("a source with a long name", "x" * 95), ("lever", "y" * 150)], "s string, i string")
    got = [r[0] for r in df.select(state.job_id(F.col("s"), F.col("i"))).collect()]
    assert got == ["lever:1", "a source with a long:" + hashlib.sha256(b"x" * 95).hexdigest()[:60], "lever:" + hashlib.sha256(b"y" * 150).hexdigest()[:60]]
    texts = spark.createDataFrame([(None,), ("  a \x00b\n",), ("w" * 254 + " more",), ("z" * 256,)], "t string")
    assert [r[0] for r in texts.select(state.fit_text(F.col("t"))).collect()] == ["", "a b", "w" * 254 + "…", "z" * 254 + "…"]

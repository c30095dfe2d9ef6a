"""Greedy clusters against the rule read from a list, one posting at a time."""

import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import clusters

SCHEMA = "ordinal long, id string, job_id string, source_name string, source_job_id string, source_url string, posted_at timestamp"


def by_list(rows):
    """cluster and representative of each row: representatives in a list, each row against all of them in order."""
    key = lambda r: {("id", r[3], r[4] or r[2])} if r[3] and (r[4] or r[2]) else set()
    url = lambda r: {("url", r[5].split("#")[0].rstrip("/").lower())} if (r[5] or "").strip() else set()
    prefer = lambda r: (r[3] in ("greenhouse", "lever", "ashby"), r[6] is not None, r[6] or 0, str(r[1] or r[2] or ""))
    found, out = [], {}
    for r in rows:
        mine = key(r) | url(r)
        for c in found:
            if mine & c["keys"]:
                if prefer(r) > prefer(c["row"]):
                    c["row"], c["keys"] = r, mine
                break
        else:
            c = {"first": r[0], "row": r, "keys": mine}
            found.append(c)
        out[r[0]] = c
    return {o: (c["first"], c["row"][0] == o) for o, c in out.items()}


def lists(n, seed):
    """n lists of postings that meet no other list's: keys carry the list's number."""
    r, out = random.Random(seed), []
    for k in range(n):
        ids, urls = r.randint(1, 5), r.randint(1, 5)
        for _ in range(r.randint(1, 12)):
            stamp = r.choice([None, 86400 * r.randint(1, 4)])
            out.append((len(out), r.choice([None, str(r.randint(1, 9))]), f"j{len(out)}", r.choice(["lever", "remotive", "ashby", "", None]), r.choice([None, "", f"{k}-{r.randint(1, ids)}"]), r.choice([None, "", f"https://x.example/{k}/{r.randint(1, urls)}", f"https://X.example/{k}/{r.randint(1, urls)}/#a"]), stamp))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r[:6], None) for r in rows], SCHEMA).drop("posted_at").join(spark.createDataFrame([(r[0], r[6]) for r in rows], "ordinal long, s long").select("ordinal", F.timestamp_seconds("s").alias("posted_at")), "ordinal")


@pytest.mark.parametrize(("n", "seed", "block"), [(1000, 1, 10_000), (150, 2, 3)])
def test_clusters_of_random_lists(spark, n, seed, block):
    rows = lists(n, seed)
    got = {r["ordinal"]: (r["cluster"], r["is_representative"]) for r in clusters.greedy_clusters(frame(spark, rows), block_rows=block).collect()}
    assert got == by_list(rows)


def test_one_url_for_all_and_some_ids_for_several(spark):
    rows = [(k, str(k), f"j{k}", "lever" if k % 3 else "remotive", str(k // 40), "https://x.example/all" if k % 50 else f"https://x.example/{k}", 86400 * (k % 7 + 1)) for k in range(400)]
    got = {r["ordinal"]: (r["cluster"], r["is_representative"]) for r in clusters.greedy_clusters(frame(spark, rows), block_rows=64).collect()}
    assert got == by_list(rows)


def test_no_rows(spark):
    assert clusters.greedy_clusters(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pairs(spark):
    one = lambda s, i, u: F.struct(F.lit(s).cast("string").alias("source_name"), F.lit(i).cast("string").alias("source_job_id"), F.lit("j").alias("job_id"), F.lit(u).cast("string").alias("source_url"))
    cases = [(("lever", "1", None), ("lever", "1", "x"), True), (("lever", "1", None), ("ashby", "1", None), False), (("a", "1", "https://X.e/p/#k"), ("b", "2", "https://x.e/p"), True), (("a", "1", " "), ("b", "2", " "), False), ((None, "1", None), (None, "1", None), False), (("a", None, None), ("a", "", None), True)]
    got = spark.range(1).select(*[clusters.same_posting(one(*a), one(*b)).alias(f"c{k}") for k, (a, b, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, _, w in cases]

"""The audit over small postings: nulls, no rows, and lists of ids that stay short."""

from postlens.operators import audits

AS_OF = "2026-06-01 00:00:00"
SCHEMA = """id long, company string, title string, location string, country string, locations array<struct<location:string,country:string>>, role_type string, term_season string,
 posted_at timestamp, skills array<string>, compensation string, pay_ranges array<struct<period:string>>, description string, source_url string"""


def metrics(spark, rows):
    return {r["metric"]: (r["n"], r["ids"]) for r in audits.public_audit(spark.createDataFrame(rows, SCHEMA), AS_OF).collect()}


def test_empty_and_null_rows(spark):
    none = metrics(spark, [])
    assert len(none) == 19 and set(map(str, none.values())) == {"(0, [])"}
    got = metrics(spark, [(1, *[None] * 13), (2, *[None] * 13)])
    failed = {k for k, (n, _) in got.items() if n}
    assert failed == {"missing_posted_at", "missing_skills", "no_pay_shown", "duplicates_identical_listings"}
    assert got["missing_skills"] == (2, [1, 2])


def test_texts_and_ids(spark):
    row = lambda k, text, pay=None: (k, f"c{k}", "T", "Toronto", "Canada", None, None, None, None, ["x"], pay, None, text, "https://x.example/1" if k < 3 else None)
    texts = ["Salary: $80,000 to $90,000", "Salary, and a bonus of $80,000 to $90,000", "The bonus comes on top. Salary $80K – $90K", "Salary " + "x" * 200 + " $80,000 - $90,000"]
    got = metrics(spark, [row(k, t, "not json") for k, t in enumerate(texts)])
    assert got["pay_stated_in_text_not_shown"][0] == 2 and got["duplicate_source_urls"][0] == 3
    many = metrics(spark, [row(k, "t") for k in range(500)])
    assert many["missing_posted_at"][0] == 500 and len(many["missing_posted_at"][1]) <= audits.SAMPLE

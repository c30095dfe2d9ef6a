"""Rows of bronze that say the same are read once, and each keeps what is its own."""

from postlens.plans.silver import silver
from postlens.sources.adapters import BRONZE


def test_repeated_and_missing_words(spark):
    said = {"source_name": "lever", "title": "Data Engineer", "raw_location": "Toronto, ON", "raw_description": "<p>We use Python.</p>", "company_name": "A", "is_listed": True}
    given = [said | {"source_job_id": "1"}, said | {"source_job_id": "2", "company_name": "B", "is_listed": False}, said | {"source_job_id": "3", "raw_description": None}, {"source_name": "lever", "source_job_id": "4"}, said | {"source_job_id": "5", "raw_description": ""}]
    bronze = spark.createDataFrame([[*[g.get(c) for c in BRONZE], k] for k, g in enumerate(given)], ", ".join(f"{c} {t}" for c, t in BRONZE.items()) + ", ordinal long")
    rows = silver(bronze)
    assert "lambdafunction" not in rows._jdf.queryExecution().optimizedPlan().toString()  # those would run for every row
    got = {r["source_job_id"]: r for r in rows.collect()}
    assert [(got[k]["job_id"], got[k]["company"], got[k]["is_listed"], got[k]["ordinal"]) for k in "12"] == [("lever:1", "A", True, 0), ("lever:2", "B", False, 1)]
    assert got["1"]["skills"] == got["2"]["skills"] == ["Python"] and got["3"]["skills"] == got["5"]["skills"] == []
    assert [got[k]["title"] for k in "1345"] == ["Data Engineer", "Data Engineer", got["4"]["title"], "Data Engineer"] and len(got) == 5
    assert got["4"]["location"] == "Unknown" and got["1"]["location"] == got["5"]["location"] == "Toronto, Ontario, Canada"

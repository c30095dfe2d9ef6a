"""A page is parsed once, not once for each record it lists."""

import json

from postlens.sources import adapters


def _above_the_records(df):
    """The optimized plan over the generator, which runs for every record."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[0]


def test_records_of_a_page_do_not_parse_it_again(spark):
    pages = spark.createDataFrame([(0, json.dumps([{"id": "a", "text": "T"}, {"id": "b", "text": "T"}]))], "page_no int, value string")
    for adapter in adapters.ADAPTERS.values():
        rows = adapters.parsed(pages, adapter, "Acme").select("page_ok", "expected", "source_job_id", "valid")
        assert "parseJson" not in _above_the_records(rows), adapter.name
    assert adapters.read_batch(pages, adapters.ADAPTERS["lever"], "Acme").metrics.first()["total_raw_records"] == 2


def test_list_pages_likewise(spark):
    page = {"total": 1, "jobPostings": [{"title": "T", "externalPath": "/job/a_1", "locationsText": "X"}]}
    lists = spark.createDataFrame([(0, json.dumps(page))], "page_no int, value string")
    details = spark.createDataFrame([("/job/a_1", json.dumps({"jobPostingInfo": {"jobDescription": "d"}}))], "path string, value string")
    metrics = adapters.workday_batch(lists, details, "Acme").metrics
    assert "parseJson" not in _above_the_records(metrics)
    assert metrics.first()["total_raw_records"] == 1

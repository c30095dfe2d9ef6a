"""Reconciliation: upserts, tombstones, the guard before a large drop, the stream over batches."""

from datetime import datetime, timedelta

import pytest

from postlens.operators import discovery, reports, state
from postlens.streaming import snapshots

STATE = "id long, source_name string, source_job_id string, company_id long, title string, company_apply_url string, posted_at timestamp, is_active boolean, is_eligible_role boolean, last_seen_at timestamp, created_at timestamp, updated_at timestamp"
SNAPSHOT = "source_name string, source_job_id string, company_id long, title string, company_apply_url string, posted_at timestamp, is_listed boolean, is_eligible boolean, failed boolean, ordinal long"
RUNS = "id long, source_name string, company_id long, status string, jobs_fetched int, snapshot_trustworthy boolean, started_at timestamp, completed_at timestamp"
BATCH = "source_name string, company_id long, run_id long, fetch_complete boolean, parse_error_count long, total_raw_records long"
T0 = datetime(2026, 10, 1)


def job(k, title="Engineer", posted=None, **more):
    return ("lever", f"j{k}", 1, title, more.get("url"), posted, more.get("listed", True), more.get("eligible", True), more.get("failed", False), k)


def run(spark, now, rows, store=None, runs=None, complete=True, errors=0, total=None, run_id=1, tombstone=True):
    store = store if store is not None else spark.createDataFrame([], STATE)
    runs = runs if runs is not None else spark.createDataFrame([], RUNS)
    batch = spark.createDataFrame([("lever", 1, run_id, complete, errors, len(rows) if total is None else total)], BATCH)
    done = state.reconcile(store, spark.createDataFrame(rows, SNAPSHOT), batch, runs, now, tombstone)
    kept = spark.createDataFrame(done.state.collect(), STATE)
    after = runs.unionByName(done.runs.select(*runs.columns))
    return kept, spark.createDataFrame(after.collect(), RUNS), done.runs.first()


def active(df):
    return {r["source_job_id"] for r in df.where("is_active").collect()}


def test_guard_confirms_on_the_third_run(spark):
    s, r, last = run(spark, T0, [job(k) for k in range(12)])
    assert last["status"] == "success" and len(active(s)) == 12
    for k in (1, 2):
        s, r, last = run(spark, T0 + timedelta(hours=6 * k), [], s, r, run_id=k + 1)
        assert last["status"] == "partial_success" and last["jobs_deactivated"] == 0 and len(active(s)) == 12
    s, r, last = run(spark, T0 + timedelta(hours=18), [], s, r, run_id=4)
    assert last["jobs_deactivated"] == 12 and not active(s)


def test_small_drop_applies_and_large_one_waits(spark):
    s, r, _ = run(spark, T0, [job(k) for k in range(20)])
    s, r, last = run(spark, T0 + timedelta(hours=6), [job(k) for k in range(18)], s, r, run_id=2)
    assert last["jobs_deactivated"] == 2 and len(active(s)) == 18
    s, r, last = run(spark, T0 + timedelta(hours=12), [job(k) for k in range(5)], s, r, run_id=3)
    assert last["jobs_deactivated"] == 0 and len(active(s)) == 18


def test_small_company_is_not_blocked(spark):
    s, r, _ = run(spark, T0, [job(k) for k in range(3)])
    s, r, last = run(spark, T0 + timedelta(hours=1), [job(0)], s, r, run_id=2)
    assert last["jobs_deactivated"] == 2 and active(s) == {"j0"}


@pytest.mark.parametrize("how", [{"complete": False}, {"errors": 1}, {"total": 9}])
def test_untrusted_snapshot_closes_nothing(spark, how):
    s, r, _ = run(spark, T0, [job(k) for k in range(4)])
    s, r, last = run(spark, T0 + timedelta(hours=1), [job(0), job(1), job(2)], s, r, run_id=2, **how)
    assert last["status"] == "partial_success" and not last["snapshot_trustworthy"] and len(active(s)) == 4


def test_failures_that_are_systemic(spark):
    s, r, last = run(spark, T0, [job(k, failed=k < 4) for k in range(5)])
    assert last["status"] == "failed"
    s, r, last = run(spark, T0, [job(k, failed=k < 1) for k in range(5)])
    assert last["status"] == "partial_success" and len(active(s)) == 4


def test_aggregator_never_closes(spark):
    s, r, _ = run(spark, T0, [job(k) for k in range(4)], tombstone=False)
    s, r, last = run(spark, T0 + timedelta(hours=1), [job(0)], s, r, run_id=2, tombstone=False)
    assert last["status"] == "success" and len(active(s)) == 4
    _, _, last = run(spark, T0 + timedelta(hours=2), [job(0)], s, r, run_id=3, tombstone=False, complete=False)
    assert last["status"] == "failed"


def test_upsert_policy(spark):
    s, r, _ = run(spark, T0, [job(1, "Old", T0 - timedelta(days=3), url="u"), job(2, "Two", T0 + timedelta(days=40)), job(3, "Three")])
    later = T0 + timedelta(hours=1)
    s, r, _ = run(spark, later, [job(1, "New", T0 - timedelta(days=1)), job(2, "Two", T0 - timedelta(days=2)), job(3, "Three", T0)], s, r, run_id=2)
    got = {x["source_job_id"]: x for x in s.collect()}
    assert got["j1"]["title"] == "New" and got["j1"]["company_apply_url"] == "u" and got["j1"]["posted_at"] == T0 - timedelta(days=3)
    assert got["j2"]["posted_at"] == T0 - timedelta(days=2) and got["j3"]["posted_at"] == T0
    assert got["j1"]["created_at"] == T0 and got["j1"]["last_seen_at"] == later


def test_listed_role_that_is_not_eligible_stays_open(spark):
    s, r, _ = run(spark, T0, [job(k) for k in range(3)])
    s, r, _ = run(spark, T0 + timedelta(hours=1), [job(0), job(1), job(2, "Sales Lead", eligible=False)], s, r, run_id=2)
    row = s.where("source_job_id = 'j2'").first()
    assert row["is_active"] and not row["is_eligible_role"] and row["title"] == "Sales Lead"


def test_row_without_id_closes_only_with_an_empty_listing(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", None)], "id long, company string, source_job_id string")
    listed = spark.createDataFrame([("a", "y")], "company string, source_job_id string")
    assert {r["id"] for r in state.unlisted(rows, listed, ["company"]).collect()} == {1, 3}


def test_stream_equals_batches(spark, tmp_path):
    extra = "run_id long, fetch_complete boolean, parse_error_count long, total_raw_records long, observed_at timestamp"
    schema = f"{SNAPSHOT}, {extra}"
    landing = str(tmp_path / "landing")
    for n, keys in enumerate([range(6), range(5), range(5)]):
        rows = [(*job(k), n, True, 0, len(keys), T0 + timedelta(hours=n)) for k in keys]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    store = snapshots.VersionedState(spark, str(tmp_path / "state"), STATE, RUNS)
    snapshots.start(spark.readStream.schema(schema).parquet(landing), store, str(tmp_path / "ckpt")).awaitTermination()
    assert active(store.read("state")) == {f"j{k}" for k in range(5)}
    assert store.read("runs").count() == 3
    snapshots.reconcile_batch(store, spark.read.parquet(landing), store.last())  # again, as after a failure
    assert active(store.read("state")) == {f"j{k}" for k in range(5)} and store.read("runs").count() == 3


def test_dimension_and_reports(spark):
    dim = spark.createDataFrame([(3, "python")], "id long, name string")
    seen = spark.createDataFrame([("go",), ("python",), (None,), ("go",)], "name string")
    assert {(r["id"], r["name"]) for r in state.with_new_keys(dim, seen, "id", ["name"]).collect()} == {(3, "python"), (4, "go")}
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("a", "x", 2), ("b", "p", 5), ("b", "q", 4)], "g string, v string, at int")
    assert {(r["g"], r["v"]) for r in reports.most_frequent(rows, "g", "v", "at").collect()} == {("a", "x"), ("b", "q")}


def test_discovery(spark):
    pages = spark.createDataFrame([("Acme", '<a href="https://boards.greenhouse.io/acme">x</a> https://jobs.lever.co/other'), ("Beta", '<a href="https://jobs.lever.co/beta/1">'), ("Gone", "careers at icims.com"), ("None", "")], "company string, html string")
    targets = spark.createDataFrame([("Beta", "lever", "BETA")], "name string, ats string, identifier string")
    got = {r["company"]: (r["status"], r["token"]) for r in discovery.discovered_boards(pages, targets).collect()}
    assert got == {"Acme": ("found", "acme"), "Beta": ("known", "beta"), "Gone": ("unsupported", None), "None": ("not_found", None)}

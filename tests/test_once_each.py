"""Long expressions run once a different value; every row gets what its value gives."""

from pyspark.sql import functions as F

from postlens.operators.staging import once_each
from postlens.plans import catalog


def test_every_row_gets_what_its_values_give(spark):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, "a", ["x"]), (3, None, None), (4, None, None), (5, "", []), (6, "a", None), (7, "a", ["x"])], "id int, k string, l array<string>")
    given = []

    def made(values):
        given.append(values.count())
        return values.select("k", "l", F.concat_ws("-", F.coalesce("k", F.lit("none")), F.coalesce(F.size("l"), F.lit(-1)).cast("string")).alias("said"))

    got = {r["id"]: r["said"] for r in once_each(rows, ["k", "l"], made).collect()}
    assert got == {1: "a-1", 2: "a-1", 3: "none--1", 4: "none--1", 5: "-0", 6: "a--1", 7: "a-1"} and given == [4]
    assert once_each(rows, ["k", "l"], made).columns == ["id", "k", "l", "said"]
    assert once_each(rows.where("id > 9"), ["k", "l"], made).count() == 0


def test_pay_is_resolved_once_a_text(spark, tables):
    plan = catalog.QUERIES["pay_resolved"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan  # those would run for every order


def test_places_are_read_once_a_label(spark, tables):
    plan = catalog.QUERIES["posting_places"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan

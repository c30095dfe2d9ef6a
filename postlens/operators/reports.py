"""Reports over postings and runs: source health, snapshots compared, audits, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame, keys: tuple[str, ...] = ("source_name", "company_identifier"), n: int = 1) -> DataFrame:
    """The last n runs of each company's source, the newest first; of equal times the larger id."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("started_at"), F.desc("id")))
    return runs.withColumn("nth", nth).where(F.col("nth") <= n)


def source_status(runs: DataFrame, active: DataFrame) -> DataFrame:
    """Health of each source by its companies' latest finished runs; active: (source_name, active_jobs)."""
    latest = latest_runs(runs.where("status <> 'running'"))
    good = F.col("status") == "success"
    counted = latest.groupBy("source_name").agg(F.count(F.lit(1)).alias("companies_tracked"), F.count_if(good).alias("companies_ok"), F.count_if(~good).alias("companies_degraded"), F.max("started_at").alias("last_attempt_at"))
    last = runs.where(good).groupBy("source_name").agg(F.max("completed_at").alias("last_success_at"))
    out = counted.join(last, "source_name", "left").join(active, "source_name", "left")
    return out.select(
        "source_name",
        F.when(F.col("companies_degraded") > 0, "degraded").otherwise("healthy").alias("status"),
        "companies_tracked",
        "companies_ok",
        "companies_degraded",
        F.coalesce("active_jobs", F.lit(0)).cast("long").alias("active_jobs"),
        "last_success_at",
        "last_attempt_at",
    )


def compare_snapshots(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: rows on both sides, how many differ in each field (nulls equal nulls), rows gone."""
    total = old.agg(F.count(F.lit(1)).alias("_total"))
    both = old.select(key, *[F.col(f).alias(f"old_{f}") for f in fields]).join(new.select(key, *[F.col(f).alias(f"new_{f}") for f in fields]), key)
    changed = [F.count_if(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))).alias(f"{f}_changed") for f in fields]
    return both.agg(F.count(F.lit(1)).alias("both_sides"), *changed).join(F.broadcast(total)).select("both_sides", *[f"{f}_changed" for f in fields], (F.col("_total") - F.col("both_sides")).alias("gone"))


def audit(rows: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """metric, n, first_id of each check, in one pass over the rows."""
    every = [x for name, c in checks.items() for x in (F.count_if(c).alias(f"n_{name}"), F.min(F.when(c, F.col(id_col))).alias(f"first_{name}"))]
    found = rows.agg(*every)
    each = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"n_{name}").alias("n"), F.col(f"first_{name}").alias("first_id")) for name in checks])
    return found.select(F.inline(each))


def ranked_counts(rows: DataFrame, column: str) -> DataFrame:
    """Value, count, share of all rows and rank; ties by the folded value."""
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("postings")).join(F.broadcast(total))
    rank = F.row_number().over(Window.orderBy(F.desc("postings"), F.lower(column), column)).cast("long")
    return counted.select(rank.alias("rank"), column, "postings", F.round(F.try_divide(100.0 * F.col("postings"), F.col("_total")), 1).alias("share_pct"))


def most_frequent(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one seen first, then the smaller."""
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("at"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "at", value))
    return counted.withColumn("nth", nth).where("nth = 1").select(group, value, "n")


def text_table(rows: list, columns: list[str]) -> str:
    """A small collected result as aligned text."""
    cells = [columns, *[["" if r[c] is None else str(r[c]) for c in columns] for r in rows]]
    widths = [max(len(row[k]) for row in cells) for k in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() for row in cells)

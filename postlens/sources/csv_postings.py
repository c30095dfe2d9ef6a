"""CSV postings: headers in any case, required columns, ragged rows refused, blank rows skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, skills

REQUIRED = ["job_id", "company", "title", "location", "country", "skills"]


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings with a normalized country and an array of normalized skills; extra columns stay.

    The header is read with the data (one file or many with the same header). A row with more values than the header
    has names is an error, a blank one is skipped, and a file without rows is an error.
    """
    reader = spark.read.option("multiLine", True).option("encoding", "UTF-8").option("header", True)
    names = [h.lstrip("\ufeff").strip().lower() for h in reader.csv(path).columns]
    missing = sorted(set(REQUIRED) - set(names))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    places = [f"c{k}" for k in range(len(names))]
    rows = reader.option("enforceSchema", True).schema(", ".join(f"{c} string" for c in [*places, "beyond"])).csv(path).toDF(*names, "_beyond")
    if not rows.where(F.col("_beyond").isNotNull()).isEmpty():
        raise ValueError("a row has more values than the header")
    filled = rows.where(F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names]).isNotNull())
    if filled.isEmpty():
        raise ValueError("no postings")
    country = geo.normalized_country(F.col("country")).alias("country")
    return filled.select(*[country if n == "country" else F.col(n) for n in names], skills.in_field(F.col("skills")).alias("skill_names"))

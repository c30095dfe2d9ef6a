"""Bronze rows to board rows: every derived column of a posting, computed once when it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, geo, pay, pay_resolve, pay_text, places, segments, skills, urls
from ..functions.html import html_clean, html_text
from ..functions.text import settled
from ..operators.staging import once_each
from ..operators.state import fit_text, job_id, source_job_id


#: What decides the derived columns, besides the description: vendors show one posting on many days and in many cities.
SAID = ("source_name", "title", "raw_location", "raw_locations", "raw_country", "raw_job_type", "raw_workplace_type", "compensation")


def silver(bronze: DataFrame) -> DataFrame:
    """The columns of a posting from bronze rows. What the vendor says is read once, however many rows say the same."""
    links = urls.application_urls(F.col("source_url"), F.col("company_apply_url"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    sid = source_job_id(F.col("source_job_id"))
    rows = once_each(bronze.withColumn("_text", F.sha2("raw_description", 256)), ["_text", *SAID], _read, carried=("raw_description",))
    return rows.select(
        job_id(F.col("source_name"), sid).alias("job_id"),
        "source_name",
        sid.alias("source_job_id"),
        F.col("company_name").alias("company"),
        F.col("_title").alias("title"),
        "description",
        "location",
        "country",
        "locations",
        "workplace_type",
        "role_type",
        "experience_level",
        "term_season",
        "term_year",
        "skills",
        F.col("pay").alias("compensation"),
        "pay_ranges",
        links["company_apply_url"].alias("company_apply_url"),
        "source_url",
        "posted_at",
        "is_listed",
        "is_eligible_role",
        "ordinal",
    )


def _read(said: DataFrame) -> DataFrame:
    """What follows from a vendor's words. HTML is read by one Arrow-batched function, the rest are expressions."""
    plain = said.withColumn("plain", html_text("raw_description")).withColumn("description", html_clean("raw_description"))
    title, text = F.col("title"), F.col("plain")
    labels = F.array_distinct(F.array_compact(F.concat(F.array("raw_location"), F.coalesce("raw_locations", F.array().cast("array<string>")))))
    segmented = F.col("source_name") == "workday"
    # This vendor's country is that of the first label alone.
    stated = F.transform(labels, lambda x, i: F.struct(x.alias("label"), F.when(i == 0, F.col("raw_country")).alias("country"), *[F.lit(None).cast("string").alias(c) for c in ("locality", "region")]))
    stated = F.when(segmented & F.col("raw_country").isNotNull(), stated)
    at = places.job_places(F.array_join(labels, ";"), stated, lambda label: F.when(segmented, segments.segment_place(label)))
    rows = settled(plain.withColumn("_stated", pay_text.pay_in_html(F.col("raw_description"))), locations=at, stated=F.col("_stated"))
    rows = settled(rows, pay=pay_resolve.resolved_with(F.col("compensation"), F.col("stated"), F.col("locations")))
    primary = geo.primary_location(F.col("locations"))
    rows = rows.withColumn("location", F.coalesce(primary["location"], F.lit("Unknown"))).withColumn("country", F.coalesce(primary["country"], F.lit("Unknown")))
    rows = rows.withColumn("role_type", classify.role_type(title, text, F.col("raw_job_type")))
    term = classify.academic_term(title, F.lit(None).cast("array<string>"), text, F.col("role_type"))
    return rows.withColumn("term", term).select(
        "_text",
        *SAID,
        fit_text(title).alias("_title"),
        "description",
        "location",
        "country",
        "locations",
        classify.workplace(F.col("raw_location"), F.col("raw_workplace_type"), F.lit(None).cast("boolean"), title, text).alias("workplace_type"),
        "role_type",
        classify.experience_level(title, F.col("role_type"), F.col("raw_description")).alias("experience_level"),
        F.col("term.season").alias("term_season"),
        F.col("term.year").alias("term_year"),
        skills.in_text(F.concat_ws("\n", title, text)).alias("skills"),
        "pay",
        pay.usable_ranges(F.col("pay")).alias("pay_ranges"),
        classify.is_software_role(title, text).alias("is_eligible_role"),
    )

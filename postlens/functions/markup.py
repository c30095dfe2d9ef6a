"""What a posting shows to other machines: structured data, sitemap rows, and small clean-ups of shown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, places
from .pay import TIMES_A_YEAR
from .text import FOLD_FROM, FOLD_TO, has, lookup

# Employment types and units of structured data, and countries that an applicant rule may name.
EMPLOYMENT_TYPES = {"full_time": "FULL_TIME", "part_time": "PART_TIME", "contract": "CONTRACTOR", "contractor": "CONTRACTOR", "temporary": "TEMPORARY", "internship": "INTERN", "co_op": "INTERN"}
SALARY_UNITS = [("YEAR", r"yr|year|annual|p\.?a\.?"), ("MONTH", "mo"), ("WEEK", "wk|week"), ("DAY", "day|daily"), ("HOUR", "hr|hour")]
APPLICANT_COUNTRIES = "^(?:Canada|United States|United Kingdom)$"
# Length of a usable site description.
BACKGROUND_CHARS = (20, 1200)
# Symbols that carry meaning stay; the rest of the pictographs go, with joiners, selectors and skin tones.
_PICTOGRAPHS = r"[\x{1F000}-\x{1FAFF}\x{2300}-\x{23FF}\x{2600}-\x{2712}\x{2715}-\x{27BF}\x{2B00}-\x{2BFF}]"
_EMOJI = rf"(?:[0-9#*]\x{{FE0F}}?\x{{20E3}}|{_PICTOGRAPHS}[\x{{FE0F}}\x{{200D}}\x{{1F3FB}}-\x{{1F3FF}}]*)"


def employment_type(role_type: Column) -> Column:
    return lookup(F.lower(F.trim(role_type)), EMPLOYMENT_TYPES)


def salary_unit(interval: Column) -> Column:
    low, out = F.lower(F.trim(interval)), F.lit(None).cast("string")
    for unit, words in reversed(SALARY_UNITS):
        out = F.when(low.rlike(words), unit).otherwise(out)
    return out


def eligible_for_markup(job: dict[str, Column]) -> Column:
    """Title, company and date given, active, and a place: remote work needs a named applicant country, other work a location.

    job: title, company, posted_at, is_active, workplace_type, location, locations, applicant_countries.
    """
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    some = lambda items, test: F.coalesce(F.exists(items, test), F.lit(False))
    placed = some(job["locations"], lambda x: given(x["location"])) | given(job["location"])
    named = some(job["applicant_countries"], lambda c: has(F.trim(c), APPLICANT_COUNTRIES))
    remote = F.coalesce(F.lower(job["workplace_type"]) == "remote", F.lit(False))
    return given(job["title"]) & given(job["company"]) & job["posted_at"].isNotNull() & F.coalesce(job["is_active"], F.lit(True)) & F.when(remote, named).otherwise(placed)


def without_emoji(text: Column) -> Column:
    """Without decorative emoji: between words one space stays, before punctuation and at the ends none."""
    run = rf"(?:\s*{_EMOJI})+"
    ends = F.regexp_replace(text, rf"^(?:{_EMOJI}\s*)+|{run}\s*$|{run}\s*(?=[.,;:!?)\]}}])", "")
    spaced = F.regexp_replace(ends, rf"(?:\s+{_EMOJI}(?:\s*{_EMOJI})*\s*|(?<=\S){_EMOJI}(?:\s*{_EMOJI})*\s+)", " ")
    return F.regexp_replace(spaced, rf"{_EMOJI}|[\x{{FE0F}}\x{{200D}}\x{{20E3}}]", "")


def site_background(page: Column) -> Column:
    """The page's own description of the company from its meta elements, or null where it is missing, too short or too long."""
    tags = F.regexp_extract_all(page, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1))

    def attribute(tag: Column, name: str) -> Column:
        at = rf"(?i)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))"
        return F.coalesce(*[F.nullif(F.regexp_extract(tag, at, k), F.lit("")) for k in (1, 2, 3)])

    def of(label: str) -> Column:
        hit = F.filter(tags, lambda t: F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"))) == label)
        texts = F.filter(F.transform(hit, lambda t: attribute(t, "content")), lambda c: c.isNotNull())
        return F.element_at(F.when(F.size(texts) > 0, texts), -1)

    text = F.coalesce(*[of(label) for label in ("description", "og:description", "twitter:description")])
    for entity, char in (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\s+", " "))
    return F.when(F.length(clean).between(*BACKGROUND_CHARS), clean)


def structured_data(jobs: DataFrame, default_country: str = "country") -> DataFrame:
    """id, json: one JobPosting object a posting that may have markup; what a posting does not say is left out."""
    job = {c: F.col(c) for c in ("title", "company", "posted_at", "is_active", "workplace_type", "location", "locations", "applicant_countries")}
    at = places.postal_address(F.col("location"), F.col(default_country))
    address = F.struct(F.lit("PostalAddress").alias("@type"), at["street"].alias("streetAddress"), at["locality"].alias("addressLocality"), at["region"].alias("addressRegion"), at["country"].alias("addressCountry"))
    remote = F.coalesce(F.lower("workplace_type") == "remote", F.lit(False))
    countries = F.transform(F.filter("applicant_countries", lambda c: has(F.trim(c), APPLICANT_COUNTRIES)), lambda c: F.struct(F.lit("Country").alias("@type"), F.trim(c).alias("name")))
    pay = F.get(F.col("pay_ranges"), F.lit(0))
    value = F.struct(F.lit("QuantitativeValue").alias("@type"), pay["min_annual"].alias("minValue"), pay["max_annual"].alias("maxValue"), F.lit("YEAR").alias("unitText"))
    whole = F.struct(
        F.lit("https://schema.org/").alias("@context"),
        F.lit("JobPosting").alias("@type"),
        F.col("title"),
        F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")).alias("hiringOrganization"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("datePosted"),
        employment_type(F.col("role_type")).alias("employmentType"),
        F.when(~remote, F.struct(F.lit("Place").alias("@type"), address.alias("address"))).alias("jobLocation"),
        F.when(remote, "TELECOMMUTE").alias("jobLocationType"),
        F.when(remote, countries).alias("applicantLocationRequirements"),
        F.when(pay.isNotNull(), F.struct(F.lit("MonetaryAmount").alias("@type"), pay["currency"].alias("currency"), value.alias("value"))).alias("baseSalary"),
    )
    return jobs.where(eligible_for_markup(job)).select("id", F.to_json(whole).alias("json"))


def sitemap_entries(jobs: DataFrame, root: str) -> DataFrame:
    """id, entry: one <url> element a posting that may have markup."""
    job = {c: F.col(c) for c in ("title", "company", "posted_at", "is_active", "workplace_type", "location", "locations", "applicant_countries")}
    loc = F.concat(F.lit(root.rstrip("/") + "/jobs/"), F.col("id").cast("string"))
    escaped = F.replace(loc, F.lit("&"), F.lit("&amp;"))
    return jobs.where(eligible_for_markup(job)).select("id", F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><lastmod>"), F.date_format("posted_at", "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("entry"))


def resolved_skills(wanted: DataFrame, offered: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """skill (as asked for), status, resolved: supported, canonicalized (other case or a known alias) or unknown; everything is
    unchecked where nothing is offered. wanted: skill. offered: name, one spelling a name."""
    asked = wanted.select("skill", F.trim("skill").alias("_asked"), F.lower(F.trim("skill")).alias("_low"))
    asked = asked.withColumn("_alias", F.lower(lookup(F.col("_low"), {k: v for k, v in aliases.items()})))
    names = offered.select("name", F.lower("name").alias("_key"))
    direct, other = names.select(F.col("name").alias("_direct"), F.col("_key").alias("_k1")), names.select(F.col("name").alias("_other"), F.col("_key").alias("_k2"))
    some = offered.agg((F.count(F.lit(1)) > 0).alias("_some"))
    out = asked.join(direct, F.col("_low") == F.col("_k1"), "left").join(other, F.col("_alias") == F.col("_k2"), "left").join(F.broadcast(some))
    found = F.coalesce("_direct", "_other")
    status = F.when(~F.col("_some") | (F.col("_asked") == ""), "unchecked").when(found.isNull(), "unknown").when(F.col("_direct") == F.col("_asked"), "supported").otherwise("canonicalized")
    return out.select("skill", status.alias("status"), F.when(status.isin("supported", "canonicalized"), found).otherwise(F.col("_asked")).alias("resolved"))


def register_functions(spark: SparkSession, prefix: str = "post_") -> list[str]:
    """Functions for SQL text: the expressions as SQL functions, which the optimizer inlines, and the HTML readers. Returns their names."""
    times = " ".join(f"WHEN '{p}' THEN {float(n)}D" for p, n in TIMES_A_YEAR.items())
    bodies = {
        "fold(x STRING) RETURNS STRING": f"translate(lower(x), '{FOLD_FROM}', '{FOLD_TO}')",
        "strip_tags(x STRING) RETURNS STRING": "regexp_replace(coalesce(x, ''), '<[^>]*>', ' ')",
        "squeeze(x STRING) RETURNS STRING": r"trim(regexp_replace(x, r'\s+', ' '))",
        "annualize(amount DOUBLE, period STRING) RETURNS DOUBLE": f"amount * CASE period {times} END",
        "page_url(x STRING) RETURNS STRING": "regexp_replace(regexp_replace(trim(x), '#.*$', ''), '/+$', '')",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}")
    readers = {"html_text": html.html_text, "html_blocks": html.html_blocks, "html_clean": html.html_clean, "html_links": html.html_links}
    for name, f in readers.items():
        spark.udf.register(prefix + name, f)
    return sorted([prefix + h.split("(")[0] for h in bodies] + [prefix + n for n in readers])

"""Vendor feeds as landed files: every adapter is a table of expressions from a JSON record to the bronze row.

A file holds one page as the vendor sent it. Pages are parsed as VARIANT, so a record of another shape becomes a
counted parse error instead of a failed read; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import needs_description
from ..functions.pay import period_of

BRONZE = {
    "source_name": "string",
    "source_job_id": "string",
    "company_name": "string",
    "title": "string",
    "raw_location": "string",
    "source_url": "string",
    "posted_at": "timestamp",
    "raw_description": "string",
    "raw_workplace_type": "string",
    "raw_job_type": "string",
    "company_apply_url": "string",
    "raw_locations": "array<string>",
    "raw_country": "string",  # of the first location
    "compensation": "string",
    "is_listed": "boolean",
}


def get(record: Column, *paths: str, kind: str = "string") -> Column:
    """The first of the paths that has a value; blank text counts as none."""
    tries = [F.try_variant_get(record, f"$.{p}", kind) for p in paths]
    if kind == "string":
        tries = [F.nullif(F.trim(t), F.lit("")) for t in tries]
    return F.coalesce(*tries)


def _is_text(record: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(record, f"$.{path}", "variant")) == "STRING", F.lit(False))


def iso_time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def any_date(text: Column) -> Column:
    """Vendor dates in the forms that occur."""
    forms = ["MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "MM/dd/yyyy"]
    return F.coalesce(iso_time(text), *[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "\\s+", " "))


def unescaped(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def joined_or_text(record: Column, path: str) -> Column:
    """An array of texts joined by commas, or the text itself."""
    return F.coalesce(F.nullif(F.array_join(F.try_variant_get(record, f"$.{path}", "array<string>"), ", "), F.lit("")), get(record, path))


def strings(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "array<string>"), F.array().cast("array<string>"))


def variants(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


@dataclass(frozen=True)
class Adapter:
    name: str
    records: str
    row_id: str
    title: str
    fields: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    company: str | None = None
    valid: Callable[[Column], Column] | None = None
    #: Pages that repeat an id keep the first; where a repeat means that pages moved, the batch is incomplete.
    repeats_break: bool = False
    #: A record that cannot be read makes the batch incomplete.
    errors_break: bool = False
    #: A page with the ids of another, in the same order, makes the batch incomplete.
    same_page_breaks: bool = False
    expected: str | None = None


def _greenhouse_pay(r: Column) -> Column:
    """One currency and one period over all ranges, or nothing; cents become units."""
    ranges = variants(r, "pay_input_ranges")
    of = lambda path, kind: F.transform(ranges, lambda x: F.try_variant_get(x, f"$.{path}", kind))
    low, high = of("min_cents", "double"), of("max_cents", "double")
    currency = F.array_distinct(of("currency_type", "string"))
    period = F.array_distinct(F.transform(of("title", "string"), lambda t: F.coalesce(period_of(t), F.lit(""))))
    whole = F.to_json(F.struct(F.get(currency, F.lit(0)).alias("currency"), (F.array_min(low) / 100).alias("min"), (F.array_max(high) / 100).alias("max"), F.nullif(F.get(period, F.lit(0)), F.lit("")).alias("interval"), F.lit("greenhouse").alias("source")))
    return F.when((F.size(ranges) > 0) & (F.size(currency) == 1) & F.get(currency, F.lit(0)).isNotNull() & (F.size(period) == 1), whole)


def _greenhouse_text(r: Column) -> Column:
    body = F.coalesce(get(r, "content"), F.lit(""))
    body = F.when(F.contains(body, F.lit("&lt;")) & F.contains(body, F.lit("&gt;")), unescaped(body)).otherwise(body)
    notes = F.filter(F.transform(variants(r, "pay_input_ranges"), lambda x: F.try_variant_get(x, "$.blurb", "string")), lambda b: b.isNotNull() & (plain(b) != "") & ~F.contains(plain(unescaped(body)), plain(unescaped(b))))
    return F.trim(F.concat_ws("\n\n", F.nullif(body, F.lit("")), F.nullif(F.array_join(F.array_distinct(notes), "\n\n"), F.lit(""))))


def _greenhouse_places(r: Column) -> Column:
    wanted = F.filter(variants(r, "metadata"), lambda m: F.lower(F.try_variant_get(m, "$.name", "string")) == "job posting location")
    each = F.transform(wanted, lambda m: F.coalesce(F.try_variant_get(m, "$.value", "array<string>"), F.array(F.try_variant_get(m, "$.value", "string"))))
    return F.filter(F.flatten(each), lambda x: x.isNotNull() & (F.trim(x) != ""))


def _lever_text(r: Column) -> Column:
    def section(s: Column) -> Column:
        content = get(s, "content")
        wrapped = F.when(content.rlike("(?i)<li") & ~content.rlike("(?i)^\\s*<[uo]l\\b"), F.concat(F.lit("<ul>\n"), content, F.lit("\n</ul>"))).otherwise(content)
        return F.concat_ws("\n", F.concat(F.lit("<h3>"), get(s, "text"), F.lit("</h3>")), wrapped)

    main = get(r, "description", "descriptionPlain")
    parts = F.concat_ws("\n\n", get(r, "opening", "openingPlain"), get(r, "descriptionBody", "descriptionBodyPlain"))
    sections = F.filter(F.transform(variants(r, "lists"), section), lambda x: x != "")
    body = F.concat_ws("\n\n", F.coalesce(main, F.nullif(parts, F.lit(""))), F.nullif(F.array_join(sections, "\n\n"), F.lit("")), get(r, "additional", "additionalPlain"))
    note = get(r, "salaryDescription", "salaryDescriptionPlain")
    heading = F.when(body.rlike("(?i)<h\\d[^>]*>\\s*(?:compensation|salary|pay)\\b"), "").otherwise("<h3>Compensation</h3>\n")
    added = F.when(note.isNotNull() & ~F.contains(plain(unescaped(body)), plain(unescaped(note))), F.concat(heading, note))
    return F.trim(F.concat_ws("\n\n", F.nullif(body, F.lit("")), added))


def _lever_pay(r: Column) -> Column:
    low, high, currency = get(r, "salaryRange.min", kind="double"), get(r, "salaryRange.max", kind="double"), get(r, "salaryRange.currency")
    built = F.to_json(F.struct(F.upper(currency).alias("currency"), low.alias("min"), high.alias("max"), period_of(get(r, "salaryRange.interval")).alias("interval"), F.lit("lever").alias("source")))
    return F.when(currency.isNotNull() & (low.isNotNull() | high.isNotNull()), built)


def _amazon_places(r: Column) -> Column:
    """Locations come as JSON inside strings."""
    parsed = F.transform(strings(r, "locations"), lambda s: F.try_parse_json(s))
    label = lambda x: F.coalesce(F.nullif(F.concat_ws(", ", get(x, "normalizedCityName", "city"), get(x, "region")), F.lit("")), get(x, "location"))
    return F.array_distinct(F.array_compact(F.transform(parsed, label)))


def _amazon_text(r: Column) -> Column:
    part = lambda name, path: F.concat(F.lit(f"<h3>{name}</h3>"), get(r, path))
    return F.concat_ws("", get(r, "description"), part("Basic Qualifications", "basic_qualifications"), part("Preferred Qualifications", "preferred_qualifications"))


_REMOTE = lambda r: F.lit("remote")

ADAPTERS = {
    a.name: a
    for a in (
        Adapter(
            "greenhouse",
            "$.jobs",
            "id",
            "title",
            {
                "raw_location": lambda r: get(r, "location.name", "location"),
                "source_url": lambda r: get(r, "absolute_url"),
                "posted_at": lambda r: iso_time(get(r, "first_published")),
                "raw_description": _greenhouse_text,
                "raw_locations": _greenhouse_places,
                "compensation": _greenhouse_pay,
            },
        ),
        Adapter(
            "lever",
            "$",
            "id",
            "text",
            {
                "raw_location": lambda r: get(r, "categories.location", "country"),
                "source_url": lambda r: get(r, "hostedUrl", "applyUrl"),
                "posted_at": lambda r: F.when(get(r, "createdAt", kind="bigint") > 0, F.timestamp_millis(get(r, "createdAt", kind="bigint"))),
                "raw_description": _lever_text,
                "raw_workplace_type": lambda r: get(r, "categories.workplaceType", "workplaceType"),
                "raw_job_type": lambda r: get(r, "categories.commitment"),
                "company_apply_url": lambda r: get(r, "applyUrl"),
                "raw_locations": lambda r: strings(r, "categories.allLocations"),
                "compensation": _lever_pay,
            },
            same_page_breaks=True,
        ),
        Adapter(
            "ashby",
            "$.jobs",
            "id",
            "title",
            {
                "raw_location": lambda r: get(r, "locationName", "location.name", "location"),
                "source_url": lambda r: get(r, "jobUrl", "applyUrl"),
                "posted_at": lambda r: iso_time(get(r, "publishedAt")),
                "raw_description": lambda r: get(r, "descriptionHtml", "description", "descriptionPlain"),
                "raw_workplace_type": lambda r: F.coalesce(get(r, "workplaceType"), F.when(get(r, "isRemote", kind="boolean"), "Remote")),
                "raw_job_type": lambda r: get(r, "employmentType"),
                "company_apply_url": lambda r: get(r, "applyUrl"),
                "raw_locations": lambda r: F.array_compact(F.concat(F.array(get(r, "locationName", "location.name", "location")), F.transform(variants(r, "secondaryLocations"), lambda x: get(x, "location", "locationName")))),
                "compensation": lambda r: F.to_json(F.try_variant_get(r, "$.compensation", "variant")),
                "is_listed": lambda r: F.coalesce(get(r, "isListed", kind="boolean"), F.lit(True)),
            },
        ),
        Adapter(
            "amazon",
            "$.jobs",
            "id_icims",
            "title",
            {
                "raw_location": lambda r: get(r, "normalized_location", "location"),
                "source_url": lambda r: F.concat(F.lit("https://www.amazon.jobs"), get(r, "job_path")),
                "company_apply_url": lambda r: F.concat(F.lit("https://www.amazon.jobs"), get(r, "job_path")),
                "posted_at": lambda r: any_date(get(r, "posted_date")),
                "raw_description": _amazon_text,
                "raw_job_type": lambda r: F.when(get(r, "is_intern", kind="boolean"), "Intern").otherwise(get(r, "job_schedule_type")),
                "raw_locations": _amazon_places,
            },
            valid=lambda r: F.coalesce(get(r, "job_path").startswith("/"), F.lit(False)),
            repeats_break=True,
            expected="$.hits",
        ),
        Adapter(
            "arbeitnow",
            "$.data",
            "slug",
            "title",
            {
                "raw_location": lambda r: F.coalesce(get(r, "location"), F.when(get(r, "remote", kind="boolean"), "Remote").otherwise("Unknown")),
                "source_url": lambda r: get(r, "url"),
                "posted_at": lambda r: F.timestamp_seconds(get(r, "created_at", kind="double")),
                "raw_description": lambda r: get(r, "description"),
                "raw_workplace_type": lambda r: F.when(get(r, "remote", kind="boolean"), "remote"),
                "raw_job_type": lambda r: joined_or_text(r, "job_types"),
            },
            company="company_name",
        ),
        Adapter(
            "remotive",
            "$.jobs",
            "id",
            "title",
            {
                "raw_location": lambda r: F.coalesce(get(r, "candidate_required_location"), F.lit("Remote")),
                "source_url": lambda r: get(r, "url"),
                "posted_at": lambda r: iso_time(get(r, "publication_date")),
                "raw_description": lambda r: get(r, "description"),
                "raw_workplace_type": _REMOTE,
                "raw_job_type": lambda r: get(r, "job_type"),
            },
            company="company_name",
        ),
        Adapter(
            "jobicy",
            "$.jobs",
            "id",
            "jobTitle",
            {
                "raw_location": lambda r: F.coalesce(get(r, "jobGeo"), F.lit("Remote")),
                "source_url": lambda r: get(r, "url"),
                "posted_at": lambda r: iso_time(get(r, "pubDate")),
                "raw_description": lambda r: get(r, "jobDescription"),
                "raw_workplace_type": _REMOTE,
                "raw_job_type": lambda r: joined_or_text(r, "jobType"),
            },
            company="companyName",
        ),
    )
}


def register(adapter: Adapter) -> None:
    """Another vendor."""
    ADAPTERS[adapter.name] = adapter


def parsed(pages: DataFrame, adapter: Adapter, company: str | None = None) -> DataFrame:
    """Bronze rows with ordinal, valid and page_ok, from pages (page_no, value). Invalid records keep their nulls."""
    page = F.try_parse_json("value")
    records = F.try_variant_get(page, adapter.records, "array<variant>")
    expected = F.try_variant_get(page, adapter.expected, "bigint") if adapter.expected else F.lit(None).cast("bigint")
    # What a page says of itself is read below the generator: beside it, it would be read again for every record, from the whole page.
    read = pages.select("page_no", records.isNotNull().alias("page_ok"), expected.alias("expected"), records.alias("records"))
    rows = read.select("page_no", "page_ok", "expected", F.posexplode_outer("records").alias("pos", "r"))
    r = F.col("r")
    title = F.when(_is_text(r, adapter.title), get(r, adapter.title))
    row_id = get(r, adapter.row_id)
    who = get(r, adapter.company) if adapter.company else F.lit(company)
    valid = row_id.isNotNull() & title.isNotNull() & (who.isNotNull() if adapter.company else F.lit(True))
    if adapter.valid:
        valid = valid & adapter.valid(r)
    own = {"source_name": F.lit(adapter.name), "source_job_id": row_id, "company_name": who, "title": title, "is_listed": F.lit(True), "raw_locations": F.array().cast("array<string>")} | {k: f(r) for k, f in adapter.fields.items()}
    columns = [own.get(c, F.lit(None)).cast(t).alias(c) for c, t in BRONZE.items()]
    return rows.select("page_no", "pos", "page_ok", "expected", r.isNotNull().alias("has_record"), F.coalesce(valid, F.lit(False)).alias("valid"), *columns)


@dataclass(frozen=True)
class Batch:
    rows: DataFrame
    metrics: DataFrame


def read_batch(pages: DataFrame, adapter: Adapter, company: str | None = None) -> Batch:
    """Valid rows, the first of a repeated id, and one row of metrics: raw records, parse errors, completeness."""
    every = parsed(pages, adapter, company)
    nth = F.row_number().over(Window.partitionBy("source_job_id").orderBy("page_no", "pos"))
    rows = every.where("valid").withColumn("nth", nth)
    repeats = rows.agg(F.count_if(F.col("nth") > 1).alias("repeats"))
    kept = rows.where("nth = 1").select(*BRONZE, (F.col("page_no").cast("long") * 1_000_000 + F.col("pos")).alias("ordinal"))
    counted = every.agg(
        F.count_if(F.col("has_record")).alias("total_raw_records"),
        F.count_if(F.col("has_record") & ~F.col("valid")).alias("parse_error_count"),
        F.coalesce(F.bool_and("page_ok"), F.lit(False)).alias("_pages_ok"),
        F.max("expected").alias("_expected"),
        F.min("expected").alias("_least"),
    )
    # A total that changes between pages means that they are not of one snapshot.
    whole = F.col("_pages_ok") & F.coalesce((F.col("_expected") == F.col("total_raw_records")) & (F.col("_expected") == F.col("_least")), F.lit(True))
    if adapter.errors_break:
        whole = whole & (F.col("parse_error_count") == 0)
    if adapter.repeats_break:
        whole = whole & (F.col("repeats") == 0)
    if adapter.same_page_breaks:
        # A page is named by a hash of its ids in order; a page that comes again means that the paging went in circles.
        ids = every.where("has_record").groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("pos", "source_job_id"))).alias("ids"))
        pages_seen = ids.select(F.sha2(F.to_json("ids"), 256).alias("name")).agg((F.count(F.lit(1)) > F.countDistinct("name")).alias("again"))
        counted = counted.join(F.broadcast(pages_seen))
        whole = whole & ~F.col("again")
    metrics = counted.join(F.broadcast(repeats)).select("total_raw_records", "parse_error_count", "repeats", whole.alias("fetch_complete"))
    return Batch(kept, metrics)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a landing folder: one file a page, numbered by name."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    number = F.coalesce(F.nullif(F.regexp_extract("name", "([0-9]+)[^0-9]*$", 1), F.lit("")).cast("int"), F.lit(0))
    return files.select(number.alias("page_no"), "value")


def read_source(spark: SparkSession, name: str, path: str, company: str | None = None) -> Batch:
    return read_batch(landed(spark, path), ADAPTERS[name], company)


# Fixed value: what a list says instead of several places.
SEVERAL = r"(?i)^\d+\s+locations?$"


def needs_detail(title: Column) -> Column:
    """Whose detail page a batch cannot do without: software roles, and titles that only the description settles."""
    return needs_description(title)


def workday_batch(lists: DataFrame, details: DataFrame, company: str, ceiling: int = 2000) -> Batch:
    """List pages (page_no, value and, if the board was listed by facets, slice) joined with detail pages (path, value) on the
    posting's path.

    Complete if in every slice the pages agree on the total, hold that many different paths, each once, below the ceiling,
    and no row is a stub; if every software role, and every title that leaves it open, has its detail; and if the slices together hold what the pages without a slice
    count (at least that, where this count is cut at the ceiling). A software role without a readable detail is left out, so it does not
    overwrite what is stored, and counts as an error.
    """
    if "slice" not in lists.columns:
        lists = lists.withColumn("slice", F.lit("all"))
    page = F.try_parse_json("value")
    read = lists.select("slice", "page_no", F.try_variant_get(page, "$.total", "bigint").alias("total"), F.try_variant_get(page, "$.jobPostings", "array<variant>").alias("records"))
    rows = read.select("slice", "page_no", "total", F.posexplode_outer("records").alias("pos", "r"))
    r = F.col("r")
    listed = rows.select("slice", "page_no", "pos", "total", get(r, "externalPath").alias("path"), get(r, "title").alias("title"), get(r, "locationsText").alias("raw_location"), r.isNotNull().alias("has_record"))
    info = F.try_variant_get(F.try_parse_json("value"), "$.jobPostingInfo", "variant")
    detail = details.select("path", get(info, "jobDescription").alias("raw_description"), any_date(get(info, "startDate")).alias("posted_at"), get(info, "timeType").alias("raw_job_type"), get(info, "externalUrl").alias("source_url"), get(info, "location").alias("place"), get(info, "country.descriptor").alias("raw_country"), strings(info, "additionalLocations").alias("more")).dropDuplicates(["path"])
    good = F.col("path").isNotNull() & F.col("title").isNotNull()
    sliced = listed.where("slice IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("slice", "page_no", "pos"))
    first = sliced.where(good).withColumn("nth", nth).where("nth = 1").join(detail, "path", "left")
    lost = needs_detail(F.col("title")) & F.col("raw_description").isNull()
    own = {"source_name": F.lit("workday"), "source_job_id": F.element_at(F.split("path", "/"), -1), "company_name": F.lit(company), "raw_location": F.coalesce("place", F.when(~F.col("raw_location").rlike(SEVERAL), F.col("raw_location"))), "is_listed": F.lit(True), "raw_locations": F.array_compact(F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<string>"))))}
    have = {"title", "raw_description", "posted_at", "raw_job_type", "source_url", "raw_country"}
    columns = [own.get(c, F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in BRONZE.items()]
    m = sliced.groupBy("slice").agg(F.count_if(F.col("has_record")).alias("n"), F.countDistinct("path").alias("paths"), F.count_if(F.col("has_record") & ~good).alias("bad"), F.min("total").alias("least"), F.max("total").alias("most"))
    whole = (F.col("least") == F.col("most")) & (F.col("paths") == F.col("most")) & (F.col("n") == F.col("paths")) & (F.col("bad") == 0) & (F.col("most") < ceiling)
    slices = m.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.bool_and(F.coalesce(whole, F.lit(False))), F.lit(False)).alias("whole"))
    found = first.agg(F.count(F.lit(1)).alias("postings"), F.count_if(lost).alias("lost"))
    board = listed.where("slice IS NULL").agg(F.max("total").alias("board"))
    all_there = F.col("board").isNull() | F.when(F.col("board") < ceiling, F.col("postings") == F.col("board")).otherwise(F.col("postings") >= F.col("board"))
    facts = slices.join(F.broadcast(found)).join(F.broadcast(board))  # one row each
    metrics = facts.select(F.col("n").alias("total_raw_records"), (F.col("bad") + F.col("lost")).alias("parse_error_count"), (F.col("n") - F.col("bad") - F.col("postings")).alias("repeats"), (F.col("whole") & (F.col("lost") == 0) & all_there).alias("fetch_complete"))
    return Batch(first.where(~lost).select(*columns, (F.col("page_no").cast("long") * 1_000_000 + F.col("pos")).alias("ordinal")), metrics)

"""Vendors without an API: saved pages of their career sites become the JSON pages that an adapter reads.

Search pages have a regular structure, so they are read by expressions. Only two things need Python, one Arrow batch at a
time: the inner HTML of an element (elements nest), and the reference table of one vendor's embedded data.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import VOID
from ..functions.text import squeeze, strip_tags
from .adapters import ADAPTERS, Adapter, Batch, any_date, get, iso_time, read_batch, register, strings, unescaped

# The sites that are read, and what marks their fields.
GOOGLE = "https://www.google.com/about/careers/applications/"
PHENOM = "https://jobs.bell.ca/ca/en/"
SHOPIFY = "https://www.shopify.com/careers"
SITES = {"rogers": "https://jobs.rogers.com", "scotiabank": "https://jobs.scotiabank.com", "telus": "https://careers.telus.com"}
UUID = "^[a-f0-9]{8}(?:-[a-f0-9]{4}){3}-[a-f0-9]{12}$"
MISSING = (-1, -5, -7)
WANTED = ("jobPostingsWithJobs", "atsLocations", "jobPosting")


def source_date(text: Column) -> Column:
    return F.coalesce(iso_time(text), any_date(text), F.try_to_timestamp(F.regexp_replace(text, r"^\w{3} (\w{3} \d{2} [\d:]{8}) UTC (\d{4})$", "$1 $2"), F.lit("MMM dd HH:mm:ss yyyy")))


def plain_text(fragment: Column) -> Column:
    return squeeze(unescaped(strip_tags(fragment)))


def attribute(tag: Column, name: str) -> Column:
    return F.nullif(unescaped(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))


def element(fragment: Column, tag: str, mark: str) -> Column:
    """The first <tag> with the mark in an attribute, up to its end tag (for elements that hold none of their kind)."""
    return F.regexp_extract(fragment, rf"(?is)(<{tag}\b[^>]*{mark}[^>]*>.*?</{tag}>)", 1)


def elements(fragment: Column, tag: str, mark: str = "") -> Column:
    return F.regexp_extract_all(fragment, F.lit(rf"(?is)(<{tag}\b[^>]*{mark}[^>]*>.*?</{tag}>)"), F.lit(1))


def _number(text: Column, pattern: str) -> Column:
    return F.replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("bigint")


def _page(total: Column, jobs: Column) -> Column:
    """One page as JSON; without a total the page cannot be judged and is null, which makes the batch incomplete."""
    return F.when(total.isNotNull(), F.to_json(F.struct(total.alias("total"), jobs.alias("jobs"))))


def successfactors_pages(pages: DataFrame, tenant: str) -> DataFrame:
    """Search pages (page_no, value) as JSON pages. Ids are scoped by tenant; rows without a job link keep a null id."""
    root = SITES[tenant]

    def row(r: Column) -> Column:
        link = element(r, "a", "jobTitle-link")
        href = attribute(F.regexp_extract(link, "^(<[^>]*>)", 1), "href")
        url = F.when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit(root), href))
        number = F.nullif(F.regexp_extract(url, rf"^{re.escape(root)}/job/.+/(\d+)/?(?:[?#]|$)", 1), F.lit(""))
        part = lambda name: F.nullif(plain_text(F.coalesce(F.nullif(element(r, "span", name), F.lit("")), element(r, "td", name))), F.lit(""))
        return F.struct(F.concat(F.lit(f"{tenant}:"), number).alias("id"), F.nullif(plain_text(link), F.lit("")).alias("title"), part("jobLocation").alias("location"), part("jobDate").alias("date"), url.alias("url"))

    total = _number(plain_text(F.col("value")), r"Results\s+\d+\s*[–-]\s*\d+\s+of\s+([\d,]+)")
    return pages.select("page_no", _page(total, F.transform(elements(F.col("value"), "tr", "data-row"), row)).alias("value"))


def google_pages(pages: DataFrame) -> DataFrame:
    """Search result pages as JSON pages; every place label of a result is kept, "+2 more" is none."""

    def row(r: Column) -> Column:
        href = attribute(F.regexp_extract(r, r"(?is)(<a\b[^>]*jobs/results/[^>]*>)", 1), "href")
        url = F.when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit(GOOGLE), F.regexp_replace(href, r"^\./", "")))
        number = F.nullif(F.regexp_extract(url, r"^https://www\.google\.com/.*/results/(\d+)-", 1), F.lit(""))
        labels = F.transform(elements(r, "span", "r0wTof"), lambda x: F.regexp_replace(plain_text(x), r"^[ ;]+|[ ;]+$", ""))
        places = F.array_distinct(F.filter(labels, lambda x: x.rlike(r"\p{L}") & ~x.rlike(r"(?i)^\+?\d+\s+more$")))
        remote = F.when(F.contains(plain_text(r), F.lit("Remote eligible")), "remote")
        return F.struct(number.alias("id"), F.nullif(plain_text(element(r, "h3", "")), F.lit("")).alias("title"), places.alias("places"), remote.alias("workplace"), url.alias("url"))

    listed = F.filter(elements(F.col("value"), "li"), lambda x: F.contains(x, F.lit("jobs/results/")))
    total = _number(plain_text(F.col("value")), r"([\d,]+)\s+jobs matched")
    return pages.select("page_no", _page(total, F.transform(listed, row)).alias("value"))


def phenom_pages(pages: DataFrame) -> DataFrame:
    """The search result embedded in a page's script. The JSON reader stops at the end of the object, whatever follows it."""
    data = F.regexp_extract("value", r"(?s)phApp\.ddo\s*=\s*(\{.*)", 1)
    result = F.get_json_object(data, "$.eagerLoadRefineSearch")
    return pages.select("page_no", F.when(F.get_json_object(result, "$.status") == "200", result).alias("value"))


def _member(cells: list, at: int, name: str) -> int:
    """Where the value of a named member of the object in a cell stands; the object's keys are places of their names."""
    return next(where for key, where in cells[at].items() if cells[int(key.removeprefix("_"))] == name)


def _plain(cells: list, at: int) -> object:
    """The value in a cell with all that it refers to, innermost first; a cell that leads back to itself raises."""
    if at in MISSING:
        return None
    if at < 0:
        raise ValueError("no table of values")
    ready, open_, todo = {}, set(), [at]
    while todo:
        here = todo[-1]
        cell = cells[here]
        if isinstance(cell, dict):
            names, parts = [int(key.removeprefix("_")) for key in cell], list(cell.values())
        else:
            names, parts = [], [x for x in cell if isinstance(x, int)] if isinstance(cell, list) else []
        waiting = [x for x in names + parts if x not in ready and x not in MISSING]
        if waiting and (here in open_ or min(waiting) < 0):
            raise ValueError("no table of values")
        if waiting:
            open_.add(here)
            todo += waiting
            continue
        value = lambda x: None if x in MISSING else ready[x]
        if isinstance(cell, dict):
            ready[here] = {str(ready[n]): value(x) for n, x in zip(names, parts, strict=True)}
        else:
            ready[here] = [value(x) if isinstance(x, int) else x for x in cell] if isinstance(cell, list) else cell
        todo.pop()
    return ready[at]


def _loader(source: str, route: str) -> str | None:
    """The postings of a route out of the page's table of values that refer to one another by place; null if it reads otherwise."""
    for text in (source or "").split("streamController.enqueue(")[1:]:
        try:
            cells = json.loads(json.JSONDecoder().raw_decode(text)[0])
            at = _member(cells, _member(cells, 0, "loaderData"), route)
            named = {cells[int(key.removeprefix("_"))]: where for key, where in cells[at].items()}
            return json.dumps({name: _plain(cells, named[name]) for name in WANTED if name in named})
        except (ValueError, TypeError, LookupError, AttributeError, StopIteration):
            continue  # another script's data
    return None


@F.pandas_udf(T.StringType())
def embedded_loader(pages: pd.Series, routes: pd.Series) -> pd.Series:
    return pd.Series([_loader(p, r) for p, r in zip(pages, routes, strict=True)], dtype=object)


def shopify_pages(pages: DataFrame) -> DataFrame:
    """The careers page's posting list, with the names of its places; unlisted postings are marked, not dropped."""
    v = F.try_parse_json("data")
    data = pages.select("page_no", embedded_loader("value", F.lit("($locale)/careers")).alias("data"))
    entries = F.try_variant_get(v, "$.jobPostingsWithJobs", "array<variant>")
    places = F.try_variant_get(v, "$.atsLocations", "array<variant>")
    names = F.map_from_entries(F.filter(F.transform(places, lambda p: F.struct(get(p, "id").alias("k"), get(p, "externalName", "name").alias("v"))), lambda e: e["k"].isNotNull()))

    def row(e: Column) -> Column:
        r = F.try_variant_get(e, "$.jobPosting", "variant")
        ids = F.concat(F.array(get(r, "locationIds.primaryLocationId")), strings(r, "locationIds.secondaryLocationIds"))
        labels = F.array_compact(F.transform(F.array_compact(ids), lambda i: F.try_element_at(names, i)))
        ours = F.when(get(r, "title").rlike(r"^US .+ Internships\b"), F.array(F.lit("United States"))).otherwise(F.array().cast("array<string>"))
        good = F.when(get(r, "id").rlike(UUID), get(r, "id"))
        listed = F.coalesce((get(r, "status") == "Published") & get(r, "isListed", kind="boolean"), F.lit(False))
        fields = {c: get(r, c) for c in ("title", "publishedDate", "workplaceType", "employmentType", "compensationTierSummary", "applicationDeadline")}
        return F.struct(good.alias("id"), listed.alias("listed"), F.concat(ours, labels).alias("places"), get(r, "locationExternalName", "locationName").alias("location"), F.coalesce(get(r, "shouldDisplayCompensationOnJobBoard", kind="boolean"), F.lit(False)).alias("showsPay"), *[x.alias(c) for c, x in fields.items()])

    return data.select("page_no", F.when(entries.isNotNull() & places.isNotNull(), F.to_json(F.struct(F.transform(entries, row).alias("jobs")))).alias("value"))


def _inner(source: str | None, mark: str) -> str | None:
    """What stands inside the first element whose tag has the mark."""
    opening = re.search(rf"(?is)<([a-z][a-z0-9]*)\b[^>]*{mark}[^>]*>", source or "")
    if not opening or opening[1].lower() in VOID:
        return None
    depth, start = 1, opening.end()
    for tag in re.finditer(rf"(?is)<(/?){opening[1]}\b[^>]*>", source[start:]):
        depth += -1 if tag[1] else 1
        if depth == 0:
            return source[start : start + tag.start()]
    return source[start:]


@F.pandas_udf(T.StringType())
def inner_html(pages: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([_inner(p, m) for p, m in zip(pages, marks, strict=True)], dtype=object)


def successfactors_details(details: DataFrame) -> DataFrame:
    """url, raw_description, detail_places of saved posting pages (url, value), from their microdata."""
    addresses = F.regexp_extract_all("value", F.lit(r"(?is)(itemprop=[\"']address[\"'].*?)(?=itemprop=[\"']address[\"']|itemprop=[\"']description[\"']|$)"), F.lit(1))

    def label(a: Column) -> Column:
        def part(name: str) -> Column:
            given = F.regexp_extract(a, rf"(?is)(<[^>]*itemprop=[\"']{name}[\"'][^>]*>)", 1)
            return F.coalesce(attribute(given, "content"), F.nullif(squeeze(F.regexp_extract(a, rf"(?is)itemprop=[\"']{name}[\"'][^>]*>([^<]*)<", 1)), F.lit("")))

        return F.concat_ws(", ", part("addressLocality"), part("addressRegion"), part("addressCountry"))

    body = F.nullif(F.trim(inner_html("value", F.lit("itemprop=[\"']description[\"']"))), F.lit(""))
    return details.select("url", F.when(plain_text(body) != "", body).alias("raw_description"), F.filter(F.transform(addresses, label), lambda x: x != "").alias("detail_places"))


def google_details(details: DataFrame) -> DataFrame:
    """url, raw_description: the posting's sections in the order of the page, with absolute links."""
    marked = [F.coalesce(inner_html("value", F.lit(rf"class=[\"'][^\"']*\b{c}\b")), F.lit("")) for c in ("KwJkGe", "aG5W3", "BDNOWe", "bE3reb")]
    text = F.regexp_replace(F.concat(*marked), r"(?i)(<a\b[^>]*\bhref=[\"'])(?![a-z][a-z0-9+.-]*:|#)(?:\./)?", f"$1{GOOGLE}")
    good = F.contains(F.col("value"), F.lit("About the job")) & F.contains(text, F.lit("Responsibilities"))
    return details.select("url", F.when(good, text).alias("raw_description"), F.array().cast("array<string>").alias("detail_places"))


def with_details(batch: Batch, details: DataFrame, needed: Column) -> Batch:
    """Rows with description and places of their detail page (url, raw_description, detail_places). A row that needs a detail
    and has none is left out, counted as an error, and makes the batch incomplete: it must not overwrite what is stored."""
    own = details.select(F.col("url").alias("_url"), F.col("raw_description").alias("_text"), F.col("detail_places").alias("_places")).dropDuplicates(["_url"])
    both = batch.rows.join(own, F.col("source_url") == F.col("_url"), "left").withColumn("_lost", F.coalesce(needed, F.lit(False)) & F.col("_text").isNull())
    some = F.size(F.coalesce("_places", F.array().cast("array<string>"))) > 0
    changed = {"raw_description": F.coalesce("_text", "raw_description"), "raw_locations": F.when(some, F.col("_places")).otherwise(F.col("raw_locations")), "raw_location": F.when(some, F.get("_places", F.lit(0))).otherwise(F.col("raw_location"))}
    rows = both.where(~F.col("_lost")).select(*[changed.get(c, F.col(c)).alias(c) for c in batch.rows.columns])
    lost = both.agg(F.count_if(F.col("_lost")).alias("_n"))
    m = batch.metrics.join(F.broadcast(lost))
    return Batch(rows, m.select("total_raw_records", (F.col("parse_error_count") + F.col("_n")).alias("parse_error_count"), "repeats", (F.col("fetch_complete") & (F.col("_n") == 0)).alias("fetch_complete")))


for adapter in (
    Adapter(
        "successfactors",
        "$.jobs",
        "id",
        "title",
        {"raw_location": lambda r: get(r, "location"), "source_url": lambda r: get(r, "url"), "company_apply_url": lambda r: get(r, "url"), "posted_at": lambda r: source_date(get(r, "date"))},
        repeats_break=True,
        errors_break=True,
        expected="$.total",
    ),
    Adapter(
        "google",
        "$.jobs",
        "id",
        "title",
        {"raw_location": lambda r: get(r, "places[0]"), "raw_locations": lambda r: strings(r, "places"), "source_url": lambda r: get(r, "url"), "company_apply_url": lambda r: get(r, "url"), "raw_workplace_type": lambda r: get(r, "workplace")},
        repeats_break=True,
        errors_break=True,
        expected="$.total",
    ),
    Adapter(
        "phenom",
        "$.data.jobs",
        "jobId",
        "title",
        {
            "source_job_id": lambda r: F.concat(F.lit("bell:"), get(r, "jobId")),
            "raw_location": lambda r: get(r, "location"),
            "source_url": lambda r: F.concat(F.lit(PHENOM + "job/"), get(r, "jobSeqNo")),
            "company_apply_url": lambda r: F.concat(F.lit(PHENOM + "job/"), get(r, "jobSeqNo")),
            "posted_at": lambda r: source_date(get(r, "postedDate")),
            "raw_description": lambda r: get(r, "description"),
            "raw_job_type": lambda r: get(r, "type"),
            "raw_locations": lambda r: F.array_compact(F.transform(F.try_variant_get(r, "$.multi_location_array", "array<variant>"), lambda x: get(x, "location"))),
            # A talent community is no vacancy.
            "is_listed": lambda r: ~(F.contains(F.lower(get(r, "title")), F.lit("future opportunities")) & F.contains(F.lower(get(r, "description")), F.lit("talent community"))),
        },
        valid=lambda r: get(r, "jobSeqNo").rlike("^[A-Za-z0-9]+$") & get(r, "description").isNotNull(),
        repeats_break=True,
        errors_break=True,
        expected="$.totalHits",
    ),
    Adapter(
        "shopify",
        "$.jobs",
        "id",
        "title",
        {
            "raw_location": lambda r: get(r, "location"),
            "raw_locations": lambda r: strings(r, "places"),
            "source_url": lambda r: F.concat(F.lit(SHOPIFY + "/_"), get(r, "id")),
            "company_apply_url": lambda r: F.concat(F.lit(SHOPIFY + "/_"), get(r, "id")),
            "posted_at": lambda r: source_date(get(r, "publishedDate")),
            "raw_workplace_type": lambda r: get(r, "workplaceType"),
            "raw_job_type": lambda r: get(r, "employmentType"),
            "compensation": lambda r: F.when(get(r, "showsPay", kind="boolean") & get(r, "compensationTierSummary").isNotNull(), F.to_json(F.struct(get(r, "compensationTierSummary").alias("compensationTierSummary")))),
            "is_listed": lambda r: get(r, "listed", kind="boolean"),
        },
        repeats_break=True,
        errors_break=True,
    ),
):
    register(adapter)


def read_scraped(pages: DataFrame, name: str, company: str, tenant: str = "") -> Batch:
    """A batch from saved pages (page_no, value) of one of the sites."""
    to_json = {"successfactors": lambda p: successfactors_pages(p, tenant), "google": google_pages, "phenom": phenom_pages, "shopify": shopify_pages}[name]
    return read_batch(to_json(pages), ADAPTERS[name], company)


__all__ = ["google_details", "read_scraped", "successfactors_details", "with_details"]

"""URLs: validity, kinds, canonical forms, the providers behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "gh_src", "lever-source", "fbclid", "gclid", "_ga", "_gl", "trk", "trackingid", "tracking_id", "position", "pageNum"]
# Providers, the hosts they are known by, and where the board's name stands.
PROVIDERS = [
    ("greenhouse", r"(?:^|\.)greenhouse\.io$", r"^/(?:embed/job_app\?for=)?([A-Za-z0-9_-]+)"),
    ("lever", r"(?:^|\.)lever\.co$", r"^/([A-Za-z0-9_.-]+)"),
    ("ashby", r"(?:^|\.)ashbyhq\.com$", r"^/([A-Za-z0-9_.%-]+)"),
    ("workday", r"(?:^|\.)myworkday(?:jobs|site)\.com$", r"^/(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_-]+)"),
    ("amazon", r"(?:^|\.)amazon\.jobs$", r"^/(?:[a-z]{2}/)?jobs/([0-9]+)"),
    ("google", r"^careers\.google\.com$|^(?:www\.)?google\.com$", r"/jobs/results/([0-9]+)"),
]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_http(url: Column) -> Column:
    u = F.trim(url)
    return F.coalesce((F.length(u) >= 10) & ~u.rlike("\\s") & u.rlike("^(?i)https?://[^/?#]*\\.[^/?#]*"), F.lit(False))


def is_linkedin_job(url: Column) -> Column:
    p = F.lower(path(url))
    other = p.rlike("/company/|/school/|/feed|/in/")
    return is_http(url) & F.contains(host(url), F.lit("linkedin.com")) & ~other & p.rlike("/jobs?/")


def is_simplify_job(url: Column) -> Column:
    return is_http(url) & F.contains(host(url), F.lit("simplify.jobs")) & F.lower(path(url)).rlike("/(?:p|c|job|jobs)/")


def is_indeed(url: Column) -> Column:
    return F.coalesce(F.contains(F.lower(url), F.lit("indeed.com")), F.lit(False))


def canonical_apply_url(url: Column) -> Column:
    """Without fragment, tracking parameters, empty parameters and trailing slashes; scheme and host in lower case."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    pairs = F.split(F.regexp_extract(u, "\\?(.*)$", 1), "&")
    tracking = [t.lower() for t in TRACKING if t == t.lower()]
    kept = F.filter(pairs, lambda p: p.rlike("=.") & ~F.lower(F.substring_index(p, "=", 1)).isin(tracking))
    query = F.array_join(kept, "&")
    bare = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), F.regexp_replace(host(u), ":$", ""), F.regexp_replace(path(u), "/+$", ""))
    return F.when(u == "", "").when(query == "", bare).otherwise(F.concat(bare, F.lit("?"), query))


def provider(url: Column) -> Column:
    """struct<provider, token>: who runs the board behind a URL and the board's name; nulls if unknown."""
    name, token = F.lit(None).cast("string"), F.lit(None).cast("string")
    for who, hosts, at in reversed(PROVIDERS):
        here = host(url).rlike(hosts)
        name = F.when(here, who).otherwise(name)
        token = F.when(here, F.nullif(F.regexp_extract(path(url), at, 1), F.lit(""))).otherwise(token)
    return F.struct(name.alias("provider"), token.alias("token"))


def application_urls(source: Column, apply: Column, linkedin: Column, simplify: Column) -> Column:
    """struct<company_apply_url, linkedin_url, simplify_url>: each URL under the kind that it is, the best of a kind first."""
    given = [apply, source, linkedin, simplify]
    first = lambda test: F.coalesce(*[F.when(test(u), F.trim(u)) for u in given])
    company = first(lambda u: is_http(u) & ~is_indeed(u) & ~F.contains(host(u), F.lit("linkedin.com")) & ~F.contains(host(u), F.lit("simplify.jobs")))
    return F.struct(company.alias("company_apply_url"), first(is_linkedin_job).alias("linkedin_url"), first(is_simplify_job).alias("simplify_url"))


def primary_apply_url(urls: Column) -> Column:
    return F.coalesce(urls["company_apply_url"], urls["linkedin_url"], urls["simplify_url"])


def redacted(url: Column) -> Column:
    """Secrets in query parameters hidden, for logs."""
    return F.regexp_replace(url, "(?i)([?&](?:token|key|api_key|secret|signature)=)[^&#]*", "$1***")

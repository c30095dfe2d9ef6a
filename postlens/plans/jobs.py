"""The job board's queries: who is shown, the list with its filters and orders, and the statistics over the same rows.

postings: id, company_id, company, title, location, country, locations, description, workplace_type, role_type,
experience_level, pay_ranges, skills, source_name, source_job_id, source_url, term_season, posted_at, created_at,
last_seen_at, is_active, is_eligible_role.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, geo, pay, text
from ..operators import dedup, search, visibility
from ..operators.staging import staged

# Sources that count as official, names that filters accept for stored values, limits of a page.
OFFICIAL = ["greenhouse", "lever", "ashby", "workday", "amazon", "google", "shopify", "phenom", "successfactors"]
ROLE_NAMES = {"fulltime": "full_time", "full_time": "full_time", "intern": "internship", "internship": "internship", "coop": "co_op", "co_op": "co_op", "newgrad": "new_grad", "new_grad": "new_grad", "entrylevel": "entry_level", "entry_level": "entry_level", "entry": "entry_level"}
EXPERIENCE_NAMES = {"intern": "internship", "internship": "internship", "co_op": "internship", "coop": "internship", "entry": "entry", "entry_level": "entry", "new_grad": "entry", "newgrad": "entry", "junior": "entry", "associate": "entry", "mid": "mid", "mid_level": "mid", "intermediate": "mid", "senior": "senior", "sr": "senior", "lead": "senior", "staff": "senior", "principal": "senior"}
WORKPLACE_NAMES = {"onsite": ["on_site", "onsite"], "on_site": ["on_site", "onsite"], "remote": ["remote"], "hybrid": ["hybrid"], "unspecified": ["unspecified"]}
SEASON_NAMES = {"winter": "winter", "summer": "summer", "fall": "fall", "autumn": "fall"}
FRESHNESS = ["recent", "all", "today", "week", "14d", "30d"]
SORTS = ["recommended", "newest", "oldest", "company", "title"]
MAX_LIMIT, MAX_OFFSET = 100, 100_000


def eligible_population(postings: DataFrame) -> DataFrame:
    """Active, official, of an eligible role and place, whatever their age: what may suppress an earlier duplicate."""
    return postings.where(F.col("is_active") & F.col("is_eligible_role") & F.col("source_name").isin(OFFICIAL) & geo.eligible(F.col("location"), F.col("country")))


def deduplicated(rows: DataFrame, population: DataFrame) -> DataFrame:
    """Rows that no later one of the population equals in source id or in URL without fragment."""
    out = rows
    url = lambda: F.nullif(F.split_part(F.col("source_url"), F.lit("#"), F.lit(1)), F.lit(""))
    keys = [("_sid", F.when(F.nullif(F.col("source_job_id"), F.lit("")).isNotNull(), F.concat_ws("\u0001", "source_name", "source_job_id"))), ("_url", url())]
    for name, key in keys:
        last = population.select(key.alias(f"{name}_k"), F.col("id").alias("_id")).where(F.col(f"{name}_k").isNotNull()).groupBy(f"{name}_k").agg(F.max("_id").alias("_last"))
        out = out.withColumn(name, key).join(last, (F.col(name) == F.col(f"{name}_k")) & (F.col("_last") > F.col("id")), "left_anti").drop(name)
    return out


def target_postings(postings: DataFrame, as_of) -> DataFrame:
    """The population of every statistic."""
    population = eligible_population(postings)
    return deduplicated(population.where(visibility.publicly_visible(as_of)), population)


def recommended_bucket(as_of, in_canada: Column, early: Column, remote: Column, posted: str = "posted_at") -> Column:
    within = lambda n: visibility.posted_within(as_of, n, posted, skew=False)
    return F.when(in_canada & within(7), 1).when(in_canada & within(30), 2).when(in_canada & early & within(60), 3).when(in_canada, 4).when(remote, 5).when(early, 6).otherwise(7)


def _listed(values, names: dict, what: str) -> list:
    out = []
    for v in values or []:
        key = v.strip().lower().replace("-", "_")
        if key not in names:
            raise ValueError(f"invalid {what}: {v}")
        found = names[key]
        out += found if isinstance(found, list) else [found]
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class JobQuery:
    search: str | None = None
    q: str | None = None
    countries: list[str] = field(default_factory=list)
    company: str | None = None
    skill: str | None = None
    workplaces: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    seasons: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    experience: list[str] = field(default_factory=list)
    min_pay: float | None = None
    currency: str | None = None
    sponsorship: str | None = None
    freshness: str = "30d"
    sort: str = "recommended"
    limit: int = 25
    offset: int = 0

    def __post_init__(self):
        texts = [x for v in vars(self).values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)]
        if any("\x00" in x for x in texts):
            raise ValueError("NUL in a parameter")
        if self.freshness not in FRESHNESS or self.sort not in SORTS:
            raise ValueError(f"invalid freshness or sort: {self.freshness}, {self.sort}")
        if not 1 <= self.limit <= MAX_LIMIT or not 0 <= self.offset <= MAX_OFFSET:
            raise ValueError("limit or offset out of range")

    def _pay_currency(self, countries: list[str]) -> str:
        if self.currency and self.currency.strip():
            return self.currency.strip().upper()
        known = {"Canada": "CAD", "United States": "USD"}
        if len(countries) == 1 and countries[0] in known:
            return known[countries[0]]
        raise ValueError("a minimum pay needs a currency or one supported country")

    def predicate(self, as_of) -> Column:
        col = F.col
        countries = geo.canonical_countries(self.countries)
        parts = [search.matches(self.search or self.q)]
        window = {"today": visibility.posted_today(as_of), "week": visibility.posted_within(as_of, 7), "14d": visibility.posted_within(as_of, 14)}
        if self.freshness != "all":
            parts.append(visibility.publicly_visible(as_of))
        if self.freshness in window:
            parts.append(window[self.freshness])
        if countries:
            parts.append(geo.country_filter(countries, col("country"), col("locations")))
        if self.company and self.company.strip():
            parts.append(F.lower("company") == self.company.strip().lower())
        if self.skill and self.skill.strip():
            parts.append(F.exists("skills", lambda s: F.lower(s) == self.skill.strip().lower()))
        for column, values in (
            ("workplace_type", _listed(self.workplaces, WORKPLACE_NAMES, "workplace")),
            ("role_type", _listed(self.roles, ROLE_NAMES, "role")),
            ("term_season", _listed(self.seasons, SEASON_NAMES, "term")),
            ("experience_level", _listed(self.experience, EXPERIENCE_NAMES, "experience")),
        ):
            if values:
                parts.append(col(column).isin(values))
        places = [geo.location_filter(v, col("location"), col("country"), col("locations")) for v in self.locations if v.strip()]
        if places:
            any_place = places[0]
            for p in places[1:]:
                any_place = any_place | p
            parts.append(any_place)
        if self.min_pay and self.min_pay > 0:
            parts.append(pay.pays_at_least(col("pay_ranges"), self.min_pay, self._pay_currency(countries)))
        wanted = (self.sponsorship or "").strip().lower()
        if wanted in ("available", "offers_sponsorship", "sponsored"):
            parts.append(classify.sponsorship(col("description"))["available"])
        elif wanted in ("not_required", "no_sponsorship", "citizen_or_pr"):
            said = classify.sponsorship(col("description"))
            only = countries[0] if len(countries) == 1 else None
            test = said["not_required"]
            test = test | said["not_required_canada"] if only != "United States" else test
            parts.append(test | said["not_required_us"] if only != "Canada" else test)
        elif wanted not in ("", "all"):
            raise ValueError(f"invalid sponsorship: {self.sponsorship}")
        out = F.lit(True)
        for p in parts:
            out = out & F.coalesce(p, F.lit(False))
        return out

    def order(self, as_of) -> list[Column]:
        posted, created, last = F.desc_nulls_last("posted_at"), F.desc("created_at"), F.desc("id")
        if self.sort == "newest":
            return [posted, created, last]
        if self.sort == "oldest":
            return [F.asc_nulls_last("posted_at"), F.asc("created_at"), F.asc("id")]
        if self.sort in ("company", "title"):
            return [F.lower(self.sort).asc(), posted, last]
        canada = (F.col("country") == "Canada") | F.coalesce(F.exists("locations", lambda x: x["country"] == "Canada"), F.lit(False))
        remote = (F.col("workplace_type") == "remote") | F.coalesce(F.col("location").rlike(r"(?i)\bremote\b"), F.lit(False))
        return [recommended_bucket(as_of, canada, F.col("role_type").isin(classify.EARLY_CAREER), remote).asc(), posted, created, last]


def matching(postings: DataFrame, query: JobQuery, as_of) -> DataFrame:
    population = eligible_population(postings)
    return deduplicated(population.where(query.predicate(as_of)), population)


def page(postings: DataFrame, query: JobQuery, as_of) -> DataFrame:
    """One page: a top-k, so only offset + limit rows of each task travel."""
    rows = matching(postings, query, as_of).orderBy(*query.order(as_of)).offset(query.offset).limit(query.limit)
    derived = {
        "freshness_status": visibility.freshness_status(as_of),
        "posted_precision": visibility.posted_precision(),
        "term_label": classify.term_label(F.col("term_season"), F.col("term_year")) if "term_year" in postings.columns else F.lit(None).cast("string"),
    }
    return rows.select("*", *[c.alias(n) for n, c in derived.items()])


def total(postings: DataFrame, query: JobQuery, as_of) -> DataFrame:
    return matching(postings, query, as_of).agg(F.count(F.lit(1)).alias("total"))


def detail(postings: DataFrame, posting_id: int) -> DataFrame:
    """The posting with its state: found, gone (no longer active) or, without a row, unknown."""
    row = postings.where((F.col("id") == posting_id) & F.col("source_name").isin(OFFICIAL) & F.col("is_eligible_role"))
    return row.withColumn("availability", F.when(F.col("is_active"), "found").otherwise("gone"))


def country_shares(targets: DataFrame) -> DataFrame:
    """Distinct (posting, country) pairs; shares are of the pairs, not of the postings."""
    own = F.array(F.struct(F.col("country").alias("country")))
    countries = F.when(F.size("locations") > 0, F.transform("locations", lambda x: F.struct(x["country"].alias("country")))).otherwise(own)
    pairs = targets.select("id", F.inline(countries)).where(F.col("country").isin(geo.ELIGIBLE)).distinct()
    counted = pairs.groupBy("country").agg(F.count(F.lit(1)).alias("postings"))
    return counted.withColumn("share_pct", F.round(100.0 * F.col("postings") / F.sum("postings").over(Window.partitionBy()), 1))


def skill_shares(targets: DataFrame) -> DataFrame:
    whole = targets.agg(F.count(F.lit(1)).alias("_total"))
    counted = targets.select("id", F.explode(F.array_distinct("skills")).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("mentions"))
    rank = F.row_number().over(Window.orderBy(F.desc("mentions"), F.lower("skill"))).alias("rank")
    return counted.join(F.broadcast(whole)).select(rank, "skill", "mentions", F.round(F.try_divide(100.0 * F.col("mentions"), F.col("_total")), 1).alias("frequency_pct"))


def overview(postings: DataFrame, as_of, countries: list[str] | None = None) -> DataFrame:
    rows = target_postings(postings, as_of)
    if countries:
        rows = rows.where(geo.country_filter(countries, F.col("country"), F.col("locations")))
    skills = rows.select(F.explode("skills").alias("skill")).agg(F.countDistinct("skill").alias("total_skills"))
    facts = rows.agg(F.count(F.lit(1)).alias("total_postings"), F.countDistinct("company_id").alias("total_companies"), F.countDistinct("location").alias("total_locations"), F.count_if(visibility.posted_within(as_of)).alias("recently_posted_postings"))
    return facts.join(F.broadcast(skills))


def location_options(targets: DataFrame) -> DataFrame:
    """Which metropolitan areas match anything at all."""
    offered = [F.coalesce(F.bool_or(geo.location_filter(o, F.col("location"), F.col("country"), F.col("locations"))), F.lit(False)) for o in geo.LOCATION_OPTIONS]
    row = targets.agg(*[c.alias(f"o{k}") for k, c in enumerate(offered)])
    return row.select(F.explode(F.array_compact(F.array(*[F.when(F.col(f"o{k}"), o) for k, o in enumerate(geo.LOCATION_OPTIONS)]))).alias("location"))


FACETS = {"role": "role_type", "workplace": "workplace_type", "company": "company"}


def facet_counts(targets: DataFrame) -> DataFrame:
    """facet, value, postings by role, workplace and company, and one row of all (facet '' and value null), by one aggregation over grouping
    sets. Written as a table, as the statistics and the options read it several times. Blank values count as unspecified."""
    rows = targets.select(*[(F.col(c) if f == "company" else text.blank_to(F.col(c), "unspecified")).alias(f) for f, c in FACETS.items()])
    counted = rows.groupingSets([[f] for f in FACETS] + [[]], *FACETS).agg(*[(F.grouping(f) == 0).alias(f"_{f}") for f in FACETS], F.count(F.lit(1)).alias("postings"))
    facet = F.coalesce(*[F.when(F.col(f"_{f}"), f) for f in FACETS], F.lit(""))
    return staged(counted.select(facet.alias("facet"), F.coalesce(*FACETS).alias("value"), "postings"))


def _shared(rows: DataFrame, facets: DataFrame) -> DataFrame:
    whole = facets.where("facet = ''").select(F.col("postings").alias("_all"))  # one row
    return rows.join(F.broadcast(whole)).select(F.col("value").alias("category"), "postings", F.round(F.try_divide(100.0 * F.col("postings"), F.col("_all")), 1).alias("share_pct"))


def breakdown(facets: DataFrame, facet: str) -> DataFrame:
    """category, postings, share_pct of role or workplace (see facet_counts), most postings first."""
    return _shared(facets.where(F.col("facet") == facet), facets).orderBy(F.desc("postings"), "category")


def top_companies(facets: DataFrame, n: int = 10) -> DataFrame:
    top = facets.where("facet = 'company' AND value IS NOT NULL").orderBy(F.desc("postings"), F.lower("value"), "value").limit(n)
    return _shared(top, facets).orderBy(F.desc("postings"), F.lower("category"), "category")


def company_directory(companies: DataFrame, targets: DataFrame, name: str | None = None) -> DataFrame:
    """companies (id and its other columns) with active_jobs_count: those with postings, by name; or, with a name given, the companies of
    that name in any case, with or without postings."""
    counted = targets.groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("active_jobs_count"))
    if name is not None:
        found = companies.where(F.lower("name") == name.lower()).join(counted, "id", "left")
        return found.withColumn("active_jobs_count", F.coalesce("active_jobs_count", F.lit(0)))
    return companies.join(counted, "id").orderBy("name")


def filter_options(targets: DataFrame, facets: DataFrame | None = None) -> DataFrame:
    """kind, value of everything that a filter can choose from the public postings: countries, companies, skills, workplaces, roles and
    the metropolitan areas that any posting matches. Blank values are no options."""
    facets = facet_counts(targets) if facets is None else facets
    plain = facets.where("facet <> '' AND value <> '' AND (facet = 'company' OR value <> 'unspecified')").select(F.col("facet").alias("kind"), "value")
    unspecified = targets.where("workplace_type = 'unspecified'").select(F.lit("workplace").alias("kind"), F.lit("unspecified").alias("value")).limit(1)
    skills = targets.select(F.lit("skill").alias("kind"), F.explode(F.array_distinct("skills")).alias("value")).where("value <> ''").distinct()
    countries = country_shares(targets).select(F.lit("country").alias("kind"), F.col("country").alias("value"))
    areas = location_options(targets).select(F.lit("location").alias("kind"), F.col("location").alias("value"))
    return plain.unionByName(unspecified).unionByName(skills).unionByName(countries).unionByName(areas)


def identity_clusters(postings: DataFrame) -> DataFrame:
    return dedup.canonical_choice(postings.withColumn("_cluster", dedup.canonical_url(F.col("source_url"))), "_cluster").drop("_cluster")

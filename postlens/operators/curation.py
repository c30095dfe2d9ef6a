"""Upkeep of stored tables: candidates, secondary links, spellings, repairs; and the counts that a load or a dry run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, geo, pay, pay_resolve, pay_text, places, segments, skills, urls
from ..functions.html import html_text
from ..functions.text import settled
from .state import last_of
from .visibility import fresh, moment

#: What a candidate that is seen again overwrites; its key, source, company and first sight stay.
CANDIDATE_COLUMNS = ["title", "locations", "role_type", "term_season", "term_year", "discovered_url", "simplify_url", "official_url", "official_url_verified", "provider", "token", "status", "reason", "matched_source_name", "matched_source_job_id"]
RECOMMENDED = ["greenhouse", "lever", "ashby", "workday"]


def upserted_candidates(stored: DataFrame, seen: DataFrame, as_of) -> DataFrame:
    """Stored candidates after a run. stored: candidate_key, source_repo, source_id, company_name, CANDIDATE_COLUMNS (those it has),
    first_seen_at, last_seen_at. seen: the same without times, with ordinal; of repeated keys the last counts."""
    now = moment(as_of)
    columns = [c for c in CANDIDATE_COLUMNS if c in stored.columns]
    kept = ["source_repo", "source_id", "company_name"]
    new = last_of(seen.where("candidate_key IS NOT NULL").select("candidate_key", *kept, *columns, "ordinal"), ["candidate_key"])
    new = new.select("candidate_key", *[F.col(c).alias(f"_{c}") for c in [*kept, *columns]], F.lit(True).alias("_seen"))
    both = stored.withColumn("_was", F.lit(True)).join(new, "candidate_key", "full")
    again = F.col("_seen").isNotNull()
    values = {c: F.when(F.col("_was").isNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in kept}
    values |= {c: F.when(again, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    values |= {"first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": F.when(again, now).otherwise(F.col("last_seen_at"))}
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in stored.columns])


def with_attached_urls(postings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Active postings take the listing URL of the verified candidate that matched them; nothing is inserted. attached says
    which rows changed; a posting that has the URL already does not. Of several candidates the last counts."""
    good = F.coalesce(F.col("official_url_verified"), F.lit(False)) & urls.is_simplify_job(F.col("simplify_url"))
    found = candidates.where(good & F.col("matched_source_name").isNotNull() & F.col("matched_source_job_id").isNotNull())
    links = last_of(found.select(F.col("matched_source_name").alias("source_name"), F.col("matched_source_job_id").alias("source_job_id"), F.col("simplify_url").alias("_url"), "ordinal"), ["source_name", "source_job_id"]).drop("ordinal")
    out = postings.join(links, ["source_name", "source_job_id"], "left")
    changes = F.coalesce(F.col("is_active") & F.col("_url").isNotNull() & ~F.col("simplify_url").eqNullSafe(F.col("_url")), F.lit(False))
    keep = {"simplify_url": F.when(changes, F.col("_url")).otherwise(F.col("simplify_url"))}
    return out.select(*[keep.get(c, F.col(c)).alias(c) for c in postings.columns], changes.alias("attached"))


def with_configured_names(companies: DataFrame, targets: DataFrame) -> DataFrame:
    """Companies with the spelling of the configuration where theirs differs in case or blanks around it; renamed says where.
    Of two configured spellings of one name the larger counts."""
    folded = lambda c: F.lower(F.trim(c))
    given = targets.where(F.trim("name") != "").groupBy(folded(F.col("name")).alias("_key")).agg(F.max("name").alias("_name"))
    out = companies.join(given, folded(F.col("name")) == F.col("_key"), "left")
    renamed = F.coalesce(F.col("_name") != F.col("name"), F.lit(False))
    return out.select(*[F.coalesce("_name", "name").alias("name") if c == "name" else F.col(c) for c in companies.columns], renamed.alias("renamed"))


def all_candidates(runs: list[DataFrame]) -> DataFrame:
    """Candidates of several lists as one table in the order of the lists; columns that one lacks are null there."""
    out = None
    for k, rows in enumerate(runs):
        placed = rows.withColumn("ordinal", F.struct(F.lit(k).alias("list"), F.col("ordinal").alias("row")))
        out = placed if out is None else out.unionByName(placed, allowMissingColumns=True)
    return out


def new_boards(discovered: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Boards that were found and are no target: rows for review in the configuration's shape (write them with write.json)."""
    known = watchlist.select(F.col("name").alias("company"), "careers_url", "priority_countries").dropDuplicates(["company"])
    found = discovered.where("status = 'found'").join(known, "company", "left")
    return found.select(F.col("company").alias("name"), F.col("provider").alias("ats"), F.col("token").alias("identifier"), "careers_url", "priority_countries")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """name, ats, identifier of a configuration file (a JSON array), in lower case where they identify a board; entries without
    either are dropped. A file that is no array of objects has no rows with a name and fails."""
    rows = spark.read.schema("name string, company string, ats string, provider string, identifier string, token string, careers_url string, priority_countries array<string>, enabled boolean, _corrupt_record string").option("multiLine", True).json(path)
    low = lambda *names: F.nullif(F.lower(F.trim(F.coalesce(*names))), F.lit(""))
    whole = F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(F.lit(f"no JSON array of objects: {path}"))).otherwise(F.coalesce("name", "company"))
    out = rows.select(whole.cast("string").alias("name"), low("ats", "provider").alias("ats"), low("identifier", "token").alias("identifier"), "careers_url", "priority_countries", F.coalesce("enabled", F.lit(True)).alias("enabled"))
    return out.where("name IS NOT NULL")


def load_counts(rows: DataFrame, postings: DataFrame, companies: DataFrame, locations: DataFrame, known_skills: DataFrame, links: DataFrame) -> DataFrame:
    """kind, total, created, existing of a load. rows: job_id, company, location, country, skills (array). Stored tables:
    job_id; name; location, country; name; job_id, skill. Companies, places and skills count once each, postings and links by row."""

    def of(kind: str, seen: DataFrame, stored: DataFrame, key: list[str], each: bool) -> DataFrame:
        counted = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        both = counted.join(stored.select(*key).distinct().withColumn("_was", F.lit(True)), key, "left")
        created = F.count_if(F.col("_was").isNull())
        total = F.coalesce(F.sum("_n"), F.lit(0)) if each else F.count(F.lit(1))
        return both.agg(total.cast("long").alias("total"), created.cast("long").alias("created")).select(F.lit(kind).alias("kind"), "total", "created", (F.col("total") - F.col("created")).alias("existing"))

    pairs = rows.select("job_id", F.explode(F.array_distinct("skills")).alias("skill"))
    every = [
        of("postings", rows, postings, ["job_id"], True),
        of("companies", rows.select(F.col("company").alias("name")), companies, ["name"], False),
        of("locations", rows, locations, ["location", "country"], False),
        of("skills", pairs.select(F.col("skill").alias("name")), known_skills, ["name"], False),
        of("relationships", pairs, links, ["job_id", "skill"], True),
    ]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def _tallied(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """kind, value, n of several columns in one pass; null values do not count."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in values.items()])
    return rows.select(F.inline(each)).where("value IS NOT NULL").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def dry_run(rows: DataFrame, as_of) -> DataFrame:
    """kind, value, n of what a load would store: roles, workplaces, countries and terms, how many are dated and stale, and the
    oldest and newest date. rows: postings as `silver` derives them; only listed ones of an eligible role count."""
    rows = rows.where("is_listed AND is_eligible_role")
    stale = F.col("posted_at").isNotNull() & ~fresh(as_of)
    rows = rows.withColumn("created_at", F.lit(None).cast("timestamp"))
    kinds = {"role_type": F.col("role_type"), "workplace_type": F.col("workplace_type"), "country": F.col("country"), "term": F.when(F.col("term_season").isNotNull(), F.concat_ws(" ", "term_season", "term_year")), "dated": F.when(F.col("posted_at").isNotNull(), "yes"), "stale": F.when(stale, "yes")}
    ends = rows.agg(F.min("posted_at").alias("a"), F.max("posted_at").alias("b"), F.count("posted_at").alias("n")).where("n > 0")
    dates = ends.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("value")) for k, c in (("oldest", "a"), ("newest", "b"))]))).withColumn("n", F.lit(1).cast("long"))
    return _tallied(rows, kinds).unionByName(dates)


def discovery_report(resolved: DataFrame) -> DataFrame:
    """kind, value, n of a discovery run (see discovery.resolve_candidates): by outcome, role and term, of all and of Canadian ones."""
    scope = F.col("status") == "discovered"
    canada = scope & F.coalesce(F.col("has_canada"), F.lit(False))
    verified = F.col("outcome").isin("verified", "known")
    term = F.when(F.col("term_season").isNotNull(), F.concat_ws(" ", "term_season", "term_year"))
    yes = lambda c: F.when(c, "yes")
    kinds = {"outcome": F.col("outcome"), "in_scope": yes(scope), "canadian": yes(canada), "role_type": F.when(scope, F.col("role_type")), "canadian_role_type": F.when(canada, F.col("role_type")), "term": F.when(scope, term), "verified": yes(scope & verified), "verified_canadian": yes(canada & verified), "reason": F.col("reason"), "company_configured": yes(scope & F.col("target").isNotNull())}
    return _tallied(resolved, kinds)


def source_audit(bronze: DataFrame) -> DataFrame:
    """A row a company and source: records, software roles, and of those the eligible, dated, paid and multi-location ones."""
    given = F.array_join(F.array_distinct(F.array_compact(F.concat(F.array("raw_location"), F.coalesce("raw_locations", F.array().cast("array<string>"))))), ";")
    rows = bronze.withColumn("_at", places.job_places(given)).withColumn("_role", F.coalesce(F.col("is_listed") & classify.is_software_role(F.col("title"), F.lit(None).cast("string")), F.lit(False)))
    role = F.col("_role")
    eligible = F.exists("_at", lambda x: geo.eligible(x["location"], x["country"]))
    counted = {"software": role, "eligible": role & eligible, "dated": role & F.col("posted_at").isNotNull(), "paid": role & (F.coalesce("compensation", F.lit("")) != ""), "multiple_locations": role & (F.size("_at") > 1)}
    return rows.groupBy("company_name", "source_name").agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counted.items()])


def repaired(postings: DataFrame) -> DataFrame:
    """Stored postings read anew by today's rules: columns as before with places, skills and (where the postings have it) pay renewed, and
    changed. Places come from what the source said (raw_location of the stored entries, else the label); skills are only added; pay is
    resolved from what the source published and the description. Repaired rows stay as they are."""
    empty = F.array().cast("array<string>")
    stored = postings.schema["locations"].dataType.elementType.fieldNames()
    labels = places.published_labels(F.transform("locations", lambda x: F.struct(*[(x[c] if c in stored else F.lit(None).cast(t)).alias(c) for c, t in (("location", "string"), ("raw_location", "string"), ("also_published", "array<string>"))])))
    said = F.when(F.size(F.coalesce("locations", F.array())) > 0, labels).otherwise(F.array("location"))
    grammar = stated = None
    if "source_name" in postings.columns and "raw_location" in stored:
        # The list-and-detail vendor's labels are read by their grammar, beside the country that is stored for each.
        segmented = F.col("source_name") == "workday"
        grammar = lambda label: F.when(segmented, segments.segment_place(label))
        label = lambda x: F.coalesce(F.nullif(F.trim(x["raw_location"]), F.lit("")), x["location"])
        none = [F.lit(None).cast("string").alias(c) for c in ("locality", "region")]
        stated = F.when(segmented, F.transform("locations", lambda x: F.struct(label(x).alias("label"), F.nullif(x["country"], F.lit("Unknown")).alias("country"), *none)))
    read = places.job_places(F.array_join(F.array_compact(said), ";"), stated, grammar)
    at = F.transform(read, lambda x: F.struct(*[x[c].alias(c) for c in stored])).cast(postings.schema["locations"].dataType)
    # A raw label that only repeats the location says nothing, so entries that differ in it alone are the same.
    bare = lambda entries: F.transform(entries, lambda x: F.struct(*[F.nullif(x[c], x["location"]) if c == "raw_location" else x[c] for c in stored]))
    rows = settled(postings, _read=at, _known=F.get(read, F.lit(0))["location"] != "Unknown")
    rows = settled(rows, _at=F.when(F.col("_known") & ~bare(F.col("locations")).eqNullSafe(bare(F.col("_read"))), F.col("_read")).otherwise(F.col("locations")))
    first = geo.primary_location(F.col("_at"))
    found = skills.in_text(F.concat_ws("\n", "title", html_text("description")))
    rows = rows.withColumn("_skills", F.array_sort(F.array_union(F.coalesce("skills", empty), found))).withColumn("_place", F.coalesce(first["location"], "location")).withColumn("_country", F.coalesce(first["country"], "country"))
    renewed = {"locations": F.col("_at"), "location": F.col("_place"), "country": F.col("_country"), "skills": F.col("_skills")}
    same = F.array_sort(F.coalesce("skills", empty)).eqNullSafe(F.col("_skills"))
    fields = [("locations", "_at"), ("location", "_place"), ("country", "_country")]
    if "compensation" in postings.columns:
        rows = settled(rows.withColumn("_stated", pay_text.pay_in_html(F.col("description"))), _said=F.col("_stated"))
        rows = settled(rows, _pay=pay_resolve.resolved_with(F.col("compensation"), F.col("_said"), F.col("_at")))
        rows = rows.withColumn("_ranges", pay.usable_ranges(F.col("_pay")))
        fields += [("compensation", "_pay"), *([("pay_ranges", "_ranges")] if "pay_ranges" in postings.columns else [])]
        renewed |= {old: F.col(new) for old, new in fields[3:]}
    for old, new in fields:
        same = same & F.col(old).eqNullSafe(F.col(new))
    return rows.select(*[renewed.get(c, F.col(c)).alias(c) for c in postings.columns], (~same).alias("changed"))


def recommended_boards(resolved: DataFrame, n: int = 40) -> DataFrame:
    """Boards of readable systems that are no target, by verified Canadian postings, then verified ones, then name."""
    good = resolved.where(F.col("target").isNull() & F.col("provider").isin(RECOMMENDED) & (F.col("outcome") == "verified"))
    counted = good.groupBy("company_name", "provider", "token").agg(F.count(F.lit(1)).alias("verified_postings"), F.count_if(F.coalesce(F.col("has_canada"), F.lit(False))).alias("canadian_postings"))
    return counted.orderBy(F.desc("canadian_postings"), F.desc("verified_postings"), "company_name", "provider", "token").limit(n)

"""Discovery over saved pages and listings: which board a company uses, and which listed postings are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, geo, places, urls
from ..functions.html import html_links
from .dedup import company_key, first_seen
from .reports import most_frequent

# Systems that are recognized but not read, and budgets of a run.
UNSUPPORTED = {"icims": "icims.com", "smartrecruiters": "smartrecruiters.com", "taleo": "taleo.net", "jobvite": "jobvite.com", "workable": "workable.com", "bamboohr": "bamboohr.com", "successfactors": "successfactors.com"}
BOARDS, DIRECT_CHECKS = 250, 600


def valid_token(token: Column) -> Column:
    return F.coalesce(token.rlike("^[A-Za-z0-9][A-Za-z0-9_.-]{1,99}$") & ~F.lower(token).isin("embed", "jobs", "api", "www", "careers", "v1", "boards"), F.lit(False))


def board_candidates(pages: DataFrame) -> DataFrame:
    """company, provider, token, position of every board link in the pages (company, html)."""
    linked = pages.select("company", F.posexplode(html_links("html")).alias("position", "url"))
    found = linked.select("company", "position", urls.provider(F.col("url")).alias("p")).select("company", "position", "p.*")
    return found.where(F.col("provider").isNotNull() & valid_token(F.col("token"))).withColumn("token", F.lower("token"))


def discovered_boards(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """company, status, provider, token: found, known (a target has the board), unsupported or not_found."""
    pairs = board_candidates(pages).withColumn("board", F.concat_ws("/", "provider", "token"))
    best = most_frequent(pairs, "company", "board", "position").select("company", "board")
    known = targets.select(F.concat_ws("/", F.lower("ats"), F.lower("identifier")).alias("board"), F.lit(True).alias("known")).distinct()
    other = F.lit(None).cast("string")
    for name, host in UNSUPPORTED.items():
        other = F.when(F.contains(F.lower("html"), F.lit(host)), name).otherwise(other)
    every = pages.groupBy("company").agg(F.max(other).alias("other"))
    out = every.join(best, "company", "left").join(known, "board", "left")
    status = F.when(F.col("known"), "known").when(F.col("board").isNotNull(), "found").when(F.col("other").isNotNull(), "unsupported").otherwise("not_found")
    return out.select("company", status.alias("status"), F.split_part("board", F.lit("/"), F.lit(1)).alias("provider"), F.split_part("board", F.lit("/"), F.lit(2)).alias("token"), "other")


def listing_candidates(listings: DataFrame, repo: str, kind: str) -> DataFrame:
    """Candidates of an early-career list (raw JSON records in value): those in scope are discovered, others closed or
    invalid with a reason; records without id, company or title are dropped (count them with malformed)."""
    r = F.try_parse_json("value")
    from ..sources.adapters import get, strings

    rows = listings.select(get(r, "id").alias("source_id"), get(r, "company_name").alias("company_name"), get(r, "title").alias("title"), get(r, "url").alias("discovered_url"), strings(r, "locations").alias("places"), strings(r, "terms").alias("terms"), get(r, "category").alias("category"), F.coalesce(get(r, "active", kind="boolean"), F.lit(False)).alias("active"), F.coalesce(get(r, "is_visible", kind="boolean"), F.lit(True)).alias("visible"))
    rows = rows.where("source_id IS NOT NULL AND company_name IS NOT NULL AND title IS NOT NULL")
    located = F.flatten(F.transform("places", lambda p: places.job_places(p)))
    role = classify.role_type(F.col("title"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    role = F.when(role.isin(classify.EARLY_CAREER), role).otherwise("internship" if kind == "internship" else "new_grad")
    terms = F.filter("terms", lambda t: F.upper(F.trim(t)) != "N/A")
    rows = rows.withColumn("locations", located).withColumn("role_type", role).withColumn("term", classify.academic_term(F.col("title"), terms, F.lit(None).cast("string"), F.col("role_type")))
    good = F.filter("locations", lambda x: geo.eligible(x["location"], x["country"]))
    canada = F.exists(good, lambda x: x["country"] == "Canada")
    reason = (
        F.when(~F.col("visible"), "hidden")
        .when(~F.col("active"), "inactive")
        .when(~classify.is_software_role(F.col("title"), F.lit(None).cast("string")), "no software role")
        .when(F.size(good) == 0, "no eligible place")
        .when(F.col("discovered_url").isNull(), "no URL")
    )
    status = F.when(reason.isNull(), "discovered").when(reason == "inactive", "closed").otherwise("invalid")
    key = F.concat_ws(":", F.lit(repo), "source_id")
    return rows.select(key.alias("candidate_key"), F.lit(repo).alias("source_repo"), "source_id", "company_name", "title", "locations", "role_type", F.col("term.season").alias("term_season"), F.col("term.year").alias("term_year"), "discovered_url", "category", canada.alias("has_canada"), status.alias("status"), reason.alias("reason"), F.monotonically_increasing_id().alias("ordinal"))


def malformed(listings: DataFrame) -> DataFrame:
    from ..sources.adapters import get

    r = F.try_parse_json("value")
    bad = get(r, "id").isNull() | get(r, "company_name").isNull() | get(r, "title").isNull()
    return listings.agg(F.count_if(bad).alias("malformed"))


def resolve_candidates(candidates: DataFrame, targets: DataFrame, snapshots: DataFrame, known_jobs: DataFrame, boards: int = BOARDS, direct: int = DIRECT_CHECKS) -> DataFrame:
    """Candidates with what became of them.

    targets: name, ats, identifier. snapshots: provider, token, job_id, complete (the ids that each board listed).
    known_jobs: source_name, source_job_id. A candidate with the URL, or the board and id, of an earlier one that is no duplicate itself is
    one (duplicate_of is the earlier one's key); boards beyond the budget are deferred; a board that was read decides whether the posting is verified.
    """
    p = urls.provider(F.col("discovered_url"))
    job = F.nullif(F.regexp_extract("discovered_url", "(?:jobs/|gh_jid=|/)([0-9]{5,}|[0-9a-f]{8}-[0-9a-f-]{27})(?:[/?#]|$)", 1), F.lit(""))
    rows = candidates.withColumn("provider", p["provider"]).withColumn("token", F.lower(p["token"])).withColumn("job_id", job).withColumn("url_key", F.nullif(urls.canonical_apply_url(F.col("discovered_url")), F.lit("")))
    known = targets.select(F.lower("ats").alias("provider"), F.lower("identifier").alias("token"), F.col("name").alias("target_by_board")).dropDuplicates(["provider", "token"])
    named = targets.select(company_key(F.col("name")).alias("name_key"), F.col("name").alias("target_by_name")).dropDuplicates(["name_key"])
    rows = rows.join(known, ["provider", "token"], "left").join(named, company_key(F.col("company_name")) == F.col("name_key"), "left").drop("name_key")
    # A name that fits is no match if the link shows another board than the company's.
    rows = rows.withColumn("target", F.coalesce("target_by_board", F.when(F.col("provider").isNull(), F.col("target_by_name")))).drop("target_by_board", "target_by_name")
    open_ = F.col("status") == "discovered"
    board_job = F.when(F.col("job_id").isNotNull(), F.to_json(F.array(F.coalesce("provider", F.lit("")), F.coalesce("token", F.lit("")), "job_id")))
    seen = first_seen(rows.where(open_).select("ordinal", "url_key", board_job.alias("job_key")), "ordinal", ["url_key", "job_key"]).where("is_duplicate").select("ordinal", "duplicate_of")
    prior = rows.select(F.col("ordinal").alias("duplicate_of"), F.col("candidate_key").alias("_prior"))
    seen = seen.join(prior, "duplicate_of").select("ordinal", F.col("_prior").alias("duplicate_of"))
    rows = rows.join(seen, "ordinal", "left").withColumn("twin", F.col("duplicate_of").isNotNull())
    sizes = rows.where(open_ & ~F.col("twin") & F.col("token").isNotNull()).groupBy("provider", "token").agg(F.count(F.lit(1)).alias("n"), F.max("has_canada").alias("canada"))
    chosen = sizes.orderBy(F.desc("canada"), F.desc("n"), "provider", "token").limit(boards).select("provider", "token", F.lit(True).alias("budgeted"))
    listed = snapshots.select(F.col("provider"), F.lower("token").alias("token"), "job_id", F.lit(True).alias("on_board")).distinct()
    read = snapshots.groupBy("provider", F.lower("token").alias("token")).agg(F.bool_and("complete").alias("board_complete"))
    have = known_jobs.select(F.col("source_name").alias("provider"), F.col("source_job_id").alias("job_id"), F.lit(True).alias("already")).distinct()
    rows = rows.join(chosen, ["provider", "token"], "left").join(listed, ["provider", "token", "job_id"], "left").join(read, ["provider", "token"], "left").join(have, ["provider", "job_id"], "left")
    budget = rows.where(open_ & ~F.col("twin") & F.col("token").isNull()).orderBy(F.desc("has_canada"), "ordinal").limit(direct)
    rows = rows.join(F.broadcast(budget.select("ordinal", F.lit(True).alias("checked"))), "ordinal", "left")  # `direct` rows at most
    outcome = (
        F.when(~open_, F.col("status"))
        .when(F.col("twin"), "duplicate")
        .when(F.col("token").isNull(), F.when(F.col("checked"), "unverified").otherwise("deferred"))
        .when(F.col("budgeted").isNull(), "deferred")
        .when(F.col("on_board"), F.when(F.col("already"), "known").otherwise("verified"))
        .when(F.col("board_complete"), "closed")
        .otherwise("unverified")
    )
    return rows.withColumn("outcome", outcome).drop("twin", "budgeted", "checked", "on_board", "board_complete", "already")


def recommendations(resolved: DataFrame, n: int = 40) -> DataFrame:
    """Boards that are no target yet, by how many postings were verified on them."""
    new = resolved.where(F.col("target").isNull() & F.col("token").isNotNull())
    counted = new.groupBy("provider", "token").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("outcome") == "verified").alias("verified"), F.min("company_name").alias("company_name"))
    return counted.orderBy(F.desc("verified"), F.desc("candidates"), "provider", "token").limit(n)

"""State of postings over snapshots: merges, tombstones and the guards before them.

Everything works on whole sets of companies at once; nothing is updated in place, each function returns the new state.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged
from .visibility import moment

# A drop is suspicious from so many rows and so large a share; so many earlier runs within so many
# hours must have seen the same count within a tenth; from so many tries and so large a share failures are systemic.
MIN_DROP, DROP_SHARE, CONFIRMATIONS, CONFIRM_HOURS, TOLERANCE = 3, 0.5, 2, 24, 0.1
MIN_TRIES, FAILED_SHARE = 5, 0.8
# Longest job id, source id and title; of a longer job id, characters of the source and hex digits of the source id's hash.
JOB_ID_CHARS, SOURCE_ID_CHARS, TITLE_CHARS = 100, 150, 255
SOURCE_CHARS, HASH_DIGITS = 20, 60
#: Buckets in which new rows get their numbers.
BUCKETS = 1024


def fit_text(text: Column, chars: int = TITLE_CHARS) -> Column:
    """Without NUL and blanks around it, cut to the length with an ellipsis; a null text is empty."""
    clean = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u0000", ""), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(clean) > chars, F.concat(F.regexp_replace(F.substring(clean, 1, chars - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(clean)


def source_job_id(raw: Column) -> Column:
    clean = F.nullif(F.trim(F.translate(raw, "\u0000", "")), F.lit(""))
    return F.when(F.length(clean) > SOURCE_ID_CHARS, F.concat(F.lit("sha256:"), F.sha2(clean.cast("binary"), 256))).otherwise(clean)


def job_id(source: Column, source_id: Column) -> Column:
    whole = F.concat_ws(":", source, source_id)
    short = F.concat_ws(":", F.substring(source, 1, SOURCE_CHARS), F.substring(F.sha2(source_id.cast("binary"), 256), 1, HASH_DIGITS))
    return F.when(F.length(whole) > JOB_ID_CHARS, short).otherwise(whole)


def merged_posted_at(as_of, old: Column, new: Column, was_active: Column) -> Column:
    """A reopened posting, or one dated more than a day ahead, takes the new date if there is one; else the earlier date stays."""
    ahead = old > moment(as_of) + F.make_dt_interval(F.lit(1))
    return F.when(~F.coalesce(was_active, F.lit(False)) | F.coalesce(ahead, F.lit(False)), F.coalesce(new, old)).otherwise(F.least(old, new))


def suspicious_drop(active: Column, gone: Column, listed: Column, minimum: int = MIN_DROP, ratio: float = DROP_SHARE) -> Column:
    """An empty listing while rows are active, or many of them gone at once."""
    return F.coalesce((gone > 0) & (active > 0) & ((listed == 0) | ((gone >= minimum) & (F.try_divide(gone.cast("double"), active) >= ratio))), F.lit(False))


def systemic_failure(attempted: Column, failed: Column) -> Column:
    many = (attempted >= MIN_TRIES) & (F.try_divide(failed.cast("double"), attempted) >= FAILED_SHARE)
    return F.coalesce((attempted > 0) & (failed > 0) & ((failed >= attempted) | many), F.lit(False))


def unlisted(state: DataFrame, listed: DataFrame, by: list[str], key: str = "source_job_id") -> DataFrame:
    """State rows whose key is not listed. A row without key is only unlisted where nothing at all is listed."""
    some = listed.select(*by).distinct().withColumn("_some", F.lit(True))
    keys = listed.select(*by, key).where(F.col(key).isNotNull()).distinct()
    gone = state.where(F.col(key).isNotNull()).join(keys, [*by, key], "left_anti").select(*state.columns)
    keyless = state.where(F.col(key).isNull()).join(some, by, "left_anti").select(*state.columns)
    return gone.unionByName(keyless)


def sync_counts(stored: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """One row: pairs to add, to remove and to keep."""
    both = stored.select(*key).distinct().withColumn("s", F.lit(1)).join(target.select(*key).distinct().withColumn("t", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("s").isNull()).alias("added"), F.count_if(F.col("t").isNull()).alias("removed"), F.count_if(F.col("s").isNotNull() & F.col("t").isNotNull()).alias("kept"))


def synced(stored: DataFrame, target: DataFrame, owners: DataFrame, key: list[str], owner: str) -> DataFrame:
    """Pairs after the owners' target sets replaced what was stored for them."""
    others = stored.join(owners.select(owner).distinct(), owner, "left_anti")
    return others.select(*key).unionByName(target.select(*key)).distinct()


def missing_pairs(stored: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of the target that are not stored, each once; a pair with a null part is none."""
    whole = target.select(*key).dropna()
    return whole.distinct().join(stored.select(*key), key, "left_anti").select(*key)


def linked(stored: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """The stored pairs as they are, and those that they lack; linking the same target again adds nothing."""
    return stored.select(*key).unionByName(missing_pairs(stored, target, key))


def last_of(rows: DataFrame, key: list[str], order: str = "ordinal") -> DataFrame:
    """Of rows with the same key the last; pre-aggregated, so a hot key does not gather in one task."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row")).select(*key, "_row.*")


def numbered_rows(rows: DataFrame, key: list[str], number: str, buckets: int = BUCKETS) -> DataFrame:
    """rows numbered from 1 without gaps, by a hash of the key, then the key: buckets are numbered each by itself, behind the
    count of those before."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    starts = counts.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))  # a row a bucket
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*key))
    return rows.withColumn(number, own).join(F.broadcast(starts), "_bucket").withColumn(number, F.col("_start") + F.col(number)).drop("_bucket", "_start")


def with_new_keys(dimension: DataFrame, seen: DataFrame, id_col: str, key: list[str]) -> DataFrame:
    """The dimension with rows for keys that it lacks; new ids follow the largest."""
    new = seen.select(*key).where(F.col(key[0]).isNotNull()).distinct().join(dimension.select(*key), key, "left_anti")
    last = dimension.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_last"))
    numbered = numbered_rows(new, key, "_n").join(F.broadcast(last))
    return dimension.select(id_col, *key).unionByName(numbered.select((F.col("_last") + F.col("_n")).cast("long").alias(id_col), *key))


def canonical_companies(companies: DataFrame, mixed: Column | None = None) -> DataFrame:
    """id, canonical_id: names that differ in case only share the verified, then mixed-case, then smallest id."""
    mixed = mixed if mixed is not None else (F.col("name") != F.upper("name")) & (F.col("name") != F.lower("name"))
    group = Window.partitionBy(F.lower(F.trim("name"))).orderBy(F.desc("verified"), mixed.desc(), "id")
    return companies.select("id", F.first_value("id").over(group).alias("canonical_id"))


def workday_scoped_id(source_url: Column, raw: Column) -> Column:
    """A tenant-scoped identity, as ids repeat between tenants."""
    tenant = F.split_part(F.regexp_extract(source_url, "^https?://([^/]+)", 1), F.lit("."), F.lit(1))
    scoped = F.concat_ws("/", F.nullif(tenant, F.lit("")), raw)
    return F.when(F.length(scoped) > SOURCE_ID_CHARS, F.concat(F.lit("sha256:"), F.sha2(scoped.cast("binary"), 256))).otherwise(scoped)


@dataclass(frozen=True)
class Reconciled:
    state: DataFrame
    runs: DataFrame


#: Columns that a snapshot overwrites, null or not; those it only fills; and the rest of the state.
OVERWRITTEN = ["title", "description", "workplace_type", "role_type", "source_url", "term_season", "term_year", "company_id", "location_id"]
FILLED = ["company_apply_url", "linkedin_url", "simplify_url"]


def upserted(state: DataFrame, snapshot: DataFrame, as_of, columns: list[str] = OVERWRITTEN, filled: list[str] = FILLED) -> DataFrame:
    """State after the eligible rows of a snapshot: one row a (source_name, source_job_id); of rows that repeat in the
    snapshot the last by ordinal. Rows without a source id match nothing and are added, each of them."""
    key = ["source_name", "source_job_id"]
    named = F.col("source_job_id").isNotNull() & F.col("source_name").isNotNull()
    new = last_of(snapshot.where(named), key).unionByName(snapshot.where(~named))
    now = moment(as_of)
    columns, filled = [c for c in columns if c in state.columns], [c for c in filled if c in state.columns]
    given = [*columns, *filled, "posted_at"]
    renamed = new.select(*key, *[F.col(c).alias(f"_{c}") for c in given], F.lit(True).alias("_seen"))
    both = state.withColumn("_was", F.lit(True)).join(renamed, key, "full")
    seen, was = F.col("_seen").isNotNull(), F.col("_was").isNotNull()
    last = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    # Only rows that are new are numbered; the stored ones keep their ids and are not sorted.
    old = both.where(was).withColumn("_n", F.lit(None).cast("long"))
    # The rest of a row goes into the hash, so that rows without an id are dealt to all buckets.
    out = old.unionByName(numbered_rows(both.where(~was), [*key, *[f"_{c}" for c in given]], "_n")).join(F.broadcast(last))
    special = {
        "id": F.coalesce("id", (F.col("_last") + F.col("_n")).cast("long")),
        "posted_at": F.when(seen & was, merged_posted_at(as_of, F.col("posted_at"), F.col("_posted_at"), F.col("is_active"))).when(seen, F.col("_posted_at")).otherwise(F.col("posted_at")),
        "is_active": F.when(seen, True).otherwise(F.col("is_active")),
        "is_eligible_role": F.when(seen, True).otherwise(F.col("is_eligible_role")),
        "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at")),
        "updated_at": F.when(seen, now).otherwise(F.col("updated_at")),
        "created_at": F.coalesce("created_at", now),
    }
    special |= {c: F.when(seen, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    special |= {c: F.coalesce(f"_{c}", c) for c in filled}
    return out.select(*[special.get(c, F.col(c)).alias(c) for c in state.columns])


def reconcile(state: DataFrame, snapshot: DataFrame, batches: DataFrame, runs: DataFrame, as_of: datetime | str, tombstone: bool = True) -> Reconciled:
    """One round over any number of (source, company) batches.

    snapshot: bronze rows with source_name, company_id, source_job_id, is_listed, is_eligible, failed (record could not
    be stored) and the state's columns. batches: source_name, company_id, run_id, fetch_complete, parse_error_count,
    total_raw_records. runs: earlier runs (source_name, company_id, id, status, jobs_fetched, snapshot_trustworthy,
    started_at, completed_at). Returns the new state and one finished run a batch.
    """
    who = ["source_name", "company_id"]
    now = moment(as_of)
    good = snapshot.where("is_listed AND is_eligible AND NOT failed")
    after = upserted(state, good, as_of)
    flips = snapshot.where("is_listed AND NOT is_eligible").select("source_name", "source_job_id", "company_id", F.col("title").alias("_title")).dropDuplicates(["source_name", "source_job_id", "company_id"])
    after = after.join(flips, ["source_name", "source_job_id", "company_id"], "left")
    flipped = F.col("_title").isNotNull()
    changed = {"title": F.coalesce("_title", "title"), "is_eligible_role": F.when(flipped, False).otherwise(F.col("is_eligible_role")), "is_active": F.when(flipped, True).otherwise(F.col("is_active")), "last_seen_at": F.when(flipped, now).otherwise(F.col("last_seen_at")), "updated_at": F.when(flipped, now).otherwise(F.col("updated_at"))}
    after = staged(after.select(*[changed.get(c, F.col(c)).alias(c) for c in state.columns]))  # read four times below
    counts = snapshot.groupBy(*who).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("source_job_id").alias("ids"),
        F.count_if(F.col("is_listed")).alias("listed"),
        F.count_if(F.col("is_listed") & F.col("is_eligible")).alias("attempted"),
        F.count_if(F.col("is_listed") & F.col("is_eligible") & F.col("failed")).alias("failed"),
    )
    listed = snapshot.where("is_listed").select(*who, "source_job_id")
    open_rows = after.where("is_active AND source_name <> 'sample'")
    stale = unlisted(open_rows.where(F.col("last_seen_at") < now), listed, who).select(*who, "id")
    active = open_rows.groupBy(*who).agg(F.count(F.lit(1)).alias("active"))
    gone = stale.groupBy(*who).agg(F.count(F.lit(1)).alias("gone"))
    recent = runs.where(F.col("status").isin("success", "partial_success") & F.col("snapshot_trustworthy") & (F.col("completed_at") >= now - F.make_dt_interval(F.lit(0), F.lit(CONFIRM_HOURS))))
    nth = F.row_number().over(Window.partitionBy(*who).orderBy(F.desc("started_at"), F.desc("id")))
    prior = recent.withColumn("nth", nth).where(F.col("nth") <= CONFIRMATIONS).groupBy(*who).agg(F.count(F.lit(1)).alias("confirmations"), F.min("jobs_fetched").alias("fewest"), F.max("jobs_fetched").alias("most"))
    b = batches
    for more in (counts, active, gone, prior):
        b = b.join(more, who, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.col("total_raw_records")
    trusted = F.col("fetch_complete") & (F.col("parse_error_count") == 0) & (total == zero("rows")) & (zero("ids") == zero("rows"))
    broken = systemic_failure(zero("attempted"), zero("failed"))
    allowed = F.when(total == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(total * TOLERANCE)))
    confirmed = F.coalesce((F.col("confirmations") >= CONFIRMATIONS) & (F.abs(F.col("fewest") - total) <= allowed) & (F.abs(F.col("most") - total) <= allowed), F.lit(False))
    held = suspicious_drop(zero("active"), zero("gone"), zero("listed")) & ~confirmed
    apply = trusted & ~broken & ~held if tombstone else F.lit(False)
    b = staged(b.select("*", trusted.alias("trusted"), broken.alias("broken"), apply.alias("apply")))
    closing = stale.join(b.where("apply").select(*who), who, "left_semi").select("id", F.lit(True).alias("_closed"))
    final = after.join(closing, "id", "left")
    closed = F.col("_closed").isNotNull()
    ends = {"is_active": F.when(closed, False).otherwise(F.col("is_active")), "updated_at": F.when(closed, now).otherwise(F.col("updated_at"))}
    clean = (F.col("apply") if tombstone else F.col("fetch_complete")) & ~F.col("broken")
    some = (zero("rows") > 0) | F.col("trusted")
    if not tombstone:  # an aggregator's listing is never complete evidence; an incomplete fetch fails
        some = F.col("fetch_complete")
    status = F.when(F.col("broken"), "failed").when(clean & (zero("failed") == 0), "success").when(clean | some, "partial_success").otherwise("failed")
    finished = b.select(
        F.col("run_id").alias("id"),
        *who,
        status.alias("status"),
        total.cast("int").alias("jobs_fetched"),
        (zero("attempted") - zero("failed")).cast("int").alias("jobs_upserted"),
        F.when(F.col("apply"), zero("gone")).otherwise(0).cast("int").alias("jobs_deactivated"),
        F.col("trusted").alias("snapshot_trustworthy"),
        now.alias("started_at"),
        now.alias("completed_at"),
    )
    return Reconciled(final.select(*[ends.get(c, F.col(c)).alias(c) for c in state.columns]), finished)

"""Registered queries of the board itself: the functions that a user calls (`jobs`, `state`, the adapters), over postings
drawn from the star tables. The postings are one list of expressions that both engines read, so each query's SQL states
the rule and not the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pay_resolve, pay_text, places, segments
from ..functions.text import settled
from ..operators import audits, clusters, curation, dedup, state
from ..operators.staging import once_each
from ..sources import adapters
from . import jobs
from .silver import silver
from .star import AS_OF, ORACLES, QUERIES, Tables, query

__all__ = ["ORACLES", "QUERIES"]

# Expressions of a posting over orders and customer, plain enough for any SQL engine.
POSTING = {
    "id": "o_orderkey",
    "company_id": "c_custkey",
    "company": "c_name",
    "title": "concat(CASE o_orderkey % 3 WHEN 0 THEN 'Software Engineer ' WHEN 1 THEN 'backend developer ' ELSE 'Data Engineer ' END, CAST(o_orderkey % 17 AS STRING))",
    "location": "CASE c_custkey % 6 WHEN 0 THEN 'Toronto, ON, Canada' WHEN 1 THEN 'New York, NY' WHEN 2 THEN 'Remote' WHEN 3 THEN 'Berlin, Germany' WHEN 4 THEN 'Remote - Europe' ELSE 'Vancouver, BC' END",
    "country": "CASE c_custkey % 6 WHEN 1 THEN 'United States' WHEN 3 THEN 'Germany' WHEN 4 THEN 'United States' ELSE 'Canada' END",
    "second": "CASE WHEN o_orderkey % 4 = 0 THEN 'Seattle, WA' WHEN o_orderkey % 4 = 1 THEN 'Brampton, ON' END",
    "second_country": "CASE WHEN o_orderkey % 4 = 0 THEN 'United States' WHEN o_orderkey % 4 = 1 THEN 'Canada' END",
    "workplace_type": "CASE o_orderkey % 5 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' WHEN 3 THEN 'on_site' ELSE 'unspecified' END",
    "role_type": "CASE o_custkey % 4 WHEN 0 THEN 'internship' WHEN 1 THEN 'full_time' WHEN 2 THEN 'co_op' ELSE 'new_grad' END",
    "experience_level": "CASE o_custkey % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'senior' ELSE 'mid' END",
    "annual": "o_totalprice",
    "currency": "CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'CAD' END",
    "source_name": "CASE o_orderkey % 9 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'arbeitnow' ELSE 'ashby' END",
    "source_job_id": "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE CAST(o_orderkey - o_orderkey % 18 AS STRING) END",
    "source_url": "CASE WHEN o_orderkey % 10 < 8 THEN concat('https://jobs.example/', CAST(o_orderkey - o_orderkey % 2 AS STRING), CASE WHEN o_orderkey % 2 = 1 THEN '#apply' ELSE '' END) END",
    "posted_at": f"CASE WHEN o_orderkey % 11 <> 0 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR * ((o_orderkey * 7) % 1500 - 60) END",
    "created_at": f"TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR * ((o_orderkey * 7) % 1500)",
    "last_seen_at": f"TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR * (o_orderkey % 90)",
    "is_active": "o_orderstatus <> 'F'",
    "is_eligible_role": "o_orderkey % 13 <> 0",
}
_LISTED = ", ".join(f"{e} AS {c}" for c, e in POSTING.items())

#: The same rules in SQL: who is official and rightly placed, who is visible, and who has no later twin in the population.
_RULES = f"""
WITH posting AS (SELECT {_LISTED} FROM orders JOIN customer ON o_custkey = c_custkey),
 population AS (SELECT *, nullif(split_part(source_url, '#', 1), '') AS url, nullif(source_job_id, '') AS sid FROM posting WHERE is_active AND is_eligible_role
   AND source_name <> 'arbeitnow' AND location IN ('Toronto, ON, Canada', 'New York, NY', 'Remote', 'Vancouver, BC')),
 last_sid AS (SELECT source_name, sid, max(id) AS last FROM population WHERE sid IS NOT NULL GROUP BY ALL),
 last_url AS (SELECT url, max(id) AS last FROM population WHERE url IS NOT NULL GROUP BY ALL),
 single AS (SELECT p.* FROM population p LEFT JOIN last_sid s ON s.source_name = p.source_name AND s.sid = p.sid LEFT JOIN last_url u ON u.url = p.url
   WHERE coalesce(s.last, p.id) <= p.id AND coalesce(u.last, p.id) <= p.id),
 target AS (SELECT * FROM single WHERE CASE WHEN posted_at < TIMESTAMP '{AS_OF}' + INTERVAL 2 DAY THEN posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
   ELSE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR END)"""


def postings(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(*[f"{e} AS {c}" for c, e in POSTING.items()])
    place = lambda name, country: F.struct(F.col(name).alias("location"), F.col(country).alias("country"))
    second = F.when(F.col("second").isNotNull(), place("second", "second_country"))
    annual = F.array(F.struct("currency", F.col("annual").alias("min_annual"), F.col("annual").alias("max_annual"), F.lit("year").alias("period")))
    return rows.select(
        "*",
        F.array_compact(F.array(place("location", "country"), second)).alias("locations"),
        annual.alias("pay_ranges"),
        F.concat(F.lit("About "), "title").alias("description"),
        F.lit(None).cast("string").alias("term_season"),
        F.array(F.concat(F.lit("skill "), (F.col("id") % 7).cast("string")), F.concat(F.lit("Skill "), (F.col("id") % 5).cast("string"))).alias("skills"),
    )


def day(column: str, name: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm").alias(name)


@query(f"{_RULES} SELECT id, company, source_name FROM target")
def board_targets(t: Tables) -> DataFrame:
    return jobs.target_postings(postings(t), AS_OF).select("id", "company", "source_name")


_STATUS = f"""CASE WHEN posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND posted_at <= TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR THEN 'recently_posted'
  WHEN posted_at IS NULL AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'recently_discovered' ELSE 'active' END AS freshness_status,
 CASE WHEN posted_at IS NULL THEN NULL WHEN source_name = 'workday' OR posted_at = date_trunc('day', posted_at) THEN 'date' ELSE 'time' END AS posted_precision"""


@query(f"""{_RULES} SELECT id, title, strftime(posted_at, '%Y-%m-%d %H:%M') AS posted, {_STATUS} FROM target WHERE workplace_type IN ('on_site', 'onsite', 'remote') AND (country = 'Canada' OR second_country = 'Canada')
 ORDER BY posted_at DESC NULLS LAST, created_at DESC, id DESC LIMIT 40 OFFSET 5""")
def board_page_newest(t: Tables) -> DataFrame:
    wanted = jobs.JobQuery(countries=["ca"], workplaces=["on-site", "Remote"], sort="newest", limit=40, offset=5)
    return jobs.page(postings(t), wanted, AS_OF).select("id", "title", day("posted_at", "posted"), "freshness_status", "posted_precision")


@query(f"""{_RULES}, ranked AS (SELECT *, coalesce(country = 'Canada' OR second_country = 'Canada', false) AS canada, posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS d7,
  posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS d30, posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AS d60, role_type <> 'full_time' AS early FROM single),
 placed AS (SELECT *, CASE WHEN canada AND d7 THEN 1 WHEN canada AND d30 THEN 2 WHEN canada AND early AND d60 THEN 3 WHEN canada THEN 4 WHEN workplace_type = 'remote' OR location = 'Remote' THEN 5 WHEN early THEN 6 ELSE 7 END AS bucket FROM ranked)
SELECT id, company FROM placed ORDER BY bucket, posted_at DESC NULLS LAST, created_at DESC, id DESC LIMIT 100 OFFSET 60""")
def board_page_recommended(t: Tables) -> DataFrame:
    return jobs.page(postings(t), jobs.JobQuery(freshness="all", limit=100, offset=60), AS_OF).select("id", "company")


@query(f"{_RULES} SELECT id, lower(title) AS title FROM target WHERE role_type IN ('internship', 'co_op') AND experience_level = 'senior' ORDER BY lower(title), posted_at DESC NULLS LAST, id DESC LIMIT 25")
def board_page_title(t: Tables) -> DataFrame:
    wanted = jobs.JobQuery(roles=["intern", "coop"], experience=["lead"], sort="title")
    return jobs.page(postings(t), wanted, AS_OF).select("id", F.lower("title").alias("title"))


@query(f"{_RULES} SELECT count(*) AS total FROM target WHERE location LIKE 'Toronto%' OR second LIKE 'Brampton%'")
def board_total_metro(t: Tables) -> DataFrame:
    return jobs.total(postings(t), jobs.JobQuery(locations=["Toronto (GTA)"]), AS_OF)


@query(f"{_RULES} SELECT count(*) AS total FROM target WHERE annual >= 100000 AND currency = 'CAD' AND (country = 'Canada' OR second_country = 'Canada')")
def board_total_pay(t: Tables) -> DataFrame:
    return jobs.total(postings(t), jobs.JobQuery(countries=["Canada"], min_pay=100000.0), AS_OF)


@query(f"""{_RULES}, pair AS (SELECT id, country FROM target UNION SELECT id, second_country FROM target WHERE second_country IS NOT NULL),
 n AS (SELECT country, count(*) AS postings FROM pair WHERE country IN ('United States', 'Canada') GROUP BY 1)
SELECT country, postings, round(100.0 * postings / sum(postings) OVER (), 1) AS share_pct FROM n""")
def board_country_shares(t: Tables) -> DataFrame:
    return jobs.country_shares(jobs.target_postings(postings(t), AS_OF))


@query(f"""{_RULES}, said AS (SELECT id, concat('skill ', CAST(id % 7 AS STRING)) AS skill FROM target UNION ALL SELECT id, concat('Skill ', CAST(id % 5 AS STRING)) FROM target),
 n AS (SELECT skill, count(*) AS mentions FROM said GROUP BY 1), w AS (SELECT count(*) AS total FROM target)
SELECT skill, mentions, round(100.0 * mentions / total, 1) AS frequency_pct FROM n, w""")
def board_skill_shares(t: Tables) -> DataFrame:
    return jobs.skill_shares(jobs.target_postings(postings(t), AS_OF)).select("skill", "mentions", "frequency_pct")


@query(f"""{_RULES} SELECT count(*) AS total_postings, count(DISTINCT company_id) AS total_companies, count(DISTINCT location) AS total_locations,
 count(*) FILTER (posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND posted_at <= TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR) AS recently_posted_postings,
 (SELECT count(*) FROM (SELECT DISTINCT 's' || id % 7 FROM target UNION SELECT DISTINCT 'S' || id % 5 FROM target)) AS total_skills FROM target""")
def board_overview(t: Tables) -> DataFrame:
    return jobs.overview(postings(t), AS_OF)


@query(f"""{_RULES}, named AS (SELECT 'Toronto (GTA)' AS location, location LIKE 'Toronto%' OR second LIKE 'Brampton%' AS hit FROM target UNION ALL SELECT 'Vancouver', location LIKE 'Vancouver%' FROM target
 UNION ALL SELECT 'New York, NY', location LIKE 'New York%' FROM target UNION ALL SELECT 'Seattle, WA', second LIKE 'Seattle%' FROM target)
SELECT location FROM named GROUP BY 1 HAVING bool_or(hit)""")
def board_location_options(t: Tables) -> DataFrame:
    return jobs.location_options(jobs.target_postings(postings(t), AS_OF))


def _breakdown_sql(column: str) -> str:
    return f"{_RULES} SELECT {column} AS category, count(*) AS postings, round(100.0 * count(*) / (SELECT count(*) FROM target), 1) AS share_pct FROM target GROUP BY 1"


@query(_breakdown_sql("role_type"))
def board_role_stats(t: Tables) -> DataFrame:
    return jobs.breakdown(jobs.facet_counts(jobs.target_postings(postings(t), AS_OF)), "role")


@query(_breakdown_sql("workplace_type"))
def board_workplace_stats(t: Tables) -> DataFrame:
    return jobs.breakdown(jobs.facet_counts(jobs.target_postings(postings(t), AS_OF)), "workplace")


@query(f"{_breakdown_sql('company')} ORDER BY postings DESC, lower(company), company LIMIT 10")
def board_company_stats(t: Tables) -> DataFrame:
    return jobs.top_companies(jobs.facet_counts(jobs.target_postings(postings(t), AS_OF)))


@query(f"{_RULES} SELECT c.c_custkey AS id, c.c_name AS name, count(*) AS active_jobs_count FROM customer c JOIN target ON company_id = c.c_custkey GROUP BY 1, 2")
def board_companies(t: Tables) -> DataFrame:
    named = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return jobs.company_directory(named, jobs.target_postings(postings(t), AS_OF))


@query(f"""{_RULES}, named AS (SELECT 'Toronto (GTA)' AS location, location LIKE 'Toronto%' OR second LIKE 'Brampton%' AS hit FROM target UNION ALL SELECT 'Vancouver', location LIKE 'Vancouver%' FROM target
 UNION ALL SELECT 'New York, NY', location LIKE 'New York%' FROM target UNION ALL SELECT 'Seattle, WA', second LIKE 'Seattle%' FROM target)
SELECT 'role' AS kind, role_type AS value FROM target UNION SELECT 'workplace', workplace_type FROM target UNION SELECT 'company', company FROM target UNION SELECT 'skill', concat('skill ', CAST(id % 7 AS STRING)) FROM target
 UNION SELECT 'skill', concat('Skill ', CAST(id % 5 AS STRING)) FROM target UNION SELECT 'country', country FROM target WHERE country IN ('United States', 'Canada') UNION SELECT 'country', second_country FROM target WHERE second_country IS NOT NULL
 UNION SELECT 'location', location FROM named WHERE hit""")
def board_filter_options(t: Tables) -> DataFrame:
    return jobs.filter_options(jobs.target_postings(postings(t), AS_OF))


# State: what was stored (two of three orders) meets a snapshot (every second one). Companies are customers.

_STORED = f"""SELECT o_orderkey AS id, 'lever' AS source_name, CAST(o_orderkey AS STRING) AS source_job_id, o_custkey % 50 AS company_id, 'old' AS title,
 CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS posted_at, o_orderstatus <> 'F' AS is_active, true AS is_eligible_role, CASE WHEN o_orderkey % 4 <> 0 THEN 'old' END AS company_apply_url,
 TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY AS last_seen_at, TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY AS updated_at, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 <> 0"""
_SNAPSHOT = """SELECT 'lever' AS source_name, CAST(o_orderkey AS STRING) AS source_job_id, o_custkey % 50 AS company_id, concat('new ', o_orderpriority) AS title,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate - INTERVAL 5 DAY END AS posted_at, CASE WHEN o_orderkey % 5 <> 0 THEN 'new' END AS company_apply_url, o_orderkey % 19 <> 0 AS is_listed,
 o_orderkey % 17 <> 0 AS is_eligible, (o_orderkey % 23 = 0 AND o_custkey % 3 = 0) OR (o_custkey % 50 = 7 AND o_orderkey % 40 <> 0) AS failed, o_orderkey AS ordinal FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 50 < 40 AND (o_custkey % 50 <> 9 OR o_orderkey % 20 = 0)"""
#: Companies 3 and 4 were fetched in part, 5 has a parse error, 6 counts other rows than it shows.
_BATCHES = f"""SELECT 'lever' AS source_name, company_id, 1000 + company_id AS run_id, company_id NOT IN (3, 4) AS fetch_complete, CASE WHEN company_id = 5 THEN 1 ELSE 0 END AS parse_error_count,
 CASE WHEN company_id = 6 THEN n + 1 ELSE n END AS total_raw_records FROM (SELECT company_id, count(*) AS n FROM ({_SNAPSHOT}) s GROUP BY company_id) c"""
_RUNS = f"""SELECT 'lever' AS source_name, company_id, 10 + k AS id, 'success' AS status, n AS jobs_fetched, true AS snapshot_trustworthy, TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR * k AS started_at,
 TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR * k AS completed_at FROM (SELECT company_id, count(*) AS n FROM ({_SNAPSHOT}) s WHERE company_id % 2 = 0 GROUP BY company_id) c CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) two"""

_AFTER = f"""
WITH st AS ({_STORED}), sn AS ({_SNAPSHOT}), good AS (SELECT * FROM sn WHERE is_listed AND is_eligible AND NOT failed),
 up AS (SELECT coalesce(o.source_job_id, n.source_job_id) AS source_job_id, CASE WHEN n.ordinal IS NULL THEN o.company_id ELSE n.company_id END AS company_id, o.id IS NULL AS created, CASE WHEN n.ordinal IS NULL THEN o.title ELSE n.title END AS title,
   CASE WHEN n.ordinal IS NULL THEN o.posted_at WHEN o.id IS NULL THEN n.posted_at WHEN NOT o.is_active THEN coalesce(n.posted_at, o.posted_at) ELSE least(o.posted_at, n.posted_at) END AS posted_at,
   CASE WHEN n.ordinal IS NULL THEN o.is_active ELSE true END AS is_active, true AS is_eligible_role, coalesce(n.company_apply_url, o.company_apply_url) AS company_apply_url, n.ordinal IS NOT NULL AS seen
   FROM st o FULL JOIN good n ON o.source_job_id = n.source_job_id)"""


@query(f"{_AFTER} SELECT source_job_id, company_id, created, title, strftime(posted_at, '%Y-%m-%d %H:%M') AS posted, is_active, company_apply_url FROM up")
def state_upserted(t: Tables) -> DataFrame:
    spark = views(t)
    after = state.upserted(spark.sql(_STORED), spark.sql(_SNAPSHOT).where("is_listed AND is_eligible AND NOT failed"), AS_OF)
    created = F.col("created_at") == F.lit(AS_OF).cast("timestamp")
    return after.select("source_job_id", "company_id", created.alias("created"), "title", day("posted_at", "posted"), "is_active", "company_apply_url")


def views(t: Tables):
    """A session of its own in which the orders are a view, so no name of the caller's is taken."""
    own = Tables(t.spark.newSession(), t.dir)
    own.spark.conf.set("spark.sql.session.timeZone", t.spark.conf.get("spark.sql.session.timeZone"))
    own.orders.createOrReplaceTempView("orders")
    return own.spark


_RECONCILED = f"""{_AFTER},
 flip AS (SELECT source_job_id, company_id, title FROM sn WHERE is_listed AND NOT is_eligible),
 af AS (SELECT u.source_job_id, u.company_id, coalesce(f.title, u.title) AS title, u.is_active OR f.title IS NOT NULL AS is_active, f.title IS NULL AS is_eligible_role, u.seen OR f.title IS NOT NULL AS seen
   FROM up u LEFT JOIN flip f ON f.source_job_id = u.source_job_id AND f.company_id = u.company_id),
 c AS (SELECT company_id, count(*) AS n, count(*) FILTER (is_listed) AS listed, count(*) FILTER (is_listed AND is_eligible) AS tried, count(*) FILTER (is_listed AND is_eligible AND failed) AS bad FROM sn GROUP BY 1),
 stale AS (SELECT a.source_job_id, a.company_id FROM af a WHERE a.is_active AND NOT a.seen AND NOT EXISTS (SELECT 1 FROM sn WHERE sn.is_listed AND sn.company_id = a.company_id AND sn.source_job_id = a.source_job_id)),
 act AS (SELECT company_id, count(*) AS active FROM af WHERE is_active GROUP BY 1), gone AS (SELECT company_id, count(*) AS gone FROM stale GROUP BY 1),
 b AS (SELECT bt.company_id, bt.run_id, bt.total_raw_records, bt.fetch_complete, n, listed, tried, bad, coalesce(active, 0) AS active, coalesce(gone, 0) AS gone,
   fetch_complete AND parse_error_count = 0 AND total_raw_records = n AS trusted, tried > 0 AND bad > 0 AND (bad >= tried OR (tried >= 5 AND bad >= 0.8 * tried)) AS broken, bt.company_id % 2 = 0 AS confirmed
   FROM ({_BATCHES}) bt JOIN c USING (company_id) LEFT JOIN act USING (company_id) LEFT JOIN gone USING (company_id)),
 d AS (SELECT *, trusted AND NOT broken AND NOT (gone > 0 AND active > 0 AND (listed = 0 OR (gone >= 3 AND gone >= 0.5 * active)) AND NOT (confirmed AND total_raw_records > 0)) AS apply FROM b)"""


def _round(t: Tables) -> state.Reconciled:
    spark = views(t)
    return state.reconcile(spark.sql(_STORED), spark.sql(_SNAPSHOT), spark.sql(_BATCHES), spark.sql(_RUNS), AS_OF)


@query(f"""{_RECONCILED} SELECT a.source_job_id, a.company_id, a.title, a.is_active AND NOT (s.source_job_id IS NOT NULL AND coalesce(d.apply, false)) AS is_active, a.is_eligible_role
 FROM af a LEFT JOIN stale s USING (source_job_id) LEFT JOIN d ON d.company_id = a.company_id""")
def reconciled_state(t: Tables) -> DataFrame:
    return _round(t).state.select("source_job_id", "company_id", "title", "is_active", "is_eligible_role")


@query(f"""{_RECONCILED} SELECT run_id AS id, company_id, CASE WHEN broken THEN 'failed' WHEN apply AND bad = 0 THEN 'success' WHEN apply OR n > 0 OR trusted THEN 'partial_success' ELSE 'failed' END AS status,
 total_raw_records AS jobs_fetched, tried - bad AS jobs_upserted, CASE WHEN apply THEN gone ELSE 0 END AS jobs_deactivated, trusted AS snapshot_trustworthy FROM d""")
def reconciled_runs(t: Tables) -> DataFrame:
    return _round(t).runs.select("id", "company_id", "status", "jobs_fetched", "jobs_upserted", "jobs_deactivated", "snapshot_trustworthy")


# Adapters: orders as pages of a vendor's JSON, one record in 31 without its id; pages repeat an order now and then.


def lever_pages(t: Tables) -> DataFrame:
    record = F.to_json(
        F.struct(
            F.when(F.col("o_orderkey") % 31 != 0, F.col("o_orderkey").cast("string")).alias("id"),
            F.concat(F.lit("  Engineer "), "o_orderpriority").alias("text"),
            F.struct(F.lit("Toronto, ON").alias("location"), F.col("o_orderstatus").alias("commitment")).alias("categories"),
            F.concat(F.lit("https://jobs.lever.co/acme/"), F.col("o_orderkey").cast("string")).alias("hostedUrl"),
            F.unix_millis("o_orderdate").alias("createdAt"),
        )
    )
    dealt = t.orders.select((F.col("o_orderkey") % 40).alias("page_no"), record.alias("r"), "o_orderkey")
    again = t.orders.where("o_orderkey % 50 = 0").select(F.lit(40).cast("long").alias("page_no"), record.alias("r"), "o_orderkey")
    pages = dealt.unionByName(again).groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "r"))).alias("x"))
    return pages.select("page_no", F.concat(F.lit("["), F.array_join(F.transform("x", lambda y: y["r"]), ","), F.lit("]")).alias("value"))


@query("""SELECT CAST(o_orderkey AS STRING) AS source_job_id, concat('Engineer ', o_orderpriority) AS title, 'Toronto, ON' AS raw_location, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS posted, o_orderstatus AS raw_job_type,
 concat('https://jobs.lever.co/acme/', CAST(o_orderkey AS STRING)) AS source_url FROM orders WHERE o_orderkey % 31 <> 0""")
def lever_batch_rows(t: Tables) -> DataFrame:
    rows = adapters.read_batch(lever_pages(t), adapters.ADAPTERS["lever"], "acme").rows
    return rows.select("source_job_id", "title", "raw_location", day("posted_at", "posted"), "raw_job_type", "source_url")


@query("""SELECT count(*) AS total_raw_records, count(*) FILTER (o_orderkey % 31 = 0) AS parse_error_count, count(*) FILTER (again AND o_orderkey % 31 <> 0) AS repeats, true AS fetch_complete
 FROM (SELECT o_orderkey, false AS again FROM orders UNION ALL SELECT o_orderkey, true FROM orders WHERE o_orderkey % 50 = 0) r""")
def lever_batch_metrics(t: Tables) -> DataFrame:
    return adapters.read_batch(lever_pages(t), adapters.ADAPTERS["lever"], "acme").metrics


@query("""SELECT count(*) + count(*) FILTER (o_orderkey % 40 = 7) AS total_raw_records, count(*) FILTER (o_orderkey % 31 = 0) + count(*) FILTER (o_orderkey % 31 = 0 AND o_orderkey % 40 = 7) AS parse_error_count,
 count(*) FILTER (o_orderkey % 31 <> 0 AND o_orderkey % 40 = 7) AS repeats, false AS fetch_complete FROM orders""")
def lever_repeated_page(t: Tables) -> DataFrame:
    pages = lever_pages(t).where("page_no < 40")
    again = pages.where("page_no = 7").withColumn("page_no", F.lit(99).cast("long"))
    return adapters.read_batch(pages.unionByName(again), adapters.ADAPTERS["lever"], "acme").metrics


_RAW_ID = "CASE o_orderkey % 5 WHEN 0 THEN concat('  ', CAST(o_orderkey AS STRING), ' ') WHEN 1 THEN repeat(CAST(o_orderkey AS STRING), 20) WHEN 2 THEN repeat(CAST(o_orderkey AS STRING), 60) WHEN 3 THEN '   ' ELSE concat(CAST(o_orderkey AS STRING), repeat('x', 90)) END"
_RAW_TITLE = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN repeat(concat(o_orderpriority, ' '), 40) ELSE concat('  ', o_orderpriority, ' ') END"


@query(f"""WITH r AS (SELECT o_orderkey AS id, nullif(trim({_RAW_ID}), '') AS raw, trim(coalesce({_RAW_TITLE}, '')) AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'lever' ELSE 'a source of a long name' END AS source FROM orders),
 i AS (SELECT *, CASE WHEN len(raw) > 150 THEN 'sha256:' || sha256(raw) ELSE raw END AS sid FROM r)
SELECT id, sid AS source_job_id, CASE WHEN sid IS NULL THEN source WHEN len(source || ':' || sid) > 100 THEN substr(source, 1, 20) || ':' || substr(sha256(sid), 1, 60) ELSE source || ':' || sid END AS job_id,
 CASE WHEN len(title) > 255 THEN rtrim(substr(title, 1, 254)) || '…' ELSE title END AS title FROM i""")
def posting_ids(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey AS id", f"{_RAW_ID} AS raw", f"{_RAW_TITLE} AS title", "CASE WHEN o_orderkey % 2 = 0 THEN 'lever' ELSE 'a source of a long name' END AS source")
    sid = state.source_job_id(F.col("raw"))
    return rows.select("id", sid.alias("source_job_id"), state.job_id(F.col("source"), sid).alias("job_id"), state.fit_text(F.col("title")).alias("title"))


@query(f"""WITH st AS ({_STORED}), sn AS ({_SNAPSHOT}), n AS (SELECT CASE WHEN ordinal % 10 <> 0 THEN source_job_id END AS source_job_id, title FROM sn)
SELECT source_job_id, title, count(*) AS n FROM (SELECT coalesce(n.source_job_id, st.source_job_id) AS source_job_id, coalesce(n.title, st.title) AS title FROM st FULL JOIN n ON n.source_job_id = st.source_job_id) x GROUP BY 1, 2""")
def state_with_keyless_rows(t: Tables) -> DataFrame:
    spark = views(t)
    snapshot = spark.sql(_SNAPSHOT).withColumn("source_job_id", F.when(F.col("ordinal") % 10 != 0, F.col("source_job_id")))
    after = state.upserted(spark.sql(_STORED), snapshot, AS_OF)
    return after.groupBy("source_job_id", "title").agg((F.count(F.lit(1)) + F.count("id") - F.countDistinct("id")).alias("n"))


# Links: what is stored of an order's customers, and what a load says, with repeats and nulls.
_LINKS = "SELECT o_orderkey % 5000 AS job_id, concat('s', CAST(o_custkey % 30 AS STRING)) AS skill FROM orders WHERE o_orderkey % 3 = 0"
_SAID = "SELECT CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 5000 END AS job_id, CASE WHEN o_custkey % 13 <> 0 THEN concat('s', CAST(o_custkey % 30 AS STRING)) END AS skill FROM orders"


@query(f"SELECT job_id, skill, NOT stored AS is_new, count(*) AS n FROM (SELECT *, true AS stored FROM ({_LINKS}) s UNION ALL SELECT *, false FROM (SELECT * FROM ({_SAID}) t WHERE job_id IS NOT NULL AND skill IS NOT NULL EXCEPT SELECT * FROM ({_LINKS}) s) m) x GROUP BY ALL")
def missing_links(t: Tables) -> DataFrame:
    spark = views(t)
    stored, said, key = spark.sql(_LINKS), spark.sql(_SAID), ["job_id", "skill"]
    after = state.linked(state.linked(stored, said, key), said, key)  # again adds nothing
    known = stored.groupBy(*key).agg(F.lit(False).alias("is_new"))
    return after.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(known, key, "left").select(*key, F.coalesce("is_new", F.lit(True)).alias("is_new"), "n")


# Upkeep: candidates, links, spellings and the counts of a load, each on tables cut from the orders and customers.


@query(f"""WITH c AS (SELECT CAST(o_orderkey % 9000 AS STRING) AS k, o_orderkey AS ordinal, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS title FROM orders WHERE o_orderkey % 2 = 0),
 n AS (SELECT k, arg_max(struct_pack(t := title), ordinal).t AS title, max(ordinal) AS o FROM c GROUP BY 1), s AS (SELECT CAST(o_orderkey AS STRING) AS k, o_orderdate AS first_seen FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey < 9000)
SELECT coalesce(n.k, s.k) AS candidate_key, CASE WHEN s.k IS NULL THEN CAST(n.o AS STRING) ELSE 'old' END AS source_id, CASE WHEN n.k IS NULL THEN 'old' ELSE n.title END AS title,
 strftime(coalesce(s.first_seen, TIMESTAMP '{AS_OF}'), '%Y-%m-%d %H:%M') AS first_seen, strftime(CASE WHEN n.k IS NULL THEN s.first_seen ELSE TIMESTAMP '{AS_OF}' END, '%Y-%m-%d %H:%M') AS last_seen FROM s FULL JOIN n ON s.k = n.k""")
def candidates_upserted(t: Tables) -> DataFrame:
    old = F.lit("old")
    stored = t.orders.where("o_orderkey % 5 = 0 AND o_orderkey < 9000").select(F.col("o_orderkey").cast("string").alias("candidate_key"), old.alias("source_repo"), old.alias("source_id"), old.alias("company_name"), old.alias("title"), F.col("o_orderdate").alias("first_seen_at"), F.col("o_orderdate").alias("last_seen_at"))
    key = F.col("o_orderkey")
    seen = t.orders.where("o_orderkey % 2 = 0").select((key % 9000).cast("string").alias("candidate_key"), F.lit("new").alias("source_repo"), key.cast("string").alias("source_id"), F.lit("new").alias("company_name"), F.when(key % 3 != 0, F.col("o_orderpriority")).alias("title"), key.alias("ordinal"))
    out = curation.upserted_candidates(stored, seen, AS_OF)
    return out.select("candidate_key", "source_id", "title", day("first_seen_at", "first_seen"), day("last_seen_at", "last_seen"))


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus <> 'F' AS active, CASE WHEN o_orderkey % 4 = 0 THEN concat('https://simplify.jobs/p/', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 4 = 1 THEN 'https://simplify.jobs/p/other' END AS url FROM orders),
 c AS (SELECT o_orderkey, concat('https://simplify.jobs/p/', CAST(o_orderkey AS STRING)) AS url FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0)
SELECT p.o_orderkey AS id, CASE WHEN active AND c.url IS NOT NULL THEN c.url ELSE p.url END AS simplify_url, active AND c.url IS NOT NULL AND (p.url IS NULL OR p.url <> c.url) AS attached FROM p LEFT JOIN c USING (o_orderkey)""")
def urls_attached(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    own = F.concat(F.lit("https://simplify.jobs/p/"), key.cast("string"))
    rows = t.orders.select(key.alias("id"), F.lit("lever").alias("source_name"), key.cast("string").alias("source_job_id"), (F.col("o_orderstatus") != "F").alias("is_active"), F.when(key % 4 == 0, own).when(key % 4 == 1, "https://simplify.jobs/p/other").alias("simplify_url"))
    found = t.orders.select(F.lit("lever").alias("matched_source_name"), key.cast("string").alias("matched_source_job_id"), (key % 3 != 0).alias("official_url_verified"), F.when(key % 5 != 0, own).otherwise(F.lit("https://example.com/p/1")).alias("simplify_url"), key.alias("ordinal"))
    return curation.with_attached_urls(rows, found).select("id", "simplify_url", "attached")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE concat(' ', c_name) END AS name, c_custkey % 3 = 0 AS renamed FROM customer""")
def configured_names(t: Tables) -> DataFrame:
    name, key = F.col("c_name"), F.col("c_custkey")
    stored = t.customer.select(key.alias("id"), F.when(key % 2 == 0, F.upper(name)).otherwise(F.concat(F.lit(" "), name)).alias("name"))
    return curation.with_configured_names(stored, t.customer.where("c_custkey % 3 = 0").select(name.alias("name")))


@query("""WITH r AS (SELECT o_orderkey % 9000 AS j, c_name, c_nationkey, [concat('s', CAST(o_orderkey % 40 AS STRING)), concat('s', CAST(o_custkey % 40 AS STRING))] AS sk FROM orders JOIN customer ON o_custkey = c_custkey),
 k AS (SELECT j, unnest(list_distinct(sk)) AS s FROM r), c AS (
 SELECT 'postings' AS kind, (SELECT count(*) FROM r) AS total, (SELECT count(DISTINCT j) FROM r WHERE j % 4 <> 0) AS created UNION ALL
 SELECT 'companies', count(DISTINCT c_name), count(DISTINCT c_name) FILTER (c_nationkey % 3 <> 0) FROM r UNION ALL SELECT 'locations', count(DISTINCT c_nationkey), count(DISTINCT c_nationkey) FILTER (c_nationkey >= 5) FROM r UNION ALL
 SELECT 'skills', count(DISTINCT s), count(DISTINCT s) FILTER (s NOT IN ('s1', 's2', 's39')) FROM k UNION ALL SELECT 'relationships', count(*), (SELECT count(*) FROM (SELECT DISTINCT j, s FROM k WHERE NOT (j % 4 = 0 AND s = 's1'))) FROM k)
SELECT kind, total, created, total - created AS existing FROM c""")
def load_statistics(t: Tables) -> DataFrame:
    job, skill = (F.col("o_orderkey") % 9000).alias("job_id"), lambda c: F.concat(F.lit("s"), (F.col(c) % 40).cast("string"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(job, F.col("c_name").alias("company"), F.col("c_nationkey").alias("location"), F.lit("x").alias("country"), F.array(skill("o_orderkey"), skill("o_custkey")).alias("skills"))
    stored = t.orders.select(job).where("job_id % 4 = 0")
    known = t.spark.createDataFrame([("s1",), ("s2",), ("s39",)], "name string")
    nations = t.nation.where("n_nationkey < 5").select(F.col("n_nationkey").alias("location"), F.lit("x").alias("country"))
    return curation.load_counts(rows, stored, t.customer.where("c_nationkey % 3 = 0").select(F.col("c_name").alias("name")), nations, known, stored.distinct().withColumn("skill", F.lit("s1")))


_LABELS = "CASE o_orderkey % 8 WHEN 0 THEN 'Toronto' WHEN 1 THEN 'toronto, ON' WHEN 2 THEN 'San Francisco, California, USA' WHEN 3 THEN 'Richmond, BC' WHEN 4 THEN 'Toronto HQ' WHEN 5 THEN 'NEW YORK, NY' WHEN 6 THEN 'Montréal, Canada' ELSE 'Boston, ON' END"


@query(f"""WITH x AS (SELECT o_orderkey AS id, {_LABELS} AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'Canada' ELSE 'Unknown' END AS country FROM orders)
SELECT id, CASE WHEN label ILIKE 'toronto' OR label = 'toronto, ON' THEN 'Toronto, Ontario, Canada' WHEN label LIKE 'Montr%' THEN 'Montréal, Quebec, Canada' WHEN country = 'Canada' AND label LIKE 'Richmond%' THEN 'Richmond, British Columbia, Canada'
 WHEN country <> 'Canada' AND label LIKE 'San%' THEN 'San Francisco, CA, United States' WHEN country <> 'Canada' AND label LIKE 'NEW%' THEN 'New York, NY, United States' END AS place FROM x""")
def place_labels(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey AS id", f"{_LABELS} AS label", "CASE WHEN o_orderkey % 3 = 0 THEN 'Canada' ELSE 'Unknown' END AS country")
    return rows.select("id", places.canonical_label(F.col("label"), F.col("country")).alias("place"))


# Pay: an order's key says what its source published and what its text states.
_LOW, _HIGH, _HOURLY = "50000 + (o_orderkey % 900) * 100", "70000 + (o_orderkey % 900) * 100", "20 + o_orderkey % 30"
_PAY = f"""CASE o_orderkey % 6 WHEN 0 THEN concat('{{"min":', {_LOW}, ',"max":', {_HIGH}, ',"currency":"CAD","interval":"year","level":[1]}}') WHEN 1 THEN concat('{{"min":', {_LOW}, ',"max":', {_HIGH}, ',"currency":"CAD"}}')
 WHEN 2 THEN '{{"min":1,"max":2,"currency":"USD","interval":"year","compensationTierSummary":"$1 – $2 • Offers equity"}}' WHEN 3 THEN '{{"min":1,"max":2,"currency":"USD","interval":"year"}}' END"""
_PAY_HTML = f"""CASE WHEN o_orderkey % 6 IN (1, 2) THEN concat('<p>About us</p><p>The base salary range for this role is $', {_LOW}, ' CAD - $', {_HIGH}, ' CAD per year.</p>')
 WHEN o_orderkey % 6 = 4 THEN concat('<p>Pay: $', {_HOURLY}, ' CAD - $', {_HOURLY} + 5, ' CAD per hour</p>') ELSE '<p>We sell 3 kinds of maps.</p>' END"""
_THOUSANDS = "'CA$' || rtrim(rtrim(printf('%.1f', ({0}) / 1000.0), '0'), '.') || 'K'"


@query(f"""SELECT o_orderkey AS id, CASE WHEN k IN (2, 4) THEN 'posting_text' END AS source, CASE k WHEN 3 THEN 1 WHEN 4 THEN {_HOURLY} WHEN 5 THEN NULL ELSE {_LOW} END::DOUBLE AS low,
 CASE k WHEN 3 THEN 2 WHEN 4 THEN {_HOURLY} + 5 WHEN 5 THEN NULL ELSE {_HIGH} END::DOUBLE AS high, CASE WHEN k = 3 THEN 'USD' WHEN k < 5 THEN 'CAD' END AS currency, CASE WHEN k = 4 THEN 'hour' WHEN k < 4 THEN 'year' END AS period,
 CASE WHEN k = 1 THEN 'posting_text' END AS period_source, CASE WHEN k = 2 THEN {_THOUSANDS.format(_LOW)} || ' – ' || {_THOUSANDS.format(_HIGH)} || ' · Offers equity' WHEN k = 4 THEN 'CA$' || ({_HOURLY}) || ' – CA$' || ({_HOURLY} + 5) || ' / hour' END AS summary,
 CASE WHEN k = 3 THEN 'placeholder' END AS problem, k = 2 AS keeps_published, true AS same_again FROM (SELECT *, o_orderkey % 6 AS k FROM orders) o""")
def pay_resolved(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey AS id", f"{_PAY} AS stored", f"{_PAY_HTML} AS html")
    said = ["source", "low", "high", "currency", "period", "period_source", "summary", "problem", "keeps_published", "same_again"]
    return once_each(rows, ["stored", "html"], _pay_of).select("id", *said)


def _pay_of(rows: DataFrame) -> DataFrame:
    """What is resolved from stored pay and a text."""
    empty = F.array().cast("array<struct<location:string,country:string>>")
    rows = settled(rows.withColumn("_ranges", pay_text.pay_in_html(F.col("html"))), ranges=F.col("_ranges"))  # of both resolutions
    rows = settled(rows, pay=pay_resolve.resolved_with(F.col("stored"), F.col("ranges"), empty))
    rows = settled(rows, again=pay_resolve.resolved_with(F.col("pay"), F.col("ranges"), empty))
    of = lambda path: F.get_json_object("pay", f"$.{path}")
    same = F.to_json(F.try_parse_json("pay")).eqNullSafe(F.to_json(F.try_parse_json("again")))  # members of a variant are sorted
    return rows.select(
        "stored",
        "html",
        of("source").alias("source"),
        of("min").cast("double").alias("low"),
        of("max").cast("double").alias("high"),
        of("currency").alias("currency"),
        of("interval").alias("period"),
        of("interval_source").alias("period_source"),
        F.when(of("source").isNotNull(), of("compensationTierSummary")).alias("summary"),
        of("validation.status").alias("problem"),
        of("source_structured").isNotNull().alias("keeps_published"),
        same.alias("same_again"),
    )


# Clusters: orders as a list of postings; twelve neighbours share four ids and five URLs, so a posting often ties two clusters.
_LISTED_AS = """o_orderkey AS ordinal, CAST(o_custkey AS STRING) AS id, CAST(o_orderkey AS STRING) AS job_id, CASE o_custkey % 4 WHEN 0 THEN 'remotive' WHEN 1 THEN '' ELSE 'lever' END AS source_name,
 CASE WHEN o_orderkey % 5 <> 0 THEN concat(CAST(o_orderkey - o_orderkey % 12 AS STRING), '-', CAST(o_custkey % 4 AS STRING)) END AS source_job_id,
 CASE WHEN o_orderkey % 7 <> 0 THEN concat('https://jobs.example/', CAST(o_orderkey - o_orderkey % 12 AS STRING), '/', CAST((o_custkey + o_orderkey) % 5 AS STRING)) END AS source_url,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS posted_at"""


@query(f"""WITH RECURSIVE l AS (SELECT {_LISTED_AS} FROM orders),
 p AS (SELECT ordinal, ordinal - ordinal % 12 AS chunk, row_number() OVER (PARTITION BY ordinal - ordinal % 12 ORDER BY ordinal) AS j, CASE WHEN source_name <> '' THEN source_name || ' ' || coalesce(source_job_id, job_id) END AS k, source_url AS u,
   printf('%d%020d', CASE WHEN source_name = 'lever' THEN 1 ELSE 0 END, coalesce(epoch(posted_at)::BIGINT, 0)) || id AS rank FROM l),
 s AS (SELECT DISTINCT chunk, 0::BIGINT AS j, []::STRUCT("first" BIGINT, best BIGINT, k VARCHAR, u VARCHAR, rank VARCHAR)[] AS cs, []::STRUCT(o BIGINT, c BIGINT)[] AS placed FROM p
  UNION ALL SELECT chunk, j, CASE WHEN m IS NULL THEN list_append(cs, {{'first': ordinal, 'best': ordinal, 'k': k, 'u': u, 'rank': rank}})
    ELSE list_transform(cs, lambda c, i: CASE WHEN i = m AND rank > c.rank THEN {{'first': c."first", 'best': ordinal, 'k': k, 'u': u, 'rank': rank}} ELSE c END) END, list_append(placed, {{'o': ordinal, 'c': CASE WHEN m IS NULL THEN ordinal ELSE cs[m]."first" END}})
   FROM (SELECT p.*, s.cs, s.placed, list_position(list_transform(s.cs, lambda c: coalesce(c.k = p.k, false) OR coalesce(c.u = p.u, false)), true) AS m FROM s JOIN p ON p.chunk = s.chunk AND p.j = s.j + 1) x),
 e AS (SELECT * FROM s QUALIFY j = max(j) OVER (PARTITION BY chunk)), b AS (SELECT unnest(cs, recursive := true) FROM e), r AS (SELECT unnest(placed, recursive := true) FROM e)
SELECT r.o AS ordinal, r.c AS cluster, r.o = b.best AS is_representative FROM r JOIN b ON b."first" = r.c""")
def greedy_clusters(t: Tables) -> DataFrame:
    return clusters.greedy_clusters(views(t).sql(f"SELECT {_LISTED_AS} FROM orders"))


@query(f"""WITH RECURSIVE l AS (SELECT {_LISTED_AS} FROM orders),
 p AS (SELECT ordinal, ordinal - ordinal % 12 AS chunk, row_number() OVER (PARTITION BY ordinal - ordinal % 12 ORDER BY ordinal) AS j, source_url AS u, source_job_id AS i FROM l),
 s AS (SELECT DISTINCT chunk, 0::BIGINT AS j, map([]::VARCHAR[], []::BIGINT[]) AS urls, map([]::VARCHAR[], []::BIGINT[]) AS ids, NULL::BIGINT AS ordinal, NULL::BIGINT AS prior FROM p
  UNION ALL SELECT chunk, j, CASE WHEN prior IS NULL AND u IS NOT NULL THEN map_concat(urls, map([u], [o])) ELSE urls END, CASE WHEN prior IS NULL AND i IS NOT NULL THEN map_concat(ids, map([i], [o])) ELSE ids END, o, prior
   FROM (SELECT p.chunk, p.j, p.ordinal AS o, p.u, p.i, s.urls, s.ids, coalesce(s.urls[p.u], s.ids[p.i]) AS prior FROM s JOIN p ON p.chunk = s.chunk AND p.j = s.j + 1) x)
SELECT ordinal, prior IS NOT NULL AS is_duplicate, prior AS duplicate_of FROM s WHERE j > 0""")
def first_seen_two_keys(t: Tables) -> DataFrame:
    rows = views(t).sql(f"SELECT {_LISTED_AS} FROM orders")
    return dedup.first_seen(rows, "ordinal", ["source_url", "source_job_id"]).select("ordinal", "is_duplicate", "duplicate_of")


# Bronze to silver: titles, places and texts by an order's key.
_BRONZE = {
    "title": "CASE o_orderkey % 4 WHEN 0 THEN 'Software Engineering Intern - Summer 2027' WHEN 1 THEN 'Senior Backend Developer' WHEN 2 THEN 'Sales Manager' ELSE 'Junior Data Engineer' END",
    "raw_location": "CASE o_orderkey % 3 WHEN 0 THEN 'Toronto, ON; toronto, Canada' WHEN 1 THEN 'San Francisco' ELSE 'Berlin, Germany' END",
    "raw_description": "concat('<p>We use Python', CASE WHEN o_orderkey % 2 = 0 THEN ' and Kubernetes' ELSE '' END, '.</p>', CASE WHEN o_orderkey % 5 = 0 THEN '<p>The base salary range for this role is $100,000 CAD - $120,000 CAD per year.</p>' ELSE '' END)",
}


@query(f"""SELECT o_orderkey AS id, 'lever:' || o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'internship' WHEN 1 THEN 'full_time' WHEN 2 THEN 'full_time' ELSE 'entry_level' END AS role_type, o_orderkey % 4 <> 2 AS is_eligible_role,
 CASE WHEN o_orderkey % 4 = 0 THEN 'summer' END AS term_season, CASE WHEN o_orderkey % 4 = 0 THEN 2027 END AS term_year,
 CASE o_orderkey % 3 WHEN 0 THEN 'Toronto, Ontario, Canada' WHEN 1 THEN 'San Francisco, CA, United States' ELSE 'Berlin, Germany' END AS location, CASE o_orderkey % 3 WHEN 0 THEN 'Canada' WHEN 1 THEN 'United States' ELSE 'Germany' END AS country,
 CASE WHEN o_orderkey % 3 = 0 THEN 'toronto, Canada' END AS also_published, CASE WHEN o_orderkey % 2 = 0 THEN 'Kubernetes,Python' ELSE 'Python' END AS skills,
 CASE WHEN o_orderkey % 5 = 0 THEN 100000.0::DOUBLE END AS min_annual, CASE WHEN o_orderkey % 5 = 0 THEN 'CA$100K – CA$120K' END AS pay_summary FROM orders""")
def silver_postings(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey", *[f"{e} AS {c}" for c, e in _BRONZE.items()])
    given = {"source_name": F.lit("lever"), "source_job_id": F.col("o_orderkey").cast("string"), "company_name": F.lit("acme"), "is_listed": F.lit(True), "raw_locations": F.array().cast("array<string>")}
    bronze = rows.select(*[given.get(c, F.col(c) if c in _BRONZE else F.lit(None)).cast(kind).alias(c) for c, kind in adapters.BRONZE.items()], F.col("o_orderkey").alias("ordinal"))
    more = F.get(F.get("locations", F.lit(0))["also_published"], F.lit(0))
    return silver(bronze).select(
        F.col("ordinal").alias("id"),
        "job_id",
        "role_type",
        "is_eligible_role",
        "term_season",
        "term_year",
        "location",
        "country",
        more.alias("also_published"),
        F.array_join(F.array_sort("skills"), ",").alias("skills"),
        F.get("pay_ranges", F.lit(0))["min_annual"].alias("min_annual"),
        F.get_json_object("compensation", "$.compensationTierSummary").alias("pay_summary"),
    )


_PLACE_FIELD = "CASE o_orderkey % 7 WHEN 0 THEN 'Toronto, ON; Toronto; TORONTO, ON, CA' WHEN 1 THEN 'Home; Vancouver, BC' WHEN 2 THEN 'San Francisco, California / New York, NY' WHEN 3 THEN 'Remote - Canada' WHEN 4 THEN 'Richmond, BC, Canada' WHEN 5 THEN 'Offsite' END"


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'Toronto, Ontario, Canada|Canada|Toronto, ON|Toronto,TORONTO, ON, CA' WHEN 1 THEN 'Vancouver, British Columbia, Canada|Canada|Vancouver, BC|'
 WHEN 2 THEN 'San Francisco, CA, United States|United States|San Francisco, California|;New York, NY, United States|United States|New York, NY|' WHEN 3 THEN 'Remote - Canada|Canada||' WHEN 4 THEN 'Richmond, British Columbia, Canada|Canada|Richmond, BC, Canada|'
 WHEN 5 THEN 'Offsite|Unknown||' ELSE 'Unknown|Unknown||' END AS places FROM orders""")
def posting_places(t: Tables) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    one = lambda x: F.concat_ws("|", x["location"], x["country"], blank(x["raw_location"]), blank(F.array_join(x["also_published"], ",")))
    found = lambda labels: settled(labels, found=places.job_places(F.col("raw"))).select("raw", F.array_join(F.transform("found", one), ";").alias("places"))
    return once_each(t.orders.selectExpr("o_orderkey AS id", f"{_PLACE_FIELD} AS raw"), ["raw"], found).select("id", "places")


# Labels of segments: an order's key says where, in one of twelve shapes; the SQL states what each shape means.
_TOWN = "CASE o_orderkey % 3 WHEN 0 THEN 'Toronto' WHEN 1 THEN 'Waterloo' ELSE 'Ottawa' END"
_STATE = "CASE o_custkey % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'WA' ELSE 'CA' END"
_SEGMENTS = f"""CASE o_orderkey % 12 WHEN 0 THEN concat('US, ', {_STATE}, ', Spring Hill') WHEN 1 THEN concat(o_orderkey, ' KING ST:', upper({_TOWN})) WHEN 2 THEN concat('AMER - Canada - Ontario - ', {_TOWN}, ' - Site ', o_custkey)
 WHEN 3 THEN concat('US, ', {_STATE}, ', Remote') WHEN 4 THEN concat('CA, ON, ', {_TOWN}) WHEN 5 THEN concat('Acme ', {_TOWN}, ' Tower') WHEN 6 THEN concat('US, ON, ', {_TOWN}) WHEN 7 THEN concat('Building ', o_orderkey)
 WHEN 8 THEN concat('Remote - ', {_TOWN}, ', Canada') WHEN 9 THEN 'New York, NY' WHEN 10 THEN 'CA' ELSE concat('OAK HILL, ', {_STATE}, ', USA') END"""


@query(f"""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 12 AS k, {_TOWN} AS town, {_STATE} AS st, CASE {_STATE} WHEN 'TX' THEN 'Texas' WHEN 'WA' THEN 'Washington' ELSE 'California' END AS state FROM orders)
SELECT id, CASE WHEN k = 0 THEN 'Spring Hill, ' || st || ', United States' WHEN k IN (1, 2, 4, 5) THEN town || ', Ontario, Canada' WHEN k = 3 THEN 'Remote - ' || state || ', United States' WHEN k = 8 THEN 'Remote - ' || town || ', Ontario, Canada'
 WHEN k = 9 THEN 'New York, NY, United States' WHEN k = 11 THEN 'Oak Hill, ' || st || ', United States' END AS location,
 CASE WHEN k IN (0, 3, 9, 11) THEN 'United States' WHEN k IN (1, 2, 4, 5, 8) THEN 'Canada' END AS country FROM x""")
def segment_places(t: Tables) -> DataFrame:
    rows = settled(t.orders.selectExpr("o_orderkey AS id", f"{_SEGMENTS} AS label"), at=segments.segment_place(F.col("label")))
    return rows.select("id", "at.location", "at.country")


# Audit: what is wrong with a posting follows from its order's key.
_AUDITED = f"""o_orderkey AS id, CAST(o_custkey % 50 AS STRING) AS company, ' Engineer' AS title, CASE o_orderkey % 4 WHEN 0 THEN 'US, CA, Santa Clara' WHEN 1 THEN 'Toronto, Ontario, Canada' ELSE 'Home, Ontario' END AS location,
 CASE WHEN o_orderkey % 4 = 2 THEN 'Unknown' ELSE 'Canada' END AS country, CASE o_orderkey % 3 WHEN 0 THEN 'internship' WHEN 1 THEN 'co_op' ELSE 'full_time' END AS role_type, CASE WHEN o_orderkey % 6 < 2 THEN 'summer' END AS term_season,
 CASE WHEN o_orderkey % 11 <> 0 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR * ((o_orderkey * 7) % 1500 - 60) END AS posted_at, o_orderkey % 5 = 2 AS shown,
 CASE o_orderkey % 5 WHEN 0 THEN '{{"min":1,"max":2}}' WHEN 1 THEN '{{"ranges":[{{"min":50000,"max":900000,"interval":"year"}}]}}' WHEN 2 THEN '{{"source":"posting_text","ranges":[{{"min":90000,"max":100000}}]}}' WHEN 4 THEN '{{"min":90000,"max":95000,"validation":{{"status":"placeholder"}}}}' END AS compensation,
 CASE o_orderkey % 7 WHEN 0 THEN '<p>The base salary range is $100,000 - $120,000.</p>' WHEN 1 THEN '<p>Salary and bonus of $100,000 to $120,000.</p>' WHEN 2 THEN '<p>Join us. You must be a U.S. citizen.</p>' WHEN 3 THEN '<p>Equal opportunity for every permanent resident.</p>'
  WHEN 4 THEN '<p>We pay $90,000 to 100K</p>' END AS description, CASE WHEN o_orderkey % 10 < 8 THEN concat('https://jobs.example/', CAST(o_orderkey - o_orderkey % 2 AS STRING)) END AS source_url"""


@query(f"""WITH p AS (SELECT {_AUDITED}, o_orderkey AS k FROM orders),
 url AS (SELECT sum(n) AS n FROM (SELECT count(*) AS n FROM p WHERE source_url IS NOT NULL GROUP BY source_url) x WHERE n > 1),
 same AS (SELECT sum(n) AS n FROM (SELECT count(*) AS n FROM p GROUP BY company, location, coalesce(description, '')) x WHERE n > 1),
 m AS (SELECT unnest([{{'metric': 'missing_posted_at', 'n': count(*) FILTER (posted_at IS NULL)}}, {{'metric': 'missing_skills', 'n': count(*) FILTER (k % 8 = 0)}}, {{'metric': 'internship_without_term', 'n': count(*) FILTER (k % 3 < 2 AND k % 6 >= 2)}},
  {{'metric': 'no_pay_shown', 'n': count(*) FILTER (NOT shown)}}, {{'metric': 'pay_shown', 'n': count(*) FILTER (shown)}}, {{'metric': 'pay_implausible_in_stored_data', 'n': count(*) FILTER (k % 5 < 2)}},
  {{'metric': 'pay_marked_unusable', 'n': count(*) FILTER (k % 5 = 4)}}, {{'metric': 'pay_period_asserted_without_source', 'n': count(*) FILTER (shown)}}, {{'metric': 'pay_from_text', 'n': count(*) FILTER (shown)}},
  {{'metric': 'pay_amount_not_found_in_posting_text', 'n': count(*) FILTER (shown AND k % 7 <> 4)}}, {{'metric': 'pay_stated_in_text_not_shown', 'n': count(*) FILTER (NOT shown AND k % 7 = 0)}},
  {{'metric': 'location_vendor_format_stored', 'n': count(*) FILTER (k % 4 = 0)}}, {{'metric': 'location_not_a_place', 'n': count(*) FILTER (k % 4 >= 2)}}, {{'metric': 'location_country_unknown_entries', 'n': count(*) FILTER (k % 4 = 2)}},
  {{'metric': 'future_dated', 'n': count(*) FILTER (posted_at > TIMESTAMP '{AS_OF}' + INTERVAL 15 MINUTE)}}, {{'metric': 'older_than_the_window', 'n': count(*) FILTER (posted_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY - INTERVAL 15 MINUTE)}},
  {{'metric': 'hard_conditions_in_text', 'n': count(*) FILTER (k % 7 = 2)}}, {{'metric': 'duplicate_source_urls', 'n': (SELECT n FROM url)}}, {{'metric': 'duplicates_identical_listings', 'n': (SELECT n FROM same)}}], recursive := true) FROM p)
SELECT metric, CAST(coalesce(n, 0) AS BIGINT) AS n FROM m""")
def board_audit(t: Tables) -> DataFrame:
    rows = views(t).sql(f"SELECT {_AUDITED} FROM orders")
    place = F.array(F.struct("location", "country"))
    pay = F.when(F.col("shown"), F.array(F.struct(F.lit("year").alias("period"))))
    rows = rows.select("*", place.alias("locations"), pay.alias("pay_ranges"), F.when(F.col("id") % 8 != 0, F.array(F.lit("Python"))).alias("skills"))
    return audits.public_audit(rows, AS_OF).select("metric", "n")

"""Registered queries: the job-board operators on the star-schema tables, each with the SQL it must agree with.

Postings are orders, companies customers, locations nations, skills parts, the bridge is the distinct
(order, part) of lineitem, runs are events. The reference time is a literal, never the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pay, skills, text, urls
from ..operators import dedup, visibility

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2001-08-02 00:00:00"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def share(part, whole, name: str = "share_pct"):
    return F.round(F.try_divide(F.lit(100.0) * part, F.nullif(whole, F.lit(0))), 1).alias(name)


def bridge(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey").distinct()


# Aggregations and rankings


@query("""
WITH bridge AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
     n AS (SELECT count(*) AS total FROM orders),
     m AS (SELECT p_partkey, p_name, count(*) AS mentions FROM bridge JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT row_number() OVER (ORDER BY mentions DESC, lower(p_name), p_partkey) AS rank, p_partkey, p_name AS skill, mentions,
       round(100.0 * mentions / nullif(total, 0), 1) AS frequency_pct FROM m, n""")
def skill_ranking(t: Tables) -> DataFrame:
    total = t.orders.agg(F.count(F.lit(1)).alias("total"))
    used = bridge(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    counted = used.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("mentions")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    # One row a part is ranked; the postings were counted before.
    rank = F.row_number().over(Window.orderBy(F.desc("mentions"), F.lower("p_name"), "p_partkey")).cast("long").alias("rank")
    return counted.join(F.broadcast(total)).select(rank, "p_partkey", F.col("p_name").alias("skill"), "mentions", share(F.col("mentions"), F.col("total"), "frequency_pct"))


_OVERVIEW = """
SELECT (SELECT count(*) FROM scope) AS total_postings, (SELECT count(DISTINCT o_custkey) FROM scope) AS total_companies,
       (SELECT count(DISTINCT c_nationkey) FROM scope) AS total_locations,
       (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN scope ON l_orderkey = o_orderkey) AS total_skills,
       (SELECT count(*) FROM scope WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 7 DAY AND o_orderdate <= TIMESTAMP '2001-08-02' + INTERVAL 1 HOUR) AS recently_posted_postings,
       strftime(coalesce((SELECT max(ts) FROM events WHERE event_type = 'refresh'), (SELECT max(ts) FROM events WHERE event_type = 'signup'), (SELECT max(ts) FROM events)), '%Y-%m-%d %H:%M:%S') AS last_refreshed_at"""


def _overview(t: Tables, scope: DataFrame) -> DataFrame:
    facts = scope.agg(
        F.count(F.lit(1)).alias("total_postings"),
        F.countDistinct("o_custkey").alias("total_companies"),
        F.countDistinct("c_nationkey").alias("total_locations"),
        F.count_if(visibility.posted_within(AS_OF, posted="o_orderdate")).alias("recently_posted_postings"),
    )
    used = t.lineitem.join(scope.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").agg(F.countDistinct("l_partkey").alias("total_skills"))
    when = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    last = t.events.agg(F.date_format(F.coalesce(when("refresh"), when("signup"), F.max("ts")), "yyyy-MM-dd HH:mm:ss").alias("last_refreshed_at"))
    return facts.join(F.broadcast(used)).join(F.broadcast(last))  # three single rows


@query("WITH scope AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey)" + _OVERVIEW)
def overview_totals(t: Tables) -> DataFrame:
    return _overview(t, t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")))


@query("WITH scope AS (SELECT o.*, c_nationkey FROM orders o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE lower(r_name) IN ('america', 'asia'))" + _OVERVIEW)
def overview_scoped(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where(F.lower("r_name").isin("america", "asia")).select(F.col("n_nationkey").alias("c_nationkey"))
    return _overview(t, t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(places, "c_nationkey", "left_semi"))


@query("""
WITH loc AS (SELECT DISTINCT l_orderkey, unnest([c_nationkey, s_nationkey]) AS nationkey FROM lineitem
             JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT n_name AS country, count(*) AS postings, round(100.0 * count(*) / (SELECT count(*) FROM loc), 1) AS share_pct
FROM loc JOIN nation ON n_nationkey = nationkey GROUP BY n_name""")
def country_distribution(t: Tables) -> DataFrame:
    placed = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    pairs = placed.select("l_orderkey", F.explode(F.array("c_nationkey", "s_nationkey")).alias("n_nationkey")).distinct()
    counted = pairs.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("postings"))
    whole = F.sum("postings").over(Window.partitionBy())  # one row a nation
    return counted.join(t.nation, "n_nationkey").select(F.col("n_name").alias("country"), "postings", share(F.col("postings"), whole))


def _breakdown(t: Tables, column: str, name: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 11 == 0, F.lit("  ")).when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col(column))
    counted = t.orders.groupBy(text.blank_to(value, "unspecified").alias(name)).agg(F.count(F.lit(1)).alias("postings"))
    return counted.select(name, "postings", share(F.col("postings"), F.sum("postings").over(Window.partitionBy())))


_BREAKDOWN = """
WITH v AS (SELECT coalesce(nullif(trim(CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN NULL ELSE {0} END), ''), 'unspecified') AS {1} FROM orders)
SELECT {1}, count(*) AS postings, round(100.0 * count(*) / (SELECT count(*) FROM v), 1) AS share_pct FROM v GROUP BY 1"""


@query(_BREAKDOWN.format("o_orderpriority", "role_type"))
def role_breakdown(t: Tables) -> DataFrame:
    return _breakdown(t, "o_orderpriority", "role_type")


@query(_BREAKDOWN.format("o_orderstatus", "workplace_type"))
def workplace_breakdown(t: Tables) -> DataFrame:
    return _breakdown(t, "o_orderstatus", "workplace_type")


@query("""
SELECT c_name AS company, count(*) AS postings, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS share_pct
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY postings DESC, lower(c_name), c_custkey LIMIT 10""")
def top_companies(t: Tables) -> DataFrame:
    counted = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("postings"))
    total = counted.agg(F.sum("postings").alias("total"))
    named = counted.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    top = named.orderBy(F.desc("postings"), F.lower("c_name"), "c_custkey").limit(10)
    return top.join(F.broadcast(total)).select(F.col("c_name").alias("company"), "postings", share(F.col("postings"), F.col("total")))


@query("""SELECT c_name AS company, count(o_orderkey) AS postings FROM customer JOIN orders ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY GROUP BY c_custkey, c_name""")
def company_directory(t: Tables) -> DataFrame:
    seen = t.orders.where(visibility.posted_within(AS_OF, 30, "o_orderdate", skew=False)).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("postings"))
    return seen.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_name").alias("company"), "postings")


@query("""SELECT c_name AS company, count(o_orderkey) AS postings FROM customer LEFT JOIN orders ON o_custkey = c_custkey
AND o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY GROUP BY c_custkey, c_name""")
def company_directory_zero(t: Tables) -> DataFrame:
    seen = t.orders.where(visibility.posted_within(AS_OF, 30, "o_orderdate", skew=False)).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("postings"))
    return t.customer.join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_name").alias("company"), F.coalesce("postings", F.lit(0)).alias("postings"))


@query("""
WITH runs AS (SELECT event_id, ts, user_id, 'source' || (user_id % 5) AS source_name, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS status FROM events),
     latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name, user_id ORDER BY ts DESC, event_id DESC) AS nth FROM runs WHERE status <> 'running') WHERE nth = 1),
     ok AS (SELECT source_name, max(ts) AS at FROM runs WHERE status = 'success' GROUP BY 1),
     active AS (SELECT 'source' || (c_nationkey % 5) AS source_name, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT l.source_name, CASE WHEN count(*) FILTER (l.status <> 'success') > 0 THEN 'degraded' ELSE 'healthy' END AS status, count(*) AS companies_tracked,
       count(*) FILTER (l.status = 'success') AS companies_ok, count(*) FILTER (l.status <> 'success') AS companies_degraded,
       coalesce(max(a.n), 0) AS active_jobs, strftime(max(o.at), '%Y-%m-%d %H:%M:%S') AS last_success_at, strftime(max(l.ts), '%Y-%m-%d %H:%M:%S') AS last_attempt_at
FROM latest l LEFT JOIN ok o USING (source_name) LEFT JOIN active a USING (source_name) GROUP BY l.source_name""")
def source_health(t: Tables) -> DataFrame:
    from ..operators.reports import source_status

    source = lambda key: F.concat(F.lit("source"), (F.col(key) % 5).cast("string")).alias("source_name")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("success")
    runs = t.events.select(F.col("event_id").alias("id"), source("user_id"), F.col("user_id").alias("company_identifier"), status.alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"))
    active = t.customer.where("c_acctbal > 0").groupBy(source("c_nationkey")).agg(F.count(F.lit(1)).alias("active_jobs"))
    found = source_status(runs, active)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("source_name", "status", "companies_tracked", "companies_ok", "companies_degraded", "active_jobs", stamp("last_success_at"), stamp("last_attempt_at"))


# Visibility, order and pages

_POSTINGS = """
WITH jp AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL 90 DAY ELSE o_orderdate END AS posted_at,
            o_orderdate AS created_at, o_orderdate + INTERVAL 2 DAY AS last_seen_at, o_orderstatus <> 'F' AS is_active, o_custkey, o_orderpriority FROM orders)
"""


def _postings(t: Tables) -> DataFrame:
    later = lambda n: F.col("o_orderdate") + F.make_dt_interval(F.lit(n))
    posted = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderkey") % 17 == 0, later(90)).otherwise(F.col("o_orderdate"))
    return t.orders.select(F.col("o_orderkey").alias("id"), posted.alias("posted_at"), F.col("o_orderdate").alias("created_at"), later(2).alias("last_seen_at"), (F.col("o_orderstatus") != "F").alias("is_active"), "o_custkey", "o_orderpriority")


@query(_POSTINGS + """
SELECT id FROM jp WHERE (posted_at IS NOT NULL AND posted_at >= TIMESTAMP '2001-07-20' - INTERVAL 30 DAY AND posted_at < TIMESTAMP '2001-07-22')
 OR ((posted_at IS NULL OR posted_at >= TIMESTAMP '2001-07-22') AND created_at >= TIMESTAMP '2001-07-20' - INTERVAL 30 DAY AND last_seen_at >= TIMESTAMP '2001-07-20' - INTERVAL 48 HOUR)""")
def visible_window(t: Tables) -> DataFrame:
    return _postings(t).where(visibility.publicly_visible("2001-07-20 00:00:00")).select("id")


@query(_POSTINGS + """
SELECT count(*) FILTER (posted_at >= TIMESTAMP '2001-07-20' AND posted_at < TIMESTAMP '2001-07-21') AS today,
 count(*) FILTER (posted_at >= TIMESTAMP '2001-07-20 09:00:00' - INTERVAL 7 DAY AND posted_at <= TIMESTAMP '2001-07-20 10:00:00') AS week,
 count(*) FILTER (posted_at >= TIMESTAMP '2001-07-20 09:00:00' - INTERVAL 14 DAY AND posted_at <= TIMESTAMP '2001-07-20 10:00:00') AS fortnight,
 count(*) FILTER (coalesce(posted_at, created_at) >= TIMESTAMP '2001-07-20 09:00:00' - INTERVAL 30 DAY) AS fresh, count(*) AS every FROM jp""")
def freshness_windows(t: Tables) -> DataFrame:
    now = "2001-07-20 09:00:00"
    return _postings(t).agg(
        F.count_if(visibility.posted_today(now)).alias("today"),
        F.count_if(visibility.posted_within(now, 7)).alias("week"),
        F.count_if(visibility.posted_within(now, 14)).alias("fortnight"),
        F.count_if(visibility.fresh(now)).alias("fresh"),
        F.count(F.lit(1)).alias("every"),
    )


@query(_POSTINGS + """
SELECT CASE WHEN NOT is_active THEN 'inactive' WHEN posted_at >= TIMESTAMP '2001-07-20' - INTERVAL 7 DAY AND posted_at <= TIMESTAMP '2001-07-20' + INTERVAL 1 HOUR THEN 'recently_posted'
 WHEN posted_at IS NULL AND created_at >= TIMESTAMP '2001-07-20' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '2001-07-20' + INTERVAL 1 HOUR THEN 'recently_discovered' ELSE 'active' END AS freshness_status,
 CASE WHEN posted_at IS NULL THEN NULL WHEN posted_at = date_trunc('day', posted_at) THEN 'date' ELSE 'time' END AS posted_precision, count(*) AS postings FROM jp GROUP BY 1, 2""")
def freshness_status(t: Tables) -> DataFrame:
    rows = _postings(t).withColumn("source_name", F.lit("lever"))
    return rows.groupBy(visibility.freshness_status("2001-07-20 00:00:00").alias("freshness_status"), visibility.posted_precision().alias("posted_precision")).agg(F.count(F.lit(1)).alias("postings"))


_RANK = """CASE WHEN n_regionkey = 1 AND posted_at >= TIMESTAMP '2001-08-02' - INTERVAL 7 DAY THEN 1 WHEN n_regionkey = 1 AND posted_at >= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY THEN 2
 WHEN n_regionkey = 1 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND posted_at >= TIMESTAMP '2001-08-02' - INTERVAL 60 DAY THEN 3 WHEN n_regionkey = 1 THEN 4
 WHEN n_name LIKE '%7' THEN 5 WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 6 ELSE 7 END"""


def _placed(t: Tables) -> DataFrame:
    return _postings(t).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))


@query(_POSTINGS + f"""
, ranked AS (SELECT id, c_name, {_RANK} AS bucket, posted_at, created_at FROM jp JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT row_number() OVER (ORDER BY bucket, posted_at DESC NULLS LAST, created_at DESC, id DESC) AS place, id, bucket FROM ranked ORDER BY place LIMIT 25 OFFSET 50""")
def recommended_page(t: Tables) -> DataFrame:
    from ..plans.jobs import recommended_bucket

    bucket = recommended_bucket(AS_OF, F.col("n_regionkey") == 1, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("n_name").endswith("7"))
    order = ["bucket", F.desc_nulls_last("posted_at"), F.desc("created_at"), F.desc("id")]
    page = _placed(t).withColumn("bucket", bucket.cast("int")).orderBy(*order).offset(50).limit(25)
    return page.select((F.row_number().over(Window.orderBy(*order)) + 50).cast("long").alias("place"), "id", "bucket")


def _page_sql(order: str) -> str:
    return _POSTINGS + f"SELECT row_number() OVER (ORDER BY {order}) AS place, id FROM jp JOIN customer ON c_custkey = o_custkey ORDER BY place LIMIT 100"


def _page(t: Tables, *order) -> DataFrame:
    page = _postings(t).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).orderBy(*order).limit(100)
    return page.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "id")


@query(_page_sql("posted_at DESC NULLS LAST, created_at DESC, id DESC"))
def newest_page(t: Tables) -> DataFrame:
    return _page(t, F.desc_nulls_last("posted_at"), F.desc("created_at"), F.desc("id"))


@query(_page_sql("posted_at ASC NULLS LAST, created_at, id"))
def oldest_page(t: Tables) -> DataFrame:
    return _page(t, F.asc_nulls_last("posted_at"), F.asc("created_at"), F.asc("id"))


@query(_page_sql("lower(c_name), posted_at DESC NULLS LAST, id DESC"))
def company_page(t: Tables) -> DataFrame:
    return _page(t, F.lower("c_name"), F.desc_nulls_last("posted_at"), F.desc("id"))


@query("""WITH b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY (o_custkey % 3 = 0) DESC, n DESC, o_custkey) AS nth FROM b)
SELECT o_custkey, n, CASE WHEN nth <= 250 THEN 'checked' ELSE 'deferred' END AS budget FROM r""")
def board_budget(t: Tables) -> DataFrame:
    boards = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    order = [(F.col("o_custkey") % 3 == 0).desc(), F.desc("n"), F.asc("o_custkey")]
    chosen = boards.orderBy(*order).limit(250).select("o_custkey", F.lit("checked").alias("budget"))
    return boards.join(chosen, "o_custkey", "left").select("o_custkey", "n", F.coalesce("budget", F.lit("deferred")).alias("budget"))


# Filters and joins


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND lower(p_brand) = 'brand#13')")
def semi_skill_filter(t: Tables) -> DataFrame:
    wanted = t.part.where(F.lower("p_brand") == "brand#13").select(F.col("p_partkey").alias("l_partkey"))
    having = t.lineitem.join(wanted, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(having, "o_orderkey", "left_semi")


@query("""SELECT o_orderkey, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS skills FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def skills_array(t: Tables) -> DataFrame:
    named = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    have = named.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("skills"))
    return t.orders.select("o_orderkey").join(have, "o_orderkey", "left").select("o_orderkey", F.coalesce("skills", F.lit("")).alias("skills"))


@query("""SELECT coalesce(bool_or(n_name LIKE '%1%'), false) AS metro_one, coalesce(bool_or(n_name LIKE '%zzz%'), false) AS metro_none, coalesce(bool_or(n_regionkey = 2 AND c_acctbal < 0), false) AS metro_three
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def bool_or_options(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    offered = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    return rows.agg(offered(F.col("n_name").contains("1"), "metro_one"), offered(F.col("n_name").contains("zzz"), "metro_none"), offered((F.col("n_regionkey") == 2) & (F.col("c_acctbal") < 0), "metro_three"))


@query("""SELECT 'segment' AS kind, c_mktsegment AS value FROM customer GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus FROM orders GROUP BY 2
UNION ALL SELECT 'brand', p_brand FROM part GROUP BY 2 UNION ALL SELECT 'nation', n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY 2""")
def filter_options(t: Tables) -> DataFrame:
    def options(kind: str, df: DataFrame, column: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(column).alias("value")).distinct()

    lived_in = t.nation.join(t.customer.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    return options("segment", t.customer, "c_mktsegment").unionAll(options("status", t.orders, "o_orderstatus")).unionAll(options("brand", t.part, "p_brand")).unionAll(options("nation", lived_in, "n_name"))


@query("""SELECT o_orderkey, coalesce(a.s_suppkey, b.s_suppkey, c.s_suppkey) AS target,
 CASE WHEN a.s_suppkey IS NOT NULL THEN 'board' WHEN b.s_suppkey IS NOT NULL THEN 'tenant' WHEN c.s_suppkey IS NOT NULL THEN 'name' ELSE 'none' END AS matched FROM orders
LEFT JOIN supplier a ON a.s_suppkey = o_custkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) b ON b.s_nationkey = o_custkey % 40
LEFT JOIN (SELECT s_suppkey % 100 AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) c ON c.k = o_custkey % 100""")
def prioritized_lookup(t: Tables) -> DataFrame:
    board = t.supplier.select(F.col("s_suppkey").alias("k1"), F.col("s_suppkey").alias("board"))
    tenant = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("k2")).agg(F.min("s_suppkey").alias("tenant"))
    name = t.supplier.groupBy((F.col("s_suppkey") % 100).alias("k3")).agg(F.min("s_suppkey").alias("name"))
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("k1"), (F.col("o_custkey") % 40).alias("k2"), (F.col("o_custkey") % 100).alias("k3"))
    found = rows.join(board, "k1", "left").join(tenant, "k2", "left").join(name, "k3", "left")
    how = F.when(F.col("board").isNotNull(), "board").when(F.col("tenant").isNotNull(), "tenant").when(F.col("name").isNotNull(), "name").otherwise("none")
    return found.select("o_orderkey", F.coalesce("board", "tenant", "name").alias("target"), how.alias("matched"))


@query("""SELECT o_orderkey, o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS known FROM orders""")
def known_flag(t: Tables) -> DataFrame:
    known = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"), F.lit(True).alias("known")).distinct()
    return t.orders.select("o_orderkey", "o_custkey").join(known, "o_custkey", "left").select("o_orderkey", F.coalesce("known", F.lit(False)).alias("known"))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0),
 b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice + (o_orderkey % 4) AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0)
SELECT count(*) AS both_sides, count(*) FILTER (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus) AS status_changed, count(*) FILTER (a.o_totalprice IS DISTINCT FROM b.o_totalprice) AS price_changed,
 (SELECT count(*) FROM a) - count(*) AS gone FROM a JOIN b USING (o_orderkey)""")
def snapshot_compare(t: Tables) -> DataFrame:
    from ..operators.reports import compare_snapshots

    old = t.orders.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") + F.col("o_orderkey") % 4).alias("price"))
    return compare_snapshots(old, new, "o_orderkey", ["status", "price"])


# Identity


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate = o.o_orderdate AND p.o_orderkey > o.o_orderkey)
 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus <> 'P' AND CASE WHEN p.o_orderkey % 9 <> 0 THEN floor(p.o_totalprice / 10) END = CASE WHEN o.o_orderkey % 9 <> 0 THEN floor(o.o_totalprice / 10) END AND p.o_orderkey > o.o_orderkey)
 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus <> 'P' AND p.o_custkey = o.o_custkey AND p.o_orderdate = o.o_orderdate AND p.o_orderkey > o.o_orderkey)""")
def dedup_keep_latest(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("url", F.when(F.col("o_orderkey") % 9 != 0, F.floor(F.col("o_totalprice") / 10)))
    first = dedup.keep_latest(rows, "o_orderkey", [["o_custkey", "o_orderdate"]])
    # The population that suppresses may hold rows that are not shown themselves, and leave out others.
    later = rows.where("o_orderstatus <> 'P'")
    for key in (["url"], ["o_custkey", "o_orderdate"]):
        last = later.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max("o_orderkey").alias("_last"))
        match = F.col("_last") > F.col("o_orderkey")
        for k in key:
            match = match & (F.col(k) == F.col(f"_{k}"))
        first = first.join(last, match, "left_anti")
    return first.select("o_orderkey")


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate = o.o_orderdate AND p.o_orderkey > o.o_orderkey)
 AND NOT EXISTS (SELECT 1 FROM orders p WHERE CASE WHEN p.o_orderkey % 9 <> 0 THEN floor(p.o_totalprice / 10) END = CASE WHEN o.o_orderkey % 9 <> 0 THEN floor(o.o_totalprice / 10) END AND p.o_orderkey > o.o_orderkey)""")
def dedup_by_window(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("url", F.when(F.col("o_orderkey") % 9 != 0, F.floor(F.col("o_totalprice") / 10)))
    return dedup.keep_latest_by_window(rows, "o_orderkey", [["o_custkey", "o_orderdate"], ["url"]]).select("o_orderkey")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1 AS is_duplicate FROM orders""")
def first_seen_dedup(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("pair", F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"))
    return dedup.first_seen(rows, "o_orderkey", ["pair"]).select("o_orderkey", "is_duplicate")


@query("""WITH g AS (SELECT count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY text, lang HAVING count(*) > 1) SELECT * FROM g""")
def identical_groups(t: Tables) -> DataFrame:
    return dedup.identical_groups(t.documents, ["text", "lang"], "doc_id").select("members", "first_id")


@query("""WITH c AS (SELECT c_custkey, lower(trim(CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END)) || (c_custkey % 50) AS folded,
 c_acctbal > 5000 AS verified, c_custkey % 3 <> 0 AS mixed FROM customer)
SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY folded ORDER BY verified DESC, mixed DESC, c_custkey) AS canonical_id FROM c""")
def case_company_merge(t: Tables) -> DataFrame:
    from ..operators.state import canonical_companies

    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment")), (F.col("c_custkey") % 50).cast("string"))
    rows = t.customer.select(F.col("c_custkey").alias("id"), name.alias("name"), (F.col("c_acctbal") > 5000).alias("verified"), (F.col("c_custkey") % 3 != 0).alias("mixed"))
    return canonical_companies(rows, mixed=F.col("mixed")).select(F.col("id").alias("c_custkey"), "canonical_id")


@query("""
WITH t AS (SELECT doc_id AS id, text, trim(regexp_replace(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), '\\s+', ' ', 'g')) AS plain FROM documents),
 c AS (SELECT id, text, plain, min(id) OVER (PARTITION BY plain) AS rep FROM t WHERE plain <> ''),
 r AS (SELECT id, length(plain) AS n, list_distinct(regexp_extract_all(plain, '[a-z0-9]{3,}')) AS words FROM c WHERE id = rep),
 w AS (SELECT id, n, len(words) AS k, unnest(words) AS word FROM r WHERE len(words) > 0),
 p AS (SELECT a.id AS a_id, b.id AS b_id, any_value(a.k) AS ka, any_value(b.k) AS kb, count(*) AS both_have FROM w a JOIN w b ON a.word = b.word AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) AND least(a.k, b.k) >= 0.85 * greatest(a.k, b.k) GROUP BY 1, 2),
 q AS (SELECT DISTINCT id, upper(unnest(regexp_extract_all(text, '\\b[pP]-[0-9]{2,6}\\b'))) AS code FROM c),
 f AS (SELECT id, min(id) OVER (PARTITION BY code) AS least FROM q)
SELECT a_id, b_id, 'tokens' AS via FROM p WHERE both_have >= 0.85 * (ka + kb - both_have)
UNION ALL SELECT rep, id, 'text' FROM c WHERE id <> rep
UNION ALL SELECT DISTINCT least, id, 'requisition' FROM f WHERE id <> least""")
def similar_documents(t: Tables) -> DataFrame:
    from ..operators.similarity import similar_pairs

    return similar_pairs(t.documents.select("doc_id", "text"), "doc_id", "text")


@query("""
WITH s AS (SELECT s_suppkey AS id, 'Acme ' || (s_suppkey % 40) || ' Inc.' AS company, 'src' || (s_suppkey % 3) AS source, 'Engineer' || CASE WHEN s_suppkey % 4 = 0 THEN ' Platform' ELSE '' END AS title,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2001-01-01' + INTERVAL (s_suppkey % 20) DAY END AS posted FROM supplier),
 k AS (SELECT id, regexp_replace(regexp_replace(lower(company), 'inc[.]?', '', 'g'), '[^a-z0-9]', '', 'g') AS ck, source, lower(title) AS title, posted FROM s)
SELECT a.id AS a_id, b.id AS b_id FROM k a JOIN k b ON a.ck = b.ck AND a.id < b.id AND a.source <> b.source
WHERE (contains(a.title, b.title) OR contains(b.title, a.title)) AND coalesce(abs(date_diff('second', a.posted, b.posted)) <= 7 * 86400, true)""")
def cross_source_pairs(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    rows = t.supplier.select(
        key.alias("id"),
        F.concat(F.lit("Acme "), (key % 40).cast("string"), F.lit(" Inc.")).alias("company"),
        F.concat(F.lit("src"), (key % 3).cast("string")).alias("source"),
        F.concat(F.lit("Engineer"), F.when(key % 4 == 0, " Platform").otherwise("")).alias("title"),
        F.when(key % 5 != 0, F.lit("2001-01-01").cast("timestamp") + F.make_dt_interval((key % 20).cast("int"))).alias("posted"),
    )
    return dedup.cross_source_suspects(rows, "id", "company", "source", "title", "posted").select("a_id", "b_id")


# State


@query("""
WITH old AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN o_orderdate + INTERVAL 4000 DAY ELSE o_orderdate END AS posted_at, o_orderstatus <> 'F' AS is_active,
   CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'old' END AS apply_url FROM orders WHERE o_orderkey % 3 <> 0),
 new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate - INTERVAL 5 DAY END AS posted_at, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'new' END AS apply_url FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, strftime(CASE WHEN n.o_orderkey IS NULL THEN o.posted_at WHEN o.o_orderkey IS NULL THEN n.posted_at WHEN NOT o.is_active THEN coalesce(n.posted_at, o.posted_at)
   WHEN o.posted_at > TIMESTAMP '2001-08-03' THEN coalesce(n.posted_at, o.posted_at) ELSE least(o.posted_at, n.posted_at) END, '%Y-%m-%d') AS posted_on,
  coalesce(n.apply_url, o.apply_url) AS apply_url, CASE WHEN n.o_orderkey IS NULL THEN o.is_active ELSE true END AS is_active, o.o_orderkey IS NULL AS created
FROM old o FULL JOIN new n USING (o_orderkey)""")
def upsert_policy(t: Tables) -> DataFrame:
    from ..operators.state import merged_posted_at

    shifted = lambda n: F.col("o_orderdate") + F.make_dt_interval(F.lit(n))
    key = F.col("o_orderkey")
    old_date = F.when(key % 6 == 0, F.lit(None)).when(key % 10 == 0, shifted(4000)).otherwise(F.col("o_orderdate"))
    old = t.orders.where("o_orderkey % 3 <> 0").select(key, old_date.alias("old_posted"), (F.col("o_orderstatus") != "F").alias("old_active"), F.when(key % 4 != 0, "old").alias("old_url"), F.lit(True).alias("was"))
    new = t.orders.where("o_orderkey % 2 = 0").select(key, F.when(key % 7 != 0, shifted(-5)).alias("new_posted"), F.when(key % 5 != 0, "new").alias("new_url"), F.lit(True).alias("seen"))
    both = old.join(new, "o_orderkey", "full")
    posted = F.when(F.col("seen").isNull(), F.col("old_posted")).when(F.col("was").isNull(), F.col("new_posted")).otherwise(merged_posted_at(AS_OF, F.col("old_posted"), F.col("new_posted"), F.col("old_active")))
    return both.select("o_orderkey", F.date_format(posted, "yyyy-MM-dd").alias("posted_on"), F.coalesce("new_url", "old_url").alias("apply_url"), F.when(F.col("seen").isNull(), F.col("old_active")).otherwise(True).alias("is_active"), F.col("was").isNull().alias("created"))


@query("""
WITH state AS (SELECT o_orderkey AS id, o_custkey % 20 AS company, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey END AS source_job_id FROM orders WHERE o_orderstatus <> 'F'),
 listed AS (SELECT o_custkey % 20 AS company, o_orderkey AS source_job_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 20 <> 3)
SELECT s.id FROM state s WHERE CASE WHEN NOT EXISTS (SELECT 1 FROM listed l WHERE l.company = s.company) THEN true WHEN s.source_job_id IS NULL THEN false
 ELSE NOT EXISTS (SELECT 1 FROM listed l WHERE l.company = s.company AND l.source_job_id = s.source_job_id) END""")
def tombstone(t: Tables) -> DataFrame:
    from ..operators.state import unlisted

    company = (F.col("o_custkey") % 20).alias("company")
    state = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), company, F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderkey")).alias("source_job_id"))
    listed = t.orders.where("o_orderkey % 5 <> 0 AND o_custkey % 20 <> 3").select(company, F.col("o_orderkey").alias("source_job_id"))
    return unlisted(state, listed, ["company"]).select("id")


@query("""
WITH g AS (SELECT o_custkey % 97 AS company, count(*) AS active, count(*) FILTER (o_orderstatus = 'P') AS gone, count(*) FILTER (o_orderstatus <> 'P' AND o_custkey % 97 <> 5) AS listed FROM orders GROUP BY 1),
 runs AS (SELECT user_id % 97 AS company, value, row_number() OVER (PARTITION BY user_id % 97 ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type IN ('view', 'click')),
 prior AS (SELECT company, count(*) AS n, count(*) FILTER (abs(floor(value) % 30 - 15) <= 9) AS alike FROM runs WHERE nth <= 2 GROUP BY 1)
SELECT company, active, gone, (gone > 0 AND (listed = 0 OR (gone >= 3 AND gone / active >= 0.33))) AS suspicious,
 (gone > 0 AND (listed = 0 OR (gone >= 3 AND gone / active >= 0.33))) AND NOT coalesce(n >= 2 AND alike = n, false) AS suppressed FROM g LEFT JOIN prior USING (company)""")
def drop_guard(t: Tables) -> DataFrame:
    from ..operators.state import suspicious_drop

    company = (F.col("o_custkey") % 97).alias("company")
    counted = t.orders.groupBy(company).agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("o_orderstatus") == "P").alias("gone"), F.count_if((F.col("o_orderstatus") != "P") & (F.col("o_custkey") % 97 != 5)).alias("listed"))
    order = Window.partitionBy("company").orderBy(F.desc("ts"), F.desc("event_id"))
    runs = t.events.where(F.col("event_type").isin("view", "click")).select((F.col("user_id") % 97).alias("company"), "value", "ts", "event_id").withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    prior = runs.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.floor("value") % 30 - 15) <= 9).alias("alike"))
    drop = suspicious_drop(F.col("active"), F.col("gone"), F.col("listed"), ratio=0.33)
    confirmed = F.coalesce((F.col("n") >= 2) & (F.col("alike") == F.col("n")), F.lit(False))
    return counted.join(prior, "company", "left").select("company", "active", "gone", drop.alias("suspicious"), (drop & ~confirmed).alias("suppressed"))


@query("""
WITH target AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 3), stored AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 2)
SELECT (SELECT count(*) FROM (SELECT * FROM target EXCEPT SELECT * FROM stored)) AS added, (SELECT count(*) FROM (SELECT * FROM stored EXCEPT SELECT * FROM target)) AS removed,
 (SELECT count(*) FROM (SELECT * FROM stored INTERSECT SELECT * FROM target)) AS kept""")
def bridge_sync(t: Tables) -> DataFrame:
    from ..operators.state import sync_counts

    pair = ["l_orderkey", "l_partkey"]
    return sync_counts(t.lineitem.where("l_linenumber >= 2").select(*pair), t.lineitem.where("l_linenumber <= 3").select(*pair), pair)


@query("""WITH b AS (SELECT o_custkey % 50 AS company, count(*) AS raw, count(DISTINCT o_orderkey // 2) AS ids, count(*) FILTER (o_orderstatus = 'F') AS bad FROM orders GROUP BY 1)
SELECT company, raw = ids AND bad = 0 AS trustworthy, CASE WHEN bad >= raw OR (raw >= 5 AND bad / raw >= 0.8) THEN 'failed' WHEN bad > 0 THEN 'partial_success' ELSE 'success' END AS status FROM b""")
def batch_status(t: Tables) -> DataFrame:
    from ..operators.state import systemic_failure

    counted = t.orders.groupBy((F.col("o_custkey") % 50).alias("company")).agg(F.count(F.lit(1)).alias("raw"), F.countDistinct(F.floor(F.col("o_orderkey") / 2)).alias("ids"), F.count_if(F.col("o_orderstatus") == "F").alias("bad"))
    status = F.when(systemic_failure(F.col("raw"), F.col("bad")), "failed").when(F.col("bad") > 0, "partial_success").otherwise("success")
    return counted.select("company", ((F.col("raw") == F.col("ids")) & (F.col("bad") == 0)).alias("trustworthy"), status.alias("status"))


# Text, search, scalar functions


@query("""SELECT doc_id, md5(translate(lower(text), 'àáâãäåāăąçćčďđèéêëēėęěğìíîïīįłñńňòóôõöøōőřśšşťùúûüūůűųýÿźżž-–—‑', 'aaaaaaaaacccddeeeeeeeegiiiiiilnnnoooooooorssstuuuuuuuuyyzzz    ')) AS folded_md5 FROM documents""")
def text_fold(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded_md5"))


@query("""SELECT page_id, md5(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS stripped_md5, length(html) AS n_chars FROM pages""")
def strip_tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.strip_tags(F.col("html")).cast("binary")).alias("stripped_md5"), F.length("html").cast("long").alias("n_chars"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])apache([^a-z0-9_]|$)') THEN 'Apache' END, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])gnu([^a-z0-9_]|$)') THEN 'GNU' END,
 CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])(mit|token)([^a-z0-9_]|$)') THEN 'MIT' END) AS skills FROM documents""")
def skills_from_text(t: Tables) -> DataFrame:
    edge = r"(?:^|[^a-z0-9_])(?:{0})(?:[^a-z0-9_]|$)"
    table = [("Apache", edge.format("apache")), ("GNU", edge.format("gnu")), ("MIT", edge.format("mit|token"))]
    return t.documents.select("doc_id", F.array_join(skills.matching(F.lower("text"), table), ",").alias("skills"))


@query("""SELECT doc_id FROM documents WHERE list_has_all(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'with', 'from'])""")
def token_and_search(t: Tables) -> DataFrame:
    from ..operators.search import contains_all

    return t.documents.where(contains_all(F.lower("text"), ["the", "with", "from"])).select("doc_id")


@query("""SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' of the ')""")
def phrase_search(t: Tables) -> DataFrame:
    from ..operators.search import contains_phrase

    return t.documents.where(contains_phrase(F.lower("text"), ["of", "the"])).select("doc_id")


@query(r"""SELECT doc_id FROM documents WHERE lower(text) LIKE '%100\%%' ESCAPE '\' OR lower(text) LIKE '%a\_b%' ESCAPE '\' OR lower(text) LIKE '%on%%%' """)
def literal_like(t: Tables) -> DataFrame:
    low = F.lower("text")
    literal = lambda x: low.like(f"%{text.like_literal(x)}%")
    return t.documents.where(literal("100%") | literal("a_b") | low.contains("on")).select("doc_id")


_PERIOD = "CASE l_linenumber % 5 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'week' WHEN 3 THEN 'day' ELSE 'hour' END"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, {_PERIOD} AS period, l_quantity * CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN 12 WHEN 2 THEN 52 WHEN 3 THEN 260 ELSE 2080 END AS annual FROM lineitem""")
def pay_annualize(t: Tables) -> DataFrame:
    period = F.expr(_PERIOD)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", period.alias("period"), pay.annualize(F.col("l_quantity"), period).alias("annual"))


@query(f"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity * (1 + l_partkey % 3000) END AS lo, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity * (l_suppkey % 50) * 100 END AS hi,
  CASE WHEN l_suppkey % 4 = 0 THEN 'JPY' ELSE 'USD' END AS cur, {_PERIOD} AS period FROM lineitem),
 w AS (SELECT *, CASE WHEN lo > 0 THEN lo END AS a, CASE WHEN hi > 0 THEN hi END AS b, CASE period WHEN 'year' THEN 1000 WHEN 'month' THEN 100 WHEN 'week' THEN 25 ELSE 5 END AS low_end,
  CASE period WHEN 'year' THEN 3000000 WHEN 'month' THEN 250000 WHEN 'week' THEN 60000 WHEN 'day' THEN 12000 ELSE 1500 END AS top FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NULL AND b IS NULL THEN 'no_amount' WHEN a > b THEN 'inverted' WHEN cur = 'JPY' THEN NULL
 WHEN coalesce(least(a, b), a, b) < low_end THEN CASE WHEN coalesce(greatest(a, b), a, b) <= 10 THEN 'placeholder' ELSE 'below_floor' END
 WHEN coalesce(greatest(a, b), a, b) > top THEN 'above_ceiling' WHEN b > 10 * a THEN 'extreme_spread' END AS problem FROM w""")
def pay_problem(t: Tables) -> DataFrame:
    lo = F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity") * (1 + F.col("l_partkey") % 3000))
    hi = F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity") * (F.col("l_suppkey") % 50) * 100)
    currency = F.when(F.col("l_suppkey") % 4 == 0, "JPY").otherwise("USD")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", pay.range_problem(lo, hi, currency, F.expr(_PERIOD)).alias("problem"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS canonical, lower(regexp_extract(url, '^[a-z]+://([^/?]*)', 1)) AS host,
 NOT contains(url, 'utm_') AS clean FROM pages""")
def page_urls(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", dedup.canonical_url(url).alias("canonical"), urls.host(url).alias("host"), (~F.contains(url, F.lit("utm_"))).alias("clean"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '(utm_[a-z]+|ref|source|gh_src|gclid|fbclid|trk|position)=[^&]*&?', '', 'g'), '[?&]+$', ''), '/+$', '') AS apply_url FROM pages""")
def apply_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.canonical_apply_url(F.col("url")).alias("apply_url"))


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 GROUP BY 1, 2""")
def json_props(t: Tables) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.withColumn("k", k).where("k >= 50").groupBy("event_type", (F.col("k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT doc_id, list_distinct([x]) AS one, x FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zàâçéèêëîïôùûü]+')) AS x FROM documents)),
 s AS (SELECT doc_id, count(*) FILTER (x IN ('le','la','les','des','et','pour','dans','est','une','par')) AS fr, count(*) FILTER (x IN ('the','and','of','to','in','for','is','with','that','are')) AS en FROM w GROUP BY 1)
SELECT doc_id, CASE WHEN fr >= 3 AND fr >= 2 * en THEN 'fr' WHEN en >= 3 AND en >= 2 * fr THEN 'en' ELSE 'unknown' END AS language
FROM (SELECT d.doc_id, coalesce(fr, 0) AS fr, coalesce(en, 0) AS en FROM documents d LEFT JOIN s USING (doc_id))""")
def language_scores(t: Tables) -> DataFrame:
    from ..functions.classify import language

    return t.documents.select("doc_id", language(F.col("text"), accents=0.0).alias("language"))


@query("""
SELECT 'short_text' AS metric, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE length(text) < 100 UNION ALL SELECT 'all_caps', count(*), min(doc_id) FROM documents WHERE text = upper(text)
UNION ALL SELECT 'has_license', count(*), min(doc_id) FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT 'length_differs', count(*), min(doc_id) FROM documents WHERE n_chars <> length(text)""")
def audit_metrics(t: Tables) -> DataFrame:
    from ..operators.reports import audit

    body = F.col("text")
    return audit(t.documents, "doc_id", {"short_text": F.length(body) < 100, "all_caps": body == F.upper(body), "has_license": F.contains(F.lower(body), F.lit("license")), "length_differs": F.col("n_chars") != F.length(body)})


# Extensions: event-time windows


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2""")
def events_daily(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "most")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, count(*) AS n FROM s GROUP BY user_id, nth""")
def events_session(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n")

"""Clusters of duplicate postings, as a list read in order makes them.

A posting joins the first cluster whose representative it duplicates: the same source and source id, or the same canonical URL. The
preferred of the two then represents the cluster. So what a posting joins depends on all before it that share a key with it,
directly or over others; postings that share none, however far, can be clustered apart.

Keys that no other posting has are dropped, and keys that always come together count as one. Then most postings share a single key with
their twins and make one cluster each, by an aggregation. Only where postings tie several keys together does the order matter; there the
runs of postings with the same keys are folded to one entry a block first, and the entries are read in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import DIRECT_SOURCES, canonical_url
from .staging import staged

#: Rows of the order that a block spans; runs inside it are folded by one task.
BLOCK_ROWS = 10_000


def same_posting(a: Column, b: Column) -> Column:
    """Two postings (structs of source_name, source_job_id, job_id, source_url) are one: same source and id, or same canonical URL.
    Blanks and nulls never match; a posting without a source id has its job id in its place."""
    mine, theirs = posting_keys(a), posting_keys(b)
    return F.coalesce(mine["id"] == theirs["id"], F.lit(False)) | F.coalesce(mine["url"] == theirs["url"], F.lit(False))


def posting_keys(p: Column) -> Column:
    """struct<id, url>: what a posting is known by; null where it says nothing."""
    own = F.coalesce(F.nullif(p["source_job_id"], F.lit("")), F.nullif(p["job_id"], F.lit("")))
    source = F.nullif(p["source_name"], F.lit(""))
    both = F.when(source.isNotNull() & own.isNotNull(), F.to_json(F.array(source, own)))
    return F.struct(both.alias("id"), F.nullif(canonical_url(p["source_url"]), F.lit("")).alias("url"))


def preference(p: Column) -> Column:
    """Larger is preferred: a direct source, a date, a newer date, a larger id as text."""
    shown = F.coalesce(F.nullif(p["id"].cast("string"), F.lit("")), p["job_id"], F.lit(""))
    return F.struct(F.coalesce(p["source_name"].isin(DIRECT_SOURCES), F.lit(False)).alias("direct"), F.coalesce(F.unix_micros(p["posted_at"]), F.lit(-(1 << 62))).alias("at"), shown.alias("name"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) over edges a, b, by smallest neighbours and shortcuts; a table a round, until nothing moves."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        nearer = labels.join(heard, "node").select("node", F.least("component", "least").alias("component"), F.col("component").alias("was"))
        up = nearer.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = staged(nearer.join(up, "component").select("node", F.least("component", "above").alias("component"), "was"))
        if jumped.where("component <> was").isEmpty():
            return jumped.select("node", "component")
        labels = jumped.select("node", "component")


def _fold(entries: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """first, cluster and component of each entry; a component's entries come together and in order. State: its representatives' keys and
    preferences, dropped with the component."""
    component = None
    for batch in entries:
        places = []
        for row in batch.itertuples(index=False):
            if row.component != component:
                component = row.component
                founded: list[int] = []  # by cluster: the place of its founder
                best: list[tuple] = []
                keys: list[tuple] = []
                holders: dict[str, set[int]] = {}  # clusters whose representative has the key
            mine = [k for k in (row.k1, row.k2) if k is not None]
            rank = (row.direct, row.at, row.name)
            open_ = set().union(*(holders.get(k, ()) for k in mine))
            if not open_:
                at = len(founded)
                founded.append(row.first)
                best.append(rank)
                keys.append(())
            else:
                at = min(open_)
            if not open_ or rank > best[at]:
                for k in keys[at]:
                    holders[k].discard(at)
                best[at], keys[at] = rank, tuple(mine)
                for k in mine:
                    holders.setdefault(k, set()).add(at)
            places.append(founded[at])
        yield pd.DataFrame({"component": batch["component"], "first": batch["first"], "cluster": pd.Series(places, index=batch.index, dtype="int64")})


def greedy_clusters(postings: DataFrame, order: str = "ordinal", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """order, cluster (the order of the posting that founded it) and is_representative of every posting.

    postings: id, job_id, source_name, source_job_id, source_url, posted_at and order, a number that no two share and that counts rows
    (gaps do no harm but for the size of blocks). Of postings that are equally preferred the earlier represents. Null or blank keys
    match nothing; no rows in, none out.
    """
    p = F.struct(*[F.col(c).alias(c) for c in ("id", "job_id", "source_name", "source_job_id", "source_url", "posted_at")])
    rows = staged(postings.select(F.col(order).alias("at_row"), posting_keys(p).alias("key"), preference(p).alias("pref")))
    kinds = ("id", "url")
    counted = {k: rows.where(F.col(f"key.{k}").isNotNull()).groupBy(F.col(f"key.{k}").alias(k)).agg(F.count(F.lit(1)).alias("n")).where("n > 1") for k in kinds}
    shared = rows.select("at_row", "pref", F.col("key.id").alias("id"), F.col("key.url").alias("url"))
    for k in kinds:
        known = counted[k].select(k, F.col("n").alias(f"n_{k}"))
        shared = shared.join(known, k, "left")  # hot keys are spread by the engine's skew join: the other side has a row a key
    name = lambda k: F.when(F.col(f"n_{k}").isNotNull(), F.concat(F.lit(f"{k}:"), F.sha2(F.col(k), 256)))
    shared = staged(shared.select("at_row", "pref", name("id").alias("k1"), name("url").alias("k2"), "n_id", "n_url"))
    pairs = shared.where("k1 IS NOT NULL AND k2 IS NOT NULL").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("n_id").alias("n1"), F.max("n_url").alias("n2"))
    pairs = staged(pairs)
    twins = pairs.where("n = n1 AND n = n2").select("k1", "k2")  # the two never come apart: one key
    ties = pairs.where("n < n1 OR n < n2")
    tied = staged(components(ties.select(F.col("k1").alias("a"), F.col("k2").alias("b"))))
    merged = shared.join(twins.select("k1", "k2", F.lit(True).alias("one")), ["k1", "k2"], "left").withColumn("k2", F.when(~F.coalesce("one", F.lit(False)), F.col("k2"))).drop("one")
    lead = F.coalesce("k1", "k2")
    merged = staged(merged.select("at_row", "pref", "k1", "k2", lead.alias("lead")).join(tied.select(F.col("node").alias("lead"), "component"), "lead", "left"))

    alone = merged.where("lead IS NULL").select("at_row", F.col("at_row").alias("cluster"), "pref")
    single = merged.where("lead IS NOT NULL AND component IS NULL")
    firsts = single.groupBy("lead").agg(F.min("at_row").alias("cluster"))
    single = single.join(firsts, "lead").select("at_row", "cluster", "pref")

    block = F.floor(F.col("at_row") / block_rows).cast("long")
    mixed = merged.where("component IS NOT NULL").select("at_row", "component", "k1", "k2", "pref", block.alias("block"))

    # Of a component's rows in a block, each stretch of the same keys is a run, known by its first row.
    order_in = Window.partitionBy("component", "block").orderBy("at_row")
    before = F.lag(F.struct("k1", "k2")).over(order_in)
    mixed = mixed.withColumn("new", ~before.eqNullSafe(F.struct("k1", "k2")))
    mixed = staged(mixed.select("at_row", "component", "k1", "k2", "pref", F.max(F.when(F.col("new"), F.col("at_row"))).over(order_in).alias("first")))
    ranked = F.struct("pref.direct", "pref.at", "pref.name", (-F.col("at_row")).alias("early"))
    entries = mixed.groupBy("component", "first", "k1", "k2").agg(F.max(ranked).alias("best")).select("component", "first", "k1", "k2", "best.direct", "best.at", "best.name")
    # A Python call reads many components: most are small.
    read = entries.repartition("component").sortWithinPartitions("component", "first")
    folded = read.mapInPandas(_fold, "component string, first long, cluster long")
    placed = mixed.join(folded, ["component", "first"]).select("at_row", "cluster", "pref")

    every = staged(alone.unionByName(single).unionByName(placed))
    best = every.groupBy("cluster").agg(F.max(F.struct("pref", (-F.col("at_row")).alias("early"))).alias("best")).select("cluster", (-F.col("best.early")).alias("at_best"))
    return every.join(best, "cluster").select(F.col("at_row").alias(order), "cluster", (F.col("at_row") == F.col("at_best")).alias("is_representative"))


def deduplicated(postings: DataFrame, order: str = "ordinal") -> DataFrame:
    """The representatives with all their columns; cluster says in which order the list would have them."""
    kept = greedy_clusters(postings, order).where("is_representative").select(order, "cluster")
    return postings.join(kept, order)

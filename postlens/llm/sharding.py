"""Sharding by k-d tree partitioning.

A node of the tree is split along its widest metadata dimension at the weighted median of bytes, found by
histograms that all executors add up and that close in on the cut, until every shard is a leaf. Equal texts
are one group, with the smallest metadata of its rows; a group stays whole unless it alone exceeds a
shard's share of the bytes, in which case it is dealt to salted parts by id. Every coordinate is an
integer whose low bits are a hash of the group, so no two groups tie.

Cases: a null text has size 1 and is a group of its own kind; null metadata sorts first; repeated rows are
separate rows with separate slots; clashing extra columns are not read; no rows in, none out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table, text_of

HISTOGRAM = 4096
LOW_BITS = 32
#: A cut is exact enough when the histogram's bucket holds this share of the node.
CLOSE = 0.0002
SLOT_BUCKETS = 512


def _coordinates(size: Column, low: Column) -> dict[str, Column]:
    """Metadata as 31-bit integers over 32 bits of hash."""

    def over(high: Column) -> Column:
        return (F.shiftleft(high.cast("long"), LOW_BITS)) + low

    def category(name: str) -> Column:
        return F.coalesce(F.shiftrightunsigned(F.xxhash64(F.lit(name), F.col(name)), 34).cast("long") + 1, F.lit(0).cast("long"))

    return {"size": over(F.floor(F.log2(size.cast("double")) * F.lit(float(1 << 25)))), "lang": over(category("lang")), "source": over(category("source"))}


def kd_shards(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("size", "lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; shards hold near-equal bytes."""
    text = text_of(text_col)
    known = {c.lower() for c in df.columns}
    meta = [(F.col(c) if c in known else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        *meta,
    )
    rows = stage_table(rows, "shard-rows")
    totals = rows.groupBy("group").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("members"), F.min("size").alias("one"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    totals = stage_table(totals, "shard-groups")
    total = totals.agg(F.sum("weight")).first()[0] or 0
    share = max(1, total // n_shards)
    # A group above a shard's share is dealt to parts of about a sixteenth of a share.
    parts = F.when(F.col("weight") > share, F.ceil(F.col("weight") * 16 / F.lit(share))).otherwise(F.lit(1)).cast("long")
    hot = totals.where(F.col("weight") > share).select("group", parts.alias("parts"))  # fewer than n_shards rows
    salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(F.lit("salt"), F.col("doc_id")), F.col("parts"))).otherwise(F.lit(0)).cast("long")
    rows = rows.select("doc_id", "size", "text_crc32", "group").join(F.broadcast(hot), "group", "left").withColumn("salt", salt).drop("parts")
    hot_parts = rows.join(F.broadcast(hot), "group", "left_semi").groupBy("group", "salt").agg(F.sum("size").alias("weight")).join(totals.drop("weight", "members"), "group")
    cold = totals.where(F.col("weight") <= share).select("group", F.lit(0).cast("long").alias("salt"), "weight", "one", "lang", "source")
    low = F.shiftrightunsigned(F.xxhash64("group", "salt"), LOW_BITS)
    units = cold.unionByName(hot_parts.select(*cold.columns))
    units = units.select("group", "salt", "weight", *[c.alias(f"at_{n}") for n, c in _coordinates(F.col("one"), low).items() if n in dims])
    units = stage_table(units, "shard-units")
    placed = units.select("group", "salt", _tree(units, n_shards, dims).alias("shard"))
    rows = rows.join(placed, ["group", "salt"])
    return _slots(rows)


def _tree(units: DataFrame, n_shards: int, dims: tuple[str, ...]) -> Column:
    """The shard of a unit as nested comparisons, one for each inner node of the tree."""
    edges = [f(f"at_{d}").alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max))]
    whole = units.agg(*edges).first()
    cuts: dict[tuple[int, int], dict] = {}

    def place(first: int, n: int) -> Column:
        if not (cut := cuts.get((first, n))):
            return F.lit(first)
        return F.when(F.col(f"at_{cut['dim']}") >= cut["cut"], place(first + n // 2, n - n // 2)).otherwise(place(first, n // 2))

    level = [(0, n_shards)] if whole[f"low_{dims[0]}"] is not None else []
    while level := [(first, n) for first, n in level if n > 1]:
        now = units.select(place(0, n_shards).alias("node"), "weight", *[f"at_{d}" for d in dims])
        found = {r["node"]: r for r in now.groupBy("node").agg(F.sum("weight").alias("weight"), *edges).collect()}
        ahead, new = [], {}
        for first, n in level:
            if r := found.get(first):  # a node without rows is one empty leaf
                width = lambda d, r=r: (r[f"high_{d}"] - r[f"low_{d}"]) / max(1, whole[f"high_{d}"] - whole[f"low_{d}"])
                dim = max(dims, key=width)
                new[first, n] = {"dim": dim, "low": r[f"low_{dim}"], "high": r[f"high_{dim}"] + 1, "goal": r["weight"] * (n // 2) / n, "before": 0, "weight": r["weight"]}
                ahead += [(first, n // 2), (first + n // 2, n - n // 2)]
        _close_in(now, new)
        cuts |= new
        level = ahead
    return place(0, n_shards).cast("int")


def _close_in(now: DataFrame, cuts: dict[tuple[int, int], dict]) -> None:
    """Sets each node's cut: histograms between low and high, narrowed to the bucket that holds the goal."""
    live = {first: c for (first, _), c in cuts.items()}
    while live:
        arms = []
        for first, c in live.items():
            c["step"] = -(-(c["high"] - c["low"]) // HISTOGRAM)
            at = f"at_{c['dim']}"
            arms.append(f"WHEN node = {first} AND {at} >= {c['low']} AND {at} < {c['high']} THEN ({at} - {c['low']}L) DIV {c['step']}L")
        buckets = now.select("node", "weight", F.expr(f"CASE {' '.join(arms)} END").alias("bucket")).where("bucket IS NOT NULL")
        seen: dict[int, list] = {}
        for r in buckets.groupBy("node", "bucket").agg(F.sum("weight").alias("weight")).collect():  # HISTOGRAM rows a node at most
            seen.setdefault(r["node"], []).append((r["bucket"], r["weight"]))
        for first, c in list(live.items()):
            total = c["before"]
            for bucket, weight in sorted(seen[first]):
                if total + weight >= c["goal"]:
                    break
                total += weight
            start = c["low"] + bucket * c["step"]
            if c["step"] == 1 or weight <= CLOSE * c["weight"]:
                c["cut"] = start if c["goal"] - total <= total + weight - c["goal"] else start + c["step"]
                del live[first]
            else:
                c["before"], c["low"], c["high"] = total, start, start + c["step"]


def _slots(rows: DataFrame) -> DataFrame:
    """A gapless place in the shard: rows of a shard are numbered in buckets, behind the counts of the buckets before."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "group"), F.lit(SLOT_BUCKETS)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # SLOT_BUCKETS rows a shard
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "group"))
    numbered = rows.withColumn("number", number)
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number") - 1).cast("long").alias("slot"))

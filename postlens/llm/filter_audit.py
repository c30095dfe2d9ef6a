"""How filters of a corpus overlap, by a Walsh-Hadamard transform.

Which of the five filters a document fails is a mask of five bits. One aggregation a part and label sums, for each of the
32 sets of filters, +1 where a document fails an even number of the set and -1 where odd. The inverse transform of
these sums is exact in integers and gives the number of documents of each mask; all orders of applying the filters,
what each removes in each place, and its Shapley value (a document that fails k filters counts 120 / k of the 120 orders
for each of them) follow from the 32 numbers.

Cases: a null text is the empty text; a null part is the empty string; a null id equals no other, so such a row neither
fails filter E nor makes another fail it, and has no label; rows that repeat with their id fail E only by a smaller id; an id of several labels
has each of them; null labels count as 0; other columns are not read; no rows in, none out.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, small_batches, stage_table, text_of

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = 120
MIN_WORDS = 200
#: Percent of words that must differ, and of code points that capitals may take.
DISTINCT, CAPITALS = 50, 2

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CONTINUED = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"


def own_failures(text: bytes) -> int:
    """The bits of filters A to D, which depend on the text alone."""
    words = text.split()
    few = len(words) < MIN_WORDS
    dull = 100 * len(set(words)) < DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > CAPITALS * len(text.translate(None, _CONTINUED))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return few | dull << 1 | loud << 2 | signs << 3


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, a 128-bit digest of the text and its mask of filters A to D."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(part_col).alias("part"), text_of(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["part"], T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            digests = pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(map(own_failures, texts), pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def masks(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, good, toxic and the whole mask of each measured row. Rows are narrow and meet others by their id, or by digest and
    id, so a text of many copies makes no large group."""
    with_id = rows.where(F.col("doc_id").isNotNull())
    firsts = with_id.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("digest", "doc_id", F.lit(True).alias("first"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = with_id.join(firsts, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    marks = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    copy = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    found = found.select("part", *marks, (F.col("mask") + copy).alias("mask"))
    return found.unionByName(rows.where(F.col("doc_id").isNull()).select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask"))


def _odd(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(b)) % 2


def parity_sums(found: DataFrame) -> DataFrame:
    """part, good, toxic and the array of the signed sums of each set of filters."""
    sums = [F.sum(1 - 2 * _odd(F.col("mask"), F.lit(u))).cast("long") for u in range(MASKS)]
    return found.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """part, and by mask the number of all its documents, of good and of toxic ones."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def inverse(s: Column) -> Column:
        signed = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda a, u: a + (1 - 2 * _odd(m, u)) * F.get(s, u))
        return F.transform(every, lambda m: (signed(m) / MASKS).cast("long"))

    one = sums.select("part", "good", "toxic", F.posexplode("sums").alias("set", "n"))
    of = lambda label: F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias(label)
    per_set = one.groupBy("part", "set").agg(F.sum("n").alias("n"), of("good"), of("toxic"))
    per_part = per_set.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("set", "n", "good", "toxic"))).alias("by_set"))  # MASKS entries
    per_part = per_part.select("part", *[F.col(f"by_set.{c}").alias(c) for c in ("n", "good", "toxic")])
    return per_part.select("part", *[let(F.col(c), inverse).alias(c) for c in ("n", "good", "toxic")])


def _steps() -> str:
    """Of each order and step: the filter's bit and those that came before it."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[x] for x in order), "step": k + 1, "bit": 1 << f, "before": sum(1 << x for x in order[:k])})
    return json.dumps(out)


def evaluate(found: DataFrame) -> DataFrame:
    """A row a part, order and step, from the cells."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def passing(by_mask: Column) -> Column:
        """By set of filters, what passes them all."""
        return F.transform(every, lambda s: F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.when(m.bitwiseAND(s) == 0, F.get(by_mask, m)).otherwise(0)))

    def shares(n: Column) -> Column:
        """By filter, how often its failures go by it, over all orders."""
        of = lambda bit: F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.when(m.bitwiseAND(bit) != 0, F.get(n, m) * (ORDERS / F.bit_count(m)).cast("long")).otherwise(0))
        return F.transform(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), of)

    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    one = found.select("part", "n", *[let(F.col(c), passing).alias(f"pass_{c}") for c in ("n", "good", "toxic")], let(F.col("n"), shares).alias("share"))
    one = one.select("part", "n", "pass_n", "pass_good", "pass_toxic", "share", F.inline(steps))
    after, place = F.col("bit").bitwiseOR(F.col("before")), F.log2("bit").cast("int")
    lost = lambda c: F.get(f"pass_{c}", F.col("before")) - F.get(f"pass_{c}", after)
    return one.select(
        "part",
        "filter_order",
        "step",
        F.get("pass_n", after).alias("kept"),
        lost("n").alias("removed"),
        (F.get("pass_n", F.lit(0)) - F.get("pass_n", F.col("bit")) - lost("n")).alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("share", place).alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    rows = stage_table(measured(df, id_col, text_col, part_col), "failures")  # read three times, a few dozen bytes a document
    return evaluate(cells(parity_sums(masks(rows, labels, id_col))))

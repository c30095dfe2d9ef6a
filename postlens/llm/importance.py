"""Importance resampling towards a target distribution.

A text's features are its words and longer runs of them, hashed to buckets. Each bucket gains by how much more of the
target's features it holds than of the corpus's; a text's weight is the sum over its features, looked up in one array.
Gumbel noise from a hash of the id turns the top of the weights into a draw without replacement. Scores are integers, so
counts of equal scores give every score's exact rank offset: coarse counts are summed from the top first, then the scores
of the bins that survive, and documents are ordered by id only within a score that survives.

Cases: a null or empty text has no features, weight 0, and is never drawn; a null id draws its noise as the empty id and
comes last in a tie; repeated rows take a rank each; an empty target or corpus leaves gains of smoothing alone; other columns are not read; no
rows in, none out.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage_table, text_of

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
#: Percent of the documents of MIN_WORDS words that are drawn.
PERCENT = 10
#: Bins of the first histogram of scores; the second holds the scores of one bin each.
BINS = 4096

#: A-Z as a-z, other ASCII but digits and letters as a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def bucket_array(text: bytes, max_words: int, n_buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of each feature, and how many words the text has."""
    words = text.translate(_FOLD).split()
    found = [np.fromiter(map(crc32, words), np.int64, len(words))]
    for n in range(2, max_words + 1):
        runs = max(0, len(words) - n + 1)
        found.append(np.fromiter((crc32(b" ".join(words[k : k + n])) for k in range(runs)), np.int64, runs))
    return np.concatenate(found) % n_buckets, len(words)


def bucket_counts(df: DataFrame, text_col: str = "text", max_words: int = 1, n_buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Tasks hand on n_buckets rows each at most, and so does the sum."""
    small_batches(df.sparkSession)

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(bucket_array(text, max_words, n_buckets)[0], minlength=n_buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    counts = np.zeros(n_buckets, np.int64)
    for r in df.select(text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of the shares that each bucket has in the target and in the corpus."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """1000 times a Gumbel variable, floored, from 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(df: DataFrame, gain: np.ndarray, max_words: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight and score of each row."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight")]])
    shared = spark.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        by_bucket = shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                buckets, n_words = bucket_array(text, max_words, len(by_bucket))
                out.append((len(buckets), n_words, int(by_bucket[buckets].sum())))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def rank_drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, bins: int = BINS) -> DataFrame:
    """scored, read several times, with rank: 1, 2, ... for the drawn rows by score and then id, null for the others."""
    spark, able = scored.sparkSession, F.col("n_words") >= min_words
    span = scored.where(able).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    wanted = span["n"] * percent // 100
    unranked = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", unranked)
    width = (span["high"] - span["low"]) // bins + 1
    bin_of = F.floor((F.col("score") - span["low"]) / F.lit(width)).cast("long")
    coarse = np.zeros(bins + 1, np.int64)
    for r in scored.where(able).groupBy(bin_of.alias("bin")).count().collect():  # bins rows at most
        coarse[r["bin"]] = r["count"]
    above = np.concatenate((np.cumsum(coarse[::-1])[::-1][1:], [0]))  # documents in the bins above each
    last = int(np.flatnonzero(above < wanted)[0])  # the lowest bin that is reached
    offsets = spark.createDataFrame([(k, int(above[k])) for k in range(last, bins + 1) if coarse[k]], "bin long, above long")
    fine = scored.where(able & (bin_of >= last)).groupBy(bin_of.alias("bin"), "score").agg(F.count(F.lit(1)).alias("n"))
    higher = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # scores of one bin: width rows at most
    fine = fine.withColumn("higher", F.coalesce(F.sum("n").over(higher), F.lit(0))).join(F.broadcast(offsets), "bin")
    fine = fine.select("score", (F.col("above") + F.col("higher")).alias("before")).where(F.col("before") < wanted)
    cutoff = fine.agg(F.min("score")).first()[0]
    drawn = able & (F.col("score") >= cutoff)
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())  # noise spreads copies over scores, so a score is small
    ranked = scored.where(drawn).join(fine, "score").withColumn("rank", F.col("before") + F.row_number().over(within))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(~drawn).select("*", unranked))


def resample(df: DataFrame, target: DataFrame, max_words: int = 1, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, n_buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank of every row."""
    gain = gains(bucket_counts(df, text_col, max_words, n_buckets), bucket_counts(target, target_col, max_words, n_buckets))
    return rank_drawn(stage_table(weigh(df, gain, max_words, seed, id_col, text_col), "weighed"), percent, min_words)

"""Scores of texts by a hashed maximum-entropy language model.

A token's probability is that of its class times that of the token within its class. Frequent words lie in classes of
equal size by rank, in which a softmax chooses; a rarer word's class is a hash of its ending, within which its count decides, and one
more share stands for all words never seen. The end of a text is a class of its own. So the probabilities of all words that
may follow sum to 1, whatever the vocabulary. The weights of both softmaxes are sums over features of the context,
hashed to rows: the word before, the one before that (a skip) and the pair of both.

Training texts are dealt to ROUNDS slices; each round takes one slice, in which every task adds up the observed and the
expected count of each weight over all its tokens. The sums meet in a tree of groups of bounded size. A weight moves by the gradient (observed less expected) over the
logarithmic mean of the two, times RATE, which stays finite and ends where both agree.

Counts of the most frequent words, KNOWN at most, are broadcast; all other words of a text meet the counts in a join.

Cases: a null or empty text is its end alone; a null id counts as not held out; without training texts every token is unknown;
repeated rows repeat and count again; other columns are not read; no rows in, none out.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage_table, text_of

#: Words that are broadcast with their counts.
KNOWN = 200_000
CLASS_WORDS = 64
FREQUENT_CLASSES = 16
ENDINGS = 15
MODELLED = CLASS_WORDS * FREQUENT_CLASSES
CLASSES = FREQUENT_CLASSES + ENDINGS + 1
END = MODELLED + ENDINGS  # the ids: modelled words by rank, endings, the end, and what stands before a text
START = END + 1
#: Rows of weights of each feature of the context alone, and of a feature with the class.
ROWS, CLASS_ROWS = 4096, 8192
CLASS_FEATURES, WORD_FEATURES = 3, 2
ROUNDS = 4
RATE, PRIOR = 0.5, 4.0
BLOCK = 256  # rows that are summed together
FAN = 64  # blocks that a group of the tree sums
CHUNK = 4096  # tokens computed at once
FEW = 64  # chunks whose observations are counted together
FLUSH = 200_000
NEVER = np.float32(-1e30)
LOG10 = math.log(10)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word as bytes, n) over all texts."""
    small_batches(df.sparkSession)

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text.lower().split())  # of bytes: A-Z, and the six blanks
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return df.select(text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Bounded: KNOWN words and a few numbers a class."""

    words: list[bytes]  # by falling count
    counts: np.ndarray
    texts: int  # of training
    total: int
    distinct: int
    rare_total: np.ndarray  # by ending, of the words that are not modelled
    rare_distinct: np.ndarray

    @property
    def modelled(self) -> int:
        return min(MODELLED, len(self.words))

    def class_bias(self) -> np.ndarray:
        n = np.zeros(CLASSES)
        np.add.at(n, np.arange(self.modelled) // CLASS_WORDS, self.counts[: self.modelled])
        n[FREQUENT_CLASSES : FREQUENT_CLASSES + ENDINGS] = self.rare_total
        n[-1] = self.texts
        used = np.arange(CLASSES) >= FREQUENT_CLASSES
        used[: (self.modelled + CLASS_WORDS - 1) // CLASS_WORDS] = True
        return np.where(used, np.log((n + 1) / (n.sum() + CLASSES)), NEVER).astype(np.float32)

    def word_bias(self) -> np.ndarray:
        n = np.full(MODELLED, -1.0)
        n[: self.modelled] = self.counts[: self.modelled]
        return np.where(n >= 0, np.log(n + 1.5), NEVER).astype(np.float32).reshape(FREQUENT_CLASSES, CLASS_WORDS)

    def rare_log10(self) -> np.ndarray:
        """What the count of a word that is not modelled, plus 1, is divided by, by ending."""
        return np.log10(self.rare_total + self.rare_distinct + 1)

    def base_log10(self) -> float:
        return math.log10(self.total + self.distinct + 1)


def ending(word: Column) -> Column:
    return F.crc32(F.substring(word, -2, 2)) % ENDINGS


def vocabulary(counts: DataFrame, texts: int, known: int = KNOWN) -> Vocabulary:
    """From all counts of words, which are read three times. Known are the words from the lowest step of counts on at which there
    are no more of them than wanted; steps are eighths of a power of two, so there are a few hundred, and no task sorts the words."""
    step = F.floor(8 * F.log2("n")).cast("int")
    steps = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    fits = np.cumsum([n for _, n in steps]) <= known
    lowest = [k for (k, _), fit in zip(steps, fits, strict=True) if fit]
    top = counts.where(step >= lowest[-1]).collect() if lowest else []  # known short rows at most
    if len(top) < MODELLED and len(lowest) < len(steps):  # the model's words are the same whatever is known
        top += counts.where(step == steps[len(lowest)][0]).orderBy(F.desc("n"), "word").limit(MODELLED - len(top)).collect()
    top.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    sums = {r["ending"]: r for r in counts.groupBy(ending(F.col("word")).alias("ending")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}  # ENDINGS rows
    total, distinct = (np.array([sums[e][c] if e in sums else 0 for e in range(ENDINGS)], np.int64) for c in ("n", "words"))
    every, n_words = int(total.sum()), int(distinct.sum())
    for r in top[:MODELLED]:
        e = crc32(bytes(r["word"])[-2:]) % ENDINGS
        total[e] -= r["n"]
        distinct[e] -= 1
    return Vocabulary([bytes(r["word"]) for r in top], np.array([r["n"] for r in top], np.int64), texts, every + texts, n_words + (texts > 0), total, distinct)


def encode(df: DataFrame, words: Vocabulary, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a text: its ids as unsigned 16-bit integers, sums over its known words, and the words beyond with their number."""
    spark = df.sparkSession
    small_batches(spark)
    slice_of = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.lit(ROUNDS))).cast("int").alias("slice")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), held.alias("held_out"), text_of(text_col).cast("binary").alias("text")).select("row", "doc_id", "held_out", slice_of, "text")
    beyond = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]))
    more = [T.StructField(*f) for f in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("rare", T.DoubleType()), ("ids", T.BinaryType()), ("beyond", beyond))]
    schema = T.StructType([*rows.schema.fields[:4], *more])
    shared = spark.sparkContext.broadcast(words)  # bounded, see Vocabulary

    def run(batches):
        known: Vocabulary = shared.value
        place = {w: k for k, w in enumerate(known.words)}
        ids_of = np.arange(len(known.words) + 1)
        ids_of[MODELLED:-1] = MODELLED + np.fromiter((crc32(w[-2:]) % ENDINGS for w in known.words[MODELLED:]), np.int64, len(known.words) - known.modelled)
        base_of = np.append(np.log10(known.counts + 1), 0.0)
        below = known.rare_log10()
        rare_of = np.zeros(len(base_of))
        rare_of[MODELLED:-1] = base_of[MODELLED:-1] - below[ids_of[MODELLED:-1] - MODELLED]
        end_base = math.log10(known.texts + 1)
        for batch in batches:
            out = []
            for text in batch.column(4).to_pylist():
                found = text.lower().split()
                at = np.fromiter(map(place.get, found, [-1] * len(found)), np.int64, len(found))
                ids, unknown = ids_of[at], np.flatnonzero(at < 0)
                rest = [found[k] for k in unknown.tolist()]
                ids[unknown] = np.fromiter((MODELLED + crc32(w[-2:]) % ENDINGS for w in rest), np.int64, len(rest))
                ids = np.append(ids, END).astype("<u2")
                rare = float(rare_of[at].sum())
                base = float(base_of[at].sum()) + end_base
                out.append((len(ids), len(found) - len(rest) + (known.texts > 0), base, rare, ids.tobytes(), list(Counter(rest).items())))
            n, n_known, base, rare, ids, rest = zip(*out, strict=True) if out else ((),) * 6
            flat = [pa.array([x[k] for r in rest for x in r], kind) for k, kind in ((0, pa.binary()), (1, pa.int64()))]
            pairs = pa.StructArray.from_arrays(flat, names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rest]))), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, pa.float64()), pa.array(ids, pa.binary()), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class Weights:
    """Bounded by the constants above: single floats of (rows, classes) and (rows, words of a class)."""

    class_bias: np.ndarray
    word_bias: np.ndarray
    by_class: np.ndarray
    by_word: np.ndarray


def fresh_weights(words: Vocabulary) -> Weights:
    return Weights(words.class_bias(), words.word_bias(), np.zeros((CLASS_FEATURES * ROWS, CLASSES), np.float32), np.zeros((WORD_FEATURES * CLASS_ROWS, CLASS_WORDS), np.float32))


def _contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts and, in rows, the two before each; a text never sees another."""
    pad = np.full(2, START, np.int64)
    joined = np.concatenate([x for t in texts for x in (pad, t)])
    at = np.flatnonzero(joined != START)
    return joined[at], np.stack([joined[at - k] for k in (1, 2)])


def class_rows(before: np.ndarray) -> np.ndarray:
    pair = (before[0] * 40503 + before[1] * 2654435761) >> 7
    return np.stack([before[0] % ROWS, ROWS + before[1] % ROWS, 2 * ROWS + pair % ROWS])


def word_rows(before: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return np.stack([k * CLASS_ROWS + ((before[k] * 40503 + classes * 2654435761) >> 5) % CLASS_ROWS for k in range(WORD_FEATURES)])


def _softmax(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = bias + weights[rows[0]]
    for r in rows[1:]:
        x += weights[r]
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _each(texts: list[np.ndarray], w: Weights):
    """By chunk: the place of the chunk; class, rows and probabilities of all classes; which tokens are modelled words, and of these the same."""
    ids, before = _contexts(texts)
    for low in range(0, len(ids), CHUNK):
        x, b = ids[low : low + CHUNK], before[:, low : low + CHUNK]
        classes = np.where(x < MODELLED, x // CLASS_WORDS, x - MODELLED + FREQUENT_CLASSES)
        rows = class_rows(b)
        words = np.flatnonzero(x < MODELLED)
        inner = word_rows(b[:, words], classes[words])
        yield low, classes, rows, _softmax(w.class_bias, w.by_class, rows), words, x[words] % CLASS_WORDS, inner, _softmax(w.word_bias[classes[words]], w.by_word, inner)


class Tally:
    """What was observed and expected of a table of weights. Observations are kept as places until there are many."""

    def __init__(self, weights: np.ndarray):
        self.width = weights.shape[1]
        self.observed, self.expected = np.zeros(weights.size, np.float32), np.zeros(weights.shape, np.float32)
        self.places: list[np.ndarray] = []

    def add(self, rows: np.ndarray, chosen: np.ndarray, p: np.ndarray) -> None:
        if not len(chosen):  # a stretch without any modelled word
            return
        self.places.append((rows * self.width + chosen).reshape(-1))
        if len(self.places) > FEW:
            self.count()
        for r in rows:
            order = np.argsort(r.astype(np.uint16), kind="stable")
            ranked = r[order]
            starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            self.expected[ranked[starts]] += np.add.reduceat(p[order], starts, axis=0)

    def count(self) -> None:
        if self.places:
            self.observed += np.bincount(np.concatenate(self.places), minlength=len(self.observed))
            self.places = []

    def blocks(self, first: int):
        """(block, its observed and expected counts) of the blocks that hold any."""
        self.count()
        observed = self.observed.reshape(self.expected.shape)
        for k in range(len(observed) // BLOCK):
            part = np.stack([observed[k * BLOCK : (k + 1) * BLOCK], self.expected[k * BLOCK : (k + 1) * BLOCK]])
            if part.any():
                yield first + k, part.tobytes()


def log_likelihoods(texts: list[np.ndarray], w: Weights) -> np.ndarray:
    """Log10 probability of each text's classes and modelled words."""
    lengths = np.array([len(t) for t in texts])
    if not len(texts):
        return np.zeros(0)
    out = np.empty(int(lengths.sum()))
    for low, classes, _, p, words, places, _, q in _each(texts, w):
        part = np.log(np.maximum(p[np.arange(len(classes)), classes], 1e-37)).astype(np.float64)
        part[words] += np.log(np.maximum(q[np.arange(len(words)), places], 1e-37))
        out[low : low + len(part)] = part
    return np.add.reduceat(out, np.concatenate(([0], np.cumsum(lengths)[:-1]))) / LOG10  # no text is without its end


def _summed(blocks: DataFrame, parts: int) -> DataFrame:
    """Sums of blocks of the same name, from parts sources, FAN at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float32) for x in table["data"].to_pylist()], axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"block": table["block"][:1], "source": table["group"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    while True:
        parts = -(-parts // FAN)
        blocks = blocks.select("block", F.floor(F.col("source") / FAN).cast("long").alias("group"), "data").groupBy("block", "group").applyInArrow(add, "block int, source long, data binary")
        if parts <= 1:
            return blocks


def train(encoded: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after one pass over the training texts, a slice a round."""
    w = fresh_weights(words)
    for k in range(rounds):
        _update(encoded.where(F.col("slice") == k).select("ids"), w)
    return w


def _update(rows: DataFrame, w: Weights) -> None:
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        now: Weights = shared.value
        by_class, by_word = Tally(now.by_class), Tally(now.by_word)
        for batch in batches:
            if texts := [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(0).to_pylist()]:
                for _, classes, rows, p, _, places, inner, q in _each(texts, now):
                    by_class.add(rows, classes, p)
                    by_word.add(inner, places, q)
        source = TaskContext.get().partitionId()
        for b, x in (*by_class.blocks(0), *by_word.blocks(len(now.by_class) // BLOCK)):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([source], pa.int64()), pa.array([x], pa.binary())], names=["block", "source", "data"])

    gathered = _summed(rows.mapInArrow(run, "block int, source long, data binary"), rows.rdd.getNumPartitions())
    n_class = len(w.by_class) // BLOCK
    for r in gathered.select("block", "data").toLocalIterator():  # as many blocks as the weights have
        weights, k = (w.by_class, r["block"]) if r["block"] < n_class else (w.by_word, r["block"] - n_class)
        seen, expected = np.frombuffer(r["data"], np.float32).reshape(2, BLOCK, -1)
        weights[k * BLOCK : (k + 1) * BLOCK] += RATE * np.log((seen + PRIOR) / (expected + PRIOR))
    shared.destroy()


def score(encoded: DataFrame, counts: DataFrame, words: Vocabulary, w: Weights) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base_score and score of each encoded text."""
    spark = encoded.sparkSession
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare"]
    rows = encoded.select(*kept, "ids")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("modelled", T.DoubleType())])
    shared = spark.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(log_likelihoods(texts, shared.value), pa.float64())], names=schema.names)

    below = F.get(F.array(*[F.lit(float(x)) for x in words.rare_log10()]), ending(F.col("word")).cast("int"))
    count = F.coalesce(F.col("count"), F.lit(0))
    base = F.log10(count + 1.0)
    beyond = encoded.where(F.size("beyond") > 0).select("row", F.inline("beyond")).join(counts.select("word", F.col("n").alias("count")), "word", "left")
    beyond = beyond.groupBy("row").agg(F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * base).alias("more_base"), F.sum(F.col("n") * (base - below)).alias("more_rare"))
    found = rows.mapInArrow(run, schema).join(beyond, "row", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    base_score = F.col("base") + more("more_base") - F.col("n_tokens") * words.base_log10()
    return found.select("row", "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"), base_score.alias("base_score"), (F.col("modelled") + F.col("rare") + more("more_rare")).alias("score"))


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; held-out rows teach nothing."""
    held = held_out(id_col)
    counts = stage_table(word_counts(df.where(~held), text_col), "words")
    words = vocabulary(counts, df.where(~held).count(), known)
    encoded = stage_table(encode(df, words, held, id_col, text_col), "encoded", by="slice")
    found = score(encoded, counts, words, train(encoded, words, rounds))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")

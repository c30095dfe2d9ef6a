"""Toxicity with noisy-channel deobfuscation.

A character language model is counted over every text. A word that looks disguised (digits or signs for
letters, letters spelled apart, letters drawn out) becomes a lattice of the characters it may stand for, and
Viterbi search finds the likeliest reading under the model and the channel's costs. Words of the restored
text and their beginnings are weighed by labelled texts; a text's score is the logistic of the prior, its
weightiest word, and half the weight of each other.

Cases: a null or empty text has no words and scores the prior; null labels teach nothing, of several labels
of an id the largest counts; without labels every score is 0.5 times the neutral prior; repeated rows repeat;
other columns are not read; no rows in, none out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of

#: Labelled rows that weights are learned from at most, the first by a hash of the id.
FIT_ROWS = 20_000
#: A feature counts if its log odds reach this much and chance alone would give such counts to few of all features
#: seen: the log likelihood ratio must exceed the log of their number by SURE.
MIN_WEIGHT = 4.5
SURE = 2.0
PREFIXES = (4, 5, 6)
ORDER = 4
SYMBOLS = 28  # a-z, anything else inside a word, and the space between words
FLUSH = 200_000
REMEMBERED = 300_000

#: What a sign may stand for.
DISGUISES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
SUBSTITUTE, DRAWN_OUT, SEPARATOR = -1.0, -0.7, -1.5

_LETTER = "a-zß-öø-ÿ"
_EDGES = re.compile(rf"^[^{_LETTER}0-9]+|[^{_LETTER}0-9]+$")
_ENDS = re.compile(rf"^[^{_LETTER}0-9@$!|+]+|[^{_LETTER}0-9@$|+]+$")
_SIGNS = re.compile(r"[^.,;:!?\"'()\[\]\-]")
_PLAIN = re.compile(rf"[{_LETTER}]+")
_DRAWN = re.compile(r"(.)\1\1")
_APART = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|])(?:[ .\-_*][^\W\s_]|[ .\-_*][@$!|]){2,}(?![^\s.,;:?])")


def _symbols(data: bytes) -> np.ndarray:
    table = np.full(256, 26, np.int64)
    table[[ord(c) for c in " \t\n\r\x0b\x0c"]] = 27
    for k in range(26):
        table[97 + k] = table[65 + k] = k
    return table[np.frombuffer(data, np.uint8)]


def count_grams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): runs of ORDER symbols in all texts; a worker adds up what it has seen before it hands on."""
    small_batches(df.sparkSession)

    def run(batches):
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = _symbols(b"   " + text.encode() + b" ")
                grams = np.zeros(len(s) - ORDER + 1, np.int64)
                for k in range(ORDER):
                    grams = grams * SYMBOLS + s[k : len(s) - ORDER + 1 + k]
                if len(grams) > len(total) // 8:
                    total += np.bincount(grams, minlength=len(total))
                else:
                    np.add.at(total, grams, 1)
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 100_000):
            part = seen[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], names=["gram", "n"])

    return df.select(text_of(text_col).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of the last symbol of each gram; SYMBOLS ** ORDER single floats, whatever the input."""
    counts = np.zeros(SYMBOLS**ORDER)
    for r in count_grams(df, text_col).toLocalIterator():  # SYMBOLS ** ORDER rows at most
        counts[r["gram"]] = r["n"]
    counts = counts.reshape(-1, SYMBOLS)
    shorter = counts.reshape(SYMBOLS, -1, SYMBOLS).sum(0)
    low = (shorter + 0.1) / (shorter.sum(1, keepdims=True) + 0.1 * SYMBOLS)
    high = (counts + 2 * np.tile(low, (SYMBOLS, 1))) / (counts.sum(1, keepdims=True) + 2)
    return np.log(high).astype(np.float32).reshape(-1)


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest reading of a disguised word: Viterbi over the last ORDER - 1 symbols."""
    step, span = SYMBOLS, SYMBOLS ** (ORDER - 1)
    start = 27 * (SYMBOLS**2 + SYMBOLS + 1)
    # A state is the context and the last character written; it keeps its best score and what was written, as a chain from the end.
    states: dict[tuple[int, str], tuple[float, tuple | None]] = {(start, ""): (0.0, None)}
    for at, c in enumerate(word):
        drawn_out = word[max(0, at - 2) : at + 1] == 3 * c or word[at - 1 : at + 2] == 3 * c or word[at : at + 3] == 3 * c
        if _PLAIN.fullmatch(c):
            options = [(c, 0.0)]
        else:
            options = [(x, SUBSTITUTE) for x in DISGUISES.get(c, "")]
            options.append(("", SEPARATOR if not c.isdigit() else 2 * SEPARATOR) if len(word) > 1 else (c, 0.0))
        ahead: dict[tuple[int, str], tuple[float, tuple | None]] = {}
        for (context, last), (score, out) in states.items():
            for x, cost in options:
                if x == "":
                    key, value = (context, last), (score + cost, out)
                else:
                    gram = context * step + (ord(x) - 97 if "a" <= x <= "z" else 26)
                    key, value = (gram % span, x), (score + cost + float(model[gram]), (x, out))
                if key not in ahead or value[0] > ahead[key][0]:
                    ahead[key] = value
                if x and x == last and drawn_out:
                    key, value = (context, last), (score + cost + DRAWN_OUT, out)
                    if key not in ahead or value[0] > ahead[key][0]:
                        ahead[key] = value
        states = ahead
    finish = lambda kv: kv[1][0] + float(model[kv[0][0] * step + 27])
    out, chain = [], max(sorted(states.items(), key=lambda kv: kv[0]), key=finish)[1][1] if states else None
    while chain:
        x, chain = chain
        out.append(x)
    return "".join(reversed(out))


def readings(word: str, model: np.ndarray) -> set[str]:
    """The word as it stands without its edges and, if it looks disguised, as restored."""
    plain = _EDGES.sub("", word)
    if _PLAIN.fullmatch(plain) and not _DRAWN.search(plain) and not _SIGNS.search(word.replace(plain, "")):
        return {plain}
    out = {plain} if plain else set()
    inner = _ENDS.sub("", word)
    if len(inner) >= 3 and not inner.isdigit():  # a number says nothing that a model of letters could judge
        out.add(decode(inner, model))
        if _DRAWN.search(inner):
            out.add(_DRAWN.sub(r"\1", re.sub(r"(.)\1+", r"\1", inner)))
    return out - {""}


def features_of(word: str, model: np.ndarray) -> list[str]:
    out = []
    for reading in sorted(readings(word, model)):
        if len(reading) >= 3:
            out.append(reading if len(reading) <= 40 else f"long~{zlib.crc32(reading.encode()):x}~{len(reading)}")
        out += [f"{reading[:k]}~" for k in PREFIXES if len(reading) > k]
    return out


def words_of(text: str) -> set[str]:
    """Different words, and letters spelled apart put together."""
    text = text.lower()
    found = set(text.split())
    for m in _APART.finditer(text):
        found.add(re.sub(r"[ .\-_*]", "", m.group()))
    return found


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(df: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[dict[str, float], float]:
    """Weights of features and the prior's logit, from labelled rows that are not held out."""
    spark = df.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_labelled")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64(F.lit("fit"), "_labelled"), "_labelled").limit(fit_rows)  # fit_rows short rows, so it may be broadcast
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(known), F.col("_id") == F.col("_labelled"))
    rows = rows.select("text", "label", F.xxhash64("text").alias("_same")).dropDuplicates(["_same", "label"])  # of copies, one teaches
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        lm, memory, counts = shared.value, {}, defaultdict(lambda: [0, 0])

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["feature", "clean", "toxic"])
            counts.clear()
            memory.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[""][label] += 1
                seen = set()
                for word in words_of(text):
                    if (found := memory.get(word)) is None:
                        found = memory[word] = features_of(word, lm)
                    seen.update(found)
                for f in seen:
                    counts[f][label] += 1
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    counts = rows.select("text", "label").mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.persist()
    try:
        whole = counts.where("feature = ''").first()
        if not whole or not whole["toxic"]:
            return {}, 0.0
        toxic, clean = whole["toxic"], whole["clean"]
        weight = F.log((F.col("toxic") + 0.05) / (toxic + 1.0)) - F.log((F.col("clean") + 0.05) / (clean + 1.0))
        seen, share = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
        ratio = F.col("toxic") * F.log(F.col("toxic") / (seen * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (seen * max(1 - share, 1e-9)))).otherwise(0)
        known_features = max(1, counts.count())
        strong = counts.where((F.col("feature") != "") & (F.col("toxic") > 0)).withColumn("weight", weight).where((F.col("weight") >= MIN_WEIGHT) & (ratio >= math.log(known_features) + SURE))
        weights = {r["feature"]: float(r["weight"]) for r in strong.orderBy(F.desc("weight"), "feature").select("feature", "weight").collect()}
    finally:
        counts.unpersist()
    return weights, math.log((toxic + 0.5) / (clean + 0.5))


def score(df: DataFrame, model: np.ndarray, weights: dict[str, float], prior: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the words that raised it."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StringType()))])
    shared = spark.sparkContext.broadcast((model, weights))  # SYMBOLS ** ORDER floats, and weights of words that several toxic ones of FIT_ROWS texts hold

    def run(batches):
        lm, known = shared.value
        memory: dict[str, float] = {}
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column(1).to_pylist():
                total, why = prior, []
                for word in words_of(text):
                    weight = memory.get(word)
                    if weight is None:
                        if len(memory) > REMEMBERED:
                            memory.clear()
                        weight = memory[word] = max((known.get(f, 0.0) for f in features_of(word, lm)), default=0.0)
                    if weight:
                        why.append((weight, word))
                why.sort(reverse=True)
                total += sum(w for w, _ in why) / 2 + (why[0][0] / 2 if why else 0)
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, total)))))
                evidence.append(sorted(w for _, w in why))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.string()))], names=schema.names)

    return rows.mapInArrow(run, schema)

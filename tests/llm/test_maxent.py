"""The language model: proper probabilities, exact counts, an exact tree of sums, and hostile rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import maxent

R = random.Random(11)
SCHEMA = "doc_id long, text string, row string, ids string, word int, n int, slice string, held_out string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z", "h") for i, t in docs], SCHEMA)


def brute(docs):
    tokens = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in docs]
    counts = {}
    for _, held, found in tokens:
        for w in found if not held else []:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    return sorted([(str(i), held, len(found), sum(w in counts for w in found), total, round(sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in found), 6)) for i, held, found in tokens])


def digest(rows):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


def hostile():
    docs = [(0, None), (1, ""), (2, "One two  ONE\ttwo\x0bthree é É"), (None, "one null id"), (None, "one null id"), (3, "x" * 70_000), (4, "ha " * 20_000), (5, " \n "), (6, "  nbsp is no blank")]
    return [*docs, *[(k, f"never{k} one two seen{k % 3} twice{k // 2}") for k in range(7, 60)], (7, "again"), (7, "again")]


def test_counts_and_base_agree_with_brute_force(spark):
    rows = maxent.score_texts(frame(spark, hostile())).collect()
    assert digest(rows) == brute(hostile())
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


@pytest.mark.parametrize("docs", [[], [(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2), "held out alone")]])
def test_without_training_texts(spark, docs):
    assert digest(maxent.score_texts(frame(spark, docs)).collect()) == brute(docs)


def test_words_beyond_the_broadcast_ones_score_the_same(spark):
    docs = [(k, " ".join(f"w{int(R.paretovariate(0.4)) % 9000}" for _ in range(300))) for k in range(60)]
    few, all_of = (sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 2)) for r in maxent.score_texts(frame(spark, docs), known=n).collect()) for n in (maxent.MODELLED, maxent.KNOWN))
    assert few == all_of and [r[:3] for r in few] == sorted((int(b[0]), b[3], b[5]) for b in brute(docs))


def model(spark):
    docs = [(k, " ".join(R.choice(["the", "of"]) + f" w{int(R.paretovariate(0.5)) % 4000}" for _ in range(200))) for k in range(40)]
    counts = maxent.word_counts(frame(spark, docs)).persist()
    words = maxent.vocabulary(counts, len(docs))
    encoded = maxent.encode(frame(spark, docs), words, F.lit(False)).persist()
    return {bytes(r["word"]): r["n"] for r in counts.collect()}, words, encoded, maxent.train(encoded, words)


def test_probabilities_of_what_may_follow_sum_to_one(spark):
    counts, words, encoded, w = model(spark)
    ids = [np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in encoded.limit(3).collect()]
    contexts, before = maxent._contexts(ids)
    p = maxent._softmax(w.class_bias, w.by_class, maxent.class_rows(before)).astype(np.float64)
    total = p[:, -1].copy()
    for c in range(maxent.FREQUENT_CLASSES):
        q = maxent._softmax(np.repeat(w.word_bias[c][None], len(contexts), 0), w.by_word, maxent.word_rows(before, np.full(len(contexts), c)))
        inside = np.arange(maxent.CLASS_WORDS) + c * maxent.CLASS_WORDS < words.modelled
        total += p[:, c] * q[:, inside].sum(1)
    modelled = set(words.words[: words.modelled])
    for e in range(maxent.ENDINGS):
        rare = [n for x, n in counts.items() if x not in modelled and zlib.crc32(x[-2:]) % maxent.ENDINGS == e]
        assert (sum(rare), len(rare)) == (words.rare_total[e], words.rare_distinct[e])
        total += p[:, maxent.FREQUENT_CLASSES + e] * (sum(n + 1 for n in rare) + 1) / 10 ** words.rare_log10()[e]
    assert np.allclose(total, 1, atol=1e-4)


def test_training_raises_the_likelihood_of_every_slice(spark):
    _, words, encoded, w = model(spark)
    ids = [np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in encoded.collect()]
    assert maxent.log_likelihoods(ids, w).sum() > maxent.log_likelihoods(ids, maxent.fresh_weights(words)).sum() + 100


def test_texts_do_not_see_each_other():
    texts = [np.array([1, 2, maxent.END]), np.array([maxent.END]), np.array([3, maxent.END])]
    ids, before = maxent._contexts(texts)
    s = maxent.START
    assert ids.tolist() == [1, 2, maxent.END, maxent.END, 3, maxent.END]
    assert before.tolist() == [[s, 1, 2, s, s, 3], [s, s, 1, s, s, s]]


@pytest.mark.parametrize("parts", [1, 64, 65, 5000])
def test_tree_sums_every_source_once(spark, parts):
    rows = [(b, s, np.full(4, 1.0 + b, np.float32).tobytes()) for s in range(parts) for b in (0, 7)]
    found = maxent._summed(spark.createDataFrame(rows, "block int, source long, data binary"), parts).collect()
    assert sorted((r["block"], np.frombuffer(r["data"], np.float32).tolist()) for r in found) == [(0, [parts * 1.0] * 4), (7, [parts * 8.0] * 4)]


def test_a_stretch_without_modelled_words(spark):
    _, words, encoded, w = model(spark)
    rare = [np.full(3 * maxent.CHUNK, maxent.MODELLED + 1), np.array([maxent.END])]
    tally = maxent.Tally(w.by_word)
    for _, classes, _, _, found, places, inner, q in maxent._each(rare, w):
        assert not len(found)
        tally.add(inner, places, q)
    assert list(tally.blocks(0)) == [] and np.isfinite(maxent.log_likelihoods(rare, w)).all()

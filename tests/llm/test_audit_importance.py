"""Filter audit and importance resampling against brute force on hostile rows."""

import hashlib
import itertools
import math
import re
import zlib

import pytest

from postlens.llm import filter_audit, importance

SCHEMA = "doc_id long, text string, source string, digest string, mask int, rank long, score long, n string"
LONG = " ".join(f"word{k}" for k in range(300))


def rows():
    texts = [LONG, LONG, None, "", "", "A B C D " * 80, "same same " * 150, "x" * 50_000, LONG + " #", "ein Worté ß " * 20, "HELLO World 12 €", LONG]
    out = [(k, t, ["hot", None, "", "hot"][k % 4], "a", 1, 2, 3, "n") for k, t in enumerate(texts)]
    return [*out, out[0], out[8], (None, LONG, "hot", "a", 1, 2, 3, "n"), (None, "", None, "a", 1, 2, 3, "n"), *[(100 + k, f"{k % 7} " + "blue sky above the old town hall and many more words in a row so that there are twenty or so of them", "hot", "a", 1, 2, 3, "n") for k in range(40)]]


LABELS = [(0, 1, 0), (0, 0, 1), (1, None, None), (3, 1, 1), (6, 0, 1), (None, 1, 1), (999, 1, 1), (105, 1, 0), (106, 0, 1)]


def brute_audit(docs, labels):
    def fails(doc_id, text):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(i is not None and i < doc_id and (s or "") == t for i, s in docs_ids)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}

    docs_ids = [(r[0], r[1]) for r in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {r[2] or "" for r in docs}:
        found = [(r[0], fails(r[0], r[1])) for r in docs if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone, failing = [d for d in left if d[1][f]], [d for d in found if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[1].values()) == 1 for d in failing), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f]
    return {k: (*v[:-1], s) for k, v in out.items() for s in [sum(o[1] for (p, order, step), o in out.items() if p == k[0] and o[-1] == v[-1])]}


def test_audit_agrees_with_brute_force(spark):
    docs = rows()
    found = filter_audit.audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in found}
    assert len(found) == len(got) and got == brute_audit(docs, LABELS)


def test_audit_of_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_cells_invert_the_sums(spark):
    found = spark.createDataFrame([("p", m % 3 == 0, m % 5 == 0, m) for m in range(32) for _ in range(m + 1)], "part string, good boolean, toxic boolean, mask int")
    r = filter_audit.cells(filter_audit.parity_sums(found)).first()
    assert list(r["n"]) == [m + 1 for m in range(32)] and list(r["good"]) == [(m + 1) * (m % 3 == 0) for m in range(32)] and list(r["toxic"]) == [(m + 1) * (m % 5 == 0) for m in range(32)]


def brute_resample(docs, target, max_words, percent, n_buckets=importance.BUCKETS):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [" ".join(w[k : k + n]) for n in range(1, max_words + 1) for k in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    count = lambda texts: _tally([bucket(f) for t in texts for f in features(t)[0]], n_buckets)
    s, t = count([d[1] for d in docs]), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + n_buckets) / ((s[b] + 1) * (sum(t) + n_buckets)))) for b in range(n_buckets)]
    out = []
    for d in docs:
        found, n = features(d[1])
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append((d[0], len(found), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {}
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        rank.setdefault(r, []).append(k)
    return sorted(((*r, rank[r].pop(0) if rank.get(r) else None) for r in out), key=str)


def _tally(found, n):
    out = [0] * n
    for b in found:
        out[b] += 1
    return out


@pytest.mark.parametrize(("max_words", "percent", "bins"), [(1, 10, 4096), (2, 33, 3), (1, 100, 1), (1, 1, 4096)])
def test_resampling_agrees_with_brute_force(spark, max_words, percent, bins):
    docs, target = rows(), ["the old town hall", None, "word1 word2 blue", ""]
    df, goal = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string")
    gain = importance.gains(importance.bucket_counts(df, max_words=max_words), importance.bucket_counts(goal, max_words=max_words))
    scored = importance.weigh(df, gain, max_words).persist()
    got = importance.rank_drawn(scored, percent, bins=bins).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_resample(docs, target, max_words, percent)


def test_resampling_of_nothing_and_towards_nothing(spark):
    none, goal = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert importance.resample(none, goal).collect() == []
    assert len(importance.resample(spark.createDataFrame(rows(), SCHEMA), goal).collect()) == len(rows())

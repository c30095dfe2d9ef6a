"""The pipeline against a plain version of each stage, on the smallest tables."""

import random
import re

import corpus_pipeline
import pytest
from postlens.llm.common import documents, stage_table

WINDOW = corpus_pipeline.PASSAGE_BYTES
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tables):
    out, docs = {"documents": documents(spark, tables)}, documents(spark, tables)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, tables), f"test-{name}")
        out[name] = docs
    return {k: {r[0]: r for r in v.collect()} if k != "best_fit_packing" else v.collect() for k, v in out.items()}


def shingles(text):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages_keep_the_columns(stages):
    for name in ("quality_rules", "ngram_jaccard", "suffix_dedup", "pii"):
        assert list(next(iter(stages[name].values())).asDict()) == COLUMNS


def test_quality_stage_keeps_most_and_drops_short_ones(stages):
    before, after = stages["documents"], stages["quality_rules"]
    assert set(after) <= set(before) and all(after[k] == before[k] for k in after)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= 50 for r in after.values())
    assert len(after) > 0.6 * len(before)


def test_one_document_of_each_group_stays(stages):
    before, after = stages["quality_rules"], stages["ngram_jaccard"]
    sets = {k: shingles(r["text"]) for k, r in before.items()}
    least = {k: k for k in sets}
    keys = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if a < b and least[a] != least[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low = min(least[a], least[b])
                    old = {least[a], least[b]}
                    for k in keys:
                        if least[k] in old:
                            least[k] = low
                    changed = True
    assert set(after) == {k for k in keys if least[k] == k} and all(after[k] == before[k] for k in after)


def test_repeated_passages_are_cut(stages):
    before, after = stages["ngram_jaccard"], stages["suffix_dedup"]
    assert set(before) == set(after)
    texts = {k: r["text"].encode() for k, r in before.items()}
    seen = {}
    for b in texts.values():
        for i in range(len(b) - WINDOW + 1):
            seen[b[i : i + WINDOW]] = seen.get(b[i : i + WINDOW], 0) + 1
    for k, b in texts.items():
        gone = {j for i in range(len(b) - WINDOW + 1) if seen[b[i : i + WINDOW]] > 1 for j in range(i, i + WINDOW)}
        want = bytes(x for j, x in enumerate(b) if j not in gone).decode("utf-8", "ignore")
        assert after[k]["text"] == want and after[k]["n_chars"] == len(want)


def test_a_passage_of_54_words_is_cut_from_both_documents(spark):
    draw = random.Random(3)
    drawn = {k: [f"w{draw.randrange(1 << 20):x}" for _ in range(200)] for k in range(1, 6)}
    words = lambda k, n: " ".join(drawn[k][:n])
    passage = words(1, 54)
    docs = spark.createDataFrame([(1, f"{words(2, 90)} {passage} {words(3, 80)}"), (2, f"{passage} {words(4, 120)}"), (3, words(5, 200))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passage_stage(spark, docs, "").collect()}
    assert passage not in got[1] + got[2]
    assert got[1].startswith(words(2, 90)[:-3]) and got[2].endswith(words(4, 120)[3:]) and got[3] == words(5, 200)


def test_personal_data_is_masked(stages):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    before, after = stages["suffix_dedup"], stages["pii"]
    assert set(before) == set(after) and not any(email.search(r["text"]) for r in after.values())
    for k, r in before.items():
        if not re.search("[0-9@:=]", r["text"]):
            assert after[k]["text"] == r["text"]


def test_everything_is_packed(stages):
    pieces = stages["best_fit_packing"]
    assert {p["doc_id"] for p in pieces} == set(stages["pii"])
    fill = {}
    for p in pieces:
        fill[p["sequence_id"]] = fill.get(p["sequence_id"], 0) + p["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def words(seed, n=80):
    import random

    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiou')}{r.randint(1, 9) * 'n'}" for _ in range(n)) + "."


HOSTILE = [(1, words(1)), (2, words(1)), (3, words(3)), (3, words(3)), (4, None), (5, ""), (6, "x" * 300_000), (None, words(7)), (8, words(8) + " write to jo@example.com"), (9, words(9, 60_000)), (10, "too short")]


def hostile_tables(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, _text string, k1 string, key string"
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "r", "s", "t", "k", "k") for i, t in rows], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_hostile_rows_pass_every_stage(spark, tmp_path):
    hostile_tables(spark, tmp_path, HOSTILE)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == columns
        seen[name] = docs.select("doc_id", "text", "n_chars", "key").collect()
    ids = lambda name: sorted((r["doc_id"] for r in seen[name]), key=lambda i: (i is None, i or 0))
    assert ids("quality_rules") == [1, 2, 3, 3, 8, 9, None]
    assert set(ids("ngram_jaccard")) == {1, 3, 8, 9, None}
    masked = {r["doc_id"]: r for r in seen["pii"]}
    assert "[email]" in masked[8]["text"] and masked[8]["n_chars"] == len(masked[8]["text"]) and {r["key"] for r in masked.values()} == {"k"}
    pieces = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == {1, 3, 8, 9, None} and all(p["length"] <= 2048 for p in pieces)


def test_no_rows_pass_every_stage(spark, tmp_path):
    hostile_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

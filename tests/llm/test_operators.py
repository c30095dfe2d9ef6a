"""Every operator on one awkward table: nulls, empty and long texts, ties, repeated rows, clashing columns, and no rows."""

import hashlib
import re
import zlib

import public_tokenizers as tokenizers
import pytest
from pyspark.sql import functions as F

from postlens.llm import bytebpe, jaccard, licenses, media, packing, pii, quality, sharding, suffixes, toxicity

WORDS = [f"w{k}x{k * 7 % 101}" for k in range(400)]
LONG = " ".join(WORDS[k * k % 400] + str(k % 13) for k in range(3000))
BASE = " ".join(WORDS[:120])
NEAR = " ".join(["other", *WORDS[1:120]])
MAIL = "Write to jo.do@mail.example.com or 10.0.0.256 or +1 (555) 123-4567, card 4111 1111 1111 1111. password=abcdef123456 é"
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, BASE), (6, BASE), (7, NEAR), (8, LONG), (9, MAIL), (9, MAIL), (None, "null id text"), (10, "Released under the MIT License. MIT\nlicense Again GNU General Public License"), (11, "spam spam spam " * 30), (12, "é" * 500), (13, "x y " + BASE[:450])]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, shard string, key string, node string, spans string, label string, piece string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, None, "c", "c", "c", "c", "c", "c", "c", "c") for k, (i, t) in enumerate(ROWS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 1, 0), (11, 0, 1), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def data(t):
    return (t or "").encode()


def test_quality(docs, none, labels):
    rules = quality.learn(docs, labels)
    got = [r for r in quality.judge(docs, rules).collect()]
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = {}
        for k in range(len(w) - 2):
            win.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + j for at in win.values() if len(at) > 1 for k in at for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.learn(none, labels) == [] and quality.judge(none, []).count() == 0


def test_suffix_dedup(docs, none):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffixes.remove_repeats(docs, form="sha256").collect())
    seen = {}
    for _, t in ROWS:
        b = data(t)
        for k in range(len(b) - 399):
            seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
    want = []
    for i, t in ROWS:
        b = data(t)
        gone = {j for k in range(len(b) - 399) if seen[b[k : k + 400]] > 1 for j in range(k, k + 400)}
        spans = sum(1 for j in gone if j - 1 not in gone)
        want.append((i or 0, len(b), len(gone), spans, hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()))
    assert got == sorted(want) and sum(w[2] for w in want) > 0
    assert suffixes.remove_repeats(none).count() == 0


def test_media(docs, none):
    got = media.store_texts(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert media.from_wav(bytes(r["media"]))[1][: r["n_bytes"]] in {data(t) for _, t in ROWS}
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= 192 and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
    assert media.store_texts(none).count() == 0
    sniffed = media.sniff_media(media.store_texts(docs).withColumn("declared", F.lit("text/plain")), "media", "declared", "doc_id").collect()
    assert all(r["detected_type"] == "audio/wav" and r["type_corrected"] for r in sniffed)


def test_licenses(docs, none):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs, licenses.word_weights(docs)).collect()}
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["last_word"], got[10]["base_labels"]) == (3, 3, 9, "gpl,mit")
    assert got[1]["n_words"] == 0 and got[1]["first_word"] is None and got[1]["labels"] == "" and got[1]["score"] == 0.0
    assert licenses.scan_licenses(none, licenses.word_weights(none)).count() == 0


def test_every_notice_of_a_text_is_found(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
    rest = "Licensed under CC BY-NC 4.0. Copyright, all rights reserved. Subject to the terms of the Mozilla Public License, v. 2.0. Licensed under the GNU Lesser General Public License."
    prose = [(k, "the public terms of a license reserved for all rights, cc to nc and mozilla, lesser general readers") for k in range(10, 40)]
    docs = spark.createDataFrame([(1, f"{bsd} {isc} {rest}"), (2, f"{rest} {isc} {bsd}"), (3, f"{bsd} {isc}"), (4, "ok"), (5, "Public forms use the license general; rights all reserved"), *prose], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs, licenses.word_weights(docs)).collect()}
    assert got[1] == got[2] == "bsd,cc-by-nc,gpl,isc,lgpl,mpl,proprietary" and got[3] == "bsd,isc" and {got[k] for k in got if k > 3} == {""}


def test_bpe(docs, none):
    vocab = tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bytebpe.load_encoding(vocab, tokenizers.PATTERN)
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in bytebpe.encode_texts(docs, vocab, tokenizers.PATTERN).collect())
    assert got == sorted((i or 0, enc.encode_ordinary(t or "")) for i, t in ROWS)
    assert bytebpe.encode_texts(none, vocab, tokenizers.PATTERN).count() == 0


def test_pii(spark, docs, none):
    booster = pii.train(spark)
    got = {r["doc_id"]: r for r in pii.span_digest(pii.find_spans(docs, booster)).collect()}
    assert (got[9]["n_email"], got[9]["n_ip"], got[9]["n_card"], got[9]["n_phone"]) == (1, 0, 1, 1)
    at = MAIL.index("password=")
    assert f"secret:{at}:{at + len('password=abcdef123456')}" in got[9]["spans"] and f"email:9:{9 + len('jo.do@mail.example.com')}" in got[9]["spans"]
    assert all(got[i]["spans"] == "" for i in (1, 2, 3, 4, 5, 12))
    found = pii.find_spans(docs, booster).where("doc_id = 9")
    assert found.select(pii.redacted(F.col("text"), F.col("spans")).alias("x")).first()["x"].startswith("Write to [email] or 10.0.0.256 or [phone], card [card]. [secret] é")
    assert pii.find_spans(none, booster).count() == 0


def test_pii_of_any_length_goes_whole(spark):
    token = "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(8))[:500]
    key = hashlib.sha512(b"k").hexdigest()
    late = "Q" * 60 + key
    digits = " ".join(str(1000 + 7 * k) for k in range(40))
    texts = {1: f"first token={token} last", 2: f"first {key} last", 3: f"first {token} last", 4: f'first secret: "{token}.{token}" last', 5: f"first {late} last", 6: f"first {digits} last", 7: f"first {'a' * 3000} last"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = pii.find_spans(docs, pii.train(spark))
    got = {r["doc_id"]: r["x"] for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("x")).collect()}
    assert got == {1: "first [secret] last", 2: "first [code] last", 3: "first [code] last", 4: "first [secret] last", 5: "first [code] last", 6: got[6], 7: texts[7]}
    proposed = docs.where("doc_id = 6").select(pii.matches(F.col("text"), pii.WIDE[2][1], "number")["found"].alias("x")).first()["x"]
    assert proposed == [digits]


def test_jaccard(docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got[5] == (116, 5) and got[6] == (116, 5) and got[7] == (116, 5) and got[4] == (1, 4) and got[1] == (0, 1) and got[2] == (0, 2) and got[None][1] is None
    kept = [r["doc_id"] for r in jaccard.distinct_documents(docs).select("doc_id").collect()]
    assert sorted(x or 0 for x in kept) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13]
    assert jaccard.jaccard_components(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.kd_shards(docs, n_shards=4).collect()
    assert len(rows) == len(ROWS)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    crc = {i: zlib.crc32(data(t)) for i, t in ROWS}
    assert all(r["text_crc32"] == crc[r["doc_id"]] and 0 <= r["shard"] < 4 for r in rows)
    assert sharding.kd_shards(none, n_shards=4).count() == 0


def test_hot_group_is_dealt_out(spark):
    same = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 500, "the same text of all").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"))
    sums = {r["shard"]: r["n"] for r in sharding.kd_shards(same, n_shards=8).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert len(sums) == 8 and max(sums.values()) < 1.4 * min(sums.values())


def test_toxicity(spark, none, labels):
    rows = [(k, ("you are a moron friend " if k % 4 == 0 else "a calm and friendly line ") + WORDS[k % 400]) for k in range(200)]
    rows += [(1000, "you m0r0n"), (1001, None), (1002, "m o r o n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.language_model(docs)
    weights, prior = toxicity.learn(docs, known, model)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, weights, prior).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(200)) and got[1000] >= 0.5 and got[1001] < 0.5 and got[1002] >= 0.5
    assert toxicity.learn(none, labels, model) == ({}, 0.0) and toxicity.score(none, model, {}, 0.0).count() == 0


def test_packing(docs, none):
    vocab = tokenizers.path("word_bpe_49k.json")
    tokenizer = packing.load_tokenizer(vocab)
    rows = packing.pack_documents(docs, vocab).collect()
    want = []
    for i, t in ROWS:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        want += [(i or 0, k, s, min(2048, n - s)) for k, s in enumerate(range(0, n, 2048))]
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"]) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
    assert len(bins) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack_documents(none, vocab).count() == 0


def test_every_template_of_one_text_is_found_and_many_hits_take_linear_time(spark):
    import time

    every = " and so on ".join(words for _, words, _ in licenses.TEMPLATES)
    rows = spark.createDataFrame([(1, every), (2, "license " * 20_000), (3, "the mit license " * 4_000)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in licenses.scan_licenses(rows, licenses.word_weights(rows)).collect()}
    assert got[1]["labels"].split(",") == sorted({label for label, _, _ in licenses.TEMPLATES}) and got[2]["labels"] == ""
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (4_000, 1, 11_998) and time.time() - began < 30


@pytest.mark.parametrize("many", [0, 1, 2, 9, 300])
def test_many_spans_keep_their_places(spark, many):
    text = "é".join(f"a{k}@b{k}.org" for k in range(many))
    got = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.train(spark)).select("base", pii.redacted(F.col("text"), F.col("base")).alias("masked")).first()
    assert [(s["start"], s["end"]) for s in got["base"]] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert got["masked"] == re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[email]", text)


@pytest.mark.parametrize("hot", [1, 2_000])
def test_classes_too_large_for_a_task_give_the_same_result(spark, monkeypatch, hot):
    rng = __import__("random").Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = " ".join(word() for _ in range(90))
    rows = [(k, shared) for k in range(12)] + [(20 + k, f"{word()} {shared} {word()} " + " ".join(word() for _ in range(80))) for k in range(8)] + [(40, " ".join(word() for _ in range(200)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, suffixes.remove_repeats(docs, form="sha256").select("doc_id", "n_removed", "kept_sha256").collect()))
    monkeypatch.setattr(suffixes, "CLASS", 3)
    monkeypatch.setattr(suffixes, "HOT", hot)
    assert sorted(map(tuple, suffixes.remove_repeats(docs, form="sha256").select("doc_id", "n_removed", "kept_sha256").collect())) == want
    assert sum(w[1] > 0 for w in want) == 20

"""The registered queries on the smallest tables: all columns of the contract against SQL or brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers as tokenizers
import pytest

from postlens.llm import bytebpe, packing, registry

COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op4_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op5_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_ngram_jaccard": "doc_id n_shingles component_id",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op12_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_importance_resampling": "doc_id n_features weight score rank",
}


def test_all_are_registered():
    assert set(registry.QUERIES) == set(COLUMNS)


@pytest.fixture(scope="module")
def texts(tables):
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM read_parquet('{tables}/documents.parquet')").fetchall())


@pytest.fixture(scope="module")
def results(spark, tables):
    """Each query as registered, run once."""
    kept = {}

    def of(name):
        if name not in kept:
            df = registry.QUERIES[name](spark, tables)
            assert df.columns == COLUMNS[name].split()
            kept[name] = df.collect()
        return kept[name]

    return of


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ("op10_best_fit_packing", "op12_filter_audit")])
def test_a_row_a_document(results, texts, name):
    assert sorted(r["doc_id"] for r in results(name)) == sorted(texts)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(results, tables, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tables}/{table}.parquet')")
    cursor = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(COLUMNS[name].split())
    assert sorted((tuple(r[c] for c in columns) for r in results(name)), key=str) == sorted(cursor.fetchall(), key=str)


def test_quality_base_columns(results, texts):
    for r in results("op1_quality_rules"):
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        again = {k + j for found in at.values() if len(found) > 1 for k in found for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_license_base_columns(results, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in results("op4_license_scan"):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]])
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        starts = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in phrases}
        every = sorted(x for s in starts.values() for x in s)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(every), every[0] if every else None, every[-1] if every else None)
        base = sorted(phrases[p] for p, s in starts.items() if s)
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_bpe_agrees_with_the_library(results, texts):
    enc = bytebpe.load_encoding(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    for r in results("op5_byte_bpe"):
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_personal_data_base_columns(results, texts):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    for r in results("op6_pii"):
        spans = [(k, m.start(), m.end()) for k, (pattern, good) in kinds.items() for m in re.finditer(pattern, texts[r["doc_id"]]) if good(m[0])]
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r["spans"].split(","))


def test_shards_are_whole_and_near_equal(results, texts):
    rows, size = results("op8_sharding"), {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw)) and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert set(size) == set(range(16)) and max(size.values()) <= 1.5 * min(size.values()) + max(r["size"] for r in rows)
    for shard in size:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_toxicity_holds_out_a_fifth(results):
    for r in results("op9_toxicity"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_packing_holds_every_id_once(results, texts):
    tokenizer, rows, bins, pieces = packing.load_tokenizer(tokenizers.path("word_bpe_49k.json")), results("op10_best_fit_packing"), {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for placed in bins.values():
        placed.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in placed] == [sum(x["length"] for x in placed[:k]) for k in range(len(placed))] and sum(r["length"] for r in placed) <= 2048
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 0]
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        want = [(k, 2048 * k, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for k, x in enumerate(cut)]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want


def test_language_model_base_columns(results, texts):
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, found in tokens.items() if not held[d] for w in found)
    total, gained = sum(counts.values()), []
    for r in results("op11_lm_scoring"):
        found = tokens[r["doc_id"]]
        want = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in found)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(found), sum(w in counts for w in found), total)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and r["score"] < 0
        gained += [(r["score"] - r["base_score"], len(found))] if r["held_out"] else []
    assert sum(g for g, _ in gained) / sum(n for _, n in gained) > 0.02  # better than the counts on texts that it has not seen

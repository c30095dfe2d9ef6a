"""The algorithms under the operators, without Spark, against plain versions."""

import random

import numpy as np
import public_tokenizers as tokenizers
import pytest

from postlens.llm import bytebpe, jaccard, media, packing, shingles, suffixes, toxicity

R = random.Random(5)


@pytest.fixture(scope="module")
def enc():
    return bytebpe.load_encoding(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


@pytest.mark.parametrize("leaf", [1, 3, 17])
def test_bpe_tree_joins_exactly(enc, leaf):
    for _ in range(60):
        text = "".join(R.choice(["a", "bc", " ", "  ", "\n", "'s", "é", "12", "!?", " ", "zz top ", "\t", "𝄞", "don't "]) for _ in range(R.randint(0, 60)))
        ids = bytebpe.encode_tree(enc, text, leaf)
        assert ids == enc.encode_ordinary(text)
        assert bytebpe.decode_tree(enc, ids, leaf) == text.encode()


def test_media_round_trip_and_carving():
    import gzip

    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + t + d + __import__("zlib").crc32(t + d).to_bytes(4, "big") for t, d in ((b"IHDR", b"x" * 13), (b"IEND", b"")))
    for raw in (b"", b"a", b"x" * 192, b"x" * 193, "é".encode() * 100):
        payload = media.pad_payload(raw)
        assert len(payload) % 192 == 0 and payload and payload.startswith(raw) and set(payload[len(raw) :]) <= {32}
        assert media.from_wav(media.to_wav(payload)) == (8000, payload)
    kind, length, found = media.sniff(media.to_wav(b"ab" + png + b"BM not one" + gzip.compress(b"z") + b"."))
    assert kind == "audio/wav" and [x[0] for x in found] == ["image/png", "application/gzip"]
    assert media.sniff(png)[0] == "image/png" and media.sniff(b"%PDF- nothing")[0] == media.UNKNOWN and media.sniff(b"") == (media.UNKNOWN, 0, [])


def brute_sets(texts):
    out = []
    for t in texts:
        w = [x.lower() for x in t.split()]
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def test_shingle_sets_count_like_plain_ones():
    texts = ["", " \n", "one", "A a b", "a b c d e", "A b c d e f A b c d e f", "é ü " * 9] + [" ".join(R.choice("abcd") for _ in range(R.randint(1, 200))) for _ in range(40)]
    found = list(shingles.shingle_sets([t.encode() for t in texts]))
    assert [len(f) for f in found] == [len(s) for s in brute_sets(texts)]
    for a in range(0, len(texts), 5):
        for b in range(len(texts)):
            assert np.intersect1d(found[a], found[b]).size == len(brute_sets([texts[a]])[0] & brute_sets([texts[b]])[0])
    assert shingles.fingerprint(found[5]) == shingles.fingerprint(found[5].copy()) != shingles.fingerprint(found[6])


def test_linked_sets_share_a_signature_and_pass_the_sketch():
    rng = np.random.default_rng(3)
    common = np.sort(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 12, 16, 25, 40, 63, 64, 65, 100, 127, 128, 200, 255, 256, 400]:
        for _ in range(12):
            base = np.unique(np.concatenate((rng.choice(common, min(n // 3, 40), replace=False), rng.integers(0, 1 << 63, n - min(n // 3, 40), dtype=np.uint64))))
            d = jaccard.most_differing(len(base))
            keep = base[rng.permutation(len(base))[: len(base) - int(rng.integers(0, d + 1))]]
            other = np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, int(rng.integers(0, d + 1)), dtype=np.uint64))))
            both = np.intersect1d(base, other).size
            if not both or 100 * both < 80 * (len(base) + len(other) - both):
                continue
            for hot in (None, common):
                assert set(jaccard.signatures(base, common=hot).tolist()) & set(jaccard.signatures(other, common=hot).tolist())
            assert jaccard.may_link(len(base), len(other), jaccard.parity_bits(base), jaccard.parity_bits(other))


def test_most_differing_is_the_bound():
    for n in range(1, 60):
        best = max(n + m - 2 * i for m in range(1, n + n // 3 + 2) for i in range(0, min(n, m) + 1) if 100 * m <= 125 * n and 100 * i >= 80 * (n + m - i))
        assert jaccard.most_differing(n) >= best


def test_spanning_links_join_what_the_sketches_allow():
    sets = [np.arange(1, 101, dtype=np.uint64) * np.uint64(7919), np.arange(5, 105, dtype=np.uint64) * np.uint64(7919), np.arange(1000, 1100, dtype=np.uint64) * np.uint64(104729)]
    sketches = jaccard.Sketches(np.array([100, 100, 100]), [jaccard.parity_bits(np.sort(s)) for s in sets], 80)
    links = jaccard.spanning_links(sketches, np.array([1, 2, 3]), [[], [], []])
    assert [{*x} for x in links] == [{0, 1}]
    assert jaccard.spanning_links(sketches, np.array([1, 2, 3]), [[1], [0], []]) == []


def test_loser_tree_merges_with_common_prefixes():
    for _ in range(60):
        runs = [sorted(bytes(R.choice(b"ab") for _ in range(R.randint(0, 12))) for _ in range(R.randint(0, 9))) for _ in range(R.randint(1, 7))]
        lcps = [suffixes.front_code(r)[0] for r in runs]
        got = [(runs[k][i], n) for k, i, n in suffixes.LoserTree(runs, lcps)]
        assert [s for s, _ in got] == sorted(s for r in runs for s in r)
        assert all(n == suffixes.common_prefix(a, b) for (a, _), (b, n) in zip(got, got[1:], strict=False))


def test_runs_survive_encoding():
    keys = sorted(bytes(R.choice(b"abc") for _ in range(R.randint(8, 20))) for _ in range(50))
    left = [k[::-1] for k in keys]
    meta = np.arange(150).reshape(3, 50)
    back = suffixes._decode_run(suffixes._encode_run(keys, left, meta))
    assert back[0] == keys and back[2] == left and (back[3] == meta).all()


def test_equal_windows_have_equal_anchors():
    piece = bytes(R.randrange(97, 123) for _ in range(900))
    texts = [b"x" * 450 + piece, piece + b"tail" * 150, bytes(R.randrange(97, 123) for _ in range(399))]
    at = {}
    for k, rows in suffixes.stretches(texts):
        for p, s, e, _, _ in rows.T.tolist():
            assert s <= p < s + suffixes.WINDOW // 2 and e - s < suffixes.WINDOW // 2
            for i in range(s, e + 1):
                at[k, i] = p - i
    assert sorted(i for k, i in at if k == 1) == list(range(len(texts[1]) - 399)) and not any(k == 2 for k, _ in at)
    assert all(at[0, 450 + i] == at[1, i] for i in range(501))


def test_long_text_is_cut_without_loss(monkeypatch):
    text = bytes(R.randrange(97, 100) for _ in range(9000))
    whole = suffixes.stretches([text])[0][1]
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    parts = np.concatenate([rows for _, rows in suffixes.stretches([text])], axis=1)
    assert (parts == whole).all()


@pytest.mark.parametrize("many", [2, 5, 40])
def test_class_matches_like_brute_force(many):
    spread = 20
    entries = sorted({(bytes(R.choice(b"ab") for _ in range(R.randint(0, 19))), bytes(R.choice(b"ab") for _ in range(19))) for _ in range(many)}, key=lambda x: x[1])
    left, right = [x for x, _ in entries], [y for _, y in entries]
    lcps = suffixes.front_code(right)[0]
    got = suffixes.class_matches(right, left, lcps, spread)
    for k in range(len(entries)):
        want = {a for a in range(len(left[k]) + 1) for j in range(len(entries)) if j != k and a <= len(left[j]) and left[k][len(left[k]) - a :] == left[j][len(left[j]) - a :] and right[k][: spread - 1 - a] == right[j][: spread - 1 - a]}
        assert {a for low, high in got[k] for a in range(low, high + 1)} == want


def test_hashes_that_lie_do_not_change_the_matches(monkeypatch):
    spread, R2 = 20, random.Random(9)
    entries = sorted({(bytes(R2.choice(b"ab") for _ in range(R2.randint(0, 19))), bytes(R2.choice(b"ab") for _ in range(19))) for _ in range(40)}, key=lambda x: x[1])
    left, right = [x for x, _ in entries], [y for _, y in entries]
    lcps = suffixes.front_code(right)[0]
    want = suffixes.class_matches(right, left, lcps, spread)
    honest = suffixes.window_hashes
    monkeypatch.setattr(suffixes, "window_hashes", lambda *a: (*honest(*a)[:2], honest(*a)[2] % np.uint64(3)))
    flat = lambda found: [{a for low, high in x for a in range(low, high + 1)} for x in found]
    assert flat(suffixes.class_matches(right, left, lcps, spread)) == flat(want)


def test_merged_runs_cover_what_repeats():
    """All covered bytes come out of the loser tree: stretches of random texts with planted copies, against brute force."""
    window, R2 = 40, random.Random(8)
    shared = [bytes(R2.randrange(97, 123) for _ in range(n)) for n in (45, 60, 130)]
    texts = [b"".join(x for _ in range(3) for x in (bytes(R2.randrange(97, 123) for _ in range(R2.randint(0, 30))), R2.choice(shared))) for _ in range(30)] + [shared[2]] * 3
    entries, head_of = [], {}
    for k, rows in suffixes.stretches(texts, window):
        for p, s, e, head, _ in rows.T.tolist():
            prefix = window - window // 2 + 1
            entries.append(((head & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + texts[k][p + prefix : e + window], texts[k][s:p], k, 0, p))
    runs = []
    for part in (entries[0::3], entries[1::3], entries[2::3]):
        part.sort()
        runs.append(suffixes._decode_run(suffixes._encode_run([x[0] for x in part], [x[1] for x in part], np.array([x[2:] for x in part], np.int64).T)))
    covered = {(k, i) for k, _, low, high in suffixes.merged_spans(runs, window) for i in range(low, high)}
    seen = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    want = {(k, i + j) for k, t in enumerate(texts) for i in range(len(t) - window + 1) if seen[t[i : i + window]] > 1 for j in range(window)}
    assert covered == want and want


def test_packing_uses_each_piece_once_and_few_bins():
    counts = {k: R.randint(1, 30) for k in R.sample(range(1, 200), 60)}
    first = packing.best_fit(counts, 200)
    bins = packing.local_search(first, 200)
    used = {}
    for pattern, n in bins.items():
        assert sum(pattern) <= 200
        for x in pattern:
            used[x] = used.get(x, 0) + n
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert -(-total // 200) <= sum(bins.values()) <= sum(first.values()) <= 1.1 * total / 200 + 1


def test_local_search_empties_a_bin():
    bins = packing.local_search(packing.Counter({(6, 3): 1, (5, 4): 1, (1, 1): 1}), 10)
    assert sum(bins.values()) == 2


@pytest.mark.parametrize("copies", [10, 1000, 100_000])
def test_local_search_works_alike_for_few_and_many_copies(copies):
    counts = {51: 6 * copies, 27: 6 * copies, 26: 6 * copies, 23: 12 * copies}
    first = packing.best_fit(counts, 100)
    bins = packing.local_search(first, 100)
    used = packing.Counter()
    for pattern, n in bins.items():
        assert sum(pattern) <= 100
        for x in pattern:
            used[x] += n
    assert used == counts and sum(first.values()) == 11 * copies and sum(bins.values()) <= 10 * copies


def test_local_search_ends_where_no_two_bins_have_an_exchange():
    bins = packing.local_search(packing.best_fit({k: 1 + k * 7 % 5 for k in range(20, 120)}, 300), 300)
    under = [(p, n) for p, n in bins.items() if sum(p) < 300]
    for donor, n in under:
        for other, _ in under:
            if sum(donor) <= sum(other) and (donor != other or n > 1):
                assert packing._exchange(donor, other, 300 - sum(other)) == ((), ())


def test_words_are_encoded_like_whole_texts():
    tokenizer = packing.load_tokenizer(tokenizers.path("word_bpe_49k.json"))
    words = packing.WordIds(tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "Hello, WORLD!! don't", "a\x1cb \x02 c d", "éÉ Ünï ΣΑΣ İx", "<|endoftext|> 3.14", "x" * 3000, "日本語 text"]
    for _ in range(2):
        got = words.encode([t.encode() for t in texts])
        assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_deobfuscation():
    model = np.log(np.full(toxicity.SYMBOLS**toxicity.ORDER, 1e-4, np.float32))
    for word in ("stupid", "idiot", "scum", "worthless"):
        s = "   " + word + " "
        codes = [27 if c == " " else ord(c) - 97 for c in s]
        for k in range(len(codes) - 3):
            a, b, c, d = codes[k : k + 4]
            model[((a * 28 + b) * 28 + c) * 28 + d] = -0.1
    for hidden, plain in (("st*pid", "stupid"), ("1d10t", "idiot"), ("idiooot", "idiot"), ("$cum", "scum"), ("w0rthle55", "worthless")):
        assert plain in toxicity.readings(hidden, model)
    assert toxicity.readings("plain.", model) == {"plain"}
    assert "idiot" in toxicity.words_of("you i d i o t you") and toxicity.words_of("") == set()


def test_long_and_digit_ridden_words_are_read_too():
    model = np.log(np.full(toxicity.SYMBOLS**toxicity.ORDER, 1e-4, np.float32))
    s = "   idiot "
    codes = [27 if c == " " else ord(c) - 97 for c in s]
    for k in range(len(codes) - 3):
        a, b, c, d = codes[k : k + 4]
        model[((a * 28 + b) * 28 + c) * 28 + d] = -0.1
    assert "idiot" in toxicity.readings("1d107", model) and "idiot" in toxicity.readings("idi" + "o" * 5000 + "t", model)
    assert toxicity.readings("1070", model) == {"1070"} and len(toxicity.features_of("x9" * 40, model)) > 0


def test_most_tokens_come_out_of_joins(enc, monkeypatch):
    text, asked = " ".join(f"word{R.randrange(10**6)}" for _ in range(3000)), []

    class Seen:
        def encode_ordinary(self, part):
            asked.append(len(part))
            return enc.encode_ordinary(part)

    assert bytebpe.encode_tree(Seen(), text) == enc.encode_ordinary(text)
    assert max(asked) <= bytebpe.LEAF_CHARS and len(asked) > len(text) / bytebpe.LEAF_CHARS

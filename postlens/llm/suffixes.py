"""Suffix-array dedup: removes every byte covered by a WINDOW-byte string that starts anywhere else too.

A suffix array over every byte would be larger than the text many times, so suffixes are sampled where their
content says so: of each window of SPREAD starts, the rightmost one with the least hash is an anchor. Two
equal WINDOW-byte strings hold the same anchor at the same place, so comparing suffixes at anchors, with what
stands before them, finds every repeat.

1. Prefix doubling in one step: suffixes whose first bytes up to the window's last anchor occur once (by their hash)
   cannot match and are dropped; the hash then stands for the prefix.
2. Distributed merge sort of all others: sorted runs, front-coded (only what differs from the string before is
   sent), go to ranges of the keys, and a loser tree merges them. It keeps the common prefix of each loser
   with its winner and compares on from there, never again what it knows. What comes out side by side shares a
   prefix; stretches that are equal as a whole, and windows that two stretches share, are told by comparing bytes.
3. Prefixes that more than CLASS suffixes share are too many for one task; those alone are compared by hashes of
   stretches and windows, through a shuffle.

Lost executors cost recomputation only: what stages hand on lies in the shared folder.

Cases: a null text counts as empty; texts under WINDOW bytes keep all; repeated rows are repeats of each
other; matches do not cross rows; other columns are not read; no rows in, none out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_tables, row_key, small_batches, stage_table, text_of
from .shingles import _BASE, _BYTE, _INVERSE, _power, mix

WINDOW = 400
GRAM = 16
SEGMENT = 1 << 20
_PLACES = 24
#: Entries of a front-coded run, and of a range that one task merges.
RUN = 50_000
RANGE = 60_000
#: Different stretches of a class that are compared pair by pair; among more, hashes of windows propose what to compare.
DIRECT = 12
#: Suffixes of one prefix that a task holds.
CLASS = 20_000
#: A key is hot if it has more than this part of all rows (and more than CLASS), so there are fewer hot keys than this.
HOT = 2_000


def _stretches(data: np.ndarray, bounds: list[tuple[int, int]], window: int, spread: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the texts at bounds in data: anchor, first and last window start that it answers for, hash of its prefix,
    hash of its stretch."""
    n = len(data)
    prefix = window - spread + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_BASE, n), dtype=np.uint64)))
        inverse = _power(_INVERSE, n + 1)
        key = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
        key = (key >> np.uint64(_PLACES)) << np.uint64(_PLACES) | np.arange((1 << _PLACES) - 1, (1 << _PLACES) - 1 - len(key), -1, dtype=np.uint64)
        wide = 1
        while 2 * wide <= spread:
            key = np.minimum(key[:-wide], key[wide:])
            wide *= 2
        rest = spread - wide
        if rest:
            key = np.minimum(key[:-rest], key[rest:])
        least = (np.uint64((1 << _PLACES) - 1) - (key & np.uint64((1 << _PLACES) - 1))).astype(np.int64)
        starts = np.concatenate([np.arange(a, b - window + 1) for a, b in bounds if b - a >= window])
        anchor = least[starts]
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((new[1:], [len(anchor)])) - 1
        p, s, e = anchor[new], starts[new], starts[last]
        head = mix((sums[p + prefix] - sums[p]) * inverse[p] + np.uint64(1))
        whole = mix((sums[e + window] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (p - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return p, s, e, head, whole


def stretches(texts: list[bytes], window: int = WINDOW, spread: int | None = None, gram: int = GRAM) -> list[tuple[int, np.ndarray]]:
    """(text's place, rows of anchor, first, last, prefix hash, stretch hash) of texts that are long enough."""
    spread = spread or window // 2
    out = []
    part: list[tuple[int, bytes]] = []

    def flush():
        bounds, at = [], 0
        for _, t in part:
            bounds.append((at, at + len(t)))
            at += len(t)
        p, s, e, head, whole = _stretches(np.frombuffer(b"".join(t for _, t in part), np.uint8), bounds, window, spread, gram)
        cut = np.searchsorted(s, [a for a, _ in bounds] + [at])
        for (k, _), (a, _), low, high in zip(part, bounds, cut[:-1], cut[1:], strict=True):
            x = slice(low, high)
            out.append((k, np.stack([p[x] - a, s[x] - a, e[x] - a, head[x].view(np.int64), whole[x].view(np.int64)])))
        part.clear()

    size = 0
    for k, text in enumerate(texts):
        if len(text) < window:
            continue
        if len(text) > SEGMENT:  # in segments; a segment's last stretch may go on, so the next starts with it
            at = 0
            while True:
                piece = text[at : at + SEGMENT + window]
                rows = np.stack([x.view(np.int64) for x in _stretches(np.frombuffer(piece, np.uint8), [(0, len(piece))], window, spread, gram)])
                done = at + len(piece) == len(text)
                rows[:3] += at
                out.append((k, rows if done else rows[:, :-1]))
                if done:
                    break
                at = int(rows[1, -1])
            continue
        if size + len(text) > SEGMENT:
            flush()
            size = 0
        part.append((k, text))
        size += len(text)
    if part:
        flush()
    return out


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be start at least."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    step = 8
    while a[start : start + step] == b[start : start + step]:
        start += step
        step *= 2
    while step > 1:
        step //= 2
        if a[start : start + step] == b[start : start + step]:
            start += step
    return start


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefix with the string before, and the rest, of sorted strings."""
    lcps, rests, last = [], [], b""
    for s in strings:
        n = common_prefix(last, s)
        lcps.append(n)
        rests.append(s[n:])
        last = s
    return lcps, rests


class LoserTree:
    """Merges sorted streams of (string, common prefix with the one before). A node keeps the stream that lost there
    and its common prefix with the string that won, so a comparison starts where the two are known to differ or
    be equal."""

    def __init__(self, strings: list[list[bytes]], lcps: list[list[int]]):
        self.strings, self.lcps = strings, lcps
        self.width = 1
        while self.width < len(strings):
            self.width *= 2
        self.at = [0] * len(strings)
        self.loser: list[tuple[int, int]] = [(-1, 0)] * self.width
        self.top = self._play(1)

    def _head(self, k: int) -> bytes | None:
        return self.strings[k][self.at[k]] if 0 <= k < len(self.strings) and self.at[k] < len(self.strings[k]) else None

    def _match(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser); the numbers are common prefixes with the last string handed out, of the loser with the winner."""
        (ka, na), (kb, nb) = a, b
        x, y = self._head(ka), self._head(kb)
        if y is None:
            return a, b
        if x is None:
            return b, a
        if na != nb:  # the longer one is the smaller, and the other parts from it where it parts from the last
            return (a, b) if na > nb else (b, a)
        n = common_prefix(x, y, na)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, (kb, n)
        return b, (ka, n)

    def _play(self, node: int) -> tuple[int, int]:
        if node >= self.width:
            return (node - self.width, 0)
        winner, self.loser[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return winner

    def __iter__(self):
        """(stream, place in it, common prefix with the string before)."""
        first = True
        while self._head(self.top[0]) is not None:
            k, n = self.top
            at = self.at[k]
            yield k, at, 0 if first else n
            first = False
            self.at[k] += 1
            now = (k, self.lcps[k][at + 1] if at + 1 < len(self.lcps[k]) else 0)
            node = (self.width + k) // 2
            while node:
                now, self.loser[node] = self._match(now, self.loser[node])
                node //= 2
            self.top = now


def window_hashes(left: list[bytes], right: list[bytes], spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, bytes before the anchor, hash of what stands around the prefix) of every window of every entry."""
    data = np.frombuffer(b"".join(x + y for x, y in zip(left, right, strict=True)), np.uint8)
    before, sizes = np.array([len(x) for x in left]), np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)])
    ends = np.cumsum(sizes)
    many = sizes - (spread - 1) + 1
    entry = np.repeat(np.arange(len(left)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = (ends - sizes)[entry] + offset
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_BASE, len(data)), dtype=np.uint64)))
        around = before[entry] - offset
        found = mix((sums[start + spread - 1] - sums[start]) * _power(_INVERSE, len(data) + 1)[start] + (around + 1).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    return entry, around, found


def _shared(k: int, other: int, right: list[bytes], backward: list[bytes], spread: int) -> tuple[int, int] | None:
    """The windows that two stretches of one prefix share, as a range of bytes before the anchor."""
    low = spread - 1 - common_prefix(right[k], right[other])
    if low > len(backward[k]):
        return None
    high = common_prefix(backward[k], backward[other])
    return (max(low, 0), high) if high >= low else None


def _proposed(right: list[bytes], left: list[bytes], spread: int) -> list[list[tuple[int, int, int]]]:
    """For each stretch: another with which hashes say that it shares windows, and the range of those."""
    entry, around, found = window_hashes(left, right, spread)
    order = np.lexsort((entry, found))
    alike = found[order[1:]] == found[order[:-1]]
    partner = np.full(len(found), -1)
    partner[order[:-1][alike]] = entry[order[1:][alike]]
    partner[order[1:][alike]] = entry[order[:-1][alike]]
    some = np.flatnonzero(partner >= 0)
    some = some[np.lexsort((around[some], partner[some], entry[some]))]
    e, p, a = entry[some], partner[some], around[some]
    new = np.flatnonzero(np.concatenate(([True], (e[1:] != e[:-1]) | (p[1:] != p[:-1]) | (a[1:] != a[:-1] + 1)))) if len(some) else np.zeros(0, np.int64)
    last = np.concatenate((new[1:], [len(some)]))[: len(new)] - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in right]
    for k, other, low, high in zip(e[new].tolist(), p[new].tolist(), a[new].tolist(), a[last].tolist(), strict=True):
        out[k].append((other, low, high))
    return out


def class_matches(right: list[bytes], left: list[bytes], lcps: list[int], spread: int) -> list[list[tuple[int, int]]]:
    """Of different stretches that share a prefix, sorted by what follows it, lcps[k] of it common to k - 1 and k: the
    windows of each that another has too, as ranges of bytes before the anchor."""
    n = len(right)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    backward = [x[::-1] for x in left]
    if n > DIRECT:
        for k, proposals in enumerate(_proposed(right, left, spread)):
            for other, low, high in proposals:
                same = _shared(k, other, right, backward, spread) if other != k else None
                if same is None or same[0] > low or same[1] < high:  # the hashes lied: look at all others
                    out[k] = [x for j in range(n) if j != k and (x := _shared(k, j, right, backward, spread))]
                    break
                out[k].append(same)
        return out
    for k in range(n):
        for step in (-1, 1):
            reach, other = len(right[k]), k + step
            while 0 <= other < n:
                reach = min(reach, lcps[max(other, other - step)])
                low = spread - 1 - reach
                if low > len(left[k]):
                    break
                high = common_prefix(backward[k], backward[other])
                if high >= low:
                    out[k].append((max(low, 0), high))
                other += step
    return out


def _encode_run(keys: list[bytes], left: list[bytes], meta: np.ndarray) -> bytes:
    """Strings front-coded; of equal strings also what stands before the anchor, from its end."""
    lcps, rests = front_code(keys)
    kept, lefts, last = [], [], b""
    for x in left:
        n = common_prefix(last[::-1], x[::-1])
        kept.append(n)
        lefts.append(x[: len(x) - n])
        last = x
    numbers = np.array([lcps, [len(x) for x in rests], kept, [len(x) for x in lefts]], "<i4")
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(4, "little") + numbers.tobytes() + meta.astype("<i8").tobytes() + b"".join(rests) + b"".join(lefts))


def _decode_run(data: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:4], "little")
    lcps, rests, kept, lefts = np.frombuffer(data, "<i4", 4 * n, 4).reshape(4, n).tolist()
    meta = np.frombuffer(data, "<i8", 3 * n, 4 + 16 * n).reshape(3, n)
    at = 4 + 40 * n
    keys, left, last = [], [], b""
    for common, rest in zip(lcps, rests, strict=True):
        last = last[:common] + data[at : at + rest]
        keys.append(last)
        at += rest
    last = b""
    for common, rest in zip(kept, lefts, strict=True):
        last = data[at : at + rest] + last[len(last) - common :]
        left.append(last)
        at += rest
    return keys, lcps, left, meta


def _anchored(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    text = text_of(text_col)
    k1, k2 = row_key(id_col, text)
    rows = df.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).where(F.octet_length("text") >= window)

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, rows in stretches([t.encode() for t in batch.column(2).to_pylist()], window):
                p, s, e, head, whole = rows
                n = len(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(head), pa.array(whole), pa.array(np.full(n, a[k])), pa.array(np.full(n, b[k])), pa.array(p.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
                    names=["head", "whole", "k1", "k2", "p", "s", "e"],
                )

    def gathered(batches):
        part, rows = [], 0
        for batch in run(batches):
            part.append(batch)
            rows += batch.num_rows
            if rows > 20_000:
                yield from pa.Table.from_batches(part).combine_chunks().to_batches()
                part, rows = [], 0
        if part:
            yield from pa.Table.from_batches(part).combine_chunks().to_batches()

    return rows.mapInArrow(gathered, "head long, whole long, k1 long, k2 long, p int, s int, e int")


def merged_spans(runs: list[tuple[list[bytes], list[int], list[bytes], np.ndarray]], window: int) -> Iterator[tuple[int, int, int, int]]:
    """k1, k2, low, high: bytes covered, from decoded runs merged by a loser tree; a key opens with 8 bytes of its prefix's hash."""
    spread = window // 2
    group: list[tuple[int, int, int]] = []

    def close():
        alike: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        lcps, reach = [], 1 << 40
        for k, i, n in group:  # in order of the keys
            reach = min(reach, n - 8)
            same = alike.setdefault((runs[k][0][i], runs[k][2][i]), [])
            if not same:
                lcps.append(reach)
                reach = 1 << 40
            same.append((k, i))
        right, left = [x[8:] for x, _ in alike], [y for _, y in alike]
        found = class_matches(right, left, lcps, spread) if len(alike) > 1 else [[]]
        for r, x, members, ranges in zip(right, left, alike.values(), found, strict=True):
            if len(members) > 1:
                ranges = [(spread - 1 - len(r), len(x))]
            for k, i in members:
                k1, k2, p = runs[k][3][:, i].tolist()
                for low, high in ranges:
                    yield k1, k2, p - high, p - low + window

    for k, i, n in LoserTree([r[0] for r in runs], [r[1] for r in runs]):
        if n < 8:
            if len(group) > 1:
                yield from close()
            group.clear()
        group.append((k, i, n))
    if len(group) > 1:
        yield from close()


def _merge_ranges(entries: DataFrame, window: int) -> DataFrame:
    """k1, k2, low, high: bytes covered, from entries (range, run)."""

    def merged(key, table):
        found = merged_spans([_decode_run(x) for x in table.column("run").to_pylist()], window)
        found = np.array(list(found), np.int64).reshape(-1, 4)
        return pa.table({c: found[:, j].copy() for j, c in enumerate(("k1", "k2", "low", "high"))})

    return entries.groupBy("range").applyInArrow(merged, "k1 long, k2 long, low long, high long")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """k1, k2 (the row's key) and spans (start, end of covered bytes, in any order, maybe overlapping)."""
    small_batches(df.sparkSession)
    anchors = stage_table(_anchored(df, id_col, text_col, window), "anchors")
    most = max(CLASS, anchors.count() // HOT)
    key = F.xxhash64("head", "whole")

    def hot(keys: DataFrame) -> list[int]:
        """Keys that more than `most` rows have; HOT at most, counted before the shuffle. They stay where they are."""
        return [r["key"] for r in keys.groupBy("key").count().where(F.col("count") > most).select("key").collect()]

    is_hot = F.col("head").isin(hot(anchors.select(F.col("head").alias("key"))))
    heads = Window.partitionBy("head")
    others = anchors.where(~is_hot).repartition("head").withColumn("n_head", F.count(F.lit(1)).over(heads)).where("n_head > 1")
    others = others.withColumn("large", F.col("n_head") > CLASS).drop("n_head")
    seen = stage_table(others.unionByName(anchors.where(is_hot).withColumn("large", F.lit(True))), "repeated-prefixes")
    drop_tables(anchors)
    counts = {r["large"]: r["count"] for r in seen.groupBy("large").count().collect()}
    text = text_of(text_col)
    k1, k2 = row_key(id_col, text)
    texts = df.select(k1.alias("k1"), k2.alias("k2"), text.alias("text"))

    def with_texts(entries: DataFrame) -> DataFrame:
        by_text = entries.groupBy("k1", "k2").agg(F.collect_list(F.struct("head", "whole", "p", "s", "e")).alias("entries"))
        return texts.hint("merge").join(by_text, ["k1", "k2"])

    every = _merge_ranges(_sorted_runs(with_texts(seen.where("NOT large").drop("whole").withColumn("whole", F.lit(0))), max(1, counts.get(False, 0) // RANGE), window), window)
    if counts.get(True):
        large = seen.where("large")
        wholes = large.groupBy("head", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "p", "s", "e")).alias("one"))
        wholes = stage_table(wholes, "hot-stretches")
        copied = key.isin(hot(large.select(key.alias("key"))))
        twice = large.where(~copied).join(wholes.where("n > 1").select("head", "whole").hint("merge"), ["head", "whole"], "left_semi")
        full = large.where(copied).unionByName(twice).select("k1", "k2", F.col("s").cast("long").alias("low"), (F.col("e") + window).cast("long").alias("high"))
        every = every.unionByName(full).unionByName(_by_windows(with_texts(wholes.select("head", "whole", "one.*")), window))
    return every.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def _slices(batch, window: int):
    """(k1, k2, entry, left, right) of a batch's entries."""
    column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
    prefix = window - window // 2 + 1
    for a, b, text, entries in zip(column("k1"), column("k2"), column("text"), column("entries"), strict=True):
        data = text.encode()
        for x in entries:
            p = x["p"]
            yield a, b, x, data[x["s"] : p], data[p + prefix : x["e"] + window]


def _sorted_runs(rows: DataFrame, ranges: int, window: int) -> DataFrame:
    """(range, run): front-coded sorted runs of (hash of the prefix, what follows it), cut at equal ranges of the hash."""

    def run(batches):
        entries: list[tuple] = []

        def flush():
            entries.sort()
            spans: dict[int, list] = {}
            for x in entries:
                spans.setdefault((int.from_bytes(x[0][:4], "big") * ranges) >> 32, []).append(x)
            entries.clear()
            data = [_encode_run([x[0] for x in part], [x[1] for x in part], np.array([x[2:] for x in part], np.int64).T) for part in spans.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(spans), pa.int32()), pa.array(data, pa.binary())], names=["range", "run"])

        for batch in batches:
            for a, b, x, left, right in _slices(batch, window):
                entries.append(((x["head"] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + right, left, a, b, x["p"]))
                if len(entries) >= RUN:
                    yield flush()
        if entries:
            yield flush()

    return rows.mapInArrow(run, "range int, run binary")


def _by_windows(rows: DataFrame, window: int) -> DataFrame:
    """k1, k2, low, high for the large classes: windows whose hash another stretch of the class has too."""
    spread = window // 2

    def run(batches):
        for batch in batches:
            found = list(_slices(batch, window))
            for at in range(0, len(found), 1000):
                part = found[at : at + 1000]
                entry, around, hashes = window_hashes([x[3] for x in part], [x[4] for x in part], spread)
                take = lambda f: np.array([f(x) for x in part], np.int64)[entry]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(take(lambda x: x[2]["head"])), pa.array(hashes.view(np.int64)), pa.array(take(lambda x: x[2]["whole"])), pa.array(take(lambda x: x[0])), pa.array(take(lambda x: x[1])), pa.array(take(lambda x: x[2]["p"]) - around)],
                    names=["head", "window", "whole", "k1", "k2", "low"],
                )

    windows = rows.mapInArrow(run, "head long, window long, whole long, k1 long, k2 long, low long")
    same = Window.partitionBy("head", "window")
    twice = windows.withColumn("least", F.min("whole").over(same)).withColumn("most", F.max("whole").over(same)).where("least <> most")
    return twice.select("k1", "k2", "low", (F.col("low") + window).alias("high"))


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted((x["low"], x["high"]) for x in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), form: str = "bytes", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, columns named in keep, n_bytes, n_removed, spans, and what is kept: kept (bytes),
    kept_sha256 or kept_text, as form says; the text drops characters of which a cut left a part."""
    field, to = {"bytes": ("kept", bytes), "sha256": ("kept_sha256", lambda x: hashlib.sha256(x).hexdigest()), "text": ("kept_text", lambda x: x.decode("utf-8", "ignore"))}[form]
    spans = repeated_spans(df, id_col, text_col, window)
    text = text_of(text_col)
    k1, k2 = row_key(id_col, text)
    rows = df.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep], k1.alias("_k1"), k2.alias("_k2"), text.alias("_text"))
    rows = rows.join(spans.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("spans").alias("_spans")), ["_k1", "_k2"], "left")
    rows = rows.select("doc_id", *keep, "_text", "_spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    fields.append(T.StructField(field, T.BinaryType() if form == "bytes" else T.StringType()))
    schema = T.StructType([*rows.schema.fields[:-2], *fields])

    def run(batches):
        for batch in batches:
            size, removed, places, kept = [], [], [], []
            for text, found in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = text.encode()
                gone = _union(found or [])
                rest, at = [], 0
                for low, high in gone:
                    rest.append(data[at:low])
                    at = high
                rest = b"".join([*rest, data[at:]])
                size.append(len(data))
                removed.append(len(data) - len(rest))
                places.append([{"start": a, "end": b} for a, b in gone])
                kept.append(to(rest))
            new = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(places, span), pa.array(kept, pa.binary() if form == "bytes" else pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=schema.names)

    return rows.mapInArrow(run, schema)

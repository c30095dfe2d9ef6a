"""Best-fit packing with swap-based local search.

Only the lengths of pieces matter to a packing, and there are at most `capacity` of them. So the lengths are
counted by all executors and the packing is made of patterns: a multiset of lengths that fill one bin, with
the number of bins filled that way. Best-fit decreasing makes the patterns; local search then moves one piece
for one, two for one, or one outright between underfull bins whenever that raises the sum of squared fills,
for all copies of two patterns at once, until no exchange is left. Pieces find their place by rank within their length, so the driver holds counts and
patterns, never pieces.

Cases: a null or empty text is one piece of one token (the closing id 0); repeated rows are packed each;
other columns are not read; no rows in, none out.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage_table, text_of
from .shingles import word_hashes

CAPACITY = 2048
#: Words whose ids a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 1_500_000
#: Pieces of one length that are numbered in one task.
NUMBERED = 250_000

#: Letters whose lower case and normal form are plain, then marks: the tokenizer parts the two.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:$%&*#]*)")
_BETWEEN = "\x02"


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _encode_pieces(tokenizer, pieces: list[str], at_once: int = 50) -> list[bytes]:
    """Ids of each piece; many are encoded as one text, parted by a sign that is one token of its own."""
    mark = tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
    if len(mark) != 1 or any(_BETWEEN in p for p in pieces):
        return [np.array(tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
    texts = [f" {_BETWEEN} ".join(pieces[k : k + at_once]) for k in range(0, len(pieces), at_once)]
    out = []
    for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
        ids = np.array(found.ids, "<u4")
        data, start = ids.tobytes(), 0
        for end in np.flatnonzero(ids == mark[0]).tolist():
            out.append(data[4 * start : 4 * end])
            start = end + 1
        out.append(data[4 * start :])
    return out


class WordIds:
    """Ids of texts by their words, each different word encoded once.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words; a word of
    letters and marks is two pieces, and letters count without their case. Words are known by a 64-bit hash;
    their ids lie behind one another in one array.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes; where each word's ids are
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.pieces: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for data, starts, ends, hashes, first in word_hashes(texts):
            if len(self.hashes) > REMEMBERED:
                self.forget()
            distinct, sample, word = np.unique(hashes, return_index=True, return_inverse=True)
            place = np.searchsorted(self.hashes, distinct)
            known = np.zeros(len(distinct), bool)
            inside = place < len(self.hashes)
            known[inside] = self.hashes[place[inside]] == distinct[inside]
            if not known.all():
                new = sample[~known]
                raw = data.tobytes()
                self._learn(place[~known], distinct[~known], [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
                place = np.searchsorted(self.hashes, distinct)
            row = self.at[place][word]
            size = self.length[row]
            upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
            take = np.repeat(self.start[row] - upto[:-1], size) + np.arange(upto[-1])
            found = self.ids[take]
            bounds = upto[first]
            out += [found[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return out

    def _learn(self, place: np.ndarray, hashes: np.ndarray, words: list[str]) -> None:
        parts = [(m[1].lower(), m[2]) if (m := _SIMPLE.fullmatch(w)) else (w, "") for w in words]
        missing = list({p for both in parts for p in both if p not in self.pieces})
        self.pieces.update(zip(missing, _encode_pieces(self.tokenizer, missing), strict=True))
        got = [self.pieces[a] + self.pieces[b] for a, b in parts]
        length = np.array([len(g) // 4 for g in got], np.int64)
        ids = np.frombuffer(b"".join(got), np.uint32)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.hashes = np.insert(self.hashes, place, hashes)
        self.at = np.insert(self.at, place, np.arange(len(self.start), len(self.start) + len(words)))
        self.start = np.concatenate((self.start, self.used + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.used += len(ids)


def tokenized(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, key (a hash that names the row), piece, start, length and ids_crc32 of each piece."""
    small_batches(df.sparkSession)
    text = text_of(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col).cast("string"), text).alias("key"), text.alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("key", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32")]])

    def run(batches):
        words = WordIds(vocab)
        for batch in batches:
            take, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(words.encode([t.encode() for t in batch.column(2).to_pylist()])):
                ids = ids.astype("<u4").tobytes() + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    take.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(x, pa.int64()) for x in (piece, start, length, crc)]], names=schema.names)

    return rows.mapInArrow(run, schema)


Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing over counts: the largest length left opens a bin, the best fitting ones fill it, and the
    pattern is used as often as the counts allow."""
    left = dict(counts)
    sizes = sorted(k for k, n in left.items() if n)
    bins: Counter[Pattern] = Counter()
    while sizes:
        pattern, room = [], capacity
        used: Counter[int] = Counter()
        at = len(sizes) - 1
        while room > 0 and at >= 0:
            at = bisect.bisect_right(sizes, room) - 1
            while at >= 0 and used[sizes[at]] >= left[sizes[at]]:
                at -= 1
            if at < 0:
                break
            size = sizes[at]
            take = min(left[size] - used[size], room // size)
            pattern += [size] * take
            used[size] += take
            room -= take * size
        times = min(left[s] // n for s, n in used.items())
        bins[tuple(pattern)] += times
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                sizes.remove(s)
    return bins


def local_search(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Exchanges between underfull bins that raise the sum of squared fills; a bin that empties is gone.

    An exchange between two patterns is made for as many copies as both have, so the work depends on the patterns, not
    on the bins. It ends when no two underfull patterns, of one kind or different ones, have an exchange left.
    """
    done = Counter({p: n for p, n in bins.items() if n and sum(p) == capacity})
    search = _Search({p: n for p, n in bins.items() if n and sum(p) < capacity}, capacity)
    search.run()
    return done + search.full + Counter({search.patterns[k]: n for k, n in search.counts.items()})


class _Search:
    """Underfull patterns by number. A pattern that comes back after its last copy went gets a new number, so what a
    donor has looked at once without finding an exchange stays looked at."""

    def __init__(self, under: dict[Pattern, int], capacity: int):
        self.capacity = capacity
        self.full: Counter[Pattern] = Counter()
        self.numbers: dict[Pattern, int] = {}
        self.patterns: dict[int, Pattern] = {}
        self.counts: dict[int, int] = {}
        self.next = 0
        self.looked: dict[int, int] = {}
        self.fill: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []
        # What an exchange may take out of each pattern (0: nothing, for a piece moved outright), what the most is that may
        # come in for it, and whose it is.
        self.used = 0
        self.taken, self.upto, self.owner = (np.zeros(1024, np.int64) for _ in range(3))
        for pattern in sorted(under):
            self._add(pattern, under[pattern])

    def _add(self, pattern: Pattern, n: int) -> None:
        fill = sum(pattern)
        if not pattern:
            return
        if fill == self.capacity:
            self.full[pattern] += n
            return
        k = self.numbers.get(pattern)
        if k is not None:
            self.counts[k] += n
            self.looked[k] = min(self.looked[k], k)  # two copies may now exchange with each other
        else:
            k = self.numbers[pattern] = self.next
            self.next += 1
            self.patterns[k], self.counts[k], self.looked[k], self.fill[k] = pattern, n, 0, fill
            values = [0, *sorted(set(pattern))]
            if self.used + len(values) > len(self.taken):
                self._make_room(len(values))
            here = slice(self.used, self.used + len(values))
            self.taken[here], self.owner[here] = values, k
            self.upto[here] = self.taken[here] + self.capacity - fill
            self.used += len(values)
        heapq.heappush(self.heap, (fill, k))

    def _make_room(self, more: int) -> None:
        live = np.isin(self.owner[: self.used], np.fromiter(self.counts, np.int64, len(self.counts)))
        kept = [x[: self.used][live] for x in (self.taken, self.upto, self.owner)]
        self.used = len(kept[0])
        space = np.zeros(self.used + 2 * more + 1024, np.int64)
        self.taken, self.upto, self.owner = (np.concatenate((x, space)) for x in kept)

    def _remove(self, k: int, n: int) -> None:
        self.counts[k] -= n
        if not self.counts[k]:
            del self.counts[k], self.numbers[self.patterns[k]], self.patterns[k], self.looked[k], self.fill[k]

    def run(self) -> None:
        seen = -1
        while seen < self.next:
            seen = self.next
            self.heap = [(sum(p), k) for k, p in self.patterns.items() if self.looked[k] < self.next]
            heapq.heapify(self.heap)
            while self.heap:
                _, k = heapq.heappop(self.heap)
                if k in self.counts and self.looked[k] < self.next:
                    self._give(k)

    def _give(self, k: int) -> None:
        """Exchanges of one donor with every pattern as full or fuller that it has not looked at."""
        donor, end = self.patterns[k], self.next
        for other in self._partners(k):
            if k not in self.counts:
                return
            n = self.counts[k] // 2 if other == k else min(self.counts[k], self.counts.get(other, 0))
            if n == 0:
                continue
            theirs = self.patterns[other]
            given, back = _exchange(donor, theirs, self.capacity - self.fill[other])
            self._remove(k, n)
            self._remove(other, n)
            self._add(_swapped(donor, given, back), n)
            self._add(_swapped(theirs, back, given), n)
        if k in self.counts:
            self.looked[k] = end

    def _partners(self, k: int) -> list[int]:
        """Patterns with an exchange: the largest sum of one or two of the donor's pieces that fits for what is taken out
        exceeds it. Those come first whose exchange raises the sum of squares most, as few steps then remain."""
        first = int(np.searchsorted(self.owner[: self.used], self.looked[k]))  # numbers only rise
        taken, upto, owner = (x[first : self.used] for x in (self.taken, self.upto, self.owner))
        mine = sorted(set(self.patterns[k]))
        one = np.zeros(self.capacity + 1, np.int64)
        one[mine] = mine
        two = one.copy()
        sums = [a + b for a, b in itertools.combinations(mine, 2)] + [2 * a for a, n in Counter(self.patterns[k]).items() if n > 1]
        two[sums] = sums
        gain = np.where(taken == 0, np.maximum.accumulate(one)[upto], np.maximum.accumulate(two)[upto]) - taken
        some = gain > 0
        best: dict[int, int] = {}
        for other, g in zip(owner[some].tolist(), gain[some].tolist(), strict=True):
            if g > best.get(other, 0):
                best[other] = g
        fill, n = self.fill[k], self.counts[k]
        found = [(g * (self.fill[o] - fill + g) * min(n, self.counts[o]), o) for o, g in best.items() if o in self.counts and self.fill[o] >= fill]
        return [o for _, o in sorted(found, reverse=True)]


def _swapped(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    left = list(pattern)
    for a in out:
        left.remove(a)
    return tuple(sorted(left + list(into), reverse=True))


def _exchange(donor: Pattern, other: Pattern, room: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """What goes to `other`, the fuller bin, and what comes back, so that it fills most: fuller grows, so the sum of squares
    does. Nothing goes if nothing raises it."""
    best, move = 0, ((), ())
    theirs = sorted(set(other))
    mine = sorted(set(donor))
    for a in mine:  # one outright
        if best < a <= room:
            best, move = a, ((a,), ())
    for a in mine:  # one for one
        k = bisect.bisect_left(theirs, a - room)
        if k < len(theirs) and best < a - theirs[k] <= room:
            best, move = a - theirs[k], ((a,), (theirs[k],))
    for a, b in itertools.combinations_with_replacement(mine, 2):  # two for one
        if a == b and donor.count(a) < 2:
            continue
        k = bisect.bisect_left(theirs, a + b - room)
        if k < len(theirs) and best < a + b - theirs[k] <= room:
            best, move = a + b - theirs[k], ((a, b), (theirs[k],))
    return move


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (key, piece, length, any other columns) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    bins = local_search(best_fit(counts, capacity), capacity)
    slots, used, first = [], Counter(), 0
    for pattern, times in bins.items():
        offset = 0
        for size in pattern:
            slots.append((size, used[size], first, offset))
            used[size] += times
            offset += size
        first += times
    places: dict[int, tuple] = {}
    for size, group in itertools.groupby(sorted(slots), key=lambda s: s[0]):
        ranks, firsts, offsets = zip(*[(r, f, o) for _, r, f, o in group], strict=True)
        places[size] = (np.array(ranks), np.array(firsts), np.array(offsets))
    shared = spark.sparkContext.broadcast(places)  # a few arrays a pattern; their number depends on the lengths, not on the pieces
    # A length with many pieces is numbered in buckets, each behind the count of those before it.
    many = {size: -(-n // NUMBERED) for size, n in counts.items() if n > NUMBERED}
    buckets = F.lit(1)
    for size, n in many.items():
        buckets = F.when(F.col("length") == size, n).otherwise(buckets)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("key", "piece"), buckets))
    sums = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("key", "piece", "start"))
    ranked = rows.withColumn("_number", number).join(F.broadcast(starts), ["length", "_bucket"])  # a row a length, and one more for every NUMBERED pieces
    ranked = ranked.withColumn("_rank", (F.col("_start") + F.col("_number") - 1).cast("long")).drop("_start", "_number", "_bucket")
    names = [c for c in ranked.columns if c != "_rank"]
    schema = T.StructType([*[ranked.schema[c] for c in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        table = shared.value
        for batch in batches:
            length, rank = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                here = np.flatnonzero(length == size)
                ranks, firsts, offsets = table[int(size)]
                k = np.searchsorted(ranks, rank[here], side="right") - 1
                sequence[here] = firsts[k] + rank[here] - ranks[k]
                offset[here] = offsets[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    pieces = stage_table(tokenized(df, vocab, id_col, text_col, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""N-gram Jaccard join by parity sketches.

A text's shingle set is dealt, by the high bits of each hash, to the words of a sketch; a word is the XOR of
its hashes, so the number of words in which two sketches differ is at most the size of the sets' symmetric
difference. Sets that link differ in at most D shingles, D following from their sizes; so, within a band of
sizes that share a sketch width, each set's first D + 1 non-empty words must hold one that both have alike
(pigeonhole). Words seen in two sets propose pairs: each set with the smallest of its group. A finer parity
sketch, one bit a shingle, whose Hamming distance is a lower bound too, throws out most false pairs; the rest
are verified on the whole sets. In groups of three or more whose members then still lie in different components,
the sketches are searched, in squares of bounded size, for links that would join those; the likeliest ones are
verified, and so on, barring those that failed, until the sketches leave none. So no link between components is
lost, and links within one need no test.

Equal sets are one node from the start. Links and components stay in tables.

Cases: a null text, or one without words, is empty and linked with nothing (its component is its own id); of
equal ids the component is the same if the texts are; null ids count as larger than any other; repeated rows
repeat; other columns are not read; no rows in, none out.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_tables, row_key, small_batches, stage_table, text_of
from .components import components
from .shingles import fingerprint, mix, shingle_sets

PERCENT = 80
#: Sets of a square of the pairwise search.
SQUARE = 2048
SEEN = 200_000
#: Texts that common shingles are looked for in, about; the share of them that makes a shingle common; and so many count.
SAMPLE = 8_000
COMMON = 0.003
MOST_COMMON = 50_000
#: Members of a group that a worker holds at once.
HELD = 20_000


@functools.lru_cache(maxsize=100_000)
def most_differing(n: int, largest: int | None = None, percent: int = PERCENT) -> int:
    """The most shingles in which a set of n and one that links with it, of `largest` at most, can differ."""
    top = min(100 * n // percent, largest if largest is not None else 100 * n // percent)
    best = 0
    for total in range(n + top, max(n + top - 9, 0), -1):  # the bound falls with the total but for rounding
        common = -(-percent * total // (100 + percent))
        best = max(best, total - 2 * common)
    return best


def band_of(n: int) -> int:
    return n.bit_length() - 1


def sketch_words(band: int, percent: int = PERCENT) -> int:
    """Words of the sketches of the band: enough that a set of any size in it has D + 1 that are not empty."""
    top = (2 << band) - 1
    need = most_differing(top, percent=percent)
    return 1 if not need else need + need // 10 + 4


def signatures(found: np.ndarray, percent: int = PERCENT, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of (band, place, word) of the first D + 1 non-empty words, for the set's own band and, if a smaller
    set of the band below may link with it, for that one.

    Words made of common shingles alone come last. The pigeonhole holds in any order of the words that all sets
    share: sets whose first D + 1 words have nothing in common differ in more than D words.
    """
    n, out = len(found), []
    own = band_of(n)
    mixed = mix(found ^ np.uint64(0x5851F42D4C957F2D))
    usual = np.zeros(n, bool)
    if common is not None and len(common):
        near = np.minimum(np.searchsorted(common, found), len(common) - 1)
        usual = common[near] == found
    for band in (own, own - 1):
        if band < 0:
            continue
        if band == own:
            most = most_differing(n, percent=percent)
        else:
            low = (2 << band) - 1  # the largest size of the band below
            if 100 * low < percent * n:
                continue
            most = most_differing(n, low, percent)
        width = sketch_words(band, percent)
        place = ((found >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)
        starts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        if len(starts) <= most:  # too few words hold anything: the empty ones count as well
            words = np.zeros(width, np.uint64)
            words[place[starts].astype(np.int64)] = np.bitwise_xor.reduceat(mixed, starts)
            places = np.arange(width, dtype=np.uint64)
        else:
            first = np.argsort(np.logical_and.reduceat(usual, starts), kind="stable")[: most + 1]
            words = np.bitwise_xor.reduceat(mixed, starts)[first]
            places = place[starts[first]]
        out.append(mix(words + mix(places * np.uint64(64) + np.uint64(band + 1))))
    return np.concatenate(out)


def common_shingles(df: DataFrame, members: DataFrame, text_col: str = "text") -> np.ndarray:
    """Shingles that many texts of a sample share. They only order the words of a sketch, so a sample will do:
    with any other order the links found are the same."""
    total = members.count()
    share = max(1, total // SAMPLE)

    def run(batches):
        for batch in batches:
            sets = [s for s in shingle_sets([t.encode() for t in batch.column(0).to_pylist()]) if len(s)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    text = text_of(text_col)
    sample = df.select(text.alias("text")).where(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(share)) == 0).distinct()
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= max(8, COMMON * min(total, SAMPLE)))
    found = counts.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["shingle"] for r in found], np.int64).view(np.uint64))


def parity_bits(found: np.ndarray) -> bytes:
    """One bit flipped a shingle, over a power of two of bits, two to eight times the set's size."""
    bits = 64 << max(0, band_of(max(1, len(found) * 4 // 5)) - 3)
    at = (mix(found + np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Differing bits; the longer sketch is folded onto the shorter, which keeps the lower bound."""
    while len(a) > len(b):
        a = (int.from_bytes(a[: len(a) // 2], "little") ^ int.from_bytes(a[len(a) // 2 :], "little")).to_bytes(len(a) // 2, "little")
    if len(b) > len(a):
        return hamming(b, a)
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def may_link(na: int, nb: int, a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    small, large = sorted((na, nb))
    total = small + large
    return 100 * small >= percent * large and hamming(a, b) <= total - 2 * -(-percent * total // (100 + percent))


def _positive(x: int) -> int:
    return (x & 0x7FFFFFFFFFFFFFFF) or 1


def _folded(rows: np.ndarray, length: int) -> np.ndarray:
    while rows.shape[1] > length:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


class Sketches:
    """Sizes and parity sketches of some sets; excess(i) says by how much each set misses a link with set i at best."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int):
        self.n, self.bits, self.percent = n, bits, percent
        lengths = np.array([len(b) for b in bits])
        self.by_length = {int(k): (at := np.flatnonzero(lengths == k), np.frombuffer(b"".join(bits[x] for x in at), np.uint8).reshape(len(at), k)) for k in np.unique(lengths)}
        self.folds: dict[tuple[int, int], np.ndarray] = {}

    def excess(self, i: int) -> np.ndarray:
        out = np.full(len(self.n), np.inf)
        own = np.frombuffer(self.bits[i], np.uint8)[None, :]
        for length, (at, rows) in self.by_length.items():
            short = min(length, own.shape[1])
            if (length, short) not in self.folds:
                self.folds[length, short] = _folded(rows, short)
            ok = 100 * np.minimum(self.n[at], self.n[i]) >= self.percent * np.maximum(self.n[at], self.n[i])
            if ok.any():
                total = self.n[at][ok] + self.n[i]
                differ = np.bitwise_count(self.folds[length, short][ok] ^ _folded(own, short)).sum(1, dtype=np.int64)
                most = total - 2 * -(-self.percent * total // (100 + self.percent))
                out[at[ok]] = np.where(differ <= most, (differ - most) / total, np.inf)
        return out


def spanning_links(sketches: Sketches, part: np.ndarray, barred: list[list[int]], more: int = 0) -> list[tuple[int, int]]:
    """The likeliest links that would join the parts as far as the sketches let them: a forest over the parts, so
    fewer than the sets, and each set's `more` next likeliest, found without listing all pairs. barred[i]: sets
    known not to link with set i."""
    count = len(part)
    best, source, inside, out = np.full(count, np.inf), np.zeros(count, np.int64), np.zeros(count, bool), []

    def enter(members: np.ndarray) -> None:
        inside[members] = True
        for i in members.tolist():
            near = sketches.excess(i)
            near[barred[i]] = np.inf
            near[part == part[i]] = np.inf
            if more:
                at = np.argsort(near, kind="stable")[:more]
                out.extend((i, int(j)) for j in at[np.isfinite(near[at])])
            closer = near < best
            best[closer], source[closer] = near[closer], i

    while not inside.all():
        open_best = np.where(inside, np.inf, best)
        k = int(np.argmin(open_best))
        if np.isinf(open_best[k]):  # nothing links with what is inside; start from another part
            k = int(np.argmin(inside))
        else:
            out.append((int(source[k]), k))
        enter(np.flatnonzero((part == part[k]) & ~inside))
    return out


def _members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1, k2 (naming the row), node, n, bits."""
    text = text_of(text_col)
    k1, k2 = row_key(id_col, text)
    rows = df.select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("k1", "k2", "node", "n")], T.StructField("bits", T.BinaryType())])

    def run(batches):
        for batch in batches:
            node, size, bits = [], [], []
            for found in shingle_sets([t.encode() for t in batch.column(3).to_pylist()]):
                node.append(fingerprint(found))
                size.append(len(found))
                bits.append(parity_bits(found) if len(found) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bits, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _signed(df: DataFrame, text_col: str, percent: int, common: np.ndarray) -> DataFrame:
    """(sig, node) of all texts with words; a worker leaves out sets that it has just done."""

    shared = df.sparkSession.sparkContext.broadcast(common)  # MOST_COMMON hashes at most

    def run(batches):
        done: set[int] = set()
        for batch in batches:
            sigs, nodes = [], []
            for found in shingle_sets([t.encode() for t in batch.column(0).to_pylist()]):
                node = fingerprint(found)
                if not len(found) or node in done:
                    continue
                if len(done) >= SEEN:
                    done.clear()
                done.add(node)
                s = signatures(found, percent, shared.value)
                sigs.append(s)
                nodes.append(np.full(len(s), node, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    return df.select(text_of(text_col).alias("text")).mapInArrow(run, "sig long, node long")


def _grouped(signed: DataFrame) -> DataFrame:
    """Of each signature's nodes: (0, smallest, other) for every other; and for groups of three or more also
    (group, node, node) of every member, where groups with the same members have the same name.

    The rows come sorted and stream through. A group's members are held to name it; those of a group above HELD
    go on as they come, under the name of their signature.
    """

    def run(batches):
        sig = low = last = name = None
        members: list[int] = []
        size = 0
        pairs: set[tuple[int, int]] = set()
        known: set[int] = set()
        out: list[tuple[int, int, int]] = []

        def close():
            nonlocal name
            if size > 2:
                if name is None:
                    with np.errstate(over="ignore"):
                        places = np.arange(1, len(members) + 1, dtype=np.uint64)
                        name = _positive(int(mix(np.array(members, np.int64).view(np.uint64) + mix(places)).sum(dtype=np.uint64)))
                    if name in known:
                        members.clear()
                    known.add(name)
                out.extend((name, m, m) for m in members)
            members.clear()
            name = None

        def emit():
            part = np.array(out, np.int64).reshape(-1, 3)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[:, k].copy()) for k in range(3)], names=["grp", "a", "b"])

        for batch in batches:
            sigs, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sigs):
                continue
            # Only signatures that come twice go on to the loop; the first and last rows may go on from or into another batch.
            same = np.concatenate(([True], sigs[1:] == sigs[:-1]))
            keep = same | np.concatenate((sigs[1:] == sigs[:-1], [True]))
            for s, node in zip(sigs[keep].tolist(), nodes[keep].tolist(), strict=True):
                if s != sig:
                    close()
                    sig, low, last, size = s, node, node, 1
                    members.append(node)
                elif node != last:
                    last = node
                    size += 1
                    members.append(node)
                    if len(members) > HELD:
                        name = name or _positive(s)
                        out.extend((name, m, m) for m in members)
                        members.clear()
                    if (low, node) not in pairs:
                        pairs.add((low, node))
                        out.append((0, low, node))
                if len(pairs) > 500_000:
                    pairs.clear()
                if len(known) > 500_000:
                    known.clear()
                if len(out) > 50_000:
                    yield emit()
        close()
        if out:
            yield emit()

    return signed.mapInArrow(run, "grp long, a long, b long")


def _sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity sketches don't rule out."""
    size = lambda p: nodes.select(F.col("node").alias(p), F.col("n").alias(f"n{p}")).hint("merge")
    bits = lambda p: nodes.select(F.col("node").alias(p), F.col("bits").alias(f"bits_{p}")).hint("merge")
    # Merged at every size: a side that is broadcast while small would make small and large inputs act differently. Sizes
    # come first, so that sketches travel only for pairs whose sizes allow a link.
    sized = pairs.join(size("a"), "a").join(size("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    sized = sized.join(bits("b"), "b").join(bits("a"), "a")

    def run(batches):
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "na", "nb", "bits_a", "bits_b"))
            keep = pa.array([may_link(*row, percent) for row in zip(na.to_pylist(), nb.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return sized.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, df: DataFrame, members: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """The staged pairs whose whole sets link, and the others; the texts of one row of each node are read again."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    rows = members.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"))
    rows = stage_table(rows.select("node", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")), "chosen")
    text = text_of(text_col)
    k1, k2 = row_key(id_col, text)
    texts = df.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).join(rows, ["k1", "k2"]).select("node", "text")
    # Repeated rows have the same key, so a node may come more than once.
    texts = stage_table(texts.dropDuplicates(["node"]), "texts")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "text_a", "text_b"))
            keep, last, last_set = [], None, None
            right = shingle_sets([t.encode() for t in y.to_pylist()])
            for node, text, other in zip(a.to_pylist(), x.to_pylist(), right, strict=True):
                if node != last:  # pairs come sorted by a
                    last, last_set = node, next(iter(shingle_sets([text.encode()])))
                common = np.intersect1d(last_set, other, assume_unique=True).size
                keep.append(100 * common >= percent * (len(last_set) + len(other) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    linked = stage_table(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "linked")
    missed = stage_table(pairs.join(linked, ["a", "b"], "left_anti"), "missed")
    drop_tables(rows, texts, pairs)
    return linked, missed


def _squared(groups: DataFrame) -> DataFrame:
    """(grp, node): groups, large ones cut into squares that are groups of their own: each pair of sides of up to SQUARE
    members makes one, so any two members of a group meet in a square and none holds more than two sides."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > SQUARE).select("grp", F.ceil(F.col("size") / F.lit(SQUARE)).cast("int").alias("sides"))
    rows = groups.join(large, "grp", "left").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("sides") - 1), lambda x: x != F.col("side"))
    squares = F.transform(others, lambda x: F.xxhash64("grp", F.least("side", x), F.greatest("side", x)))
    return rows.select(F.explode(F.when(F.col("sides").isNull(), F.array("grp")).otherwise(squares)).alias("grp"), "node")


def _across(groups: DataFrame, nodes: DataFrame, parts: DataFrame, failed: DataFrame, percent: int, more: int) -> DataFrame:
    """(grp, a, b): for each group whose members lie in different components, links that may join those; and, if there
    are any, (grp, m, m) of each member m."""
    same = Window.partitionBy("grp")
    placed = groups.join(parts.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.withColumn("low", F.min("component").over(same)).withColumn("high", F.max("component").over(same)).where("low <> high")
    both = failed.select(F.col("a").alias("node"), F.col("b").alias("not")).unionByName(failed.select(F.col("b").alias("node"), F.col("a").alias("not")))
    barred = both.groupBy("node").agg(F.collect_set("not").alias("barred"))
    rows = mixed.join(nodes.hint("merge"), "node").join(barred.hint("merge"), "node", "left").select("grp", "node", "n", "bits", "component", "barred")

    def run(key, table):
        node, n, part = (table.column(c).to_numpy() for c in ("node", "n", "component"))
        place = {x: k for k, x in enumerate(node.tolist())}
        known = [[place[x] for x in row or () if x in place] for row in table.column("barred").to_pylist()]
        pairs = spanning_links(Sketches(n, table.column("bits").to_pylist(), percent), part, known, more)
        found = [(min(node[i], node[j]), max(node[i], node[j])) for i, j in pairs]
        found = np.array(found + [(x, x) for x in node] if found else [], np.int64).reshape(-1, 2)
        return pa.table({"grp": np.full(len(found), key[0].as_py()), "a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return rows.groupBy("grp").applyInArrow(run, "grp long, a long, b long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, k1 and k2 (the row's key), n_shingles, component (its smallest node; null without words) and component_id of
    each row."""
    spark = df.sparkSession
    small_batches(spark)
    members = stage_table(_members(df, id_col, text_col), "members")
    nodes = members.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = stage_table(nodes, "nodes")
    signed = _signed(df, text_col, percent, common_shingles(df, members, text_col))
    proposed = stage_table(_grouped(signed.repartition("sig").sortWithinPartitions("sig", "node")), "proposed")
    groups = stage_table(_squared(proposed.where("grp <> 0").select("grp", F.col("a").alias("node")).distinct()), "groups")
    tried = stage_table(_sketched(proposed.where("grp = 0").select("a", "b").distinct(), nodes, percent), "tried")
    drop_tables(proposed)
    links = failed = parts = None
    more = 0
    while True:
        linked, missed = _verified(tried, df, members, id_col, text_col, percent)
        links, failed = (linked, missed) if links is None else (links.unionByName(linked), failed.unionByName(missed))
        if parts is None or not linked.isEmpty():
            parts = stage_table(components(links), "parts")
        found = stage_table(_across(groups, nodes, parts, failed, percent, more), "across")
        drop_tables(groups)
        if found.isEmpty():
            break
        # A group that has nothing left to try has nothing later either: components only merge, and failures only add up.
        groups = found.where("a = b").select("grp", F.col("a").alias("node"))
        groups.staged_at = found.staged_at
        tried = stage_table(found.where("a <> b").select("a", "b").distinct(), "tried")
        more = 4 * more + 1  # what is left to try is little, and most of it fails
    heads = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = heads.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "component").select("node", "component", "component_id")
    full = members.where("n > 0").select("doc_id", "k1", "k2", "node", "n").join(named, "node")
    empty = members.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    columns = ["doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component", "component_id"]
    return full.select(*columns).unionByName(empty.select(*columns))


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """df with one row of each component, that of the smallest id (of equal ids, any one), and every row without words;
    columns as they were."""
    found = jaccard_components(df, id_col, text_col, percent).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k1"), F.col("k2")))
    chosen = found.groupBy("component").agg(first.alias("row")).select(F.col("row.k1").alias("_k1"), F.col("row.k2").alias("_k2"))
    text = text_of(text_col)
    k1, k2 = row_key(id_col, text)
    words = text.rlike("[^\\x20\\x09-\\x0D]")
    row = F.struct(*[F.col(c) for c in df.columns])
    full = df.where(words).select(k1.alias("_k1"), k2.alias("_k2"), row.alias("_row"))
    kept = full.join(chosen, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_row.*")
    return kept.unionByName(df.where(~words))

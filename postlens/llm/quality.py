"""Quality rules: a learned decision list.

Features of each text are Spark expressions. A bounded sample of labelled rows gives counts of good and bad
texts by binned features; sequential covering grows conjunctions of thresholds on one part of the counts,
prunes them on the other, and emits them, in order, as one conditional Spark expression.

Cases: a null or empty text has no words and fails the base rule; a null label is no label, of several labels
of an id the smallest counts; without labels the list is empty and only the base rule rejects; repeated rows
repeat; other columns are not read; no rows in, none out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

#: Labelled rows that a list is learned from at most, the first by a hash of the id.
FIT_ROWS = 20_000
#: A rule must be this precise where it was grown and where it was pruned.
MIN_PRECISION = 0.9
MIN_COVER = 5
MAX_RULES = 12
MAX_CONDITIONS = 3
#: Thresholds are these quantiles of the good and of the bad texts.
QUANTILES = [0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995, 0.999]

GAPS = "[\\x20\\x09-\\x0D]+"
FEATURES = ["n_words", "word_length", "symbol_rate", "upper_rate", "mark_rate", "digit_rate", "dup_line_rate", "repeat_rate", "line_words"]


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def _count(text: Column, char_class: str) -> Column:
    """Characters of the class: the pieces between them, less one."""
    return (F.size(F.split(text, char_class)) - 1).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")))["n"]

    def twice(windows: Column) -> Column:
        same = F.filter(windows, lambda x, k: (x["h"] == F.get(windows, k - 1)["h"]) | (x["h"] == F.get(windows, k + 1)["h"]))
        return covered(F.array_sort(F.transform(same, lambda x: x["i"])))

    def of_hashes(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, twice))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(let(hashes, of_hashes))

    return let(words, of_words).cast("long")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts and the features of each row; columns named in keep ride along."""
    text = text_of(text_col)
    one = df.select(F.col(id_col).alias("doc_id"), *[F.col(k) for k in keep], text.alias("_text"), word_list(text).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = one.select(
        "doc_id",
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), "[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        _count(F.col("_text"), "[A-Z]").alias("_upper"),
        _count(F.col("_text"), "[!?]").alias("_marks"),
        _count(F.col("_text"), "[0-9]").alias("_digits"),
    )

    def per(count: str | Column, total: str | Column, times: int) -> Column:
        return F.coalesce(F.try_divide(times * (F.col(count) if isinstance(count, str) else count), F.col(total) if isinstance(total, str) else total), F.lit(0.0))

    return one.select(
        "doc_id",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("_lines.dup").alias("n_dup_lines"),
        "n_repeat_words",
        per("word_chars", "n_words", 1).alias("word_length"),
        per("n_symbols", "word_chars", 1000).alias("symbol_rate"),
        per("_upper", "word_chars", 1000).alias("upper_rate"),
        per("_marks", "word_chars", 1000).alias("mark_rate"),
        per("_digits", "word_chars", 1000).alias("digit_rate"),
        per(F.col("_lines.dup"), F.col("_lines.n"), 1000).alias("dup_line_rate"),
        per("n_repeat_words", "n_words", 1000).alias("repeat_rate"),
        per("n_words", F.col("_lines.n"), 1).alias("line_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, at_least, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_least, threshold in self.conditions:
            out = out & (F.col(name) >= threshold if at_least else F.col(name) < threshold)
        return out


def verdict(rules: list[Rule]) -> Column:
    """Keep unless a rule of the list, taken in order, rejects."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """The decision list from labelled rows: label 1 is good, 0 bad. Rows that the base rule rejects teach nothing."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_labelled")).agg(F.min(label_col).alias("_label"))
    known = known.orderBy(F.xxhash64(F.lit("fit"), "_labelled"), "_labelled").limit(fit_rows)  # fit_rows short rows at most, so it may be broadcast
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_full")).join(F.broadcast(known), F.col("_id") == F.col("_labelled"))
    rows = rows.select("_id", "_full", "_label").persist()  # or the base rule's filter would go below the join and measure every text
    seen = measured(rows, "_id", "_full", keep=("_label",)).where(~base_failed()).select("doc_id", "_label", *FEATURES)
    part = (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) == 0).alias("prune")
    seen = seen.select(part, (F.col("_label") == 0).alias("bad"), *FEATURES).persist()
    try:
        marks = seen.groupBy("bad").agg(*[F.percentile_approx(f, QUANTILES, 2000).alias(f) for f in FEATURES]).collect()
        cuts = {f: sorted({x for r in marks for x in r[f]}) for f in FEATURES}
        bins = [sum(((F.col(f) >= c).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]
        cells = seen.select("prune", "bad", *bins).groupBy("prune", "bad", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()  # fit_rows at most
    finally:
        seen.unpersist()
        rows.unpersist()
    return cover(cells, cuts)


def cover(cells: list, cuts: dict[str, list[float]]) -> list[Rule]:
    bins = np.array([[r[f] for f in FEATURES] for r in cells])
    count = np.array([r["n"] for r in cells], float)
    bad, prune = np.array([r["bad"] for r in cells], bool), np.array([r["prune"] for r in cells], bool)
    tests = [(k, at_least, b) for k, f in enumerate(FEATURES) for b in range(1, len(cuts[f]) + 1) for at_least in (True, False)]
    left, rules = np.ones(len(cells), bool), []

    def holds(test) -> np.ndarray:
        k, at_least, b = test
        return (bins[:, k] >= b) == at_least

    def tally(mask: np.ndarray) -> tuple[float, float]:
        return count[mask & bad].sum(), count[mask & ~bad].sum()

    while len(rules) < MAX_RULES and tally(left & ~prune)[0] >= MIN_COVER:
        now, chosen = left & ~prune, []
        while len(chosen) < MAX_CONDITIONS:
            p0, n0 = tally(now)
            if not n0:
                break
            best, gain = None, 0.0
            for test in tests:
                p, n = tally(now & holds(test))
                if p >= MIN_COVER and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain + 1e-9:
                    best, gain = test, g
            if best is None:
                break
            chosen.append(best)
            now &= holds(best)

        def worth(parts: list, where: np.ndarray) -> float:
            mask = where.copy()
            for t in parts:
                mask &= holds(t)
            p, n = tally(mask)
            return (p + 1) / (p + n + 2)

        while len(chosen) > 1:  # drop a last condition that the pruning part does not support
            if worth(chosen[:-1], left & prune) < worth(chosen, left & prune):
                break
            chosen.pop()
        mask = left.copy()
        for t in chosen:
            mask &= holds(t)
        (p, n), (hp, hn) = tally(mask), tally(mask & prune)
        if not chosen or p < MIN_COVER or p / (p + n) < MIN_PRECISION or not hp or (hp + 1) / (hp + hn + 1) < MIN_PRECISION:
            break
        rules.append(Rule(tuple((FEATURES[k], at_least, float(cuts[FEATURES[k]][b - 1])) for k, at_least, b in chosen)))
        left &= ~mask
    return rules


def judge(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The measures with base_failed and kept."""
    seen = measured(df, id_col, text_col, keep)
    failed = base_failed()
    return seen.withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(verdict(rules)))

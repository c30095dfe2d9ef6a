"""Personal data by candidate gradient boosting.

High-recall patterns propose spans, which may overlap: the four base kinds and, beyond them, words with
digits, groups of digits and settings such as `password=`. Features of a candidate's format and of the text
before it go through boosted trees, which are plain conditional Spark expressions; a threshold calibrated on
held-out examples selects. Spans of the base kinds that pass their own checks always stay; a selected
candidate is added unless one span holds it whole already. So spans may overlap, and redaction masks their union: of a setting whose value holds
an address, all goes. Offsets are code points.

The trees are trained here, on examples written by rule: well-formed personal data and secrets, also with
data of the base kinds inside, against the dates, versions, prices, part numbers and settings that look like them.

Cases: a null or empty text has no spans; repeated rows repeat; other columns are not read; no rows in, none
out.
"""

from __future__ import annotations

import functools
import json
import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, scan_before, text_of

_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: Kind, pattern, and what a text must hold to be searched. A match of an unanchored pattern always starts where
#: a run of its first class starts or where the match before ended; saying so keeps long runs from being tried
#: from every place in them.
BASE = [
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]+\.[0-9]"),
    ("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){15}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
]

#: Generators beyond the base kinds: name, pattern, and what a text must hold. No run has a longest length, or its tail would
#: stay; a run is taken whole (possessive), so its length costs no second try.
WIDE = [
    ("secret", r"(?i)(?<![A-Za-z])(?:password|passwd|passphrase|pwd|secret|token|(?:api|access|private)[ _-]?key)[ \t]*+[:=][ \t]*+(?:\"[^\"\n]*+\"|[^\s\"]++)", r"[:=]"),
    ("code", r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{6,}+", r"[0-9]"),
    ("number", r"(?<![0-9])[0-9]{2,}+(?:[ .-][0-9]{2,}+)++", r"[0-9][ .-][0-9]"),
    ("letters", r"(?<![A-Za-z0-9])[A-Za-z]{20,}+(?![0-9])", r"[A-Za-z]{20}"),
]
KINDS = [kind for kind, _, _ in BASE + WIDE]
CONTEXT = 24
KEYWORDS = "(?i)(?:tel|phone|call|fax|mobile|mail|card|visa|iban|account|ssn|social security|passport|password|passwd|pwd|secret|token|key|login|host|server|ip)[^A-Za-z]{0,6}$"
OTHER_WORDS = "(?i)(?:version|release|v|page|pages|chapter|section|isbn|room|table|figure|fig|no|part|model|order|since|year|in)[^A-Za-z]{0,3}$"
FEATURES = ["length", "digits", "upper", "lower", "marks", "groups", "longest_digits", "hex", "mixed", "at", "dots", "dashes", "setting", "equals", "quoted", "case_changes", "key_before", "word_before", "prefix"]
SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches with their offsets: what lies between matches gives where they are."""

    def placed(x: Column) -> Column:
        both = F.transform(x["in"], lambda m, i: F.length(F.get(x["out"], i)) + F.length(m))

        def span(m: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(x["out"], i))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"))

        return let(scan_before(both, lambda a, b: a + b), lambda before: F.transform(x["in"], lambda m, i: span(m, i, before)))

    return let(F.struct(F.split(text, pattern, -1).alias("out"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("in")), placed)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^0*{_PART}(?:\.0*{_PART}){{3}}$")
    if kind == "card":
        return let(_digits(found), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def features(found: Column, before: Column) -> dict[str, Column]:
    def kept(char_class: str) -> Column:
        return F.length(F.regexp_replace(found, f"[^{char_class}]", ""))

    digits, upper, lower = kept("0-9"), kept("A-Z"), kept("a-z")
    runs = F.transform(F.split(found, "[^0-9]+"), lambda x: F.length(x))
    return {
        "length": F.length(found),
        "digits": digits,
        "upper": upper,
        "lower": lower,
        "marks": F.length(found) - digits - upper - lower,
        "groups": F.size(F.filter(runs, lambda n: n > 0)),
        "longest_digits": F.array_max(runs),
        "hex": found.rlike("[0-9a-f]{16}").cast("int"),
        "mixed": ((digits > 0) & (upper + lower > 0)).cast("int"),
        "at": F.size(F.split(found, "@")) - 1,
        "dots": F.size(F.split(found, "[.]")) - 1,
        "dashes": F.size(F.split(found, "-")) - 1,
        "setting": found.rlike("[:=]").cast("int"),
        "equals": found.rlike("=").cast("int"),
        "quoted": found.rlike("\"").cast("int"),
        "case_changes": F.size(F.split(found, "(?<=[a-z])(?=[A-Z])")) - 1,
        "key_before": before.rlike(KEYWORDS).cast("int"),
        "word_before": before.rlike(OTHER_WORDS).cast("int"),
        "prefix": found.rlike("^(?:AKIA|ASIA|ghp|sk|xox|AIza)").cast("int"),
    }


def _examples() -> list[tuple[str, str, int]]:
    """(text before, span, label), by rule from a fixed seed."""
    r = random.Random(11)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    digits = lambda n: pick(string.digits, n)
    word = lambda: pick("aeioulnrst", r.randint(3, 9))
    hexed, code = "0123456789abcdef", string.ascii_uppercase + string.digits
    yes = {
        "": [
            lambda: f"{word()}.{digits(2)}@{word()}.example.com",
            lambda: f"{word()}@{word()}.org",
            lambda: ".".join(str(r.randint(10, 255)) for _ in range(4)),
            lambda: digits(16),
            lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
            lambda: f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}",
            lambda: f"+{digits(2)} {digits(3)} {digits(7)}",
            lambda: f"AKIA{pick(code, 16)}",
            lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
            lambda: f"password={pick(hexed, r.randint(8, 20))}",
            lambda: f'token = "{pick(hexed, r.randint(24, 40))}"',
            lambda: f"api_key: {pick(string.ascii_letters + string.digits, 24)}",
            lambda: pick(hexed, 40),
            lambda: f"password={pick(string.ascii_letters + string.digits + '!?#%', r.randint(5, 12))}",
            lambda: f"password={word()}{digits(1)}!{word()}@{word()}.com",
            lambda: f"api_key: {pick(string.ascii_lowercase + string.digits, 12)}.{'.'.join(str(r.randint(1, 255)) for _ in range(4))}{pick(string.ascii_lowercase, 2)}",
            lambda: f'token="{word()}+1{digits(10)}{digits(2)}{word()}"',
            lambda: f"pwd={digits(2)}{pick(string.ascii_lowercase, 2)}",
            lambda: f"passwd   =\t{pick(string.ascii_lowercase + string.digits, r.randint(6, 14))}",
            lambda: f'secret: "{word()} {word()} {word()}"',
            lambda: f"password={word()}",
            lambda: pick(string.ascii_letters, r.randint(24, 48)),
            lambda: f"{pick(string.ascii_uppercase, 2)}{digits(2)}{digits(18)}",
        ],
        "call ": [lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)} {digits(4)}"],
    }
    no = {
        "": [
            lambda: f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.20{digits(2)}",
            lambda: f"{r.randint(10, 23)}-{r.randint(10, 59)}",
            lambda: f"{digits(2)}.{digits(2)}",
            lambda: f"{digits(4)}-{digits(4)}",
            lambda: f"{digits(3)} {digits(3)}",
            lambda: f"{digits(2)}.{digits(2)}.{digits(2)}",
            lambda: f"{word()}{word()}{digits(2)}",
            lambda: f"{word()}{digits(1)}{word()}{word()}",
            lambda: f"{pick(string.ascii_uppercase, 3)}{digits(5)}",
            lambda: digits(6),
            lambda: digits(8),
            lambda: digits(10),
            lambda: f"{word()}{digits(1)}",
            lambda: f"{pick(string.ascii_uppercase, 1)}{digits(5)}",
            lambda: f"token: {word()}",
            lambda: f"Password : {word()}",
            lambda: pick(string.ascii_lowercase, r.randint(20, 60)),
            lambda: pick(string.ascii_uppercase, r.randint(20, 40)),
            lambda: pick(string.ascii_uppercase, 1) + pick(string.ascii_lowercase, r.randint(20, 40)),
            lambda: f"{digits(4)}x{digits(4)}",
            lambda: f"{word().upper()}{word().upper()}{digits(2)}",
            lambda: f"{digits(3)}-{digits(1)}{digits(1)}-{digits(6)}-{digits(2)}",
        ],
        "version ": [lambda: ".".join(digits(2) for _ in range(3)), lambda: f"{digits(2)}.{digits(3)}"],
        "pages ": [lambda: f"{digits(3)}-{digits(3)}"],
        "isbn ": [lambda: f"978-{digits(2)}-{digits(5)}-{digits(2)}"],
    }
    out = []
    for label, kinds in ((1, yes), (0, no)):
        for before, makers in kinds.items():
            for make in makers:
                out += [(f"{word()} {word()} {before}", make(), label) for _ in range(24)]
    r.shuffle(out)
    return out


@dataclass(frozen=True)
class Booster:
    """Trees of depth two as (feature, threshold, feature, threshold, feature, threshold, four leaves); a bias, and the
    calibrated threshold of the sum."""

    trees: tuple[tuple, ...]
    threshold: float

    def score(self, x: dict[str, Column]) -> Column:
        total = F.lit(0.0)
        for f0, t0, f1, t1, f2, t2, a, b, c, d in self.trees:
            total = total + F.when(x[f0] < t0, F.when(x[f1] < t1, a).otherwise(b)).otherwise(F.when(x[f2] < t2, c).otherwise(d))
        return total


def _stump(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, float]:
    """Best (gain, feature, threshold) of a split of the rows."""
    best = (0.0, 0, -np.inf)
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for k in range(x.shape[1]):
        for t in np.unique(x[rows, k])[1:]:
            left = rows & (x[:, k] < t)
            right = rows & ~left
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - whole
            if gain > best[0] + 1e-9:
                best = (gain, k, float(t))
    return best


def _boost(x: np.ndarray, y: np.ndarray, rounds: int, rate: float) -> tuple[tuple, ...]:
    total, trees = np.zeros(len(y)), []
    every = np.ones(len(y), bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        _, k0, t0 = _stump(x, g, h, every)
        low = x[:, k0] < t0
        _, k1, t1 = _stump(x, g, h, low)
        _, k2, t2 = _stump(x, g, h, ~low)
        parts = [low & (x[:, k1] < t1), low & ~(x[:, k1] < t1), ~low & (x[:, k2] < t2), ~low & ~(x[:, k2] < t2)]
        leaves = [float(rate * g[m].sum() / (h[m].sum() + 1)) for m in parts]
        for m, leaf in zip(parts, leaves, strict=True):
            total[m] += leaf
        trees.append((FEATURES[k0], t0, FEATURES[k1], t1, FEATURES[k2], t2, *leaves))
    return tuple(trees)


def _sums(trees: tuple, x: np.ndarray) -> np.ndarray:
    at = {f: k for k, f in enumerate(FEATURES)}
    total = np.zeros(len(x))
    for f0, t0, f1, t1, f2, t2, a, b, c, d in trees:
        total += np.where(x[:, at[f0]] < t0, np.where(x[:, at[f1]] < t1, a, b), np.where(x[:, at[f2]] < t2, c, d))
    return total


def train(spark: SparkSession, rounds: int = 30, rate: float = 0.4, precision: float = 0.99) -> Booster:
    """Trees on two thirds of the examples; the threshold is the lowest at which the rest reach the precision."""
    rows = json.dumps([{"before": b, "found": f, "label": y} for b, f, y in _examples()])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<before:string,found:string,label:int>>")))
    seen = table.select(*[c.cast("double").alias(n) for n, c in features(F.col("found"), F.col("before")).items()], "label").collect()  # as many as the examples
    return _fit(tuple(tuple(r) for r in seen), rounds, rate, precision)


@functools.lru_cache(maxsize=4)
def _fit(seen: tuple, rounds: int, rate: float, precision: float) -> Booster:
    table = np.array(seen, float)
    x, y = table[:, :-1], table[:, -1]
    held = np.arange(len(y)) % 3 == 0
    trees = _boost(x[~held], y[~held], rounds, rate)
    sums, truth = _sums(trees, x[held]), y[held]
    order = np.argsort(-sums)
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(right >= precision)
    last = enough[-1] if len(enough) else 0
    return Booster(trees, float(max(0.0, sums[order][last])))


def find_spans(df: DataFrame, booster: Booster, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, base (valid spans of the base kinds) and spans (all), sorted by kind, then start."""
    text = F.col("text")
    # Both digits and the marks of the base kinds are rare, so most texts are only looked through once.
    rows = df.select(F.col(id_col).alias("doc_id"), *[F.col(k) for k in keep], text_of(text_col).alias("text"))
    none = F.array().cast(SPAN)

    def base_kind(kind: str, pattern: str, needs: str) -> Column:
        here = F.contains(text, F.lit("@")) if needs == "@" else text.rlike(needs)
        return F.when(here, F.filter(matches(text, pattern, kind), lambda s: _valid(kind, s["found"]))).otherwise(none)

    base = F.concat(*[base_kind(*x) for x in BASE])
    rows = rows.withColumn("base", F.when(text.rlike("[0-9@]"), base).otherwise(none))

    def chosen(candidates: Column, taken: Column) -> Column:
        def good(s: Column) -> Column:
            before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
            free = ~F.exists(taken, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
            scored = let(F.struct(*[c.alias(n) for n, c in features(s["found"], before).items()]), lambda x: booster.score({n: x[n] for n in FEATURES}))
            return free & (scored >= booster.threshold)

        return F.filter(candidates, good)

    def wide(taken: Column) -> Column:
        for kind, pattern, needs in WIDE:  # an earlier kind's spans rule out a later one's that they hold
            found = F.when(text.rlike(needs), matches(text, pattern, kind)).otherwise(none)
            taken = let(F.struct(taken.alias("t"), found.alias("f")), lambda x: F.concat(x["t"], chosen(x["f"], x["t"])))
        return taken

    return rows.withColumn("spans", F.when(text.rlike("[0-9=:]|[A-Za-z]{20}"), wide(F.col("base"))).otherwise(F.col("base")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, nothing stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(s: Column) -> Column:
        def piece(x: Column, at: Column) -> Column:
            return F.concat(F.substring(text, at + 1, F.greatest(x["start"] - at, F.lit(0))), F.lit("["), x["kind"], F.lit("]"))

        before = scan_before(F.transform(s, lambda x: x["end"]), F.greatest)
        parts = let(before, lambda b: F.transform(s, lambda x, i: piece(x, F.get(b, i))))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.array_max(F.transform(s, lambda x: x["end"])) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(ordered, cut)).otherwise(text)


def span_digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k, _, _ in BASE], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""Text functions as Spark expressions: folding, case, tags, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that search folds to a plain one, and dashes that it folds to a space.
FOLDS = [
    ("àáâãäåāăą", "a"),
    ("çćč", "c"),
    ("ďđ", "d"),
    ("èéêëēėęě", "e"),
    ("ğ", "g"),
    ("ìíîïīį", "i"),
    ("ł", "l"),
    ("ñńň", "n"),
    ("òóôõöøōő", "o"),
    ("ř", "r"),
    ("śšş", "s"),
    ("ť", "t"),
    ("ùúûüūůűų", "u"),
    ("ýÿ", "y"),
    ("źżž", "z"),
    ("-–—‑", " "),
]
FOLD_FROM = "".join(chars for chars, _ in FOLDS)
FOLD_TO = "".join(to * len(chars) for chars, to in FOLDS)


def fold(text: Column) -> Column:
    """Lower case, without accents, dashes as spaces: what search compares."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def trimmed(parts: Column) -> Column:
    """Every part trimmed. (A function of two parameters given to transform would get the index as the second.)"""
    return F.transform(parts, lambda p: F.trim(p))


def has(text: Column, pattern: str) -> Column:
    """Case-insensitive search; false for null."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def title_case(text: Column) -> Column:
    """Every letter after a non-letter in upper case, the others in lower case (so node.js becomes Node.Js)."""
    parts = F.split(F.lower(text), "(?<=[^\\p{L}])(?=\\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def blank_to(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def like_literal(text: str) -> str:
    """Escapes what LIKE would read as wildcards."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def once(value: Column, body) -> Column:
    """body of a value that is made once: a lambda's variable is bound, where a column would be written out at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, made by a generator of one row: later expressions read their values, where a projection of long
    expressions would be merged into each of its users."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))

"""Checks over public postings: what is missing, implausible, twice there or unlike its text. All of them in one reading of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has, once, squeeze, strip_tags
from .visibility import moment

# What the checks look for, on their own terms and not by the rules that they audit.
VENDOR_LABEL = r"^(?:US|USA|CA|GB),|United States of America|^[A-Z]{2}, [A-Z]{2}\b"
NOT_A_PLACE = r"\bOffsite\b|^Home\b|Friendly \(Travel"
NO_COUNTRY = ["Unknown", "Americas", "Unspecified"]
PAY_WORDS = r"salary|pay range|base pay|compensation|wage|base range|hiring range|pay details|annual base"
OTHER_MONEY = r"bonus|equity|stock|rsu|signing|stipend|funding|raised|valuation|revenue"
_SIGN, _AMOUNT = r"(?:CA\$|US\$|C\$|\$|£|€)", r"(?:\d{2,3}(?:,\d{3})+(?:\.\d+)?|\d{2,3}\s?k)"
STATED_PAY = rf"(?s)(?:{PAY_WORDS})(?:(?!{OTHER_MONEY}).){{0,160}}?{_SIGN}\s?{_AMOUNT}\s*(?:-|–|—|to|and)\s*{_SIGN}?\s?{_AMOUNT}"
HARD_CONDITION = r"\bITAR\b|(?:must|required to) be (?:a )?(?:U\.S\. )?citizens?|citizenship (?:is )?(?:required|essential)|(?:U\.S\.|US|Canadian) citizen(?:ship)?\b|permanent resident|(?:TS/SCI|top secret|secret|security|reliability)\s+(?:status\s+)?clearance"
EQUAL_CHANCES = r"equal opportunity|equal employment|diversity|inclusi|accommodat|protected (?:class|status)|without regard|regardless of (?:race|color)|disabilit"
LOWEST, HIGHEST, SPREAD, OLDEST_DAYS = 10, 3_000_000, 10, 30
#: Ids that a metric shows: the smallest in each of so many hash buckets, so that no list grows with the rows.
SAMPLE = 16


def _stored_ranges(pay: Column) -> Column:
    """array<struct<min, max, interval>> of a pay object: its own amounts and those of its ranges."""
    kind = "struct<min:double,max:double,interval:string>"
    return F.filter(F.concat(F.array(F.from_json(pay, kind)), F.coalesce(F.from_json(pay, f"struct<ranges:array<{kind}>>")["ranges"], F.array().cast(f"array<{kind}>"))), lambda r: r["min"].isNotNull() | r["max"].isNotNull())


def _impossible(r: Column) -> Column:
    return F.coalesce((r["max"] <= LOWEST) | (r["max"] > HIGHEST) | ((r["min"] > 0) & (r["max"] / r["min"] > SPREAD)), F.lit(False))


def _written(amount: Column, text: Column) -> Column:
    """Whether an amount stands in a text without commas: whole, with cents, or as thousands."""
    thousands = F.when(amount % 1000 == 0, F.contains(text, F.concat((amount / 1000).cast("long").cast("string"), F.lit("K"))))
    return F.contains(text, F.round(amount).cast("long").cast("string")) | F.contains(text, F.format_string("%.2f", amount)) | F.coalesce(thousands, F.lit(False))


def checks(as_of) -> dict[str, Column]:
    """A condition a metric, over columns of a posting and its text (see public_audit). None is null."""
    ranges, text = _stored_ranges(F.col("compensation")), F.col("_text")
    member = lambda name: F.get_json_object("compensation", f"$.{name}")
    shown = F.size(F.coalesce("pay_ranges", F.array())) > 0
    from_text = shown & (member("source") == "posting_text")
    labels = F.concat(F.array(F.struct("location", "country")), F.transform(F.coalesce("locations", F.array()), lambda x: F.struct(x["location"].alias("location"), x["country"].alias("country"))))
    sentences = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9•–-])")
    bare = F.replace(text, F.lit(","))
    untraced = once(bare, lambda t: F.exists(ranges, lambda r: F.exists(F.array_compact(F.array(r["min"], r["max"])), lambda v: ~_written(v, t))))
    found = {
        "missing_posted_at": F.col("posted_at").isNull(),
        "missing_skills": F.size(F.coalesce("skills", F.array().cast("array<string>"))) == 0,
        "internship_without_term": F.col("role_type").isin("internship", "co_op") & F.col("term_season").isNull(),
        "no_pay_shown": ~shown,
        "pay_shown": shown,
        "pay_implausible_in_stored_data": F.exists(ranges, _impossible),
        "pay_marked_unusable": member("validation").isNotNull(),
        "pay_period_asserted_without_source": shown & F.exists("pay_ranges", lambda r: r["period"].isNotNull()) & (F.size(F.filter(ranges, lambda r: r["interval"].isNotNull())) == 0),
        "pay_from_text": from_text,
        "pay_amount_not_found_in_posting_text": from_text & untraced,
        "pay_stated_in_text_not_shown": ~shown & has(text, STATED_PAY),
        "location_vendor_format_stored": F.exists(labels, lambda x: x["location"].rlike(VENDOR_LABEL)),
        "location_not_a_place": F.exists(labels, lambda x: x["location"].rlike(NOT_A_PLACE)),
        "location_country_unknown_entries": F.exists(F.slice(labels, 2, 1_000_000), lambda x: x["country"].isin(NO_COUNTRY)),
        "future_dated": F.col("posted_at") > moment(as_of) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(15)),
        "older_than_the_window": F.col("posted_at") < moment(as_of) - F.make_dt_interval(F.lit(OLDEST_DAYS), F.lit(0), F.lit(15)),
        "hard_conditions_in_text": F.exists(sentences, lambda s: s.rlike(f"(?i){HARD_CONDITION}") & ~s.rlike(f"(?i){EQUAL_CHANCES}")),
    }
    return {name: F.coalesce(c, F.lit(False)) for name, c in found.items()}


def public_audit(postings: DataFrame, as_of) -> DataFrame:
    """metric, n, ids of every check, zeros included. postings: id, company, title, location, country, locations, role_type, term_season, posted_at,
    skills, compensation, pay_ranges, description, source_url. Null columns of a posting fail no check but those of missing values.

    Rows are read once: a posting gives its failed checks, with its id's bucket as the key, and its keys of sameness (its URL, and
    company, title, place and text). Keys are counted, those of sameness that are alone go, and the rest is summed.
    """
    rows = postings.withColumn("_text", squeeze(strip_tags(F.col("description"))))
    conditions = checks(as_of)
    bucket = F.pmod(F.xxhash64("id"), F.lit(SAMPLE)).cast("string")
    same = F.sha2(F.to_json(F.struct("company", F.lower(F.trim("title")).alias("title"), "location", "_text")), 256)
    keyed = [F.when(c, F.struct(F.lit(name).alias("metric"), bucket.alias("key"))) for name, c in conditions.items()]
    twins = {"duplicate_source_urls": F.nullif(F.trim("source_url"), F.lit("")), "duplicates_identical_listings": same}
    keyed += [F.when(k.isNotNull(), F.struct(F.lit(name).alias("metric"), k.alias("key"))) for name, k in twins.items()]
    counted = rows.select("id", F.inline(F.array_compact(F.array(*keyed)))).groupBy("metric", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    kept = counted.where(~F.col("metric").isin(list(twins)) | (F.col("n") > 1))
    by_bucket = kept.groupBy("metric", F.pmod(F.xxhash64("id"), F.lit(SAMPLE)).alias("b")).agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    summed = by_bucket.groupBy("metric").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))  # at most SAMPLE a metric
    names = postings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in (*conditions, *twins)])).alias("metric"))
    return names.join(summed, "metric", "left").select("metric", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("ids", F.array().cast(summed.schema["ids"].dataType)).alias("ids"))

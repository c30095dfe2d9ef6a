"""The pay to store for a posting: what its source published, and what its text states beside it.

A pay object is JSON text of any shape. It is edited as a map of variants, so members that no rule knows stay as they came. The
result, resolved again with the same text, is the same: what a text added is marked, and taken off first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pay_text, places
from .pay import WAGES, period_of, range_problem
from .text import lookup, once

# Signs of currencies, what follows an amount by its period, and marks of what a text added.
SIGNS = {"USD": "$", "CAD": "CA$", "AUD": "A$", "GBP": "£", "EUR": "€", "NZD": "NZ$", "SGD": "S$", "CHF": "CHF ", "INR": "₹"}
SUFFIX = {"hour": " / hour", "day": " / day", "week": " / week", "month": " / month", "year": ""}
FROM_TEXT = "posting_text"
SEVERAL = "Multiple ranges"
OTE_NOTE = "On-target earnings (base plus commission or bonus target), as stated in the posting."
MONEY_IN_PART = r"[$£€]|\b(?:USD|CAD|GBP|EUR|AUD)\b"

OBJECT = "map<string,variant>"
#: How often text may have been put over text: once by these rules, so twice is enough for what others stored.
UNWRAPS = 2
UNIT = 1 << 52


def _fixed(x: Column, digits: int) -> Column:
    """x, from 1 to 1000, to so many digits, ties by the exact binary value to the even digit; no zeros at the end."""
    scaled = (x * float(UNIT)).cast("decimal(20,0)") * 10**digits

    def rounded(n: Column) -> Column:
        rest = n % F.lit(UNIT)
        whole = ((n - rest) / F.lit(UNIT)).cast("decimal(20,0)")
        up = (2 * rest > UNIT) | ((2 * rest == UNIT) & (whole % 2 == 1))
        return (whole + up.cast("int")).cast("double") / 10**digits

    text = F.format_string(f"%.{digits}f", once(scaled, rounded))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def money(amount: Column, currency: Column, sign: Column | None = None) -> Column:
    """CA$154K, £1.25M, $42.5; a currency without a sign of its own stands before the amount; without a currency the sign given."""
    code = F.upper(F.nullif(currency, F.lit("")))
    prefix = F.when(code.isNotNull(), F.coalesce(lookup(code, SIGNS), F.concat(code, F.lit(" ")))).otherwise(F.coalesce(sign, F.lit("")) if sign is not None else F.lit(""))
    body = F.when(amount >= 1_000_000, F.concat(_fixed(amount / 1_000_000, 2), F.lit("M"))).when(amount >= 1000, F.concat(_fixed(amount / 1000, 1), F.lit("K"))).otherwise(_fixed(amount, 2))
    return F.concat(prefix, body)


def span(low: Column, high: Column, currency: Column, sign: Column | None, interval: Column) -> Column:
    """One amount or two with a dash, and the period unless it is a year."""
    both = F.when(low == high, money(low, currency, sign)).otherwise(F.concat(money(low, currency, sign), F.lit(" – "), money(high, currency, sign)))
    return F.concat(both, F.coalesce(lookup(interval, SUFFIX), F.lit("")))


def built(currency: Column, low: Column, high: Column, interval: Column, source: Column, note: Column) -> Column:
    """JSON text of published figures; null without a currency or an amount over zero. Figures in the wrong order are turned round."""
    a, b = F.when(low > 0, low), F.when(high > 0, high)
    least, most = F.least(a, b), F.greatest(a, b)
    whole = F.struct(span(least, most, currency, None, interval).alias("compensationTierSummary"), F.upper(currency).alias("currency"), least.alias("min"), most.alias("max"), source.alias("source"), F.nullif(interval, F.lit("")).alias("interval"), F.nullif(note, F.lit("")).alias("note"))
    return F.when((currency != "") & least.isNotNull(), F.to_json(whole))


def mentions_amount(text: Column, amount: Column) -> Column:
    """The text states the figure: from 1000 on its digits anywhere, less only with a sign before."""
    whole = F.bround(amount).cast("bigint").cast("string")
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s,]", "")
    small = F.regexp(F.coalesce(text, F.lit("")), F.concat(F.lit(r"[$£€]\s?"), whole, F.lit(r"(?:\.\d+)?\b")))
    return F.when(F.bround(amount) >= 1000, F.contains(plain, whole)).otherwise(small)


def _object(text: Column) -> Column:
    """A JSON object's members; null for anything else."""
    return F.from_json(text, OBJECT)


def _word(member: Column) -> Column:
    return F.try_variant_get(member, "$", "string")


def _list(member: Column) -> Column:
    return F.coalesce(F.try_variant_get(member, "$", "array<variant>"), F.array().cast("array<variant>"))


def published(stored: Column) -> Column:
    """The members of what the source itself published, from its object or from one that was resolved; null for none."""
    inner = lambda m: F.when(_word(m["source"]) == FROM_TEXT, F.when(m["source_structured"].isNotNull(), _object(F.to_json(m["source_structured"])))).otherwise(m)
    out = stored
    for _ in range(UNWRAPS):
        out = once(out, inner)
    marks = F.array(F.lit("validation"), F.lit("interval_source"))
    own = lambda m: F.map_filter(m, lambda k, _: ~F.array_contains(marks, k) & ~((k == "interval") & F.coalesce(_word(m["interval_source"]) == FROM_TEXT, F.lit(False))))
    return once(out, lambda m: F.when(F.size(m) > 0, own(m)))


def ranges_of(pay: Column) -> Column:
    """array<min, max, currency, interval> of every wage that an object (its members) holds, believable or not, numbers only: its ranges,
    each over what the object says itself, or the object; then summary and tier components."""
    nothing = F.array().cast(f"array<{OBJECT}>")
    objects = lambda items: F.filter(F.transform(items, lambda x: _object(F.to_json(x))), lambda x: x.isNotNull())
    over = lambda own, parent: F.map_concat(F.map_filter(parent, lambda k, _: ~F.map_contains_key(own, k)), own)
    listed = lambda name: objects(_list(pay[name]))
    rest = F.map_filter(pay, lambda k, _: k != "ranges")
    alone = F.when(F.map_contains_key(pay, "min") | F.map_contains_key(pay, "max"), F.array(pay)).otherwise(nothing)
    top = F.when(F.size(_list(pay["ranges"])) > 0, F.transform(listed("ranges"), lambda own: over(own, rest))).otherwise(alone)
    tiers = F.flatten(F.transform(listed("compensationTiers"), lambda t: objects(_list(t["components"]))))
    number = lambda x: F.when(F.schema_of_variant(x).rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(x, "$", "double"))
    either = lambda p, a, b: F.when(F.map_contains_key(p, a), p[a]).otherwise(p[b])

    def read(p: Column) -> Column:
        kind, interval = _word(p["compensationType"]), _word(p["interval"])
        currency = F.coalesce(F.nullif(_word(p["currencyCode"]), F.lit("")), F.nullif(_word(p["currency"]), F.lit("")))
        return F.struct(F.coalesce(F.lower(kind).isin(WAGES), F.lit(True)).alias("wage"), number(either(p, "minValue", "min")).alias("min"), number(either(p, "maxValue", "max")).alias("max"), currency.alias("currency"), period_of(interval).alias("interval"))

    parts = F.filter(F.transform(F.concat(top, listed("summaryComponents"), tiers), read), lambda r: r["wage"])
    return F.transform(parts, lambda r: F.struct(*[r[c].alias(c) for c in ("min", "max", "currency", "interval")]))


def problem_of(ranges: Column) -> Column:
    """Null if a range is believable, else what is wrong with the first; no_amount without any."""
    each = F.transform(ranges, lambda r: range_problem(r["min"], r["max"], r["currency"], r["interval"]))
    return F.when(F.size(ranges) == 0, "no_amount").when(~F.exists(each, lambda p: p.isNull()), F.get(each, F.lit(0)))


def stated(ranges: Column, locations: Column) -> Column:
    """struct of the pay that a text states (see pay_text.pay_in_text), null without any. Ranges of other currencies, periods or places
    are never blended into one; a range for a place says how far the place reaches over the posting's locations."""
    sign = lambda r: F.when(r["currency"].isNull(), "$")  # noqa: E731  the only sign that names no currency

    def entry(r: Column) -> Column:
        reach = F.when(r["qualifier"].isNotNull(), places.scope(r["qualifier"], locations))
        fields = [r[c].alias(c) for c in ("min", "max", "currency")] + [sign(r).alias("symbol")] + [r[c].alias(c) for c in ("interval", "label", "qualifier")]
        return F.struct(*fields, F.when(r["kind"] == "ote", "ote").alias("kind"), reach.alias("scope"), r["evidence"].alias("_evidence"))

    def whole(e: Column) -> Column:
        first, n = F.get(e, F.lit(0)), F.size(e)
        alike = F.forall(e, lambda x: x["currency"].eqNullSafe(first["currency"]) & x["interval"].eqNullSafe(first["interval"]))
        one = (n == 1) | (alike & F.forall(e, lambda x: x["currency"].isNotNull() & x["qualifier"].isNull()))
        low, high = F.array_min(F.transform(e, lambda x: x["min"])), F.array_max(F.transform(e, lambda x: x["max"]))
        each = F.array_join(F.transform(e, lambda x: span(x["min"], x["max"], x["currency"], x["symbol"], x["interval"])), " · ")
        more = F.concat(F.lit(" · "), F.lit(SEVERAL))
        joined = F.concat(span(low, high, first["currency"], first["symbol"], first["interval"]), F.when(n > 1, more).otherwise(""))
        return F.struct(
            F.lit(FROM_TEXT).alias("source"),
            F.transform(e, lambda x: x.dropFields("_evidence")).alias("ranges"),
            first["_evidence"].alias("evidence"),
            F.when(one, low).alias("min"),
            F.when(one, high).alias("max"),
            *[F.when(one, first[c]).alias(c) for c in ("currency", "symbol", "interval")],
            F.when(one, joined).otherwise(F.concat(each, more)).alias("compensationTierSummary"),
            F.when(F.exists(e, lambda x: x["kind"].isNotNull()), OTE_NOTE).alias("note"),
        )

    return once(F.transform(pay_text.usable(ranges), entry), lambda e: F.when(F.size(e) > 0, whole(e)))


def _other_parts(summary: Column) -> Column:
    """Parts of a published summary that name no pay."""
    parts = F.transform(F.split(F.coalesce(summary, F.lit("")), r"\s*[•·]\s*"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & (p != SEVERAL) & ~(p.rlike("[0-9]") & p.rlike(MONEY_IN_PART)))


def _with_period(base: Column, ranges: Column) -> Column:
    """An amount without a period takes the one that the text states beside the same amount, if it states but one."""
    number = lambda name: F.try_variant_get(base[name], "$", "double")
    low, high = number("min"), F.coalesce(F.nullif(number("max"), F.lit(0.0)), number("min"))
    same = F.filter(ranges, lambda r: r["interval"].isNotNull() & (F.abs(r["min"] - low) < 0.5) & (F.abs(r["max"] - high) < 0.5))
    named = F.array_distinct(F.transform(same, lambda r: r["interval"]))
    open_ = (F.coalesce(_word(base["interval"]), F.lit("")) == "") & low.isNotNull() & (F.size(named) == 1)
    added = F.create_map(F.lit("interval"), F.get(named, F.lit(0)).cast("variant"), F.lit("interval_source"), F.lit(FROM_TEXT).cast("variant"))
    return F.when(open_, F.map_concat(F.map_filter(base, lambda k, _: k != "interval"), added)).otherwise(base)


def resolved_with(stored: Column, ranges: Column, locations: Column) -> Column:
    """The same with the text's ranges (pay_text.pay_in_text) given."""

    def decide(x: Column) -> Column:
        base = x["base"]

        def judged(problem: Column) -> Column:
            def by_text(t: Column) -> Column:
                other = F.when(base.isNotNull(), _other_parts(_word(base["compensationTierSummary"]))).otherwise(F.array().cast("array<string>"))
                summary = F.array_join(F.concat(F.array(t["compensationTierSummary"]), other), " · ")
                return F.to_json(t.withField("compensationTierSummary", summary).withField("source_structured", base))

            marked = F.map_concat(base, F.create_map(F.lit("validation"), F.parse_json(F.to_json(F.struct(problem.alias("status"))))))
            unusable = F.when(base.isNotNull(), F.to_json(F.when(problem != "no_amount", marked).otherwise(base)))
            instead = once(stated(x["ranges"], locations), lambda t: F.when(t.isNotNull(), by_text(t)).otherwise(unusable))
            return F.when(base.isNotNull() & problem.isNull(), F.to_json(_with_period(base, x["ranges"]))).otherwise(instead)

        return once(F.when(base.isNotNull(), problem_of(ranges_of(base))).otherwise("no_amount"), judged)

    none = F.array().cast(pay_text.RANGES)
    return once(F.struct(published(_object(stored)).alias("base"), F.coalesce(ranges, none).alias("ranges")), decide)


def resolved(stored: Column, html: Column, locations: Column) -> Column:
    """The JSON text to store. A believable published range stays, with a period of the text if it has none; else the ranges that the
    text states replace it, and the published object stays inside; else an impossible object stays, marked, so that nothing takes it
    for pay. Null where neither says anything."""
    return resolved_with(stored, pay_text.pay_in_html(F.when(html.rlike("[0-9]"), html)), locations)

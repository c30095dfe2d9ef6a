"""Pay: plausibility, annual amounts and the usable ranges of a vendor's pay object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods a year, least and greatest believable amounts by period, currencies that are judged, the
# widest spread, what still counts as a placeholder, and pay components that are wages.
TIMES_A_YEAR = {"year": 1, "month": 12, "week": 52, "day": 260, "hour": 2080}
FLOOR = {"year": 1000, "month": 100, "week": 25, "day": 5, "hour": 5}
CEILING = {"year": 3_000_000, "month": 250_000, "week": 60_000, "day": 12_000, "hour": 1_500}
FLOOR_UNSTATED, CEILING_UNSTATED = 5, 3_000_000
JUDGED = ["USD", "CAD", "AUD", "GBP", "EUR"]
MAX_SPREAD, PLACEHOLDER = 10, 10
WAGES = ["salary", "basesalary", "hourly", "wage"]
PERIOD_WORDS = [("year", "year|annual"), ("month", "month"), ("week", "week"), ("day", "day|daily"), ("hour", "hour")]


def _by_period(period: Column, table: dict[str, float], default: float | None = None) -> Column:
    out = F.lit(None if default is None else float(default)).cast("double")
    for name, value in table.items():
        out = F.when(period == name, float(value)).otherwise(out)
    return out


def annualize(amount: Column, period: Column) -> Column:
    """Null where the period is unknown."""
    return amount * _by_period(period, TIMES_A_YEAR)


def range_problem(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Why a range cannot be pay, or null: no_amount, inverted, placeholder, below_floor, above_ceiling, extreme_spread.

    Amounts that are not positive count as missing; other currencies than the judged ones are taken as they come.
    """
    a, b = F.when(low > 0, low), F.when(high > 0, high)
    least, most = F.least(a, b), F.greatest(a, b)
    judged = currency.isNull() | (currency == "") | F.upper(currency).isin(JUDGED)
    short = least < _by_period(period, FLOOR, FLOOR_UNSTATED)
    return (
        F.when(least.isNull(), "no_amount")
        .when(a > b, "inverted")
        .when(~judged, F.lit(None))
        .when(short & (most <= PLACEHOLDER), "placeholder")
        .when(short, "below_floor")
        .when(most > _by_period(period, CEILING, CEILING_UNSTATED), "above_ceiling")
        .when(b > a * MAX_SPREAD, "extreme_spread")
    )


def period_of(interval: Column) -> Column:
    """The period that a vendor's interval names, the longest first; null if none."""
    low = F.lower(F.coalesce(interval, F.lit("")))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PERIOD_WORDS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def _text(part: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_variant_get(part, f"$.{n}", "string") for n in names])


def _amount(text: Column) -> Column:
    """Only plain decimals are amounts; signs and exponents are not."""
    return F.when(text.rlike("^[0-9]+([.][0-9]+)?$"), text.try_cast("decimal(18,2)").cast("double"))


def _has(part: Column, name: str) -> Column:
    """The key is there, be it null."""
    return F.array_contains(F.coalesce(F.map_keys(F.from_json(F.to_json(part), "map<string,string>")), F.array().cast("array<string>")), name)


def usable_ranges(pay: Column) -> Column:
    """array<currency, min_annual, max_annual, period> of a pay object (JSON text): its ranges, each over what the
    object says itself, or the object; then summary and tier components. Marked pay, on-target earnings, pay of
    other places and implausible ranges are left out."""
    v = F.try_parse_json(pay)
    part_type = "struct<own:variant,parent:variant>"
    pairs = lambda items, parent: F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.struct(x.alias("own"), parent.alias("parent")))
    listed = lambda path, source=v: F.try_variant_get(source, path, "array<variant>")
    none = F.lit(None).cast("variant")
    ranges = listed("$.ranges")
    alone = F.when(_has(v, "min") | _has(v, "max"), F.array(F.struct(v.alias("own"), none.alias("parent")))).otherwise(F.array().cast(f"array<{part_type}>"))
    first = F.when(F.size(F.coalesce(ranges, F.array().cast("array<variant>"))) > 0, pairs(ranges, v)).otherwise(alone)
    tiers = F.flatten(F.transform(F.coalesce(listed("$.compensationTiers"), F.array().cast("array<variant>")), lambda t: F.coalesce(listed("$.components", t), F.array().cast("array<variant>"))))
    parts = F.concat(first, pairs(listed("$.summaryComponents"), none), pairs(tiers, none))

    def field(p: Column, *names: str) -> Column:
        """An own field hides the parent's even if it is null."""
        tries = [F.when(_has(p["own"], n), _text(p["own"], n)).otherwise(_text(p["parent"], n)) for n in names]
        return F.coalesce(*tries)

    def read(p: Column) -> Column:
        period = period_of(field(p, "interval"))
        lo, hi = _amount(field(p, "minValue", "min")), _amount(field(p, "maxValue", "max"))
        times = _by_period(period, TIMES_A_YEAR)
        kind = F.lower(field(p, "compensationType"))
        currency = F.upper(F.coalesce(field(p, "currencyCode", "currency"), F.lit("")))
        low, high = F.coalesce(lo, hi), F.coalesce(hi, lo)
        judged = currency.isin(JUDGED)
        believable = (F.least(low, high) >= _by_period(period, FLOOR)) & (F.greatest(low, high) <= _by_period(period, CEILING)) & ~F.coalesce(hi > lo * MAX_SPREAD, F.lit(False))
        ok = (
            F.coalesce(kind.isin(WAGES), F.lit(True))
            & ~F.coalesce(field(p, "kind") == "ote", F.lit(False))
            & ~F.coalesce(field(p, "scope") == "none", F.lit(False))
            & currency.rlike("^[A-Z]{3}$")
            & times.isNotNull()
            & (low > 0)
            & (high > 0)
            & ~F.coalesce(lo > hi, F.lit(False))
            & (~judged | believable)
        )
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), currency.alias("currency"), (low * times).alias("min_annual"), (high * times).alias("max_annual"), F.lower(field(p, "interval")).alias("period"))

    read_parts = F.filter(F.transform(parts, read), lambda r: r["ok"])
    kept = F.transform(read_parts, lambda r: F.struct(r["currency"].alias("currency"), r["min_annual"].alias("min_annual"), r["max_annual"].alias("max_annual"), r["period"].alias("period")))
    empty = F.array().cast("array<struct<currency:string,min_annual:double,max_annual:double,period:string>>")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(is_object & ~_has(v, "validation"), kept).otherwise(empty)


def pays_at_least(ranges: Column, amount: float, currency: str) -> Column:
    return F.exists(ranges, lambda r: (r["max_annual"] >= amount) & (r["currency"] == currency))


def compact_money(amount: Column) -> Column:
    """120K, 1.5M; small amounts as they are."""
    trimmed = lambda x: F.regexp_replace(F.format_string("%.1f", x), "\\.0$", "")
    return F.when(amount >= 1_000_000, F.concat(trimmed(amount / 1_000_000), F.lit("M"))).when(amount >= 1000, F.concat(trimmed(amount / 1000), F.lit("K"))).otherwise(trimmed(amount))

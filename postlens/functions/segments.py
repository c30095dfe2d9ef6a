"""Locations of the list-and-detail vendor: labels of segments that name a country, a region, a city, a street or a site, in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo, places
from .text import lookup, once, squeeze

# What a segment may say, by its lower-case text without dots at its end.
COUNTRIES = {"us": "United States", "usa": "United States", "united states": "United States", "united states of america": "United States", "canada": "Canada", "can": "Canada"}
WAYS_OF_WORKING = ["hybrid", "on-site", "onsite", "on site", "in-office"]
AT_HOME = ["offsite", "off-site", "home", "offsite/home", "off-site/home", "home office", "work from home", "wfh"]
OTHER_PROVINCE_NAMES = {"québec": "QC", "newfoundland": "NL"}
# Prefixes of a hierarchy of regions, words that end a street's name, and words inside a city's name in lower case.
PREFIX = r"(?i)^(?:AMER|NAMER|NA|APAC|EMEA|LATAM)\s*[-–—:]\s*"
STREET_ENDS = ["st", "street", "ave", "avenue", "rd", "road", "blvd", "boulevard", "dr", "drive", "way", "lane", "ln", "hwy", "highway", "sq", "square", "pl", "place", "cres", "crescent", "ct", "court", "pkwy", "parkway", "terrace", "trail"]
SMALL_WORDS = ["of", "de", "la", "le", "du", "des", "and", "the", "on", "upon"]

_BETWEEN = r"(?:\s*[:,]\s*|\s+[-–—]\s+)"
_CAPITAL = "\u0001capital"
_STREET = rf"(?i)^\d+[a-z]?(?:-\d+)?\s+\S.*$|^(?:[\p{{L}}\p{{N}}_.'’-]+\s+){{0,4}}(?:{'|'.join(STREET_ENDS)})\.?(?:\s+(?:n|s|e|w|ne|nw|se|sw)\.?)?$"
CANADIAN_CITIES = {city.lower(): (city, code) for city, code in places.CITIES if code in places.PROVINCES}
#: Every city that a site's name may hold, so that a name of two places is seen as such.
KNOWN_CITIES = sorted({*CANADIAN_CITIES, *[city for cities in geo.CITIES.values() for city in cities]})


def _meanings() -> tuple[dict[str, str], dict[str, str]]:
    """kind/value by name and by code of two letters; what comes first in this list wins."""
    names: dict[str, str] = {"remote": "remote/"}
    codes: dict[str, str] = {}
    for word in [*WAYS_OF_WORKING, *AT_HOME]:
        names.setdefault(word, "way/")
    for word, country in COUNTRIES.items():
        names.setdefault(word, f"country/{country}")
    names["ca"] = "either/"
    for code, name in places.PROVINCES.items():
        names.setdefault(name.lower(), f"province/{code}")
        codes.setdefault(code.lower(), f"province/{code}")
    for name, code in OTHER_PROVINCE_NAMES.items():
        names.setdefault(name, f"province/{code}")
    for code in places.STATES:
        names.setdefault(places.REGION_NAME[code], f"state/{code}")
        codes.setdefault(code.lower(), f"state/{code}")
    for key in CANADIAN_CITIES:
        names.setdefault(key, f"city/{key}")
    return names | {_CAPITAL: "capital/DC"}, codes


NAMES, CODES = _meanings()


def at_home(label: Column) -> Column:
    """Whether a label only says that one works at home."""
    return F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(AT_HOME)


def _city_case(text: Column) -> Column:
    """A name in one case alone as names are written; any other as it stands."""
    word = lambda w: F.array_join(F.transform(F.split(w, "(?<=['’-])"), F.initcap), "")
    cased = F.transform(F.split(F.lower(text), r"\s+"), lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(word(w)))
    return F.when((text == F.upper(text)) | (text == F.lower(text)), F.array_join(cased, " ")).otherwise(text)


def _city_within(text: Column) -> Column:
    """The Canadian city that a site's name holds, if it names no other place and no alternatives; else null."""
    low = F.lower(text)
    words = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    named = F.filter(F.array(*[F.lit(c) for c in KNOWN_CITIES]), lambda c: F.contains(words, F.concat(F.lit(" "), c, F.lit(" "))))
    return F.when(~low.rlike(r"\s(?:and|or|&)\s|[/&|;]") & (F.size(named) == 1) & F.get(named, F.lit(0)).isin(list(CANADIAN_CITIES)), F.get(named, F.lit(0)))


def _segments(text: Column) -> Column:
    """array<struct<kind, value, text>> of a label; the capital's name with its district is one segment, and the last."""
    whole = F.regexp_replace(text, rf"(?i)(^|{_BETWEEN})washington{_BETWEEN}(?:district of columbia|d\.?c)\.*\s*(?:{_BETWEEN}.*)?$", f"$1{_CAPITAL}")
    cut = F.filter(F.transform(F.split(whole, _BETWEEN), lambda s: F.regexp_replace(s, r"^[\s()]+|[\s()]+$", "")), lambda s: s != "")

    def read(s: Column) -> Column:
        means = F.coalesce(lookup(F.regexp_replace(F.lower(s), r"\.+$", ""), NAMES), lookup(F.lower(s), CODES), F.when(s.rlike(_STREET), "street/").otherwise("other/"))
        return F.struct(F.split_part(means, F.lit("/"), F.lit(1)).alias("kind"), F.split_part(means, F.lit("/"), F.lit(2)).alias("value"), s.alias("text"))

    return F.transform(cut, read)


def _evidence(seg: Column) -> Column:
    """What the segments say together, before anything is decided."""
    of = lambda *kinds: F.filter(seg, lambda s: s["kind"].isin(*kinds))
    home = lambda s: F.when(s["kind"] == "country", s["value"]).when(s["kind"] == "province", "Canada").otherwise("United States")
    regions = of("province", "state", "capital")
    return F.struct(
        F.exists(seg, lambda s: s["kind"] == "remote").alias("remote"),
        F.exists(seg, lambda s: s["kind"] == "either").alias("either"),
        F.exists(seg, lambda s: s["kind"] == "capital").alias("capital"),
        F.get(F.transform(of("country", "province", "state", "capital"), home), F.lit(0)).alias("first"),
        F.get(F.transform(regions, home), F.lit(0)).alias("region_home"),
        F.get(F.transform(regions, lambda s: s["value"]), F.lit(0)).alias("region"),
        ((F.size(F.array_distinct(F.transform(regions, lambda s: s["value"]))) > 1) | (F.size(of("province")) > 1)).alias("clash"),
        F.transform(of("state"), lambda s: s["text"]).alias("states"),
        F.get(F.transform(of("city"), lambda s: s["value"]), F.lit(0)).alias("city"),
        F.transform(of("other"), lambda s: s["text"]).alias("others"),
    )


def segment_place(label: Column) -> Column:
    """struct<location, country> of a label: "City, Province, Canada", "City, ST, United States", a region with its country, or a country,
    with "Remote - " before it where a segment says so. Null where the label leaves the place open or contradicts itself; null and
    blank labels are null.

    The first country or region must agree with the region; a label names one region. CA is California beside the United States, Canada
    beside Canada or one of its cities, and else unknown. A city is a known one, a state named a second time, a city inside a site's
    name, or the one segment left over where the region or country is known (in a hierarchy of regions the first one left over).
    """
    text = squeeze(F.coalesce(label, F.lit("")))
    bare = F.regexp_replace(text, PREFIX, "")
    hierarchy = text.rlike(PREFIX) & F.contains(text, F.lit(" - "))

    def with_country(e: Column) -> Column:
        country = F.coalesce(e["region_home"], e["first"])
        us = country == "United States"
        settled = F.when(~e["either"] | F.coalesce(us, F.lit(False)), country).when((country == "Canada") | e["city"].isNotNull(), "Canada")
        california = F.coalesce(e["either"] & us, F.lit(False))
        wrong = e["clash"] | F.coalesce(e["first"] != e["region_home"], F.lit(False)) | F.coalesce(california & (e["region"] != "CA"), F.lit(False)) | (e["either"] & settled.isNull())
        states = F.when(california, F.array_append(e["states"], F.lit("CA"))).otherwise(e["states"])
        return F.struct(e.alias("e"), settled.alias("country"), F.when(california, "CA").otherwise(e["region"]).alias("region"), states.alias("states"), wrong.alias("wrong"))

    def with_city(c: Column) -> Column:
        e = c["e"]
        canadian = F.coalesce(c["country"] == "Canada", F.lit(True))
        spelled = F.filter(c["states"], lambda s: F.length(s) > 2)
        twice = F.when((c["country"] == "United States") & (F.size(c["states"]) >= 2) & (F.size(e["others"]) == 0), F.get(spelled, F.lit(0)))
        left = F.get(e["others"], F.lit(0))
        within = F.when(canadian, _city_within(left))
        plain = F.when(c["country"].isNotNull() & ~left.rlike(r"\d") & (F.size(F.split(left, r"\s+")) <= 4), left)
        known = F.coalesce(e["city"], F.when(F.size(e["others"]) > 0, within))
        own = F.when(canadian, lookup(known, {key: code for key, (_, code) in CANADIAN_CITIES.items()}))
        city = F.when(e["capital"], "Washington").otherwise(F.coalesce(lookup(known, {key: name for key, (name, _) in CANADIAN_CITIES.items()}), _city_case(F.coalesce(twice, plain))))
        many = e["city"].isNull() & ~e["capital"] & (F.size(e["others"]) > 1) & ~hierarchy
        lost = (F.size(e["others"]) > 0) & city.isNull()
        country = F.when(own.isNotNull(), "Canada").otherwise(c["country"])
        return F.struct(city.alias("city"), F.coalesce(c["region"], own).alias("region"), country.alias("country"), e["remote"].alias("remote"), (c["wrong"] | many | lost | country.isNull()).alias("wrong"))

    def shown(p: Column) -> Column:
        whole_name = (p["country"] == "Canada") | p["city"].isNull()
        region = F.when(whole_name, lookup(p["region"], places.PROVINCES | _STATE_NAMES)).otherwise(p["region"])
        place = F.concat(F.when(p["remote"], "Remote - ").otherwise(""), F.concat_ws(", ", p["city"], region, p["country"]))
        return F.when(~p["wrong"], F.struct(place.alias("location"), p["country"].alias("country")))

    return once(once(once(once(_segments(bare), _evidence), with_country), with_city), shown)


# As people write them: "District of Columbia" has a small word.
_STATE_NAMES = {code: " ".join(w if w in SMALL_WORDS else w.capitalize() for w in name.split()) for code, name in places.STATES.items()}


def repaired_entries(entries: Column) -> Column:
    """Stored array<struct<location, country, raw_location>> read anew: a label that only says that one works at home goes, a place that the
    grammar reads takes its shape if the stored country is the same or none, everything else stays under the label it was published by.
    A null array stays null, and reading the result again changes nothing."""

    def one(x: Column) -> Column:
        published = F.trim(F.coalesce(F.nullif(F.trim(x["raw_location"]), F.lit("")), x["location"], F.lit("")))
        said = F.lower(F.regexp_replace(F.trim(F.coalesce(x["country"], F.lit(""))), r"\.+$", ""))
        stored = F.coalesce(lookup(said, COUNTRIES), F.trim(F.coalesce(x["country"], F.lit(""))))

        def edited(at: Column) -> Column:
            fits = at.isNotNull() & (at["location"] != published) & stored.isin("", "Unknown") | (stored == at["country"]) & (at["location"] != published)
            new = F.struct(at["location"].alias("location"), at["country"].alias("country"), published.alias("raw_location"))
            return F.when(F.coalesce(fits, F.lit(False)), new).otherwise(F.struct(published.alias("location"), x["country"].alias("country"), x["raw_location"].alias("raw_location")))

        return once(segment_place(published), edited)

    real = F.filter(entries, lambda x: F.coalesce(F.nullif(F.trim(x["raw_location"]), F.lit("")), F.nullif(F.trim(x["location"]), F.lit(""))).isNotNull())
    return F.filter(F.transform(real, one), lambda x: ~at_home(x["location"]))

"""Place labels: one shape for well-known cities, places named in a text, and how far a text's place reaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import ELIGIBLE, STATE_CODES, STATE_NAMES, alternatives, eligible, located, token_country
from .text import has, lookup, once, squeeze, trimmed

# Provinces; cities whose region is unambiguous, under their region; other spellings of their names.
PROVINCES = {"AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon"}
CITIES = [
    ("Toronto", "ON"), ("Ottawa", "ON"), ("Mississauga", "ON"), ("Waterloo", "ON"), ("Kitchener", "ON"), ("Markham", "ON"),
    ("Brampton", "ON"), ("Oakville", "ON"), ("Burlington", "ON"), ("Hamilton", "ON"), ("Guelph", "ON"), ("Richmond Hill", "ON"),
    ("Vancouver", "BC"), ("Burnaby", "BC"), ("Richmond", "BC"), ("Montreal", "QC"), ("Montréal", "QC"), ("Quebec City", "QC"),
    ("Laval", "QC"), ("Calgary", "AB"), ("Edmonton", "AB"), ("Winnipeg", "MB"), ("Halifax", "NS"), ("Saskatoon", "SK"), ("Regina", "SK"),
    ("San Francisco", "CA"), ("New York", "NY"), ("Seattle", "WA"), ("Boston", "MA"), ("Austin", "TX"), ("Chicago", "IL"),
    ("Los Angeles", "CA"), ("Atlanta", "GA"), ("Pittsburgh", "PA"), ("Palo Alto", "CA"), ("Mountain View", "CA"), ("Menlo Park", "CA"),
    ("Foster City", "CA"), ("Sunnyvale", "CA"), ("Santa Clara", "CA"), ("McLean", "VA"), ("Denver", "CO"),
]
OTHER_CITY_NAMES = {"new york city": "New York"}
#: Canadian cities with namesakes elsewhere: only where the country is known.
NAMESAKES = ["richmond", "hamilton", "burlington", "waterloo", "regina"]
COUNTRY_FIELDS = {"United States": ["us", "usa", "united states", "united states of america"], "Canada": ["ca", "can", "canada"]}
# Words for countries and regions in running text.
COUNTRY_WORDS = {"united states of america": "United States", "united states": "United States", "u.s.a.": "United States", "u.s.": "United States", "usa": "United States", "us": "United States", "american": "United States", "canada": "Canada", "canadian": "Canada"}
REGION_WORDS = {"bay area": ("city", "san francisco"), "greater toronto": ("city", "toronto"), "gta": ("city", "toronto"), "nyc": ("city", "new york"), "new york city": ("city", "new york"), "washington d.c.": ("state", "DC"), "washington dc": ("state", "DC"), "d.c.": ("state", "DC"), "district of columbia": ("state", "DC")}

STATES = {code.upper(): name for code, name in zip(STATE_CODES, STATE_NAMES, strict=True)}
REGION = {city.lower(): code for city, code in CITIES} | {other: dict(CITIES)[city] for other, city in OTHER_CITY_NAMES.items()}
NAME = {city.lower(): city for city, _ in CITIES} | OTHER_CITY_NAMES
HOME = {city: "Canada" if code in PROVINCES else "United States" for city, code in REGION.items()}
REGION_NAME = {code: name.lower() for code, name in (STATES | PROVINCES).items()}
TOKENS = "array<struct<kind:string,name:string>>"
#: Depths of a path from a country over its regions to a city.
KINDS = ["country", "state", "city"]


def _region_path(code: str) -> str:
    return f"{'Canada' if code in PROVINCES else 'United States'}/{code}"


def _gazetteer() -> dict[str, list[str]]:
    """Paths by what names them, in words with a blank between. A word with dots inside reads without them and with one at its end."""
    out: dict[str, list[str]] = {}

    def put(name: str, path: str) -> None:
        words = [w.replace(".", "") + "." if "." in w else w for w in name.split()]
        out.setdefault(" ".join(words), []).append(path)

    for name, country in COUNTRY_WORDS.items():
        put(name, country)
    for code, name in REGION_NAME.items():
        put(name, _region_path(code))
    for key, city in NAME.items():
        put(key, f"{_region_path(REGION[key])}/{city.lower()}")
    for name, (kind, where) in REGION_WORDS.items():
        if kind == "state":
            put(name, _region_path(where))
        elif name not in NAME:
            put(name, f"{_region_path(REGION[where])}/{where}")
    return out


GAZETTEER = _gazetteer()
LONGEST = max(len(name.split()) for name in GAZETTEER)


def canonical_label(label: Column, country: Column) -> Column:
    """"City, Province, Canada" or "City, ST, United States" where the label is a well-known city alone or with its own region
    and country, in this order; null for anything else, for a null label and for a city of another country than the given."""
    parts = trimmed(F.split(F.coalesce(label, F.lit("")), ","))
    city = F.lower(F.get(parts, F.lit(0)))
    rest = F.transform(F.slice(parts, 2, 2), lambda p: F.regexp_replace(F.lower(p), r"\.+$", ""))
    code, home = lookup(city, REGION), lookup(city, HOME)
    own_region = lambda p: (p == F.lower(code)) | (p == lookup(code, REGION_NAME))
    own_country = lambda p: F.when(home == "Canada", p.isin(COUNTRY_FIELDS["Canada"])).otherwise(p.isin(COUNTRY_FIELDS["United States"]))
    first, second = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))
    fits = F.when(F.size(parts) == 1, True).when(F.size(parts) == 2, own_region(first) | own_country(first)).when(F.size(parts) == 3, own_region(first) & own_country(second)).otherwise(False)
    whole = F.forall(parts, lambda p: p != "") & fits
    here = F.coalesce(country, F.lit("")).isin("", "Unknown") | (country == home)
    sure = ~city.isin(NAMESAKES) | F.coalesce(country == "Canada", F.lit(False))
    region = F.when(home == "Canada", lookup(code, PROVINCES)).otherwise(code)
    return F.when(code.isNotNull() & whole & here & sure, F.concat_ws(", ", lookup(city, NAME), region, home))


def place_paths(text: Column) -> Column:
    """Paths of the places that a text names, distinct. Its words are looked up from the left, the longest name first, and a word
    belongs to one name; a postal code counts after a comma."""
    raw = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(F.lower(raw), F.lit(r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"), F.lit(0))
    words = F.transform(found, lambda w: F.when(F.contains(w, F.lit(".")), F.concat(F.replace(w, F.lit(".")), F.lit("."))).otherwise(w))
    names = F.create_map(*[x for name, paths in GAZETTEER.items() for x in (F.lit(name), F.array(*[F.lit(p) for p in paths]))])

    def starting(w: Column, i: Column) -> Column:
        """The longest name from a word on: how many words, and its paths."""
        sizes = [F.struct(F.lit(n).alias("n"), F.element_at(names, F.array_join(F.slice(w, i + 1, n), " ")).alias("paths")) for n in range(LONGEST, 0, -1)]
        whole = F.filter(F.array(*sizes), lambda s: s["paths"].isNotNull() & (i + s["n"] <= F.size(w)))
        return F.get(whole, F.lit(0))

    def read(w: Column) -> Column:
        begun = F.transform(w, lambda _, i: F.struct(i.alias("i"), starting(w, i).alias("hit")))
        zero = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("paths"))
        take = lambda a, x: F.struct((x["i"] + x["hit"]["n"]).alias("free"), F.concat(a["paths"], x["hit"]["paths"]).alias("paths"))
        return F.aggregate(F.filter(begun, lambda x: x["hit"].isNotNull()), zero, lambda a, x: F.when(x["i"] >= a["free"], take(a, x)).otherwise(a))["paths"]

    posted = F.transform(F.regexp_extract_all(raw, F.lit(r",\s*([A-Z]{2})\b"), F.lit(1)), lambda c: lookup(c, {code: _region_path(code) for code in REGION_NAME}))
    return F.array_distinct(F.concat(once(words, read), F.array_compact(posted)))


def named_places(text: Column) -> Column:
    """array<struct<kind, name>> of the countries, states or provinces (by code) and cities that a text names, distinct."""
    parts = F.transform(place_paths(text), lambda p: F.split(p, "/"))
    return F.transform(parts, lambda p: F.struct(F.get(F.array(*[F.lit(k) for k in KINDS]), F.size(p) - 1).alias("kind"), F.element_at(p, -1).alias("name"))).cast(TOKENS)


def scope(qualifier: Column, locations: Column) -> Column:
    """How far a place in a text reaches over a posting's locations: all, some, none; unclear where the text names no known
    place or there are no locations; null without a text. A region or city reaches the locations inside it, if every country that
    the text names holds them too; a text of countries alone reaches the locations in any of them."""

    def inside(place: Column, region: Column) -> Column:
        return F.startswith(F.concat(place, F.lit("/")), F.concat(region, F.lit("/")))

    def reach(q: Column) -> Column:
        narrow, wide = F.filter(q, lambda p: F.contains(p, F.lit("/"))), F.filter(q, lambda p: ~F.contains(p, F.lit("/")))

        def reached(x: Column) -> Column:
            own = F.array_compact(F.array(F.when(x["country"].isin("United States", "Canada"), x["country"])))
            here = F.concat(place_paths(x["location"]), own)
            within = lambda region: F.exists(here, lambda place: inside(place, region))
            return F.when(F.size(narrow) > 0, F.exists(narrow, within) & F.forall(wide, within)).otherwise(F.exists(wide, within))

        at = F.transform(locations, lambda x: F.struct(x["location"].alias("location"), x["country"].alias("country")))
        hits = F.transform(F.coalesce(at, F.array().cast("array<struct<location:string,country:string>>")), reached)
        yes = F.size(F.filter(hits, lambda h: h))
        return F.when((F.size(q) == 0) | (F.size(hits) == 0), "unclear").when(yes == F.size(hits), "all").when(yes > 0, "some").otherwise("none")

    named = once(place_paths(qualifier), reach)
    return F.when(F.coalesce(qualifier, F.lit("")) != "", named)


#: What a vendor says of a place beside its label: the country it means, and parts of an address.
STATED = "array<struct<label:string,country:string,locality:string,region:string>>"
PLACES = "array<struct<location:string,country:string,raw_location:string,also_published:array<string>,source_location:string>>"
# Labels that say how one works and not where.
NOT_A_PLACE = r"(?i)^\(?\s*(?:remote\s*[-–]?\s*friendly\b.*|travel[- ]required\)?|offsite(?:/home)?|off-site|home|work from home)\s*\)?$"
COUNTRY_CODES = {"us": "United States", "usa": "United States", "ca": "Canada", "can": "Canada", "gb": "United Kingdom", "de": "Germany", "fr": "France"}


def _read(x: Column, grammar: Callable[[Column], Column] | None = None) -> Column:
    """One alternative as a place with its published label. A country that the vendor states overrules the label's, and what a grammar
    reads counts only beside the same country."""
    code = F.lower(F.trim(F.coalesce(x["country"], F.lit(""))))
    stated = F.when(code != "", F.coalesce(lookup(code, COUNTRY_CODES), token_country(x["country"], F.lit("")), F.trim(x["country"])))

    def placed(both: Column) -> Column:
        at, own = both["at"], both["own"]
        country = F.coalesce(stated, own["country"], at["country"])
        label = F.coalesce(F.when(own["country"] == country, own["location"]), canonical_label(at["location"], country), F.when((at["location"] == "Unknown") & stated.isNotNull(), stated), at["location"])
        # A label that does not show the stated country gives way to the address; it stays as the source's location.
        hidden = stated.isin(ELIGIBLE) & ~eligible(label, country)
        address = F.array_join(F.array_compact(F.array(F.nullif(F.trim(x["locality"]), F.lit("")), F.nullif(F.trim(x["region"]), F.lit("")), country)), ", ")
        hidden = F.coalesce(hidden, F.lit(False))
        return F.struct(F.when(hidden, address).otherwise(label).alias("location"), country.alias("country"), x["label"].alias("published"), F.when(hidden, label).alias("source_location"))

    own = grammar(x["label"]) if grammar else F.lit(None).cast("struct<location:string,country:string>")
    return once(F.struct(located(x["label"]).alias("at"), own.alias("own")), placed)


def job_places(raw: Column, stated: Column | None = None, grammar: Callable[[Column], Column] | None = None) -> Column:
    """array<location, country, raw_location, also_published, source_location> of a posting, from a raw field or from what a vendor states
    of each place (STATED), in order; without any place one that is Unknown.

    Labels of one place, by its location and country, are one entry: the first published label that differs from the location is
    its raw_location, and every other one is kept in also_published. Ways of working are no places, unless there is nothing else.
    grammar: reads a vendor's own labels as struct<location, country>, null where it cannot.
    """
    plain = F.transform(alternatives(raw), lambda p: F.struct(p.alias("label"), *[F.lit(None).cast("string").alias(c) for c in ("country", "locality", "region")]))
    given = plain if stated is None else F.when(F.size(F.coalesce(stated, F.array().cast(STATED))) > 0, _spread(stated)).otherwise(plain)

    def merged(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda x: F.struct(x["location"].alias("location"), x["country"].alias("country"))))

        def entry(k: Column) -> Column:
            own = F.filter(found, lambda x: (x["location"] == k["location"]) & (x["country"] == k["country"]))
            labels = F.filter(F.array_distinct(F.transform(own, lambda x: x["published"])), lambda p: (p != k["location"]) & (p != ""))
            more = F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1)))
            return F.struct(k["location"].alias("location"), k["country"].alias("country"), F.get(labels, F.lit(0)).alias("raw_location"), F.when(F.size(more) > 0, more).alias("also_published"), F.get(F.array_compact(F.transform(own, lambda x: x["source_location"])), F.lit(0)).alias("source_location"))

        return F.transform(keys, entry)

    def kept(every: Column) -> Column:
        real = F.filter(every, lambda x: ~x["location"].rlike(NOT_A_PLACE))
        nowhere = F.array(F.struct(F.lit("Unknown"), F.lit("Unknown"), F.lit(None), F.lit(None), F.lit(None)).cast(PLACES.removeprefix("array<")[:-1]))
        return F.when(F.size(real) > 0, real).when(F.size(every) > 0, every).otherwise(nowhere)

    return once(once(F.transform(given, lambda x: _read(x, grammar)), merged), kept).cast(PLACES)


def _spread(stated: Column) -> Column:
    """A stated label that lists alternatives is each of them; its country then belongs to none for certain."""

    def each(x: Column) -> Column:
        several = lambda parts: F.when(F.size(parts) > 1, F.transform(parts, lambda p: F.struct(p.alias("label"), *[F.lit(None).cast("string").alias(c) for c in ("country", "locality", "region")]))).otherwise(F.array(F.struct(F.coalesce(F.trim(x["label"]), F.lit("")).alias("label"), *[x[c].alias(c) for c in ("country", "locality", "region")])))
        return once(alternatives(x["label"]), several)

    return F.flatten(F.transform(stated, each))


def published_labels(places: Column) -> Column:
    """Every label under which the places were published, to read them anew."""
    each = F.transform(places, lambda x: F.concat(F.array(F.coalesce(x["raw_location"], x["location"])), F.coalesce(x["also_published"], F.array().cast("array<string>"))))
    return F.array_distinct(F.flatten(each))


def postal_address(label: Column, default_country: Column) -> Column:
    """struct<street, locality, region, country> of a label by how many parts it has; a country alone has no locality."""
    parts = F.filter(trimmed(F.split(squeeze(F.coalesce(label, F.lit(""))), "[,·]")), lambda p: p != "")
    n = F.size(parts)
    at = lambda k: F.get(parts, k if isinstance(k, Column) else F.lit(k))
    is_country = lambda p: has(p, "^(?:Canada|United States|United Kingdom)$")
    given = F.nullif(default_country, F.lit(""))
    street = F.when(n >= 4, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 3, F.lit(0))), ", "))
    locality = F.when((n == 1) & is_country(at(0)), F.lit(None)).when(n >= 4, at(n - 3)).otherwise(at(0))
    region = F.when(n >= 3, at(n - 2)).when((n == 2) & ~is_country(at(1)), at(1))
    country = F.when(n >= 3, at(n - 1)).when((n > 0) & is_country(at(n - 1)), at(n - 1)).when(n > 0, given)
    return F.struct(street.alias("street"), locality.alias("locality"), region.alias("region"), country.alias("country"))

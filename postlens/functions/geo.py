"""Places: countries, eligibility for the public board, location filters and normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has, like_literal, lookup, squeeze, title_case, trimmed

# Codes and names of states and provinces.
STATE_CODES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split()
STATE_NAMES = ["alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia"]
PROVINCE_CODES = "ab bc mb nb nl ns nt nu on pe qc sk yt".split()
PROVINCE_NAMES = ["alberta", "british columbia", "manitoba", "new brunswick", "newfoundland and labrador", "newfoundland", "northwest territories", "nova scotia", "nunavut", "ontario", "prince edward island", "quebec", "québec", "saskatchewan", "yukon"]
# Cities that stand for their country.
CITIES = {
    "United States": ["san francisco", "new york", "new york city", "nyc", "seattle", "boston", "austin", "chicago", "los angeles", "palo alto", "mountain view", "menlo park", "foster city", "atlanta", "pittsburgh", "mclean"],
    "Canada": ["toronto", "vancouver", "montreal", "montréal", "calgary", "ottawa", "waterloo", "kitchener", "mississauga"],
    "United Kingdom": ["london", "cardiff", "manchester", "edinburgh", "bristol", "cambridge", "oxford"],
}
# Countries that are known by their name, and other names for countries.
COUNTRIES = ["Argentina", "Australia", "Austria", "Belgium", "Brazil", "Bulgaria", "Canada", "Chile", "Colombia", "Croatia", "Cyprus", "Czech Republic", "Denmark", "Egypt", "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Iceland", "India", "Indonesia", "Ireland", "Israel", "Italy", "Japan", "Kenya", "Latvia", "Lithuania", "Luxembourg", "Malaysia", "Malta", "Mexico", "Netherlands", "New Zealand", "Nigeria", "Norway", "Peru", "Philippines", "Poland", "Portugal", "Romania", "Singapore", "Slovakia", "South Africa", "South Korea", "Spain", "Sweden", "Switzerland", "Taiwan", "Turkey", "Ukraine", "United Arab Emirates", "United Kingdom", "United States", "Uruguay", "Vietnam"]
OTHER_NAMES = {
    "united states of america": "United States",
    "usa": "United States",
    "us": "United States",
    "u.s.": "United States",
    "u.s.a.": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "great britain": "United Kingdom",
    "england": "United Kingdom",
    "scotland": "United Kingdom",
    "wales": "United Kingdom",
    "northern ireland": "United Kingdom",
    "deutschland": "Germany",
    "federal republic of germany": "Germany",
    "czechia": "Czech Republic",
    "korea": "South Korea",
    "türkiye": "Turkey",
    "uae": "United Arab Emirates",
}
# Regions that are no country, and names that a plain CSV country field may use.
BROAD_REGIONS = ["north america", "south america", "latin america", "latam", "europe", "european union", "eu", "emea", "apac", "asia pacific", "asia", "africa", "middle east", "worldwide", "global", "americas"]
FIELD_NAMES = {"united states": "United States", "usa": "United States", "u.s.a.": "United States", "united kingdom": "United Kingdom", "uk": "United Kingdom", "u.k.": "United Kingdom", "canada": "Canada", "germany": "Germany"}
ELIGIBLE = ["United States", "Canada"]
REJECTED = r"\b(?:unknown|unspecified|anywhere|worldwide|global|latam|apac|emea|europe|timezones|north america|americas)\b"
# Metropolitan areas that a location filter may name.
_TORONTO = "toronto|gta|greater toronto area|mississauga|brampton|markham|vaughan|richmond hill|oakville|burlington|milton|pickering|ajax|whitby|oshawa|newmarket|aurora|king|halton hills|caledon|scarborough|north york|etobicoke|(?<!new\\s)york|east york"
CANADIAN_METROS = {
    "toronto": _TORONTO,
    "gta": _TORONTO,
    "vancouver": "vancouver|greater vancouver|metro vancouver|burnaby|richmond|surrey|coquitlam|north vancouver|west vancouver|delta|langley|new westminster|port coquitlam|port moody",
    "montreal": "montreal|montréal|greater montreal|grand montréal|laval|longueuil|brossard|kirkland|dorval|pointe claire|pointe-claire|westmount|saint laurent|saint-laurent|boucherville|terrebonne",
    "ottawa": "ottawa|gatineau|national capital region|kanata|nepean|gloucester|orleans",
    "waterloo": "waterloo|kitchener|kitchener-waterloo|kw|cambridge|guelph",
    "calgary": "calgary|greater calgary|airdrie|cochrane|okotoks|chestermere",
    "edmonton": "edmonton|greater edmonton|st albert|st\\. albert|sherwood park|spruce grove|leduc",
}
_BAY, _NYC, _SEATTLE = "san francisco|sf|south san francisco", "new york|nyc|new york city|manhattan|brooklyn", "seattle|bellevue|redmond"
US_METROS = {"san francisco, ca": _BAY, "san francisco": _BAY, "sf": "san francisco|sf", "new york, ny": _NYC, "new york": _NYC, "nyc": _NYC, "seattle, wa": _SEATTLE, "seattle": _SEATTLE}
LOCATION_OPTIONS = ["Toronto (GTA)", "Vancouver", "Montreal", "Ottawa", "Waterloo", "Calgary", "Edmonton", "San Francisco, CA", "New York, NY", "Seattle, WA"]

_OFFICE = r"(?i)\s+(?:office|hq|headquarters|campus|site)\b"


def _escaped(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(".", "\\.") for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def _regions(country: str) -> list[str]:
    if country == "Canada":
        return [*PROVINCE_CODES, *PROVINCE_NAMES, "canada"]
    return [*STATE_CODES, *STATE_NAMES, "us", "usa", "u.s.", "u.s.a.", "united states", "united states of america", "d.c."]


def location_patterns(country: str) -> list[str]:
    """A country or region alone, a known city, a city with its region."""
    region, city = _escaped(_regions(country)), _escaped(CITIES[country])
    mode, gap = r"(?:remote(?:\s+(?:job|work|in))?|hybrid|onsite|on-site|in-office)", r"[\s()\[\],:/|–—-]*"
    return [rf"^{gap}(?:{mode}{gap})?{region}(?:{gap}{mode})?{gap}$", rf"\b{city}\b", rf"\b[A-Za-z][A-Za-z .'-]+,\s*{region}(?=\W|$)"]


def eligible(location: Column, country: Column) -> Column:
    """Explicitly in an eligible country, or remote within one."""
    place = F.trim(F.coalesce(location, F.lit("")))
    known = F.lit(False)
    for name in ELIGIBLE:
        for pattern in location_patterns(name):
            known = known | has(place, pattern)
    remote = F.lower(place).isin("remote", "remote job", "remote work")
    return (place != "") & F.coalesce(country.isin(ELIGIBLE), F.lit(False)) & ~has(place, REJECTED) & (remote | known)


def normalized_country(raw: Column) -> Column:
    """A country field as shown: blanks and broad regions are Unknown."""
    clean = F.trim(F.coalesce(raw, F.lit("")))
    low = F.lower(clean)
    return F.when((clean == "") | low.isin(BROAD_REGIONS), "Unknown").otherwise(F.coalesce(lookup(low, FIELD_NAMES), title_case(clean)))


def canonical_countries(values: list[str]) -> list[str]:
    """Names that a country filter means; blanks are dropped, others kept as given."""
    names = {c.lower(): c for c in COUNTRIES} | OTHER_NAMES | {"ca": "Canada"}
    return list(dict.fromkeys(names.get(v.strip().lower(), v.strip()) for v in values if v and v.strip()))


def canadian_context(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    segments = F.transform(F.split(t, r"[,;/()|]|\s+[-–—]\s+"), lambda s: F.regexp_replace(s, r"^[\s()\[\]–—/:,|-]+|[\s()\[\]–—/:,|-]+$", ""))
    coded = F.exists(segments, lambda s: s.isin(PROVINCE_CODES) | (s.rlike(r"^[a-z]{2}\s+[a-z]\d") & F.substring(s, 1, 2).isin(PROVINCE_CODES)))
    return coded | has(t, rf"(?U)\b{_escaped([*PROVINCE_NAMES, *CITIES['Canada'], 'canada'])}\b")


def token_country(token: Column, context: Column) -> Column:
    """The country of a country, state, province or known city; null if none. CA is California unless the context is Canadian."""
    t = F.lower(F.trim(token))
    bare = F.trim(F.regexp_replace(t, _OFFICE, ""))
    names = {c.lower(): c for c in COUNTRIES} | OTHER_NAMES
    cities = {city: country for country, all_ in CITIES.items() for city in all_}

    def one(x: Column, codes: bool) -> Column:
        states = F.when(x.isin(STATE_NAMES) | (x.isin(STATE_CODES) if codes else F.lit(False)), "United States")
        provinces = F.when(x.isin(PROVINCE_NAMES) | (x.isin(PROVINCE_CODES) if codes else F.lit(False)), "Canada")
        return F.coalesce(lookup(x, names), states, provinces, lookup(x, cities))

    ca = F.when(canadian_context(context), "Canada").otherwise("United States")
    return F.when((t == "ca") | (bare == "ca"), ca).otherwise(F.coalesce(one(t, True), one(bare, False)))


def located(raw: Column) -> Column:
    """struct<location, country> of a raw location. The last part that names a country or region decides; then the first
    known part; then any country word; else Unknown. Blank and worldwide locations are Unknown."""
    clean = squeeze(F.coalesce(raw, F.lit("")))
    inner = F.regexp_replace(clean, r"(?i)^(?:remote|hybrid|onsite|on-site|in-office)\s*[-–—:,(]*\s*|[)\s]+$", "")
    parts = F.filter(trimmed(F.split(inner, r"\s*[,;/|()]\s*|\s+[-–—]\s+")), lambda p: p != "")
    found = F.filter(F.transform(F.reverse(parts), lambda p: token_country(p, clean)), lambda c: c.isNotNull())
    word = F.when(has(clean, r"\bcanada\b"), "Canada").when(has(clean, r"\b(?:united states|usa|u\.s\.a?\.?)(?:\b|$)"), "United States")
    broad = F.lower(clean).isin([*BROAD_REGIONS, "remote", "remote job", "remote work", "anywhere", "unknown", "unspecified", "hybrid", "onsite", "international"])
    country = F.when(broad, "Unknown").otherwise(F.coalesce(F.get(found, F.lit(0)), word, F.lit("Unknown")))
    return F.when(clean == "", F.struct(F.lit("Unknown").alias("location"), F.lit("Unknown").alias("country"))).otherwise(F.struct(clean.alias("location"), country.alias("country")))


def alternatives(raw: Column) -> Column:
    """The places that a raw field lists: split at semicolons, slashes, pipes and "or" outside parentheses, each once."""
    pieces = F.filter(trimmed(F.split(F.coalesce(raw, F.lit("")), r"\s*(?:;|\||\s/\s|\bor\b)\s*(?![^()]*\))")), lambda p: p != "")
    return F.array_distinct(pieces)


def job_locations(raw: Column) -> Column:
    """array<struct<location, country, raw_location>> of a raw field, as the labels stand; of places that read alike the first stays.
    (places.job_places has one shape for well-known cities, and every published label.)"""

    def one(p: Column) -> Column:
        at = located(p)
        return F.struct(at["location"].alias("location"), at["country"].alias("country"), p.alias("raw_location"))

    empty = F.array().cast("array<struct<location:string,country:string,raw_location:string>>")
    return F.aggregate(F.transform(alternatives(raw), one), empty, lambda a, x: F.when(F.exists(a, lambda y: (F.lower(y["location"]) == F.lower(x["location"])) & (y["country"] == x["country"])), a).otherwise(F.array_append(a, x)))


def primary_location(locations: Column) -> Column:
    """The first eligible place, else the first."""
    good = F.filter(locations, lambda x: eligible(x["location"], x["country"]))
    return F.coalesce(F.get(good, F.lit(0)), F.get(locations, F.lit(0)))


def location_filter(value: str, location: Column, country: Column, others: Column) -> Column:
    """A metropolitan area by its towns, anything else as literal text, on the main place or any other."""
    name = value.strip().lower()
    bare = name.split("(")[0].strip()
    if bare in CANADIAN_METROS:
        pattern, where = rf"(?U)\b(?:{CANADIAN_METROS[bare]})\b", "Canada"
    elif name in US_METROS:
        pattern, where = rf"\b(?:{US_METROS[name]})\b", "United States"
    else:
        like = f"%{like_literal(value)}%".lower()
        return F.coalesce(F.lower(location).like(like), F.lit(False)) | F.coalesce(F.exists(others, lambda x: F.coalesce(F.lower(x["location"]).like(like), F.lit(False))), F.lit(False))
    here = (country == where) & has(location, pattern)
    return F.coalesce(here, F.lit(False)) | F.coalesce(F.exists(others, lambda x: (x["country"] == where) & has(x["location"], pattern)), F.lit(False))


def country_filter(values: list[str], country: Column, others: Column) -> Column:
    wanted = [v.lower() for v in canonical_countries(values)]
    return F.coalesce(F.lower(country).isin(wanted), F.lit(False)) | F.coalesce(F.exists(others, lambda x: F.lower(x["country"]).isin(wanted)), F.lit(False))

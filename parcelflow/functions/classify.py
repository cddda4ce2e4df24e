"""Lookup-table operators: asset types, residential gates, boroughs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow.functions.normalize import BOROUGHS

# Fixed values.
DEED_TYPE_REJECT = ["D1", "D2", "D3", "D4", "RG", "RP", "RV", "SC", "SP", "MC", "MP", "SA", "SM", "CK", "CA", "BS", "TS", "MR", "GR", "PS", "NA", "PA"]
CLASS_REJECT = ["C0", "C3", "C6", "C8", "D0", "D4", "DC"]
CLASS_TYPES = {"C": "Multifamily", "D": "Multifamily", "E": "Industrial", "F": "Industrial", "G": "Garage/Auto", "H": "Hotel", "J": "Entertainment", "K": "Retail", "L": "Office", "O": "Office", "P": "Entertainment", "S": "Mixed-Use", "V": "Development Site"}
LETTER_REJECT = "ABIMNQTUWYZR"
DEED_TYPES = {"CR": "Commercial", "OF": "Office", "RB": "Retail", "IB": "Industrial", "AP": "Multifamily", "EA": "Entertainment", "D5": "Multifamily", "D6": "Multifamily", "F1": "Mixed-Use", "F4": "Mixed-Use", "F5": "Mixed-Use", "FS": "Mixed-Use", "VL": "Development Site", "VN": "Development Site", "VR": "Development Site", "SR": "Storage"}
BANNED_ASSETS = ["Condo", "Commercial Condo", "Co-op", "Single Family", "Two Family", "1-2 Family"]
SLUG_TYPES = {
    "multifamily": "Multifamily", "office": "Office", "retail": "Retail", "industrial": "Industrial", "hotel": "Hotel", "mixed-use": "Mixed-Use", "development": "Development Site",
    "development-site": "Development Site", "land": "Development Site", "parking-lot": "Parking Lot", "garage": "Garage/Auto", "commercial": "Commercial", "special-purpose": "Special Purpose",
    "hospital": "Hospital", "nursing-home": "Nursing Home", "school": "School", "church": "Church", "student-housing": "Student Housing", "senior-housing": "Senior Housing", "package-deal": "Package Deal", "storage": "Storage",
}
NEIGHBOURHOODS = {
    "yorkville": "Manhattan", "harlem": "Manhattan", "tribeca": "Manhattan", "soho": "Manhattan", "nolita": "Manhattan", "chinatown": "Manhattan", "chelsea": "Manhattan", "midtown": "Manhattan",
    "upper east side": "Manhattan", "upper west side": "Manhattan", "inwood": "Manhattan", "hudson yards": "Manhattan", "east village": "Manhattan", "west village": "Manhattan",
    "greenwich village": "Manhattan", "financial district": "Manhattan", "lower east side": "Manhattan", "flatiron": "Manhattan", "williamsburg": "Brooklyn", "bushwick": "Brooklyn",
    "dumbo": "Brooklyn", "park slope": "Brooklyn", "bed-stuy": "Brooklyn", "bedford-stuyvesant": "Brooklyn", "sunset park": "Brooklyn", "brooklyn heights": "Brooklyn", "red hook": "Brooklyn",
    "bay ridge": "Brooklyn", "crown heights": "Brooklyn", "astoria": "Queens", "long island city": "Queens", "flushing": "Queens", "jamaica": "Queens", "sunnyside": "Queens",
    "forest hills": "Queens", "rego park": "Queens", "jackson heights": "Queens", "mott haven": "Bronx", "fordham": "Bronx", "riverdale": "Bronx", "wakefield": "Bronx",
}
COUNTIES = {"new york": "Manhattan", "kings": "Brooklyn", "queens": "Queens", "bronx": "Bronx", "richmond": "Staten Island"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def classify_asset(bldg_class: Column, deed_type: Column, units: Column, class_types: dict[str, str] | None = None, letters: str = LETTER_REJECT) -> Column:
    """Asset type by building class, then by the deed's property type; null is a rejection."""
    cls, letter, deed = F.upper(bldg_class), F.upper(F.substring(bldg_class, 1, 1)), F.upper(F.coalesce(deed_type, F.lit("")))
    has = F.coalesce(bldg_class != "", F.lit(False))
    commercial = F.coalesce(letter.isin(*"CDEFHKLO"), F.lit(False))
    by_class = lookup(class_types or CLASS_TYPES, letter)
    return (
        F.when(has & F.substring(cls, 1, 2).isin(CLASS_REJECT), F.lit(None))
        .when(has & letter.isin(*letters), F.lit(None))
        .when(has & letter.isin("C", "D") & (units <= 4), F.lit(None))
        .when(has & by_class.isNotNull(), by_class)
        .when(deed.isin("CC", "CP"), F.lit(None))
        .when(deed.isin(DEED_TYPE_REJECT) & ~commercial, F.lit(None))
        .otherwise(F.coalesce(lookup(DEED_TYPES, deed), F.when(deed != "", "Commercial")))
    )


def classify_asset_v2(bldg_class: Column, deed_type: Column, units: Column) -> Column:
    """The later variant: condominium classes with a commercial deed type stay, as commercial condos."""
    condo = F.upper(F.substring(bldg_class, 1, 1)).eqNullSafe("R") & F.upper(deed_type).isin("CC", "CP")
    return F.when(condo, "Commercial Condo").otherwise(classify_asset(bldg_class, deed_type, units))


def residential_gate(asset_type: Column, bldg_class: Column) -> Column:
    cls = F.upper(F.trim(bldg_class))
    return (
        F.when(asset_type.isin(BANNED_ASSETS), "banned_asset_type")
        .when(cls.rlike("^(A[0-9A-Z]?|B[0-9A-Z]?|RG)$"), "one_two_family")
        .when(cls.rlike("^R[0-9A-Z]?$"), "condo_unit")
        .otherwise("ok")
    )


def residential_gate_sql(bldg_class: Column) -> Column:
    return F.coalesce(F.upper(bldg_class).rlike("^(A|B|R|C0|C3|C6|C8|D0|D4|DC)"), F.lit(False))


def small_unit_flag(source: Column, bldg_class: Column, units: Column, asset_type: Column) -> Column:
    scraped = source.isin("traded", "crexi", "instagram", "upload")
    blank = F.coalesce(F.trim(asset_type), F.lit("")).isin("", "Multifamily")
    return F.coalesce(scraped & (F.trim(F.coalesce(bldg_class, F.lit(""))) == "") & (units <= 2) & blank, F.lit(False))


def asset_from_slug(url: Column) -> Column:
    return lookup(SLUG_TYPES, F.lower(F.regexp_extract(url, "/deals/[^/]+/([^/]+)/", 1)))


def borough_from_zip(zip_code: Column) -> Column:
    n = F.regexp_extract(F.trim(F.coalesce(zip_code, F.lit(""))), r"^(\d{5})", 1).try_cast("int")
    p = F.floor(n / 100)
    return (
        F.when(n.isin(11004, 11005), "Queens").when(p.isin(100, 101, 102), "Manhattan").when(p == 103, "Staten Island").when(p == 104, "Bronx")
        .when(p == 112, "Brooklyn").when(p.isin(111, 113, 114, 116), "Queens")
    )


def neighbourhood(text: Column) -> Column:
    names = F.array(*map(F.lit, NEIGHBOURHOODS))
    return F.get(F.filter(names, lambda n: F.lower(text).contains(n)), F.lit(0))


def borough_from_text(text: Column) -> Column:
    """A borough's own name, in a fixed order, else the first neighbourhood's."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    explicit = F.coalesce(*[F.when(lower.rlike(rf"\b{b.lower()}\b"), b) for b in BOROUGHS])
    return F.coalesce(explicit, lookup(NEIGHBOURHOODS, neighbourhood(lower)))


def resolve_geo(zip_code: Column, city: Column, submarket: Column, title: Column) -> Column:
    """struct(borough, conflict, note): the first of caption, submarket, zip and city that speaks; a note where they differ."""
    named = F.coalesce(*[F.when(F.lower(F.trim(city)) == b.lower(), b) for b in BOROUGHS])
    signals = [("caption", borough_from_text(title)), ("submarket", borough_from_text(submarket)), ("zip", borough_from_zip(zip_code)), ("city", named)]
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("by"), v.alias("b")) for k, v in signals]), lambda s: s["b"].isNotNull())
    first = F.get(found, F.lit(0))
    other = F.get(F.filter(found, lambda s: s["b"] != first["b"]), F.lit(0))
    note = F.concat(F.lit("Borough conflict: "), first["by"], F.lit("="), first["b"], F.lit(" vs "), other["by"], F.lit("="), other["b"], F.lit("; used "), first["b"])
    return F.struct(first["b"].alias("borough"), other.isNotNull().alias("conflict"), note.alias("note"))


def borough_from_county_city(county: Column, city: Column) -> Column:
    by_city = reduce(lambda a, b: a.when(F.lower(F.trim(city)) == b.lower(), b), BOROUGHS[1:], F.when(F.lower(F.trim(city)) == "staten island", "Staten Island")).when(F.lower(F.trim(city)) == "new york", "Manhattan")
    return F.coalesce(lookup(COUNTIES, F.lower(F.trim(county))), by_city)


def canon_borough(c: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(F.trim(c)) == b.lower(), b) for b in BOROUGHS], c)

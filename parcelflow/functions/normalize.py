"""Normalisers and derived columns: Column in, Column out, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PLACEHOLDERS = r"unknown|n/?a|not\s+specified|not\s+provided|not\s+disclosed|not\s+found|undisclosed|confidential|withheld|anonymous|private\s+investor|various|multiple|null|undefined|none|no\s+name|tbd|tba|-+|\*+"
DIRECTIONS = {"EAST": "E", "WEST": "W", "NORTH": "N", "SOUTH": "S"}
SUFFIXES = {
    "STREET": "ST", "AVENUE": "AVE", "AV": "AVE", "BOULEVARD": "BLVD", "ROAD": "RD", "DRIVE": "DR", "LANE": "LN", "PLACE": "PL", "PARKWAY": "PKWY",
    "SQUARE": "SQ", "COURT": "CT", "TERRACE": "TER", "PLAZA": "PLZ", "HIGHWAY": "HWY", "EXPRESSWAY": "EXPY", "BROADWAY": "BWAY",
}
LATER_SUFFIXES = {k: v for k, v in SUFFIXES.items() if k != "BROADWAY"} | {"STR": "ST", "CIRCLE": "CIR", "TURNPIKE": "TPKE"}
ADDRESS_WORDS = {
    "east": "e", "west": "w", "north": "n", "south": "s", "street": "st", "avenue": "ave", "boulevard": "blvd", "road": "rd", "place": "pl",
    "parkway": "pkwy", "drive": "dr", "lane": "ln", "court": "ct", "terrace": "ter", "square": "sq",
}
GENERIC_TOKENS = ["ST", "AVE", "BLVD", "RD", "DR", "LN", "PL", "PKWY", "SQ", "CT", "TER", "PLZ", "E", "W", "N", "S"]
BOROUGHS = ["Staten Island", "Brooklyn", "Queens", "Bronx", "Manhattan"]
CHANNELS = ["call", "email", "meeting", "text", "other"]


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def is_placeholder(c: Column) -> Column:
    """Null, blank, or one of the usual non-answers."""
    return F.coalesce(F.trim(c).rlike(f"(?i)^(?:{PLACEHOLDERS})$") | (F.trim(c) == ""), F.lit(True))


def placeholder_short(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("unknown", "n/a", "none", "null", "tbd", "undisclosed", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_entity(c: Column) -> Column:
    name = F.regexp_replace(F.upper(F.trim(c)), r"L\.L\.C\.|LLC", "LLC")
    name = squeeze(F.regexp_replace(name, r"INC\.|INCORPORATED|INC", "INC"))
    return F.when(~is_placeholder(c), empty_to_null(name))


def alnum_upper(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def entity_type(norm_name: Column) -> Column:
    return F.when(norm_name.rlike(r"\bLLC\b"), "llc").when(norm_name.rlike(r"\b(INC|CORP|CORPORATION)\b"), "corp").otherwise("unknown")


def _map_tokens(text: Column, words: dict[str, str]) -> Column:
    """Each token of a text in upper case replaced if it is in words."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def canon_street(c: Column) -> Column:
    text = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[.,#]", " ")
    return _map_tokens(F.regexp_replace(text, r"(\d+)(?:ST|ND|RD|TH)\b", "$1"), DIRECTIONS | SUFFIXES)


def house_number(address: Column) -> Column:
    number = F.regexp_extract(F.coalesce(address, F.lit("")), r"^\s*(\d+[\-/]?\d*)\s+.+$", 1)
    return empty_to_null(F.when(F.regexp_replace(number, "^0+", "") == "", number).otherwise(F.regexp_replace(number, "^0+", "")))


def street_of(address: Column) -> Column:
    """The street part of an address with a house number, up to a comma or a place name."""
    tail = F.regexp_extract(F.coalesce(address, F.lit("")), r"^\s*\d+[\-/]?\d*\s+(.+)$", 1)
    tail = F.regexp_replace(tail, ",.*$", "")
    tail = F.regexp_replace(tail, r"(?i)\b(NEW YORK|NY|NYC|MANHATTAN|BROOKLYN|QUEENS|BRONX|STATEN ISLAND)\b.*$", "")
    return F.when(house_number(address).isNotNull(), canon_street(tail))


def street_strict(address: Column) -> Column:
    tail = F.regexp_extract(F.coalesce(address, F.lit("")), r"^\s*\d+(?:-\d+)?\s+(.+)$", 1)
    tail = F.regexp_replace(F.regexp_replace(tail, ",.*$", ""), r"(?i)\s+(MANHATTAN|BROOKLYN|QUEENS|BRONX|STATEN ISLAND)\s*$", "")
    return empty_to_null(canon_street(tail))


def normalize_address(c: Column) -> Column:
    text = F.regexp_replace(F.lower(c), "[.,#]", " ")
    text = F.regexp_replace(text, r"\b(new york|ny|brooklyn|bronx|queens|manhattan|staten island)\b", "")
    for word, short in ADDRESS_WORDS.items():
        text = F.regexp_replace(text, rf"\b{word}\b", short)
    return squeeze(F.regexp_replace(text, r"(\d+)(?:st|nd|rd|th)\b", "$1"))


def canonicalize_address(c: Column) -> Column:
    """Trailing ZIP codes and places go, however many; then ordinals and words are shortened."""
    text = squeeze(F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[.,;:()#]", " "))
    text = F.regexp_replace(text, r"(?:\s+(?:\d{5}(?:-\d{4})?|NY|NYC|NEW YORK|MANHATTAN|BROOKLYN|QUEENS|BRONX|STATEN ISLAND|[A-Z][A-Z ]*COUNTY))+$", "")
    return _map_tokens(F.regexp_replace(text, r"(\d+)(?:ST|ND|RD|TH)\b", "$1"), DIRECTIONS | LATER_SUFFIXES)


def longest_token(street: Column, skip: list[str] | None = None, above: int = 0) -> Column:
    """The longest token, the first of equals; skip: generic ones that don't count."""
    tokens = F.filter(F.split(street, " "), lambda t: (F.length(t) > above) & ~t.isin(skip or [""]))
    return F.aggregate(tokens, F.lit(None).cast("string"), lambda best, t: F.when(best.isNull() | (F.length(t) > F.length(best)), t).otherwise(best))


def build_bbl(boro: Column, block: Column, lot: Column) -> Column:
    b, k, t = F.trim(boro.cast("string")), F.regexp_replace(block.cast("string"), "[^0-9]", ""), F.regexp_replace(lot.cast("string"), "[^0-9]", "")
    fits = b.rlike("^[1-5]$") & F.length(k).between(1, 5) & F.length(t).between(1, 4)
    return F.when(fits, F.concat(b, F.lpad(k, 5, "0"), F.lpad(t, 4, "0")))


def norm_phone(c: Column) -> Column:
    return empty_to_null(F.regexp_replace(c, "[^0-9]", ""))


def phone_e164(c: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when((F.length(d) == 11) & d.startswith("1") | F.length(d).between(8, 15), F.concat(F.lit("+"), d))


def norm_email(c: Column) -> Column:
    return empty_to_null(F.lower(F.trim(c)))


def norm_website(c: Column) -> Column:
    site = F.regexp_replace(F.lower(F.trim(c)), "^https?://", "")
    return empty_to_null(F.regexp_replace(F.regexp_replace(site, r"^www\.", ""), "/+$", ""))


def norm_contact_address(c: Column) -> Column:
    text = F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " ")
    for word, short in {"SUITE": "STE", "FLOOR": "FL", "AVENUE": "AVE", "STREET": "ST", "ROAD": "RD", "BOULEVARD": "BLVD"}.items():
        text = F.regexp_replace(text, rf"\b{word}\b", short)
    return empty_to_null(F.trim(text))


def strip_article(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"(?i)^(the|a|an)\s+", "")


def source_from_url(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return F.when(u.contains("acris"), "acris").when(u.contains("traded"), "traded").when(u.contains("crexi"), "crexi").otherwise("other")


def map_source_system(source: Column, url: Column) -> Column:
    s = F.lower(F.trim(source))
    return F.when(s.isin("acris", "traded", "crexi", "other"), s).otherwise(source_from_url(url))


def doc_id_from_url(url: Column) -> Column:
    return empty_to_null(F.regexp_extract(url, "doc_id=([A-Z0-9]+)", 1))


def doc_id_from_notes(notes: Column) -> Column:
    return empty_to_null(F.regexp_extract(notes, r"parties from ACRIS (\w+) \(amount", 1))


def party_provenance(notes: Column, url: Column) -> Column:
    """(source, reference, gate): from the notes, else the deed id, else the URL."""
    noted, deed = doc_id_from_notes(notes), doc_id_from_url(url)
    return F.when(noted.isNotNull(), F.concat_ws("|", F.lit("acris"), noted, F.lit("true"))).when(deed.isNotNull(), F.concat_ws("|", F.lit("acris"), deed, F.lit("true"))).otherwise(F.concat_ws("|", source_from_url(url), F.coalesce(url, F.lit("")), F.lit("")))


def slug_from_url(url: Column) -> Column:
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), "([^/]+)/*$", 1)
    return F.regexp_replace(F.upper(last), "[^A-Z0-9]+", "-")


def canonical_deal_url(url: Column) -> Column:
    """An address of the deals section without query and with one closing slash; null elsewhere."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", "")
    return F.when(bare.rlike(r"^https?://(?:www\.)?traded\.co/deals/[^/]+/"), F.concat(bare, F.lit("/")))


def parse_money(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[$,]", "").try_cast("double")


def parse_int_loose(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double").try_cast("int")


def iso_date_pad(c: Column) -> Column:
    y, m, d = (F.regexp_extract(F.trim(c), r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:$|[T ])", i) for i in (1, 2, 3))
    fits = (y != "") & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    return F.when(fits, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def parse_date_loose(c: Column) -> Column:
    us = F.regexp_replace(F.trim(c), r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2")
    return F.coalesce(F.try_to_date(iso_date_pad(c), "yyyy-MM-dd"), F.try_to_date(us, "yyyy-MM-dd")).cast("string")


def upload_timestamp(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(F.coalesce(iso_date_pad(c), F.lit("")), F.lit("yyyy-MM-dd")), "yyyy-MM-dd HH:mm:ss")


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def clean_sale_date(value: Column, title: Column) -> Column:
    """ISO or US date, else a month-name date from the title (day 1 where it has none)."""
    s = F.trim(F.coalesce(value, F.lit("")))
    names = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
    number = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, f"{v:02d}")])
    t = F.lower(F.coalesce(title, F.lit("")))
    full, short = r"\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b", r"\b([a-z]{3,9})\.?\s+(\d{4})\b"
    month, month2 = F.element_at(number, F.regexp_extract(t, full, 1)), F.element_at(number, F.regexp_extract(t, short, 1))
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    return (
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10))
        .when(s.rlike(us), F.concat_ws("-", F.regexp_extract(s, us, 3), F.lpad(F.regexp_extract(s, us, 1), 2, "0"), F.lpad(F.regexp_extract(s, us, 2), 2, "0")))
        .when(month.isNotNull(), F.concat_ws("-", F.regexp_extract(t, full, 3), month, F.lpad(F.regexp_extract(t, full, 2), 2, "0")))
        .when(month2.isNotNull(), F.concat_ws("-", F.regexp_extract(t, short, 2), month2, F.lit("01")))
    )


def day_distance(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(9999))


def per_unit(price: Column, units: Column) -> Column:
    """Rounded half up to cents, in decimals: a double can't hold half a cent."""
    return F.when(units > 0, F.round(price.cast("decimal(14,2)") / units, 2).cast("double"))


def confidence_deed(buyer: Column, seller: Column, bldg_class: Column, sqft: Column) -> Column:
    points = [F.when(c.isNotNull(), p).otherwise(0) for c, p in ((buyer, 20), (seller, 15), (bldg_class, 15), (sqft, 10))]
    return F.least(F.lit(100), F.lit(40) + points[0] + points[1] + points[2] + points[3])


def confidence_listing(price: Column, buyer: Column, seller: Column, day: Column) -> Column:
    points = [F.when(c.isNotNull(), p).otherwise(0) for c, p in ((price, 25), (buyer, 20), (seller, 15), (day, 10))]
    return F.lit(20) + points[0] + points[1] + points[2] + points[3]


def clamp_confidence(c: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.round(c), F.lit(50)))).cast("int")


def append_note_once(notes: Column, note: Column) -> Column:
    have = F.coalesce(notes, F.lit(""))
    return F.when(have.contains(note), have).otherwise(F.regexp_replace(F.concat(have, F.lit(" | "), note), r"^[\s|]+|[\s|]+$", ""))


def audit_hash(*fields: Column) -> Column:
    """md5 over every field, nulls as empty: concat_ws would drop them."""
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.md5(F.concat(*[x for p in parts for x in (p, F.lit("|"))]))


def address_title(number: Column, street: Column, borough: Column) -> Column:
    return F.concat_ws(", ", F.concat_ws(" ", number.cast("string"), F.initcap(street)), borough, F.lit("NY"))


def channel(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(CHANNELS), F.lower(F.trim(c))).otherwise("other")


def role(c: Column) -> Column:
    """Role synonyms to their usual name."""
    r = F.lower(F.trim(c))
    out = F.when(r.isin("buyer", "purchaser", "grantee"), "Buyer").when(r.isin("seller", "vendor", "grantor"), "Seller")
    return out.when(r.isin("owner", "landlord"), "Owner").when(r.isin("broker", "agent"), "Broker").when(r.isin("lender", "bank"), "Lender").otherwise("Other")

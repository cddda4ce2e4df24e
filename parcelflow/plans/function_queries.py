"""A query for each normaliser and lookup: its view, the columns shown beside the result, the Spark expression and the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import classify as C
from parcelflow.functions import normalize as N
from parcelflow.plans.views import frame, with_views

def c(name: str):
    return F.col(name)


PH = r"^(unknown|n/?a|not\s+specified|not\s+provided|not\s+disclosed|not\s+found|undisclosed|confidential|withheld|anonymous|private\s+investor|various|multiple|null|undefined|none|no\s+name|tbd|tba|-+|\*+)$"


def is_ph(x: str) -> str:
    return f"coalesce(regexp_matches(trim({x}), '{PH}', 'i') OR trim({x}) = '', true)"


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def tokens(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> ''), lambda t: CASE t {cases} ELSE t END), ' ')"


def canon(x: str) -> str:
    return tokens(rf"regexp_replace(regexp_replace(upper(coalesce({x}, '')), '[.,#]', ' ', 'g'), '(\d+)(ST|ND|RD|TH)\b', '\1', 'g')", N.DIRECTIONS | N.SUFFIXES)


def chain(x: str, pairs: list[tuple[str, str]], flags: str = "g") -> str:
    for a, b in pairs:
        x = f"regexp_replace({x}, '{a}', '{b}', '{flags}')"
    return x


def case(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


NORM = f"CASE WHEN NOT {is_ph('name')} THEN nullif({sq(chain('upper(trim(name))', [(r'L\.L\.C\.|LLC', 'LLC'), (r'INC\.|INCORPORATED|INC', 'INC')]))}, '') END"
NUM = r"regexp_extract(coalesce(address, ''), '^\s*(\d+[\-/]?\d*)\s+.+$', 1)"
HOUSE = f"nullif(CASE WHEN ltrim({NUM}, '0') = '' THEN {NUM} ELSE ltrim({NUM}, '0') END, '')"
TAIL = chain(r"regexp_extract(coalesce(address, ''), '^\s*\d+[\-/]?\d*\s+(.+)$', 1)", [(",.*$", "")])
STREET = f"CASE WHEN {HOUSE} IS NOT NULL THEN {canon(chain(TAIL, [(r'\b(NEW YORK|NY|NYC|MANHATTAN|BROOKLYN|QUEENS|BRONX|STATEN ISLAND)\b.*$', '')], 'gi'))} END"
LONGEST = "(list_sort(list_transform(list_filter(string_split({s}, ' '), lambda t: {f}), lambda t, i: {{'n': -length(t), 'i': i, 't': t}}))[1]).t"
SRC = "CASE WHEN lower(coalesce(url, '')) LIKE '%acris%' THEN 'acris' WHEN lower(coalesce(url, '')) LIKE '%traded%' THEN 'traded' WHEN lower(coalesce(url, '')) LIKE '%crexi%' THEN 'crexi' ELSE 'other' END"
DOC_URL, DOC_NOTES = "nullif(regexp_extract(url, 'doc_id=([A-Z0-9]+)', 1), '')", r"nullif(regexp_extract(notes, 'parties from ACRIS (\w+) \(amount', 1), '')"
PAD = r"CASE WHEN regexp_matches(trim({x}), '^\d{{4}}-\d{{1,2}}-\d{{1,2}}($|[T ])') AND TRY_CAST(string_split(trim({x}), '-')[2] AS INT) BETWEEN 1 AND 12 AND TRY_CAST(regexp_extract(trim({x}), '^\d{{4}}-\d{{1,2}}-(\d{{1,2}})', 1) AS INT) BETWEEN 1 AND 31 THEN concat_ws('-', regexp_extract(trim({x}), '^(\d{{4}})', 1), lpad(string_split(trim({x}), '-')[2], 2, '0'), lpad(regexp_extract(trim({x}), '^\d{{4}}-\d{{1,2}}-(\d{{1,2}})', 1), 2, '0')) END"
DAY = PAD.format(x="day")
DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
ZIPN = r"TRY_CAST(regexp_extract(trim(coalesce(zip, '')), '^(\d{5})', 1) AS INT)"
ZIPB = f"CASE WHEN {ZIPN} IN (11004, 11005) THEN 'Queens' WHEN {ZIPN} // 100 IN (100, 101, 102) THEN 'Manhattan' WHEN {ZIPN} // 100 = 103 THEN 'Staten Island' WHEN {ZIPN} // 100 = 104 THEN 'Bronx' WHEN {ZIPN} // 100 = 112 THEN 'Brooklyn' WHEN {ZIPN} // 100 IN (111, 113, 114, 116) THEN 'Queens' END"
BANNED = "'Condo', 'Commercial Condo', 'Co-op', 'Single Family', 'Two Family', '1-2 Family'"
MONTH_NUMBERS = {m: f"{i:02d}" for i, m in enumerate(N.MONTHS, 1)} | {m[:3]: f"{i:02d}" for i, m in enumerate(N.MONTHS, 1)} | {"sept": "09"}
FULL, SHORT = r"\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b", r"\b([a-z]{3,9})\.?\s+(\d{4})\b"


def ex(x: str, p: str, g: int) -> str:
    return f"regexp_extract({x}, '{p}', {g})"


def boro_text(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    own = ", ".join(rf"CASE WHEN regexp_matches({low}, '\b{b.lower()}\b') THEN '{b}' END" for b in N.BOROUGHS)
    hood = " ".join(f"WHEN contains({low}, '{k}') THEN '{v}'" for k, v in C.NEIGHBOURHOODS.items())
    return f"coalesce({own}, CASE {hood} END)"


def classify_sql(types: dict[str, str]) -> str:
    has, letter, deed = "coalesce(bldg_class <> '', false)", "upper(substr(bldg_class, 1, 1))", "upper(coalesce(doc_class, ''))"
    return (
        f"CASE WHEN {has} AND substr(upper(bldg_class), 1, 2) IN ({', '.join(map(repr, C.CLASS_REJECT))}) THEN NULL WHEN {has} AND {letter} IN ({', '.join(map(repr, C.LETTER_REJECT))}) THEN NULL "
        f"WHEN {has} AND {letter} IN ('C', 'D') AND units <= 4 THEN NULL WHEN {has} AND {case(letter, types)} IS NOT NULL THEN {case(letter, types)} WHEN {deed} IN ('CC', 'CP') THEN NULL "
        f"WHEN {deed} IN ({', '.join(map(repr, C.DEED_TYPE_REJECT))}) AND NOT coalesce({letter} IN ('C', 'D', 'E', 'F', 'H', 'K', 'L', 'O'), false) THEN NULL ELSE coalesce({case(deed, C.DEED_TYPES)}, CASE WHEN {deed} <> '' THEN 'Commercial' END) END"
    )


CITYB = "coalesce(" + ", ".join(f"CASE WHEN lower(trim(city)) = '{b.lower()}' THEN '{b}' END" for b in N.BOROUGHS) + ")"
NOTE = "'{n} (checked)'"

#: key: (view, Spark expression, DuckDB expression)
FUNCTIONS = {
    "is_placeholder": ("raw_names", lambda: N.is_placeholder(c("name")), is_ph("name")),
    "placeholder_short": ("raw_names", lambda: N.placeholder_short(c("name")), "lower(trim(name)) IN ('unknown', 'n/a', 'none', 'null', 'tbd', 'undisclosed', '')"),
    "norm_entity": ("raw_names", lambda: N.norm_entity(c("name")), NORM),
    "norm_entity_alnum": ("raw_names", lambda: N.alnum_upper(c("name")), "trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g'))"),
    "entity_type": ("raw_names", lambda: N.entity_type(N.norm_entity(c("name"))), rf"CASE WHEN regexp_matches({NORM}, '\bLLC\b') THEN 'llc' WHEN regexp_matches({NORM}, '\b(INC|CORP|CORPORATION)\b') THEN 'corp' ELSE 'unknown' END"),
    "strip_article": ("raw_names", lambda: N.strip_article(c("name")), r"regexp_replace(trim(name), '^(the|a|an)\s+', '', 'i')"),
    "canon_street": ("raw_addresses", lambda: N.canon_street(c("address")), canon("address")),
    "split_address": ("raw_addresses", lambda: F.concat_ws("|", N.house_number(c("address")), N.street_of(c("address"))), f"concat_ws('|', {HOUSE}, {STREET})"),
    "split_address_strict": ("raw_addresses", lambda: N.street_strict(c("address")), f"nullif({canon(chain(chain(ex(chr(99) + 'oalesce(address, ' + chr(39) * 2 + ')', r'^\s*\d+(?:-\d+)?\s+(.+)$', 1), [(',.*$', '')]), [(r'\s+(MANHATTAN|BROOKLYN|QUEENS|BRONX|STATEN ISLAND)\s*$', '')], 'gi'))}, '')"),
    "normalize_address": ("raw_addresses", lambda: N.normalize_address(c("address")), sq(chain("lower(address)", [("[.,#]", " "), (r"\b(new york|ny|brooklyn|bronx|queens|manhattan|staten island)\b", ""), *[(rf"\b{k}\b", v) for k, v in N.ADDRESS_WORDS.items()], (r"(\d+)(st|nd|rd|th)\b", r"\1")]))),
    "canonicalize_address": ("raw_addresses", lambda: N.canonicalize_address(c("address")), tokens(chain(sq(chain("upper(trim(coalesce(address, '')))", [("[.,;:()#]", " ")])), [(r"(\s+(\d{5}(-\d{4})?|NY|NYC|NEW YORK|MANHATTAN|BROOKLYN|QUEENS|BRONX|STATEN ISLAND|[A-Z][A-Z ]*COUNTY))+$", ""), (r"(\d+)(ST|ND|RD|TH)\b", r"\1")]), N.DIRECTIONS | N.LATER_SUFFIXES)),
    "norm_address_alnum": ("raw_addresses", lambda: N.alnum_upper(c("address")), "trim(regexp_replace(upper(address), '[^A-Z0-9]+', ' ', 'g'))"),
    "key_token": ("raw_addresses", lambda: N.longest_token(N.street_of(c("address")), N.GENERIC_TOKENS), LONGEST.format(s=STREET, f="t NOT IN (" + ", ".join(map(repr, N.GENERIC_TOKENS)) + ") AND t <> ''")),
    "longest_token": ("raw_addresses", lambda: N.longest_token(N.street_of(c("address")), None, 2), LONGEST.format(s=STREET, f="length(t) > 2")),
    "bad_address_gate": ("raw_addresses", lambda: F.coalesce(~c("address").rlike(r"^\s*\d") | c("address").rlike(r"(?i)\b(portfolio|lease|mortgage)\b"), F.lit(True)), r"coalesce(NOT regexp_matches(address, '^\s*\d') OR regexp_matches(address, '\b(portfolio|lease|mortgage)\b', 'i'), true)"),
    "norm_contact_address": ("raw_addresses", lambda: N.norm_contact_address(c("address")), "nullif(trim(" + chain("upper(address)", [("[^A-Z0-9]+", " "), *[(rf"\b{k}\b", v) for k, v in {"SUITE": "STE", "FLOOR": "FL", "AVENUE": "AVE", "STREET": "ST", "ROAD": "RD", "BOULEVARD": "BLVD"}.items()]]) + "), '')"),
    "build_bbl": ("raw_fields", lambda: N.build_bbl(c("boro"), c("block"), c("lot")), "CASE WHEN boro BETWEEN 1 AND 5 AND length(CAST(block AS VARCHAR)) <= 5 AND length(CAST(lot AS VARCHAR)) <= 4 THEN concat(boro, lpad(CAST(block AS VARCHAR), 5, '0'), lpad(CAST(lot AS VARCHAR), 4, '0')) END"),
    "norm_phone": ("raw_fields", lambda: N.norm_phone(c("phone")), f"nullif({DIGITS}, '')"),
    "phone_e164": ("raw_fields", lambda: N.phone_e164(c("phone")), f"CASE WHEN length({DIGITS}) = 10 THEN concat('+1', {DIGITS}) WHEN length({DIGITS}) BETWEEN 8 AND 15 THEN concat('+', {DIGITS}) END"),
    "norm_email": ("raw_fields", lambda: N.norm_email(c("email")), "nullif(lower(trim(email)), '')"),
    "norm_website": ("raw_fields", lambda: N.norm_website(c("website")), r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(website)), '^https?://', ''), '^www\.', ''), '/+$', ''), '')"),
    "src_system_from_url": ("raw_fields", lambda: N.source_from_url(c("url")), SRC),
    "map_source_system": ("raw_fields", lambda: N.map_source_system(F.when(c("id") % 2 == 0, " Crexi ").otherwise("web"), c("url")), f"CASE WHEN id % 2 = 0 THEN 'crexi' ELSE {SRC} END"),
    "doc_id_from_url": ("raw_fields", lambda: N.doc_id_from_url(c("url")), DOC_URL),
    "doc_id_from_notes": ("raw_fields", lambda: N.doc_id_from_notes(c("notes")), DOC_NOTES),
    "party_provenance": ("raw_fields", lambda: N.party_provenance(c("notes"), c("url")), f"CASE WHEN {DOC_NOTES} IS NOT NULL THEN concat('acris|', {DOC_NOTES}, '|true') WHEN {DOC_URL} IS NOT NULL THEN concat('acris|', {DOC_URL}, '|true') ELSE concat({SRC}, '|', coalesce(url, ''), '|') END"),
    "slug_from_url": ("raw_fields", lambda: N.slug_from_url(c("url")), "regexp_replace(upper(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1)), '[^A-Z0-9]+', '-', 'g')"),
    "canonical_deal_url": ("raw_fields", lambda: N.canonical_deal_url(c("url")), r"CASE WHEN regexp_matches(url, '^https?://(www\.)?traded\.co/deals/[^/]+/') THEN concat(rtrim(regexp_replace(trim(url), '[?#].*$', ''), '/'), '/') END"),
    "asset_from_slug": ("raw_fields", lambda: C.asset_from_slug(c("url")), case("lower(regexp_extract(url, '/deals/[^/]+/([^/]+)/', 1))", C.SLUG_TYPES)),
    "parse_money": ("raw_fields", lambda: N.parse_money(c("money")), "TRY_CAST(regexp_replace(trim(money), '[$,]', '', 'g') AS DOUBLE)"),
    "parse_int_loose": ("raw_fields", lambda: N.parse_int_loose(F.regexp_replace("money", r"^\$|\.50$", "")), r"CAST(trunc(TRY_CAST(regexp_replace(trim(regexp_replace(money, '^\$|\.50$', '', 'g')), ',', '', 'g') AS DOUBLE)) AS INT)"),
    "iso_date_pad": ("raw_fields", lambda: N.iso_date_pad(c("day")), DAY),
    "parse_date_loose": ("raw_fields", lambda: N.parse_date_loose(c("day")), rf"CAST(coalesce(TRY_CAST({DAY} AS DATE), TRY_CAST(regexp_replace(trim(day), '^(\d{{2}})/(\d{{2}})/(\d{{4}})$', '\3-\1-\2') AS DATE)) AS VARCHAR)"),
    "upload_timestamp": ("raw_fields", lambda: N.upload_timestamp(c("day")), f"strftime(TRY_CAST({DAY} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"),
    "audit_hash": ("raw_fields", lambda: N.audit_hash(c("phone"), c("email"), c("url")), "md5(concat(coalesce(phone, ''), '|', coalesce(email, ''), '|', coalesce(url, ''), '|'))"),
    "append_note_once": ("raw_fields", lambda: N.append_note_once(c("notes"), F.lit("checked")), r"CASE WHEN contains(coalesce(notes, ''), 'checked') THEN notes ELSE regexp_replace(concat(coalesce(notes, ''), ' | ', 'checked'), '^[\s|]+|[\s|]+$', '', 'g') END"),
    "clamp_confidence": ("raw_fields", lambda: N.clamp_confidence(F.when(c("id") % 3 == 0, None).otherwise(c("id") - 300)), "CAST(least(100, greatest(0, coalesce(CASE WHEN id % 3 <> 0 THEN id - 300 END, 50))) AS INT)"),
    "choice_coerce": ("raw_fields", lambda: F.concat_ws("|", N.channel(F.when(c("id") % 2 == 0, " Email").otherwise("fax")), N.role(c("segment")), N.role(F.lit("Grantee"))), "concat_ws('|', CASE WHEN id % 2 = 0 THEN 'email' ELSE 'other' END, 'Other', 'Buyer')"),
    "address_title": ("properties", lambda: N.address_title(c("street_number"), c("p_name"), c("borough")), "concat(street_number, ' ', array_to_string(list_transform(string_split(p_name, ' '), lambda t: concat(upper(t[1]), lower(t[2:]))), ' '), ', ', borough, ', NY')"),
    "day_distance": ("deals", lambda: N.day_distance(c("sale_date"), c("created_on") - F.expr("interval 3 days")), "coalesce(abs(date_diff('day', CAST(created_on - INTERVAL 3 DAY AS DATE), sale_date)), 9999)"),
    "ppu_ppsf": ("deals", lambda: F.struct(N.per_unit(c("sale_price"), c("units")).alias("a"), N.per_unit(c("sale_price"), c("sqft")).alias("b")), ("CASE WHEN units > 0 THEN CAST((2 * CAST(round(sale_price * 100) AS BIGINT) + units) // (2 * units) AS DOUBLE) / 100 END", "CASE WHEN sqft > 0 THEN CAST((2 * CAST(round(sale_price * 100) AS BIGINT) + sqft) // (2 * sqft) AS DOUBLE) / 100 END")),
    "confidence_deed": ("deals", lambda: N.confidence_deed(F.when(c("deal_id") % 19 != 0, 1), F.when(c("deal_id") % 23 != 0, 1), c("bldg_class"), c("sqft")), "CAST(least(100, 40 + CASE WHEN deal_id % 19 <> 0 THEN 20 ELSE 0 END + CASE WHEN deal_id % 23 <> 0 THEN 15 ELSE 0 END + 15 + CASE WHEN sqft IS NOT NULL THEN 10 ELSE 0 END) AS INT)"),
    "confidence_listing": ("deals", lambda: N.confidence_listing(c("sale_price"), F.when(c("deal_id") % 19 != 0, 1), F.when(c("deal_id") % 23 != 0, 1), c("sale_date")), "CAST(20 + CASE WHEN sale_price IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN deal_id % 19 <> 0 THEN 20 ELSE 0 END + CASE WHEN deal_id % 23 <> 0 THEN 15 ELSE 0 END + CASE WHEN sale_date IS NOT NULL THEN 10 ELSE 0 END AS INT)"),
    "classify_asset": ("raw_geo", lambda: C.classify_asset(c("bldg_class"), c("doc_class"), c("units")), classify_sql(C.CLASS_TYPES)),
    "classify_asset_v2": ("raw_geo", lambda: C.classify_asset_v2(c("bldg_class"), c("doc_class"), c("units")), f"CASE WHEN bldg_class LIKE 'R%' AND bldg_class <> 'RG' AND doc_class = 'CC' THEN 'Commercial Condo' WHEN bldg_class = 'RG' AND doc_class = 'CC' THEN 'Commercial Condo' ELSE {classify_sql(C.CLASS_TYPES)} END"),
    "residential_gate": ("raw_geo", lambda: C.residential_gate(c("asset_type"), c("bldg_class")), f"CASE WHEN asset_type IN ({BANNED}) THEN 'banned_asset_type' WHEN regexp_matches(bldg_class, '^(A[0-9A-Z]?|B[0-9A-Z]?|RG)$') THEN 'one_two_family' WHEN regexp_matches(bldg_class, '^R[0-9A-Z]?$') THEN 'condo_unit' ELSE 'ok' END"),
    "residential_gate_sql": ("raw_geo", lambda: C.residential_gate_sql(c("bldg_class")), "coalesce(regexp_matches(bldg_class, '^(A|B|R|C0|C3|C6|C8|D0|D4|DC)'), false)"),
    "small_unit_flag": ("raw_geo", lambda: C.small_unit_flag(F.when(c("id") % 2 == 0, "traded").otherwise("acris"), c("bldg_class"), c("units"), c("asset_type")), "coalesce(id % 2 = 0 AND bldg_class IS NULL AND units <= 2 AND coalesce(asset_type, '') IN ('', 'Multifamily'), false)"),
    "borough_from_zip": ("raw_geo", lambda: C.borough_from_zip(c("zip")), ZIPB),
    "borough_from_text": ("raw_geo", lambda: C.borough_from_text(c("title")), boro_text("title")),
    "resolve_geo": ("raw_geo", lambda: C.resolve_geo(c("zip"), c("city"), c("submarket"), c("title"))["borough"], f"coalesce({boro_text('title')}, {boro_text('submarket')}, {ZIPB}, {CITYB})"),
    "borough_from_county_city": ("raw_geo", lambda: C.borough_from_county_city(c("county"), c("city")), f"coalesce({case('lower(trim(county))', C.COUNTIES)}, {CITYB}, CASE WHEN lower(trim(city)) = 'new york' THEN 'Manhattan' END)"),
    "canon_borough": ("raw_geo", lambda: C.canon_borough(c("city")), f"coalesce({CITYB}, city)"),
    "clean_sale_date": ("raw_geo", lambda: N.clean_sale_date(F.when(c("id") % 3 == 0, "6/3/2020"), c("title")), f"CASE WHEN id % 3 = 0 THEN '2020-06-03' WHEN {case(ex('lower(title)', FULL, 1), MONTH_NUMBERS)} IS NOT NULL THEN concat_ws('-', {ex('lower(title)', FULL, 3)}, {case(ex('lower(title)', FULL, 1), MONTH_NUMBERS)}, lpad({ex('lower(title)', FULL, 2)}, 2, '0')) WHEN {case(ex('lower(title)', SHORT, 1), MONTH_NUMBERS)} IS NOT NULL THEN concat_ws('-', {ex('lower(title)', SHORT, 2)}, {case(ex('lower(title)', SHORT, 1), MONTH_NUMBERS)}, '01') END"),
}
IDS = {"properties": "property_id", "deals": "deal_id"}


def _query(view: str, expr):
    key = IDS.get(view, "id")

    def run(spark, sf_dir):
        df = frame(spark, sf_dir, view).select(c(key).alias("id"), expr().alias("value"))
        if "struct" in df.schema["value"].dataType.typeName():
            return df.select("id", c("value.a").alias("value"), c("value.b").alias("value2"))
        return df

    return run


def _sql(view: str, expr) -> str:
    key = IDS.get(view, "id")
    if isinstance(expr, tuple):
        return with_views(f"SELECT {key} AS id, {expr[0]} AS value, {expr[1]} AS value2 FROM {view}")
    return with_views(f"SELECT {key} AS id, {expr} AS value FROM {view}")


def queries() -> dict:
    return {k: _query(v, e) for k, (v, e, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _sql(v, s) for k, (v, _, s) in FUNCTIONS.items()}

"""Domain tables over the given star schema.

Each view is one SELECT in the dialect that Spark and DuckDB share; {name} stands for a given table, and bare names for other views. `frame`
gives a view as a DataFrame, `with_views` puts the views a statement needs before it for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF, AS_OF_TOUCH = "2001-08-02 00:00:00", "2024-01-31 00:00:00"
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]

def made_name(key: str) -> str:
    """SQL for a firm's name of two words of seven letters that spread out from a number; names of different numbers share few trigrams."""
    word = lambda step, letters: f"translate(CAST(CAST({key} AS BIGINT) * {step} % 9000000 + 1000000 AS STRING), '0123456789', '{letters}')"
    return f"concat({word(2654435, 'bdfgklmnrs')}, ' ', {word(1618033, 'aeioutvpcz')})"


VIEWS = {
    "properties": """
SELECT p_partkey AS property_id,
  CASE p_partkey % 5 WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Brooklyn' WHEN 2 THEN 'Queens' WHEN 3 THEN 'Bronx' ELSE 'Staten Island' END AS borough,
  p_partkey % 400 + 1 AS street_number,
  concat(CAST(p_partkey % 400 + 1 AS STRING), ' ', p_name, ' Street, ', CASE p_partkey % 5 WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Brooklyn' WHEN 2 THEN 'Queens' WHEN 3 THEN 'Bronx' ELSE 'Staten Island' END, ', NY') AS address_raw,
  lower(concat(CAST(p_partkey % 400 + 1 AS STRING), ' ', p_name, ' st')) AS address_norm,
  p_name, p_brand AS market, p_type,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS units,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size * 450 END AS sqft,
  concat(CASE p_type WHEN 'ECONOMY' THEN 'C' WHEN 'SMALL' THEN 'K' WHEN 'MEDIUM' THEN 'O' WHEN 'PROMO' THEN 'S' WHEN 'STANDARD' THEN 'E' ELSE 'H' END, CAST(p_partkey % 10 AS STRING)) AS bldg_class,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(40.5 AS DOUBLE) + CAST(p_partkey % 400 AS DOUBLE) / 1000 END AS latitude,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(-74.2 AS DOUBLE) + CAST(p_partkey % 500 AS DOUBLE) / 1000 END AS longitude
FROM {part}""",
    "sides": "SELECT l_orderkey, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey FROM {lineitem} GROUP BY l_orderkey",
    "deals": """
SELECT o_orderkey AS deal_id, p.property_id, o_custkey, s.suppkey, p.borough, p.market, p.address_raw, p.address_norm, p.bldg_class,
  CASE p.p_type WHEN 'ECONOMY' THEN 'Multifamily' WHEN 'SMALL' THEN 'Retail' WHEN 'MEDIUM' THEN 'Office' WHEN 'PROMO' THEN 'Mixed-Use' WHEN 'STANDARD' THEN 'Industrial' ELSE 'Hotel' END AS asset_type,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS sale_price,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS sale_date,
  p.units, p.sqft,
  CASE o_orderkey % 4 WHEN 0 THEN 'acris' WHEN 1 THEN 'traded' WHEN 2 THEN 'crexi' ELSE 'other' END AS source_system,
  o_orderkey % 101 AS confidence,
  CASE WHEN o_orderstatus = 'P' THEN 'needs_review' ELSE 'ok' END AS parse_status,
  CAST(o_orderdate AS DATE) AS created_on, CAST(o_orderkey % 30 AS INT) AS update_lag
FROM {orders} o JOIN sides s ON o.o_orderkey = s.l_orderkey JOIN properties p ON p.property_id = s.partkey""",
    "entities": """
SELECT concat('C', CAST(c_custkey AS STRING)) AS entity_id, c_name AS display_name, upper(c_name) AS norm_name, c_custkey % 11 = 0 AS is_spv_suspect,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE concat(CAST(c_custkey AS STRING), ' Main St') END AS mailing_address, c_custkey AS entity_key FROM {customer}
UNION ALL
SELECT concat('S', CAST(s_suppkey AS STRING)), s_name, upper(s_name), s_suppkey % 11 = 0, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE concat(CAST(s_suppkey AS STRING), ' Main St') END, s_suppkey FROM {supplier}""",
    "entity_aliases": "SELECT concat('C', CAST(c_custkey AS STRING)) AS entity_id, concat(c_name, ' LLC') AS alias_raw, upper(concat(c_name, ' LLC')) AS alias_norm FROM {customer} WHERE c_nationkey < 8",
    "deal_parties": """
SELECT deal_id, concat('C', CAST(o_custkey AS STRING)) AS entity_id, 'buyer' AS role, source_system = 'acris' AS amount_gate_passed FROM deals WHERE deal_id % 19 <> 0
UNION ALL
SELECT deal_id, concat('S', CAST(suppkey AS STRING)), 'seller', source_system = 'acris' FROM deals WHERE deal_id % 23 <> 0""",
    "contacts": """
SELECT c_custkey AS contact_id, concat('C', CAST(c_custkey AS STRING)) AS entity_id,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('(212) 555-', CAST(1000 + c_custkey % 9000 AS STRING)) END AS phone,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('C', CAST(c_custkey AS STRING), '@Mail.Example.com') END AS email,
  CASE WHEN c_custkey % 4 = 0 THEN concat('https://www.c', CAST(c_custkey AS STRING), '.example.com/') ELSE NULL END AS website,
  c_custkey % 2 = 1 AS is_primary, 50 + c_custkey % 50 AS confidence, CASE WHEN c_custkey % 2 = 0 THEN 'csv' ELSE 'registry' END AS source
FROM {customer} WHERE c_acctbal >= 5000""",
    "interactions": """
SELECT event_id AS interaction_id, concat('C', CAST(user_id AS STRING)) AS entity_id, ts AS occurred_at,
  CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'email' WHEN 'signup' THEN 'meeting' WHEN 'purchase' THEN 'text' ELSE 'other' END AS channel, props AS notes FROM {events}""",
    "review_queue": """
SELECT o_orderkey AS review_id, 'deal' AS object_type, o_orderkey AS object_id, CASE o_orderkey % 3 WHEN 0 THEN 'field_conflict' WHEN 1 THEN 'party_conflict' ELSE 'small_units' END AS issue_class,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'medium' END AS severity, CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'resolved' END AS status, CAST(o_orderdate AS DATE) AS created_on
FROM {orders} WHERE o_orderstatus = 'P'""",
    "source_runs": """
SELECT CAST(ts AS DATE) AS started_on, event_type AS job, CASE WHEN count(*) % 5 = 0 THEN 'failed' WHEN count(*) % 7 = 0 THEN 'running' ELSE 'ok' END AS status, count(*) AS n FROM {events} GROUP BY CAST(ts AS DATE), event_type""",
    "uploads": "SELECT DISTINCT c_custkey % 7 AS upload_id, CASE c_custkey % 7 WHEN 0 THEN 'staged' WHEN 1 THEN 'resolving' WHEN 2 THEN 'failed' ELSE 'imported' END AS status FROM {customer}",
    "upload_rows": """
SELECT c_custkey % 7 AS upload_id, c_custkey AS row_num,
  CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat(c_name, ' LLC') ELSE replace(c_name, 'Customer', 'Custmer') END AS owner,
  CASE WHEN c_custkey % 40 = 0 THEN 'n/a' ELSE concat('(917) 555-', CAST(1000 + c_custkey % 9000 AS STRING)) END AS phone,
  CASE c_custkey % 3 WHEN 2 THEN 'review' ELSE 'imported' END AS status FROM {customer}""",
    "firms": f"""
SELECT entity_id, entity_key, display_name, upper(display_name) AS norm_name, is_spv_suspect, mailing_address
FROM (SELECT entity_id, entity_key, {made_name("CASE WHEN entity_id LIKE 'S%' THEN entity_key + 40009 ELSE entity_key END")} AS display_name, is_spv_suspect, mailing_address FROM entities) n""",
    "firm_aliases": f"SELECT entity_id, upper({made_name('entity_key + 777777')}) AS alias_norm FROM entities WHERE entity_id LIKE 'C%' AND entity_key % 5 = 0",
    "asked": f"""
SELECT a.row_num, a.upload_id,
  CASE a.row_num % 7 WHEN 0 THEN name WHEN 1 THEN CASE WHEN a.row_num % 5 = 0 THEN alias ELSE name END WHEN 2 THEN concat(substr(name, 1, 3), substr(name, 5))
  WHEN 3 THEN concat(substr(name, 1, 3), substr(name, 5, 6), substr(name, 12)) WHEN 4 THEN 'n/a' WHEN 5 THEN other ELSE concat(substr(name, 1, 9), substr(name, 11), 's') END AS owner,
  CASE WHEN a.row_num % 2 = 0 THEN p.address_norm ELSE concat(p.address_norm, 'reet') END AS address_norm, p.property_id, p.borough, CASE WHEN a.row_num % 3 = 0 THEN 'Retail' END AS asset
FROM (SELECT c_custkey AS row_num, c_custkey % 7 AS upload_id, {made_name('c_custkey')} AS name, {made_name('c_custkey + 777777')} AS alias, {made_name('c_custkey + 333333')} AS other FROM {{customer}}) a
LEFT JOIN (SELECT o_custkey, min(property_id) AS property_id FROM deals GROUP BY o_custkey) d ON d.o_custkey = a.row_num LEFT JOIN properties p ON p.property_id = d.property_id""",
    "deed_masters": """
SELECT deal_id AS document_id, sale_price * (95 + deal_id % 10) / 100 AS document_amt, sale_date AS deal_date, CAST(deal_id % 80 AS INT) - 40 AS day_shift, address_norm, borough, property_id, o_custkey, suppkey FROM deals""",
    "reports": """
SELECT deal_id AS ord, deal_id % 4000 AS doc, address_norm, borough, sale_price, sale_date, CASE WHEN deal_id % 29 = 0 THEN 'Condo' WHEN deal_id % 20 = 5 THEN 'Multifamily' ELSE asset_type END AS asset_type,
  CASE WHEN deal_id % 31 = 0 THEN 'A1' WHEN deal_id % 37 = 0 THEN 'R4' WHEN deal_id % 5 = 0 THEN NULL ELSE bldg_class END AS bldg_class, source_system, CASE WHEN deal_id % 20 = 5 THEN 2 ELSE units END AS units FROM deals WHERE created_on >= DATE '1999-01-01'
UNION ALL
SELECT deal_id + 10000000, (deal_id + 1) % 4000, address_norm, borough, sale_price, sale_date, asset_type, bldg_class, 'traded', units FROM deals WHERE created_on >= DATE '1999-01-01' AND deal_id % 3 = 0
UNION ALL
SELECT deal_id + 20000000, CASE WHEN deal_id % 4 = 0 THEN NULL ELSE (deal_id + 1) % 4000 END, address_norm, CASE WHEN deal_id % 10 = 0 THEN NULL ELSE borough END, coalesce(sale_price, 0) + 1, sale_date, asset_type, bldg_class, 'crexi', units FROM deals WHERE created_on >= DATE '1999-01-01' AND deal_id % 2 = 0
UNION ALL
SELECT deal_id + 30000000, (deal_id + 2) % 4000, address_norm, borough, coalesce(sale_price, 0) + 1, sale_date, asset_type, bldg_class, 'crexi', units FROM deals WHERE created_on >= DATE '1999-01-01' AND deal_id % 6 = 0""",
    "fetch_ledger": "SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'fetch_error:HTTP' ELSE 'ok' END AS disposition FROM {pages}",
    "exclusion_ledger": "SELECT DISTINCT address_norm AS addr_norm, coalesce(sale_price, 0) AS price, 'one_two_family' AS reason FROM deals WHERE confidence = 7",
    "raw_names": """
SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 0 THEN concat(c_name, ' L.L.C.') WHEN 1 THEN concat('  ', c_name, '   llc ') WHEN 2 THEN concat(c_name, ' Incorporated') WHEN 3 THEN 'N/A' WHEN 4 THEN ' not  disclosed ' WHEN 5 THEN '---'
  WHEN 6 THEN concat('Lincoln ', c_mktsegment, ' Corp') WHEN 7 THEN NULL WHEN 8 THEN '   ' WHEN 9 THEN concat(CAST(c_custkey % 400 + 1 AS STRING), ' small Owner LLC') WHEN 10 THEN concat('The ', c_name) ELSE concat(c_name, ' & Sons, Inc.') END AS name FROM {customer}""",
    "raw_addresses": """
SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat('0', CAST(p_partkey % 400 + 1 AS STRING), ' East 12th Street, New York, NY 10001') WHEN 1 THEN concat(CAST(p_partkey % 400 + 1 AS STRING), '-', CAST(p_partkey % 90 + 10 AS STRING), ' ', p_name, ' Boulevard Queens NY')
  WHEN 2 THEN concat(CAST(p_partkey % 400 + 1 AS STRING), ' W. ', p_name, ' Ave., #4, Brooklyn, NY') WHEN 3 THEN concat(p_name, ' Plaza') WHEN 4 THEN NULL WHEN 5 THEN concat(CAST(p_partkey % 400 + 1 AS STRING), ' North 3rd Road Kings County NY 11211-1234')
  WHEN 6 THEN 'Portfolio of 3 buildings' ELSE concat(CAST(p_partkey % 400 + 1 AS STRING), ' ', p_name, ' Street, Manhattan, NY') END AS address FROM {part}""",
    "raw_fields": """
SELECT c_custkey AS id,
  CASE c_custkey % 6 WHEN 0 THEN concat('(212) 555-', CAST(1000 + c_custkey % 9000 AS STRING)) WHEN 1 THEN concat('1-212-555-', CAST(1000 + c_custkey % 9000 AS STRING)) WHEN 2 THEN '+44 20 7946 0958' WHEN 3 THEN 'ext 12' WHEN 4 THEN NULL ELSE concat('212.555.', CAST(1000 + c_custkey % 9000 AS STRING), ' ') END AS phone,
  CASE c_custkey % 3 WHEN 0 THEN concat('  ', c_name, '@Example.COM ') WHEN 1 THEN '  ' ELSE NULL END AS email,
  CASE c_custkey % 4 WHEN 0 THEN 'https://www.Example.com//' WHEN 1 THEN 'HTTP://example.org/a/' WHEN 2 THEN 'www.example.net' ELSE NULL END AS website,
  CASE c_custkey % 5 WHEN 0 THEN concat('$', CAST(c_custkey * 7 AS STRING), ',500.50') WHEN 1 THEN 'N/A' WHEN 2 THEN ' 1200.0 ' WHEN 3 THEN NULL ELSE CAST(c_custkey AS STRING) END AS money,
  CASE c_custkey % 7 WHEN 0 THEN '2024-6-8' WHEN 1 THEN '2024-13-01' WHEN 2 THEN '06/30/2023' WHEN 3 THEN 'unknown' WHEN 4 THEN NULL WHEN 5 THEN '2022-01-31T10:00:00' ELSE concat('2021-', CAST(c_custkey % 12 + 1 AS STRING), '-', CAST(c_custkey % 28 + 1 AS STRING)) END AS day,
  CASE c_custkey % 5 WHEN 0 THEN concat('https://a836-acris.nyc.gov/DS?doc_id=FT', CAST(c_custkey AS STRING), '&x=1') WHEN 1 THEN concat('https://traded.co/deals/new-york/', CASE c_custkey % 3 WHEN 0 THEN 'multifamily' WHEN 1 THEN 'land' ELSE 'castle' END, '/sale/', CAST(c_custkey AS STRING), '-main-st/?ref=1') WHEN 2 THEN 'https://www.crexi.com/properties/9' WHEN 3 THEN NULL ELSE 'https://news.example.com/x/' END AS url,
  CASE c_custkey % 4 WHEN 0 THEN concat('x | parties from ACRIS FT', CAST(c_custkey AS STRING), ' (amount within 3%)') WHEN 1 THEN 'checked' WHEN 2 THEN NULL ELSE '' END AS notes,
  c_custkey % 6 AS boro, c_custkey % 99999 AS block, c_custkey % 12000 AS lot, c_mktsegment AS segment, c_acctbal AS amount, c_name AS name
FROM {customer}""",
    "raw_geo": """
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '11201' WHEN 1 THEN '10453-1' WHEN 2 THEN '11004' WHEN 3 THEN '90210' WHEN 4 THEN NULL ELSE ' 10301' END AS zip,
  CASE p_partkey % 4 WHEN 0 THEN 'Brooklyn' WHEN 1 THEN 'queens ' WHEN 2 THEN 'Albany' ELSE NULL END AS city,
  CASE p_partkey % 7 WHEN 0 THEN 'Bushwick' WHEN 1 THEN 'East Village' WHEN 2 THEN 'Riverdale Bronx' WHEN 3 THEN '' ELSE NULL END AS submarket,
  CASE p_partkey % 9 WHEN 0 THEN 'Sold in Astoria, March 5th, 2021' WHEN 1 THEN 'Queens retail trade Jan. 2020' WHEN 2 THEN 'Harlem and Staten Island package' ELSE p_name END AS title,
  CASE p_partkey % 5 WHEN 0 THEN 'Kings' WHEN 1 THEN 'new york' WHEN 2 THEN 'Nassau' ELSE NULL END AS county, p_size AS units,
  CASE p_partkey % 14 WHEN 0 THEN 'A1' WHEN 1 THEN 'RG' WHEN 2 THEN 'R4' WHEN 3 THEN 'C0' WHEN 4 THEN 'C1' WHEN 5 THEN 'D4' WHEN 6 THEN 'O5' WHEN 7 THEN 'S1' WHEN 8 THEN NULL WHEN 9 THEN 'V1' WHEN 10 THEN 'K4' WHEN 11 THEN 'B2' WHEN 12 THEN 'R' ELSE 'E9' END AS bldg_class,
  CASE p_partkey % 10 WHEN 0 THEN 'CR' WHEN 1 THEN 'CC' WHEN 2 THEN 'D1' WHEN 3 THEN 'VL' WHEN 4 THEN NULL WHEN 5 THEN 'ZZ' ELSE 'F4' END AS doc_class,
  CASE p_partkey % 6 WHEN 0 THEN 'Condo' WHEN 1 THEN 'Co-op' WHEN 2 THEN NULL ELSE 'Multifamily' END AS asset_type
FROM {part}""",
}


def needed(sql: str) -> list[str]:
    """The views that sql reads, each after those that it reads itself."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views it reads before it."""
    names = needed(sql)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if names:
        body = sql.strip()
        sql = f"WITH {'RECURSIVE ' if 'USING KEY' in body else ''}{head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
    return re.sub(r"\{([a-z_]+)\}", r"\1", sql)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = f"SELECT * FROM {name}"
    names = needed(text)
    sql = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + f" {text}"
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)

"""Queries over landed documents: JSON inside pages, sitemaps, uploaded files with headers of their own, listings, and contacts and questions as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import normalize as N
from parcelflow.operators import extract as E
from parcelflow.operators import merge as G
from parcelflow.operators import nested as J
from parcelflow.plans.views import frame, with_views
from parcelflow.sources import landing
from parcelflow.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = lambda n: F.col(n)


def query(*views: str, sql: str):
    """Registers a function of (spark, views...)."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, *[frame(spark, sf_dir, v) for v in views])
        SQL[f.__name__] = with_views(sql)
        return f

    return register


# JSON in pages --------------------------------------------------------------------------------------------------------


def _deal_pages(deals):
    """A page for each deal, with its data in a script element: at depths 1 to 6 below objects and arrays, in the listed place or in the single one; some pages have a decoy, broken JSON, or none.
    Keys come in either order."""
    n = c("deal_id")
    price, address = c("sale_price"), F.array(F.struct(c("address_raw").alias("displayAddress")))
    one = F.to_json(F.struct(price.alias("salePrice"), address.alias("properties")), {"ignoreNullFields": "false"})
    turned = F.to_json(F.struct(address.alias("properties"), F.lit("2001-01-01").alias("closingDate"), price.alias("salePrice")), {"ignoreNullFields": "false"})
    node = F.when(n % 2 == 0, one).otherwise(turned)
    decoy = F.lit('{"salePrice": 1, "properties": {"0": "no list"}}')
    depth = (n % 6 + 1).cast("int")
    deep = F.concat(F.repeat(F.lit('{"a": [1, null], "y": '), depth - 1), F.lit('{"x": '), decoy, F.lit(', "n": ['), node, F.lit("]}"), F.repeat(F.lit("}"), depth - 1))
    listed = F.concat(F.lit('{"props": {"pageProps": {"initialValues": {"dealsWithCount": {"deals": ['), decoy, F.lit(", "), node, F.lit(", "), node, F.lit(']}}, "deal": '), node, F.lit("}}}"))
    single = F.concat(F.lit('{"other": '), node, F.lit(', "props": {"pageProps": {"deal": '), node, F.lit("}}}"))
    body = F.when(n % 11 == 0, listed).when(n % 11 == 1, single).when(n % 13 == 0, F.lit('{"broken": ')).otherwise(deep)
    html = F.concat(F.lit("<html><head><script>track(1);</script>"), F.when(n % 17 == 0, "").otherwise(F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script>"))), F.lit("</head><body></body></html>"))
    return deals.select("deal_id", html.alias("html"))


HAS = "deal_id % 17 <> 0 AND (deal_id % 11 IN (0, 1) OR deal_id % 13 <> 0)"


@query("deals", sql=f"SELECT deal_id, CASE WHEN NOT ({HAS}) THEN 'none' WHEN deal_id % 11 = 0 THEN 'props' WHEN deal_id % 11 = 1 THEN 'other' WHEN deal_id % 6 = 0 THEN 'n' ELSE 'a' END AS first_key FROM deals")
def extract_embedded_json(spark, deals):
    """The first key, by name, of the object in each page's script, or none."""
    doc = J.embedded_json(c("html"))
    keys = F.array_sort(F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>")))
    return _deal_pages(deals).select("deal_id", F.coalesce(F.get(keys, F.lit(0)), F.lit("none")).alias("first_key"))


@query("deals", sql=f"SELECT deal_id, unnest(CASE WHEN deal_id % 11 = 0 THEN [1, 2] ELSE [0] END) AS nth, CASE WHEN deal_id % 11 IN (0, 1) THEN 1 ELSE deal_id % 6 + 2 END AS depth, sale_price AS price, address_raw AS address FROM deals WHERE {HAS}")
def find_deal_nodes(spark, deals):
    """Every deal of every page, where it was found, its price and address."""
    found = J.deal_nodes(_deal_pages(deals).select("deal_id", J.embedded_json(c("html")).alias("doc")), "deal_id")
    nth = F.when(c("deal_id") % 11 == 0, c("path")[0]).otherwise(0)
    return found.select("deal_id", nth.cast("int").alias("nth"), F.size("path").cast("bigint").alias("depth"), F.try_variant_get("node", "$.salePrice", "double").alias("price"), F.try_variant_get("node", "$.properties[0].displayAddress", "string").alias("address"))


# Sitemaps -------------------------------------------------------------------------------------------------------------

DEAL_URL = "concat('https://traded.co/deals/new-york/', CASE WHEN deal_id % 5 = 0 THEN 'retail/lease/' ELSE 'retail/sale/' END, CAST(deal_id AS STRING), '-main-st')"
SITEMAP = f"SELECT {DEAL_URL} AS loc, CAST(created_on AS STRING) AS lastmod, deal_id % 4 AS sub FROM deals UNION ALL SELECT concat({DEAL_URL}, '/'), CAST(created_on + INTERVAL 9 DAY AS STRING), (deal_id + 1) % 4 FROM deals WHERE deal_id % 3 = 0"


@query("deals", sql=f"SELECT concat(rtrim(loc, '/'), '/') AS url, max(substr(CAST(lastmod AS VARCHAR), 1, 10)) AS lastmod FROM ({SITEMAP}) WHERE sub <> 3 AND contains(loc, '/sale/') GROUP BY 1")
def extract_sitemap_urls(spark, deals):
    """Sitemap files of many entries and the index that names them (but one) are landed as XML; each sale URL of a named file once, with its latest date."""
    path = landing.folder(spark, "sitemaps")
    entries = spark.sql(f"SELECT loc, substr(lastmod, 1, 10) AS lastmod, sub FROM ({SITEMAP}) s".replace("FROM deals", "FROM {deals}"), deals=deals)
    entries.write.partitionBy("sub").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(f"{path}/files")
    spark.sql("SELECT concat('https://traded.co/sub=', id, '.xml') AS loc FROM range(3)").write.format("xml").option("rootTag", "sitemapindex").option("rowTag", "sitemap").save(f"{path}/index")
    return T.sitemap_urls(spark, f"{path}/index", f"{path}/files", r"(?i)^https://traded\.co/deals/new-york/[a-z-]+/sale/[^<]+$")


# Uploads --------------------------------------------------------------------------------------------------------------

#: Header rows as people write them; what each upload's three columns and a row number are called.
HEADERS = [("Owner", "Phone", "Notes"), ("Company Name", "Work Phone", "Comments"), ("landlord", "Tel", "remarks"), ("Contact Name", "Mobile", "Zip"), ("Entity", "Phone Number", "when last-contacted"), ("Buyer", "Cell", "Via"), ("Borrower LLC", "telephone no", "Owner")]
#: Header, field and score by the synonyms: an exact one 3, a phrase 2, a token 1. In the last upload the exact Owner beats Borrower LLC.
MAPPED = "(VALUES (0, 0, 'Owner', 'entity_name', 3), (0, 1, 'Phone', 'phone', 3), (0, 2, 'Notes', 'interaction_notes', 3), (1, 0, 'Company Name', 'entity_name', 1), (1, 1, 'Work Phone', 'phone', 1), (1, 2, 'Comments', 'interaction_notes', 3), (2, 0, 'landlord', 'entity_name', 3), (2, 1, 'Tel', 'phone', 3), (2, 2, 'remarks', 'interaction_notes', 3), (3, 0, 'Contact Name', 'person_name', 3), (3, 1, 'Mobile', 'phone', 3), (4, 0, 'Entity', 'entity_name', 3), (4, 1, 'Phone Number', 'phone', 3), (4, 2, 'when last-contacted', 'last_contact_date', 2), (5, 0, 'Buyer', 'entity_name', 3), (5, 1, 'Cell', 'phone', 3), (5, 2, 'Via', 'channel', 3), (6, 1, 'telephone no', 'phone', 1), (6, 2, 'Owner', 'entity_name', 3)) m(upload_id, pos, name, field, score)"


def _uploaded(spark, rows):
    """Each upload's rows land as CSV files with that upload's header row, and are read as cells."""
    path = landing.folder(spark, "uploads")
    text = lambda n: c(n).cast("string")
    for u, names in enumerate(HEADERS):
        rows.filter(c("upload_id") == u).select(c("owner").alias(names[0]), c("phone").alias(names[1]), text("status").alias(names[2]), text("row_num").alias("Nr")).write.option("header", True).option("escape", '"').csv(f"{path}/upload-{u}")
    cells = T.csv_cells(spark, f"{path}/upload-*")
    return cells.withColumn("upload_id", F.regexp_extract("file", r"/upload-(\d+)/", 1).cast("int"))


def _columns(cells):
    headers = cells.filter("is_header").select("file", "upload_id", F.posexplode("values").alias("pos", "name")).filter("name IS NOT NULL")
    return headers


def _mapped(cells):
    return J.mapped_rows(cells.filter("NOT is_header"), J.assigned(_columns(cells)))


@query("upload_rows", sql=f"SELECT CAST(upload_id AS INTEGER) AS upload_id, CAST(row_num AS BIGINT) AS row_num, 4 AS n_cells, owner AS first_cell FROM upload_rows")
def scan_upload_rows(spark, rows):
    staged = _uploaded(spark, rows).filter("NOT is_header")
    return staged.select("upload_id", c("values")[3].cast("bigint").alias("row_num"), F.size(F.array_compact("values")).alias("n_cells"), c("values")[0].alias("first_cell"))


@query("upload_rows", sql="SELECT CAST(upload_id AS INTEGER) AS upload_id, CAST(row_num AS BIGINT) AS row_num, CASE upload_id WHEN 3 THEN NULL WHEN 6 THEN status ELSE owner END AS entity_name, CASE upload_id WHEN 3 THEN owner END AS person_name, phone, CASE WHEN upload_id IN (0, 1, 2) THEN status END AS notes FROM upload_rows")
def upload_value(spark, rows):
    """Rows by fields: whatever a file calls its columns, each is taken by the field that its header speaks for."""
    m = lambda f: F.try_element_at("mapped", F.lit(f))
    got = _mapped(_uploaded(spark, rows))
    return got.select("upload_id", c("values")[3].cast("bigint").alias("row_num"), m("entity_name").alias("entity_name"), m("person_name").alias("person_name"), m("phone").alias("phone"), m("interaction_notes").alias("notes"))


def _per_upload(cells, exact: bool):
    names = _columns(cells).select(c("upload_id").alias("file"), "pos", "name").distinct()  # parts of an upload have one header
    return J.assigned(names, exact).select(c("file").alias("upload_id"), "name", "field", "score")


@query("upload_rows", sql=f"SELECT m.upload_id, name, field, score FROM {MAPPED} WHERE upload_id IN (SELECT upload_id FROM upload_rows)")
def sniff_mapping(spark, rows):
    """Headers to fields one to one, by score."""
    return _per_upload(_uploaded(spark, rows), False)


@query("upload_rows", sql=f"SELECT m.upload_id, name, field, score FROM {MAPPED} WHERE upload_id IN (SELECT upload_id FROM upload_rows) AND score = 3")
def sniff_mapping_exact(spark, rows):
    return _per_upload(_uploaded(spark, rows), True)


# Listings, contacts, questions ----------------------------------------------------------------------------------------


@query("contacts", sql="WITH a AS (SELECT contact_id, concat('Agent ', contact_id % 40) AS name, concat('Firm ', contact_id % 7) AS company, phone, contact_id % 3 AS nth FROM contacts) SELECT name, company, min(phone) AS phone FROM a GROUP BY 1, 2")
def listing_agents_explode(spark, contacts):
    """Listings with nested agents land as JSON; each agent and company once. Phones are compared by place in the list, then by number."""
    path = landing.folder(spark, "listings")
    n = c("contact_id")
    agent = F.struct(F.concat(F.lit(" Agent "), (n % 40).cast("string")).alias("full_name"), "phone", F.struct(F.concat(F.lit("Firm "), (n % 7).cast("string"), F.lit(" ")).alias("name")).alias("brokerage"))
    blank = F.struct(F.lit("  ").alias("full_name"), F.lit("1").alias("phone"), F.struct(F.lit("x").alias("name")).alias("brokerage"))
    contacts.select(F.struct(n.cast("string").alias("listing_id")).alias("listing"), F.struct(F.array(agent, blank).alias("agents")).alias("relationships")).write.json(path)
    return T.listing_agents(T.listings_json(spark, path))


COPIES = """SELECT contact_id * 3 + k AS contact_id, entity_id, CASE WHEN contact_id % 5 = 0 AND k = 1 THEN 'Owner' ELSE 'Buyer' END AS role,
  CASE k WHEN 1 THEN replace(phone, '-', '.') ELSE phone END AS phone, CASE k WHEN 1 THEN concat(' ', upper(email)) ELSE email END AS email,
  CASE k WHEN 2 THEN replace(website, 'https://www.', 'http://') ELSE website END AS website, CASE k WHEN 1 THEN concat(CAST(contact_id AS STRING), ' Main Street') WHEN 2 THEN concat(CAST(contact_id AS STRING), ' main st.') END AS mailing_address,
  is_primary AND k = 2 AS is_primary, contact_id % 7 + k AS created FROM contacts, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) n"""
SAME = r"entity_id, role, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), coalesce(nullif(lower(trim(email)), ''), ''), coalesce(regexp_replace(regexp_replace(regexp_replace(lower(trim(website)), '^https?://', ''), '^www\.', ''), '/+$', ''), ''), coalesce(trim(regexp_replace(regexp_replace(upper(mailing_address), '[^A-Z0-9]+', ' ', 'g'), '\bSTREET\b', 'ST')), '')"
RANK = "is_primary DESC, (phone IS NOT NULL)::INT * 4 + (email IS NOT NULL)::INT * 4 + (website IS NOT NULL)::INT * 2 + (mailing_address IS NOT NULL)::INT DESC, created, contact_id"


@query("contacts", sql=f"SELECT entity_id, keep_id, count(*) - 1 AS removed FROM (SELECT *, first_value(contact_id) OVER (PARTITION BY {SAME} ORDER BY {RANK}) AS keep_id FROM ({COPIES}) d) e GROUP BY 1, 2")
def contact_dedupe(spark, contacts):
    """Contacts written in three ways: of those that are the same once their four fields are normalised, the primary one, the fullest, the oldest stays."""
    copies = spark.sql(COPIES.replace("FROM contacts", "FROM {contacts}"), contacts=contacts)
    return G.dedupe_contacts(copies)


PRICE = r"(?i)\$?([0-9]+(?:\.[0-9]+)?)\s*(billion|bn|b|million|mm|m|thousand|k)?\b"
NUMBER, UNIT = (rf"regexp_extract(text, '\$?([0-9]+(\.[0-9]+)?)\s*(billion|bn|b|million|mm|m|thousand|k)?\b', {g}, 'i')" for g in (1, 3))
CRITERIA = f"""SELECT conv_id, turn, CASE WHEN lower({UNIT}) IN ('billion', 'bn', 'b') THEN TRY_CAST({NUMBER} AS DOUBLE) * 1e9 WHEN lower({UNIT}) IN ('million', 'mm', 'm') THEN TRY_CAST({NUMBER} AS DOUBLE) * 1e6 WHEN lower({UNIT}) IN ('thousand', 'k') THEN TRY_CAST({NUMBER} AS DOUBLE) * 1e3 WHEN TRY_CAST({NUMBER} AS DOUBLE) >= 100000 THEN TRY_CAST({NUMBER} AS DOUBLE) END AS price,
  TRY_CAST(nullif(regexp_extract(text, '(last|past)\\s+([0-9]+)\\s+days?', 2, 'i'), '') AS INTEGER) AS days,
  array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3 AND NOT list_contains({E.SKIPPED!r}, w))), lambda w: [lpad(CAST(list_position(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), w) AS VARCHAR), 9, '0'), w]))[1:6], lambda x: x[2]), ' ') AS keywords
  FROM (SELECT conv_id, turn, concat(text, CASE (conv_id + turn) % 4 WHEN 0 THEN concat(' for $', CAST(conv_id + 1 AS VARCHAR), ' million in the last 30 days') WHEN 1 THEN concat(' over ', CAST(99000 + conv_id * 10 AS VARCHAR)) ELSE '' END) AS text FROM {{conversations}} WHERE role = 'user')"""


@query("conversations", sql=CRITERIA)
def question_criteria(spark, conversations):
    """Price, days and keywords of every question, its own text included; half of the questions are given an amount."""
    n = c("conv_id")
    more = F.when((n + c("turn")) % 4 == 0, F.concat(F.lit(" for $"), (n + 1).cast("string"), F.lit(" million in the last 30 days"))).when((n + c("turn")) % 4 == 1, F.concat(F.lit(" over "), (n * 10 + 99000).cast("string"))).otherwise("")
    asked = conversations.filter("role = 'user'").select("conv_id", "turn", F.concat("text", more).alias("text"))
    return asked.select("conv_id", "turn", E.question_price(c("text")).alias("price"), E.question_days(c("text")).alias("days"), F.array_join(E.question_keywords(c("text")), " ").alias("keywords"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

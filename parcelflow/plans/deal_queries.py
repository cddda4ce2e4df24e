"""The read surface: filters, joins, aggregates, windows, rankings and audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.operators import relational as R
from parcelflow.plans.views import AS_OF, AS_OF_TOUCH, frame, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = lambda n: F.col(n)


def query(*views: str, sql: str | None = None, also: tuple[str, ...] = ()):
    """Registers a function of the named views under its own name, and names that ask for the same rows."""

    def register(f):
        def run(spark, sf_dir):
            return f(*[frame(spark, sf_dir, v) for v in views])

        for name in (f.__name__, *also):
            QUERIES[name] = run
            if sql:
                SQL[name] = with_views(sql)
        return f

    return register


ROLLUP = """SELECT e.entity_id, e.display_name, e.is_spv_suspect, count(DISTINCT p.deal_id) AS n_deals, round(coalesce(sum(sale_price), 0), 2) AS volume, min(sale_price) AS min_price, max(sale_price) AS max_price,
 CAST(min(sale_date) AS VARCHAR) AS first_date, CAST(max(sale_date) AS VARCHAR) AS last_date, array_to_string(list_sort(list(DISTINCT asset_type)), ',') AS asset_types, array_to_string(list_sort(list(DISTINCT borough)), ',') AS boroughs
 FROM deal_parties p JOIN deals d ON p.deal_id = d.deal_id JOIN entities e ON p.entity_id = e.entity_id WHERE role = '{role}' GROUP BY e.entity_id, e.display_name, e.is_spv_suspect"""
FIRST = "first_p AS (SELECT deal_id, min(CASE WHEN role = 'buyer' THEN entity_id END) AS buyer_id, min(CASE WHEN role = 'seller' THEN entity_id END) AS seller_id FROM deal_parties GROUP BY deal_id), full_d AS (SELECT d.*, f.buyer_id, f.seller_id, b.display_name AS buyer, s.display_name AS seller FROM deals d LEFT JOIN first_p f ON d.deal_id = f.deal_id LEFT JOIN entities b ON f.buyer_id = b.entity_id LEFT JOIN entities s ON f.seller_id = s.entity_id)"
SHOWN = ["deal_id", "address_raw", "borough", "asset_type", "sale_price", "buyer", "seller"]
SHOWN_SQL = ", ".join(SHOWN) + ", CAST(sale_date AS VARCHAR) AS sale_date"


def shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN, c("sale_date").cast("string").alias("sale_date"))


# Filters ------------------------------------------------------------------------------------------------------------

CRITERIA = dict(q="ring", borough="Brooklyn", sale_price_min=100000.0, sqft_max=20000, confidence_min=10, has_buyer=True)
FILTERED = "(address_raw ILIKE '%ring%' OR buyer ILIKE '%ring%' OR seller ILIKE '%ring%') AND borough = 'Brooklyn' AND sale_price >= 100000 AND sqft <= 20000 AND confidence >= 10 AND buyer IS NOT NULL"


@query("deals", "deal_parties", "entities", sql=f"WITH {FIRST} SELECT {SHOWN_SQL} FROM full_d WHERE {FILTERED}")
def filter_deals_16(deals, parties, entities):
    return shown(R.filter_deals(R.with_parties(deals, parties, entities), **CRITERIA))


@query("deals", "deal_parties", "entities", sql=f"WITH {FIRST} SELECT {SHOWN_SQL} FROM full_d WHERE address_raw ILIKE '%1_ small%' OR buyer ILIKE '%1_ small%' OR seller ILIKE '%1_ small%'")
def text_search_ilike(deals, parties, entities):
    return shown(R.filter_deals(R.with_parties(deals, parties, entities), q="1_ small"))


DEEDS = "SELECT m.document_id, m.document_amt, d.sale_price, coalesce(abs(date_diff('day', CAST(m.deal_date + m.day_shift * INTERVAL 1 DAY AS DATE), d.sale_date)), 9999) AS days FROM deed_masters m JOIN deals d ON d.deal_id = m.document_id"


def _deeds(masters, deals):
    days = F.coalesce(F.abs(F.datediff(F.date_add("deal_date", c("day_shift")), "sale_date")), F.lit(9999))
    return masters.join(deals.select(c("deal_id").alias("document_id"), "sale_price", "sale_date"), "document_id").select("document_id", "document_amt", "sale_price", days.alias("days"))


@query("deed_masters", "deals", sql=f"SELECT document_id, CASE WHEN coalesce(sale_price > 0, false) THEN coalesce(document_amt > 0 AND abs(document_amt - sale_price) <= sale_price * 0.03, false) ELSE coalesce(days <= 60, false) END AS passed FROM ({DEEDS})")
def amount_gate(masters, deals):
    return _deeds(masters, deals).select("document_id", R.amount_gate(c("document_amt"), c("sale_price"), c("days")).alias("passed"))


@query("deed_masters", "deals", sql=f"SELECT document_id, coalesce(document_amt > 0 AND sale_price > 0 AND abs(document_amt - sale_price) <= sale_price * 0.03, false) AS passed FROM ({DEEDS})")
def amount_gate_sync(masters, deals):
    return _deeds(masters, deals).select("document_id", R.amount_gate_sync(c("document_amt"), c("sale_price")).alias("passed"))


@query("deals", "exclusion_ledger", sql="SELECT deal_id FROM deals d WHERE NOT EXISTS (SELECT 1 FROM exclusion_ledger x WHERE x.addr_norm = d.address_norm AND x.price = coalesce(d.sale_price, 0))")
def exclusion_gate(deals, ledger):
    keyed = deals.select("deal_id", c("address_norm").alias("addr_norm"), F.coalesce("sale_price", F.lit(0.0)).alias("price"))
    return keyed.join(ledger, ["addr_norm", "price"], "left_anti").select("deal_id")


@query("deed_masters", sql="SELECT document_id, document_amt FROM deed_masters WHERE document_amt >= 250000")
def price_floor(masters):
    return masters.filter("document_amt >= 250000").select("document_id", "document_amt")


@query("deals", sql="SELECT deal_id, borough FROM (SELECT deal_id, CASE WHEN deal_id % 10 = 0 THEN 'Yonkers' WHEN deal_id % 10 = 1 THEN NULL ELSE borough END AS borough FROM deals) WHERE borough IS NULL OR borough IN ('Manhattan', 'Brooklyn', 'Queens', 'Bronx', 'Staten Island')")
def nyc_filter(deals):
    df = deals.select("deal_id", F.when(c("deal_id") % 10 == 0, "Yonkers").when(c("deal_id") % 10 == 1, None).otherwise(c("borough")).alias("borough"))
    return df.filter(c("borough").isNull() | c("borough").isin("Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"))


@query("deals", sql="SELECT count(*) AS n, count(*) FILTER (WHERE sale_price IS NULL AND sale_date IS NULL AND units IS NULL) AS factless FROM deals")
def factless_filter(deals):
    return deals.agg(F.count(F.lit(1)).alias("n"), F.count_if(c("sale_price").isNull() & c("sale_date").isNull() & c("units").isNull()).alias("factless"))


@query("deals", sql="SELECT deal_id FROM deals WHERE source_system = 'crexi' AND asset_type NOT IN ('Hotel') AND borough <> 'Bronx'")
def listing_scope(deals):
    return deals.filter((c("source_system") == "crexi") & ~c("asset_type").isin("Hotel") & (c("borough") != "Bronx")).select("deal_id")


@query("raw_names", sql=r"SELECT id, name FROM raw_names WHERE NOT regexp_matches(name, '\b(lincoln|sons)\b', 'i')")
def agent_mill_filter(names):
    return names.filter(~c("name").rlike(r"(?i)\b(lincoln|sons)\b")).select("id", "name")


@query("raw_names", sql=r"SELECT id, name FROM raw_names WHERE regexp_matches(name, '\b(llc|inc|incorporated|corp|corporation|lp|trust|group|realty|holdings|partners|associates)\b', 'i')")
def company_like_filter(names):
    return names.filter(c("name").rlike(r"(?i)\b(llc|inc|incorporated|corp|corporation|lp|trust|group|realty|holdings|partners|associates)\b")).select("id", "name")


# Joins --------------------------------------------------------------------------------------------------------------


@query("deal_parties", "entities", "deals", "properties", sql="SELECT p.deal_id, p.role, e.display_name, d.asset_type, r.address_raw FROM deal_parties p JOIN entities e ON p.entity_id = e.entity_id JOIN deals d ON d.deal_id = p.deal_id JOIN properties r ON r.property_id = d.property_id")
def join_star_inner(parties, entities, deals, properties):
    return R.star(parties, entities, deals.drop("address_raw")).join(properties.select("property_id", "address_raw"), "property_id").select("deal_id", "role", "display_name", "asset_type", "address_raw")


@query("deals", "deal_parties", "entities", sql=f"WITH {FIRST} SELECT deal_id, buyer, seller FROM full_d")
def join_lateral_first(deals, parties, entities):
    return R.with_parties(deals, parties, entities).select("deal_id", "buyer", "seller")


@query("entities", "contacts", sql="SELECT entity_id, EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = e.entity_id) AS has_contact FROM entities e")
def join_semi_exists(entities, contacts):
    held = contacts.select("entity_id").distinct().withColumn("has_contact", F.lit(True))
    return entities.join(held, "entity_id", "left").select("entity_id", F.coalesce("has_contact", F.lit(False)).alias("has_contact"))


@query("deal_parties", "contacts", sql="SELECT DISTINCT entity_id FROM deal_parties p WHERE role = 'buyer' AND NOT EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = p.entity_id)")
def join_anti_gap(parties, contacts):
    return parties.filter("role = 'buyer'").select("entity_id").distinct().join(contacts, "entity_id", "left_anti")


MISSING = "SELECT d.deal_id, max(CASE WHEN role = 'buyer' THEN 1 ELSE 0 END) = 0 AS no_buyer, max(CASE WHEN role = 'seller' THEN 1 ELSE 0 END) = 0 AS no_seller FROM deals d LEFT JOIN deal_parties p ON p.deal_id = d.deal_id GROUP BY d.deal_id HAVING no_buyer OR no_seller"


@query("deals", "deal_parties", sql=MISSING, also=("dq_missing_parties",))
def join_anti_party(deals, parties):
    roles = parties.groupBy("deal_id").agg(*[F.bool_or(c("role") == r).alias(r) for r in ("buyer", "seller")])
    flags = deals.select("deal_id").join(roles, "deal_id", "left").select("deal_id", ~F.coalesce("buyer", F.lit(False)), ~F.coalesce("seller", F.lit(False))).toDF("deal_id", "no_buyer", "no_seller")
    return flags.filter("no_buyer OR no_seller")


@query("deal_parties", "contacts", sql="WITH k AS (SELECT entity_id, count(*) AS n_contacts FROM contacts GROUP BY 1), b AS (SELECT entity_id, count(*) AS n_deals FROM deal_parties WHERE role = 'buyer' GROUP BY 1) SELECT b.entity_id, n_deals, coalesce(n_contacts, 0) AS n_contacts FROM b LEFT JOIN k ON b.entity_id = k.entity_id")
def join_left_counts(parties, contacts):
    buyers = parties.filter("role = 'buyer'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_deals"))
    return buyers.join(R.contact_flags(contacts), "entity_id", "left").select("entity_id", "n_deals", F.coalesce("n_contacts", F.lit(0)).alias("n_contacts"))


@query("entities", "interactions", "deal_parties", sql="SELECT entity_id, (SELECT strftime(max(occurred_at), '%Y-%m-%d') FROM interactions i WHERE i.entity_id = e.entity_id) AS last_touch, (SELECT count(*) FROM deal_parties p WHERE p.entity_id = e.entity_id) AS n_deals FROM entities e")
def join_correlated_scalar(entities, interactions, parties):
    last = interactions.groupBy("entity_id").agg(F.date_format(F.max("occurred_at"), "yyyy-MM-dd").alias("last_touch"))
    n = parties.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_deals"))
    return entities.select("entity_id").join(last, "entity_id", "left").join(n, "entity_id", "left").select("entity_id", "last_touch", F.coalesce("n_deals", F.lit(0)).alias("n_deals"))


@query("deals", "deed_masters", sql="SELECT d.deal_id, m.document_id FROM deals d JOIN deed_masters m ON m.address_norm = d.address_norm WHERE abs(m.document_amt - d.sale_price) <= d.sale_price * 0.03")
def join_theta_range(deals, masters):
    near = F.abs(c("document_amt") - c("sale_price")) <= c("sale_price") * 0.03
    return deals.select("deal_id", "address_norm", "sale_price").join(masters.select("document_id", "document_amt", "address_norm"), "address_norm").filter(near).select("deal_id", "document_id")


SPV = r"SELECT DISTINCT n.id FROM (SELECT id, regexp_extract(upper(name), '^(\d+)[\s\-]+([A-Z0-9]+)', 1) AS num, lower(regexp_extract(upper(name), '^(\d+)[\s\-]+([A-Z0-9]+)', 2)) AS tok FROM raw_names) n JOIN properties p ON CAST(p.street_number AS VARCHAR) = n.num AND starts_with(p.address_norm, concat(n.num, ' ', n.tok)) WHERE n.num <> ''"


@query("raw_names", "properties", sql=SPV, also=("spv_suspect",))
def join_theta_prefix(names, properties):
    pattern = r"^(\d+)[\s\-]+([A-Z0-9]+)"
    keyed = names.select("id", F.regexp_extract(F.upper("name"), pattern, 1).alias("num"), F.lower(F.regexp_extract(F.upper("name"), pattern, 2)).alias("tok")).filter("num <> ''").alias("n")
    held = properties.select(c("street_number").cast("string").alias("num"), "address_norm").alias("p")
    return keyed.join(held, (c("n.num") == c("p.num")) & c("p.address_norm").startswith(F.concat_ws(" ", "n.num", "n.tok")), "left_semi").select("id")


@query("deals", "properties", sql="SELECT d.deal_id, p.property_id FROM (SELECT deal_id, address_norm, CASE WHEN deal_id % 6 = 0 THEN NULL ELSE borough END AS b FROM deals) d JOIN (SELECT property_id, address_norm, CASE WHEN property_id % 6 = 0 THEN NULL ELSE borough END AS b FROM properties) p ON p.address_norm = d.address_norm AND p.b IS NOT DISTINCT FROM d.b")
def join_nullsafe_key(deals, properties):
    d = deals.select("deal_id", "address_norm", F.when(c("deal_id") % 6 != 0, c("borough")).alias("b")).alias("d")
    p = properties.select("property_id", "address_norm", F.when(c("property_id") % 6 != 0, c("borough")).alias("b")).alias("p")
    return d.join(p, (c("d.address_norm") == c("p.address_norm")) & c("d.b").eqNullSafe(c("p.b"))).select("deal_id", "property_id")


@query("contacts", "entities", sql="SELECT contact_id FROM (SELECT contact_id, CASE WHEN contact_id % 30 = 0 THEN 'X' ELSE entity_id END AS entity_id FROM contacts) k WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.entity_id = k.entity_id)")
def join_orphan_check(contacts, entities):
    return contacts.withColumn("entity_id", F.when(c("contact_id") % 30 == 0, "X").otherwise(c("entity_id"))).join(entities, "entity_id", "left_anti").select("contact_id")


# Aggregates ---------------------------------------------------------------------------------------------------------


@query("deals", sql="SELECT count(*) FILTER (WHERE sale_price IS NULL) AS no_price, count(*) FILTER (WHERE parse_status = 'needs_review') AS review, count(*) FILTER (WHERE confidence >= 60) AS sure FROM deals")
def agg_count_filter(deals):
    return deals.agg(F.count_if(c("sale_price").isNull()).alias("no_price"), F.count_if(c("parse_status") == "needs_review").alias("review"), F.count_if(c("confidence") >= 60).alias("sure"))


@query("deal_parties", sql="SELECT role, count(DISTINCT entity_id) AS entities, count(DISTINCT deal_id) AS deals FROM deal_parties GROUP BY role")
def agg_count_distinct(parties):
    return parties.groupBy("role").agg(F.countDistinct("entity_id").alias("entities"), F.countDistinct("deal_id").alias("deals"))


@query("deals", sql="SELECT borough, round(coalesce(sum(sale_price), 0), 2) AS volume FROM deals GROUP BY borough")
def agg_sum_coalesce(deals):
    return deals.groupBy("borough").agg(F.round(F.coalesce(F.sum("sale_price"), F.lit(0.0)), 2).alias("volume"))


@query("deals", sql="SELECT borough, round(sum(DISTINCT round(sale_price)), 2) AS volume FROM deals GROUP BY borough")
def agg_sum_distinct(deals):
    return deals.groupBy("borough").agg(F.round(F.sum_distinct(F.round("sale_price")), 2).alias("volume"))


@query("deals", sql="SELECT borough, asset_type, round(quantile_cont(sale_price, 0.5), 3) AS median FROM deals GROUP BY borough, asset_type")
def agg_median(deals):
    return R.exact_median(deals, ["borough", "asset_type"], "sale_price").withColumn("median", F.round("median", 3))


@query("deals", sql="SELECT borough, min(sale_price) AS low, max(sale_price) AS high, CAST(min(sale_date) AS VARCHAR) AS first_date, CAST(max(sale_date) AS VARCHAR) AS last_date FROM deals GROUP BY borough")
def agg_min_max(deals):
    return deals.groupBy("borough").agg(F.min("sale_price").alias("low"), F.max("sale_price").alias("high"), F.min("sale_date").cast("string").alias("first_date"), F.max("sale_date").cast("string").alias("last_date"))


@query("deals", sql="SELECT market, array_to_string(list_sort(list(DISTINCT asset_type)), ',') AS types FROM deals GROUP BY market")
def agg_array_distinct(deals):
    return deals.groupBy("market").agg(F.array_join(F.array_sort(F.collect_set("asset_type")), ",").alias("types"))


@query("contacts", sql="SELECT entity_id, bool_or(phone IS NOT NULL OR email IS NOT NULL) AS reachable FROM contacts GROUP BY entity_id")
def agg_bool_or(contacts):
    return R.contact_flags(contacts).select("entity_id", "reachable")


@query("deal_parties", sql="SELECT entity_id, count(*) AS n FROM deal_parties WHERE role = 'buyer' GROUP BY entity_id HAVING count(*) >= 3")
def agg_having(parties):
    return parties.filter("role = 'buyer'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("deal_parties", "deals", sql="SELECT p.entity_id, string_agg(concat(CAST(p.deal_id AS VARCHAR), ':', d.asset_type), ';' ORDER BY p.deal_id) AS deals FROM deal_parties p JOIN deals d ON p.deal_id = d.deal_id WHERE role = 'buyer' GROUP BY p.entity_id")
def agg_json_array(parties, deals):
    items = F.array_sort(F.collect_list(F.struct("deal_id", "asset_type")))
    joined = parties.filter("role = 'buyer'").join(deals, "deal_id")
    return joined.groupBy("entity_id").agg(F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["deal_id"].cast("string"), x["asset_type"])), ";").alias("deals"))


@query("deal_parties", "deals", sql="SELECT p.entity_id, sum(CASE WHEN asset_type = 'Retail' THEN 3 ELSE -2 END + CASE WHEN borough = 'Queens' THEN 2 ELSE -1 END) AS points FROM deal_parties p JOIN deals d ON p.deal_id = d.deal_id WHERE role = 'buyer' GROUP BY p.entity_id")
def agg_sum_case(parties, deals):
    points = F.when(c("asset_type") == "Retail", 3).otherwise(-2) + F.when(c("borough") == "Queens", 2).otherwise(-1)
    return parties.filter("role = 'buyer'").join(deals, "deal_id").groupBy("entity_id").agg(F.sum(points).alias("points"))


@query("deals", sql="SELECT address_norm, CASE WHEN count(DISTINCT units) FILTER (WHERE units > 0) = 1 THEN max(units) FILTER (WHERE units > 0) END AS units FROM deals GROUP BY address_norm")
def agg_consistent(deals):
    positive = F.when(c("units") > 0, c("units"))
    return deals.groupBy("address_norm").agg(F.when(F.countDistinct(positive) == 1, F.max(positive)).alias("units"))


@query("deals", sql="SELECT market, string_agg(DISTINCT bldg_class, '; ' ORDER BY bldg_class) AS classes FROM deals GROUP BY market")
def agg_string(deals):
    return deals.groupBy("market").agg(F.array_join(F.array_sort(F.collect_set("bldg_class")), "; ").alias("classes"))


DUPES = "SELECT address_norm, borough, count(*) AS n FROM properties GROUP BY address_norm, borough HAVING count(*) > 1"


@query("properties", sql=DUPES, also=("dq_duplicate_properties",))
def agg_group_dupes(properties):
    return properties.groupBy("address_norm", "borough").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("review_queue", sql="SELECT issue_class, status, count(*) AS n FROM review_queue GROUP BY issue_class, status")
def agg_status_counts(reviews):
    return reviews.groupBy("issue_class", "status").agg(F.count(F.lit(1)).alias("n"))


# Windows and order --------------------------------------------------------------------------------------------------

BOARD = "WITH g AS (SELECT d.asset_type, p.entity_id, count(*) AS n, round(coalesce(sum(sale_price), 0), 2) AS volume FROM deal_parties p JOIN deals d ON p.deal_id = d.deal_id WHERE role = 'buyer' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY asset_type ORDER BY n DESC, volume DESC, entity_id) AS rank FROM g) SELECT * FROM r WHERE rank <= 5"


@query("deal_parties", "deals", sql=BOARD, also=("q_leaderboards",))
def win_topn_group(parties, deals):
    g = parties.filter("role = 'buyer'").join(deals, "deal_id").groupBy("asset_type", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("sale_price"), F.lit(0.0)), 2).alias("volume"))
    return R.top_per_group(g, ["asset_type"], [c("n").desc(), c("volume").desc(), c("entity_id")], 5)


PAGE = "SELECT deal_id, sale_price FROM deals ORDER BY sale_price DESC NULLS LAST, deal_id LIMIT 25 OFFSET 50"


@query("deals", sql=PAGE)
def win_pagination(deals):
    return R.sort_page(deals, "sale_price", ["sale_date", "sale_price"], "deal_id", page=3, per_page=25).select("deal_id", "sale_price")


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY sale_date DESC NULLS LAST, deal_id DESC) AS rn FROM deals) WHERE rn = 1)"


@query("deals", sql=f"WITH {LATEST} SELECT property_id, deal_id, CAST(sale_date AS VARCHAR) AS sale_date FROM latest")
def win_distinct_on(deals):
    return R.latest_per_property(deals).select("property_id", "deal_id", c("sale_date").cast("string").alias("sale_date"))


SCORE = "CASE WHEN phone IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN is_primary THEN 1 ELSE 0 END"


def contact_score():
    return F.when(c("phone").isNotNull(), 4).otherwise(0) + F.when(c("email").isNotNull(), 4).otherwise(0) + F.when(c("website").isNotNull(), 2).otherwise(0) + F.when(c("is_primary"), 1).otherwise(0)


@query("contacts", sql=f"SELECT contact_id, first_value(contact_id) OVER (PARTITION BY right(phone, 2) ORDER BY {SCORE} DESC, contact_id) AS keep_id FROM contacts")
def win_first_value_keep(contacts):
    w = Window.partitionBy(F.right("phone", F.lit(2))).orderBy(contact_score().desc(), "contact_id")
    return contacts.select("contact_id", F.first("contact_id").over(w).alias("keep_id"))


@query("contacts", sql=f"WITH s AS (SELECT contact_id, concat('C', contact_id % 50) AS owner, {SCORE} AS score FROM contacts), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, contact_id) AS rank FROM s) SELECT owner, contact_id, score FROM r WHERE rank = 1", also=("contact_primary",))
def win_primary_rank(contacts):
    s = contacts.select("contact_id", F.concat(F.lit("C"), (c("contact_id") % 50).cast("string")).alias("owner"), contact_score().alias("score"))
    return R.top_per_group(s, ["owner"], [c("score").desc(), c("contact_id")]).select("owner", "contact_id", "score")


@query("deals", sql="WITH k AS (SELECT deal_id, concat('D', deal_id % 900) AS code FROM deals), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY deal_id) AS place FROM k) SELECT deal_id, CASE WHEN place = 1 THEN code ELSE concat(code, '-DUP', place - 1) END AS code FROM r")
def win_first_seen(deals):
    k = deals.select("deal_id", F.concat(F.lit("D"), (c("deal_id") % 900).cast("string")).alias("code"))
    place = F.row_number().over(Window.partitionBy("code").orderBy("deal_id"))
    return k.withColumn("place", place).select("deal_id", F.when(c("place") == 1, c("code")).otherwise(F.concat("code", F.lit("-DUP"), (c("place") - 1).cast("string"))).alias("code"))


RECENT = "recent AS (SELECT * FROM (SELECT p.entity_id, d.deal_id, d.address_raw, d.sale_price, row_number() OVER (PARTITION BY p.entity_id ORDER BY sale_date DESC NULLS LAST, d.deal_id DESC) AS rank FROM deal_parties p JOIN deals d ON p.deal_id = d.deal_id WHERE role = 'buyer') WHERE rank <= 3)"


def recent_deals(parties, deals, n: int = 3):
    joined = parties.filter("role = 'buyer'").join(deals, "deal_id").select("entity_id", "deal_id", "address_raw", "sale_price", "sale_date")
    return R.top_per_group(joined, ["entity_id"], [c("sale_date").desc_nulls_last(), c("deal_id").desc()], n)


@query("deal_parties", "deals", sql=f"WITH {RECENT} SELECT entity_id, string_agg(CAST(deal_id AS VARCHAR), ',' ORDER BY rank) AS deals FROM recent GROUP BY entity_id")
def win_recent_n(parties, deals):
    items = F.array_sort(F.collect_list(F.struct("rank", "deal_id")))
    return recent_deals(parties, deals).groupBy("entity_id").agg(F.array_join(F.transform(items, lambda x: x["deal_id"].cast("string")), ",").alias("deals"))


@query("deals", sql="SELECT deal_id, sale_price FROM deals ORDER BY sale_price DESC NULLS LAST, deal_id LIMIT 100")
def topk_limit(deals):
    return deals.orderBy(c("sale_price").desc_nulls_last(), "deal_id").limit(100).select("deal_id", "sale_price")


@query("review_queue", sql="SELECT review_id, severity FROM review_queue WHERE status = 'open' ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, created_on DESC, review_id LIMIT 200")
def sort_priority_tasks(reviews):
    rank = F.when(c("severity") == "high", 0).otherwise(1)
    return reviews.filter("status = 'open'").orderBy(rank, c("created_on").desc(), "review_id").limit(200).select("review_id", "severity")


TASKS = f"""WITH b AS ({ROLLUP.format(role='buyer')}), l AS (SELECT entity_id, max(occurred_at) AS last FROM interactions GROUP BY 1)
SELECT 'contact_gap' AS kind, entity_id AS subject, CASE WHEN volume >= 500000 THEN 'high' ELSE 'medium' END AS priority FROM b WHERE n_deals >= 2 AND NOT EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = b.entity_id)
UNION ALL SELECT 'review', CAST(review_id AS VARCHAR), severity FROM review_queue WHERE status = 'open'
UNION ALL SELECT 'follow_up', b.entity_id, 'medium' FROM b LEFT JOIN l ON b.entity_id = l.entity_id WHERE n_deals >= 3 AND (last IS NULL OR last < TIMESTAMP '{AS_OF_TOUCH}' - INTERVAL 90 DAY)"""


@query("deal_parties", "entities", "deals", "contacts", "review_queue", "interactions", sql=TASKS, also=("set_union_all",))
def q_tasks(parties, entities, deals, contacts, reviews, interactions):
    b = R.rollup_parties(parties, entities, deals, "buyer")
    gap = b.filter("n_deals >= 2").join(contacts, "entity_id", "left_anti").select(F.lit("contact_gap").alias("kind"), c("entity_id").alias("subject"), F.when(c("volume") >= 500000, "high").otherwise("medium").alias("priority"))
    open_reviews = reviews.filter("status = 'open'").select(F.lit("review").alias("kind"), c("review_id").cast("string").alias("subject"), c("severity").alias("priority"))
    last = interactions.groupBy("entity_id").agg(F.max("occurred_at").alias("last"))
    quiet = c("last").isNull() | (c("last") < F.lit(AS_OF_TOUCH).cast("timestamp") - F.expr("interval 90 days"))
    follow = b.filter("n_deals >= 3").join(last, "entity_id", "left").filter(quiet).select(F.lit("follow_up").alias("kind"), c("entity_id").alias("subject"), F.lit("medium").alias("priority"))
    return gap.unionByName(open_reviews).unionByName(follow)


@query("pages", "fetch_ledger", sql="SELECT page_id, url FROM {pages} p WHERE NOT EXISTS (SELECT 1 FROM fetch_ledger l WHERE l.url = p.url AND disposition NOT LIKE 'fetch_error%')")
def set_subtract_ledger(pages, ledger):
    final = ledger.filter(~c("disposition").startswith("fetch_error"))
    return pages.join(final.select("url"), "url", "left_anti").select("page_id", "url")


@query("pages", "deals", sql="SELECT page_id FROM {pages} WHERE TRY_CAST(regexp_extract(url, '/(\\d+)', 1) AS BIGINT) NOT IN (SELECT deal_id FROM deals) OR regexp_extract(url, '/(\\d+)', 1) = ''")
def set_subtract_existing(pages, deals):
    keyed = pages.select("page_id", F.regexp_extract("url", r"/(\d+)", 1).try_cast("bigint").alias("deal_id"))
    return keyed.join(deals, "deal_id", "left_anti").select("page_id")


@query("deals", sql="SELECT DISTINCT 'borough' AS field, borough AS value FROM deals UNION ALL SELECT DISTINCT 'asset_type', asset_type FROM deals UNION ALL SELECT DISTINCT 'market', market FROM deals")
def set_distinct_values(deals):
    parts = [deals.select(F.lit(f).alias("field"), c(f).alias("value")).distinct() for f in ("borough", "asset_type", "market")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("contacts", "uploads", sql="SELECT contact_id, entity_id, NULL AS upload_id FROM contacts UNION ALL SELECT NULL, NULL, upload_id FROM uploads")
def set_union_keys(contacts, uploads):
    return contacts.select("contact_id", "entity_id").unionByName(uploads.select("upload_id"), allowMissingColumns=True)


# The read surface ---------------------------------------------------------------------------------------------------


@query("deals", sql="SELECT count(*) AS deals FROM deals")
def q_health(deals):
    return deals.agg(F.count(F.lit(1)).alias("deals"))


@query("deals", "deal_parties", sql="SELECT (SELECT count(*) FROM deals) AS deals, (SELECT round(sum(sale_price), 2) FROM deals) AS volume, (SELECT count(DISTINCT entity_id) FROM deal_parties WHERE role = 'buyer') AS buyers, (SELECT array_to_string(list_sort(list(DISTINCT borough)), ',') FROM deals) AS boroughs")
def q_meta(deals, parties):
    a = deals.agg(F.count(F.lit(1)).alias("deals"), F.round(F.sum("sale_price"), 2).alias("volume"), F.array_join(F.array_sort(F.collect_set("borough")), ",").alias("boroughs"))
    b = parties.filter("role = 'buyer'").agg(F.countDistinct("entity_id").alias("buyers"))
    return a.crossJoin(b).select("deals", "volume", "buyers", "boroughs")  # one row each


@query("deals", "deal_parties", "entities", sql=f"WITH {FIRST} SELECT {SHOWN_SQL} FROM full_d WHERE borough = 'Queens' AND sale_price >= 50000 ORDER BY full_d.sale_date DESC NULLS LAST, deal_id LIMIT 50 OFFSET 50")
def q_deals(deals, parties, entities):
    found = R.filter_deals(deals, borough="Queens", sale_price_min=50000)
    page = R.sort_page(found, "sale_date", ["sale_date", "sale_price"], "deal_id", page=2)
    return shown(R.with_parties(page, parties, entities))


@query("deals", sql="SELECT count(*) AS n, round(sum(sale_price), 2) AS volume, round(quantile_cont(sale_price, 0.5), 3) AS median FROM deals WHERE borough = 'Queens' AND sale_price >= 50000")
def q_deals_pulse(deals):
    found = R.filter_deals(deals, borough="Queens", sale_price_min=50000)
    one = found.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sale_price"), 2).alias("volume"))
    return one.join(R.exact_median(found, [], "sale_price").select(F.round("median", 3).alias("median")), F.lit(True), "left")  # a row each


@query("deals", "deal_parties", "entities", sql=f"WITH {FIRST} SELECT {SHOWN_SQL} FROM full_d WHERE address_raw ILIKE '%widget%' OR buyer ILIKE '%widget%' OR seller ILIKE '%widget%' ORDER BY full_d.sale_date DESC NULLS LAST, deal_id LIMIT 20")
def q_recent_deals(deals, parties, entities):
    found = R.filter_deals(R.with_parties(deals, parties, entities), q="widget")
    return shown(R.sort_page(found, "sale_date", ["sale_date"], "deal_id", per_page=20))


@query("deal_parties", "entities", "deals", sql=f"SELECT * FROM ({ROLLUP.format(role='buyer')}) WHERE n_deals >= 2 ORDER BY volume DESC, entity_id LIMIT 200")
def q_buyers(parties, entities, deals):
    return R.rollup_parties(parties, entities, deals, "buyer").filter("n_deals >= 2").orderBy(c("volume").desc(), "entity_id").limit(200)


@query("deal_parties", "entities", "deals", sql=f"SELECT entity_id, display_name, n_deals, volume FROM ({ROLLUP.format(role='buyer').replace('WHERE role', 'WHERE sale_date >= DATE ' + chr(39) + '1998-01-01' + chr(39) + ' AND role')}) ORDER BY n_deals DESC, volume DESC, entity_id LIMIT 50")
def q_buyer_leaderboard(parties, entities, deals):
    since = deals.filter(c("sale_date") >= F.lit("1998-01-01").cast("date"))
    return R.rollup_parties(parties, entities, since, "buyer").orderBy(c("n_deals").desc(), c("volume").desc(), "entity_id").limit(50).select("entity_id", "display_name", "n_deals", "volume")


SIMILAR = """SELECT p.entity_id, count(*) AS n, round(sum(CASE WHEN asset_type = 'Retail' THEN 3 ELSE -2 END + CASE WHEN borough = 'Queens' THEN 2 ELSE -1 END + CASE WHEN sale_price BETWEEN 100000 AND 400000 THEN 1 WHEN sale_price IS NULL THEN 0 ELSE -1 END + CASE WHEN address_raw ILIKE '%ring%' THEN 2 ELSE 0 END)
 + 0.5 * least(count(*), 5) - CASE WHEN bool_or(is_spv_suspect) THEN 3 ELSE 0 END, 2) AS score FROM deal_parties p JOIN deals d ON p.deal_id = d.deal_id JOIN entities e ON e.entity_id = p.entity_id WHERE role = 'buyer' GROUP BY p.entity_id ORDER BY score DESC, n DESC, entity_id LIMIT 50"""


def similar_buyers(parties, entities, deals, asset_type="Retail", borough="Queens", price=200000.0, words=("ring",), n=50):
    fits = F.when(c("asset_type") == asset_type, 3).otherwise(-2) + F.when(c("borough") == borough, 2).otherwise(-1)
    band = F.when(c("sale_price").between(price * 0.5, price * 2), 1).when(c("sale_price").isNull(), 0).otherwise(-1)
    said = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.lower("address_raw").contains(w)), 2).otherwise(0)
    g = R.star(parties.filter("role = 'buyer'"), entities, deals).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.sum(fits + band + said).alias("points"), F.bool_or("is_spv_suspect").alias("spv"))
    score = F.round(c("points") + 0.5 * F.least(c("n"), F.lit(5)) - F.when(c("spv"), 3).otherwise(0), 2)
    return g.select("entity_id", "n", score.cast("double").alias("score")).orderBy(c("score").desc(), c("n").desc(), "entity_id").limit(n)


@query("deal_parties", "entities", "deals", sql=f"SELECT entity_id, n, CAST(score AS DOUBLE) AS score FROM ({SIMILAR})")
def q_similar_buyers(parties, entities, deals):
    return similar_buyers(parties, entities, deals)


@query("deal_parties", "entities", "deals", "contacts", sql=f"WITH s AS ({SIMILAR}), {RECENT} SELECT s.entity_id, CAST(s.score AS DOUBLE) AS score, string_agg(CAST(r.deal_id AS VARCHAR), ',' ORDER BY r.rank) AS recent, EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = s.entity_id) AS has_contact FROM s LEFT JOIN recent r ON r.entity_id = s.entity_id GROUP BY s.entity_id, s.score")
def q_similar_buyers_recent(parties, entities, deals, contacts):
    top = similar_buyers(parties, entities, deals)
    items = F.array_sort(F.collect_list(F.struct("rank", "deal_id")))
    recent = recent_deals(parties, deals).groupBy("entity_id").agg(F.array_join(F.transform(items, lambda x: x["deal_id"].cast("string")), ",").alias("recent"))
    return top.join(recent, "entity_id", "left").join(R.contact_flags(contacts), "entity_id", "left").select("entity_id", "score", "recent", c("n_contacts").isNotNull().alias("has_contact"))


@query("deal_parties", "entities", "deals", sql=f"SELECT entity_id, display_name, n_deals, volume FROM ({ROLLUP.format(role='seller')}) ORDER BY n_deals DESC, volume DESC, entity_id LIMIT 50")
def q_similar_sellers(parties, entities, deals):
    return R.rollup_parties(parties, entities, deals, "seller").orderBy(c("n_deals").desc(), c("volume").desc(), "entity_id").limit(50).select("entity_id", "display_name", "n_deals", "volume")


@query("deal_parties", "entities", "deals", "contacts", sql=f"SELECT entity_id, n_deals, volume FROM ({ROLLUP.format(role='buyer')}) b WHERE n_deals >= 2 AND NOT EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = b.entity_id AND (phone IS NOT NULL OR email IS NOT NULL))")
def q_missing_contacts(parties, entities, deals, contacts):
    return R.rollup_parties(parties, entities, deals, "buyer").filter("n_deals >= 2").join(contacts.filter("phone IS NOT NULL OR email IS NOT NULL"), "entity_id", "left_anti").select("entity_id", "n_deals", "volume")


@query("deal_parties", "entities", "deals", "contacts", sql=f"SELECT entity_id, n_deals, volume FROM ({ROLLUP.format(role='buyer')}) b WHERE n_deals >= 2 AND NOT EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = b.entity_id) ORDER BY volume DESC, entity_id LIMIT 100")
def q_contact_gaps(parties, entities, deals, contacts):
    return R.rollup_parties(parties, entities, deals, "buyer").filter("n_deals >= 2").join(contacts, "entity_id", "left_anti").orderBy(c("volume").desc(), "entity_id").limit(100).select("entity_id", "n_deals", "volume")


@query("entities", "deal_parties", "contacts", sql="SELECT e.entity_id, e.display_name, (SELECT string_agg(concat(p.role, ':', CAST(p.deal_id AS VARCHAR)), ',' ORDER BY p.role, p.deal_id) FROM deal_parties p WHERE p.entity_id = e.entity_id) AS deals, (SELECT string_agg(CAST(contact_id AS VARCHAR), ',' ORDER BY contact_id) FROM contacts k WHERE k.entity_id = e.entity_id) AS contacts FROM entities e")
def q_entity_detail(entities, parties, contacts):
    d = F.transform(F.array_sort(F.collect_list(F.struct("role", "deal_id"))), lambda x: F.concat_ws(":", x["role"], x["deal_id"].cast("string")))
    deals = parties.groupBy("entity_id").agg(F.array_join(d, ",").alias("deals"))
    held = contacts.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("contact_id")), lambda x: x.cast("string")), ",").alias("contacts"))
    return entities.select("entity_id", "display_name").join(deals, "entity_id", "left").join(held, "entity_id", "left")


@query("interactions", sql="WITH r AS (SELECT entity_id, channel, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS at, row_number() OVER (PARTITION BY entity_id ORDER BY occurred_at DESC, interaction_id) AS rank FROM interactions) SELECT * FROM r WHERE rank <= 5")
def q_last_interaction(interactions):
    r = R.top_per_group(interactions, ["entity_id"], [c("occurred_at").desc(), c("interaction_id")], 5)
    return r.select("entity_id", "channel", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "rank")


@query("entities", "contacts", sql="SELECT e.entity_id, e.display_name, string_agg(concat(CASE WHEN is_primary THEN '*' ELSE '' END, coalesce(phone, '-')), ',' ORDER BY is_primary DESC, k.contact_id) AS contacts FROM entities e JOIN contacts k ON k.entity_id = e.entity_id WHERE e.display_name ILIKE '%0012%' GROUP BY e.entity_id, e.display_name")
def q_contact_search(entities, contacts):
    items = F.array_sort(F.collect_list(F.struct((~c("is_primary")).alias("o"), "contact_id", F.concat(F.when(c("is_primary"), "*").otherwise(""), F.coalesce("phone", F.lit("-"))).alias("t"))))
    return entities.filter(c("display_name").ilike("%0012%")).join(contacts, "entity_id").groupBy("entity_id", "display_name").agg(F.array_join(F.transform(items, lambda x: x["t"]), ",").alias("contacts"))


@query("deals", sql=f"SELECT deal_id, CAST(created_on AS VARCHAR) AS created_on FROM deals WHERE created_on + update_lag * INTERVAL 1 DAY >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ORDER BY created_on + update_lag * INTERVAL 1 DAY DESC, deal_id LIMIT 500")
def q_recent_changes(deals):
    changed = F.date_add("created_on", c("update_lag"))
    return deals.filter(changed >= F.date_sub(F.lit(AS_OF).cast("date"), 30)).orderBy(changed.desc(), "deal_id").limit(500).select("deal_id", c("created_on").cast("string").alias("created_on"))


@query("deals", "deal_parties", "contacts", "review_queue", sql="SELECT (SELECT count(*) FROM deals) AS deals, (SELECT count(*) FROM deals WHERE parse_status = 'needs_review') AS review_deals, (SELECT count(*) FROM review_queue WHERE status = 'open') AS open_reviews, (SELECT count(DISTINCT entity_id) FROM deal_parties p WHERE role = 'buyer' AND NOT EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = p.entity_id)) AS gaps")
def q_workbench_stats(deals, parties, contacts, reviews):
    a = deals.agg(F.count(F.lit(1)).alias("deals"), F.count_if(c("parse_status") == "needs_review").alias("review_deals"))
    b = reviews.agg(F.count_if(c("status") == "open").alias("open_reviews"))
    g = parties.filter("role = 'buyer'").join(contacts, "entity_id", "left_anti").agg(F.countDistinct("entity_id").alias("gaps"))
    return a.crossJoin(b).crossJoin(g)  # one row each


OWNERS = f"WITH {LATEST}, b AS (SELECT deal_id, min(entity_id) AS owner FROM deal_parties WHERE role = 'buyer' GROUP BY 1) SELECT l.property_id, b.owner, EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = b.owner) AS has_contact, EXISTS (SELECT 1 FROM interactions i WHERE i.entity_id = b.owner) AS touched FROM latest l JOIN b ON b.deal_id = l.deal_id"


@query("deals", "deal_parties", "contacts", "interactions", sql=OWNERS)
def q_owner_targets(deals, parties, contacts, interactions):
    owners = R.latest_per_property(deals).join(R.first_party(parties, "buyer"), "deal_id").select("property_id", c("buyer_id").alias("entity_id"))
    k = contacts.select("entity_id").distinct().withColumn("k", F.lit(True))
    i = interactions.select("entity_id").distinct().withColumn("i", F.lit(True))
    return owners.join(k, "entity_id", "left").join(i, "entity_id", "left").select("property_id", c("entity_id").alias("owner"), c("k").isNotNull().alias("has_contact"), c("i").isNotNull().alias("touched"))


@query("properties", "deals", sql=f"WITH {LATEST}, n AS (SELECT property_id, count(*) AS n_deals FROM deals GROUP BY 1) SELECT p.property_id, p.address_raw, l.deal_id AS last_deal, l.sale_price, coalesce(n_deals, 0) AS n_deals FROM properties p LEFT JOIN latest l ON l.property_id = p.property_id LEFT JOIN n ON n.property_id = p.property_id WHERE p.address_raw ILIKE '%ring%' ORDER BY p.property_id LIMIT 100")
def q_properties(properties, deals):
    latest = R.latest_per_property(deals).select("property_id", c("deal_id").alias("last_deal"), "sale_price")
    n = deals.groupBy("property_id").agg(F.count(F.lit(1)).alias("n_deals"))
    found = properties.filter(c("address_raw").ilike("%ring%")).orderBy("property_id").limit(100)
    return found.join(latest, "property_id", "left").join(n, "property_id", "left").select("property_id", "address_raw", "last_deal", "sale_price", F.coalesce("n_deals", F.lit(0)).alias("n_deals"))


@query("properties", "deals", sql=f"WITH {LATEST} SELECT p.property_id, latitude, longitude, l.sale_price FROM properties p JOIN latest l ON l.property_id = p.property_id WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY l.sale_price DESC NULLS LAST, p.property_id LIMIT 300")
def q_property_map(properties, deals):
    placed = properties.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("property_id", "latitude", "longitude")
    return R.latest_per_property(deals).select("property_id", "sale_price").join(placed, "property_id").orderBy(c("sale_price").desc_nulls_last(), "property_id").limit(300)


@query("properties", sql="WITH b AS (SELECT min(latitude) AS a, greatest(max(latitude) - min(latitude), 0.0001) AS h, min(longitude) AS o, greatest(max(longitude) - min(longitude), 0.0001) AS w FROM properties) SELECT property_id, round((latitude - a) / h, 6) AS y, round((longitude - o) / w, 6) AS x FROM properties, b WHERE latitude IS NOT NULL")
def map_viewport(properties):
    bounds = properties.agg(F.min("latitude").alias("a"), F.greatest(F.max("latitude") - F.min("latitude"), F.lit(0.0001)).alias("h"), F.min("longitude").alias("o"), F.greatest(F.max("longitude") - F.min("longitude"), F.lit(0.0001)).alias("w"))
    return properties.filter("latitude IS NOT NULL").crossJoin(F.broadcast(bounds)).select("property_id", F.round((c("latitude") - c("a")) / c("h"), 6).alias("y"), F.round((c("longitude") - c("o")) / c("w"), 6).alias("x"))  # one row of bounds


@query("deal_parties", "entities", "deals", "contacts", sql=f"WITH b AS ({ROLLUP.format(role='buyer')}), k AS (SELECT entity_id, count(*) AS n_contacts, count(email) AS n_emails, count(phone) AS n_phones FROM contacts GROUP BY 1) SELECT b.entity_id, n_deals, volume, n_contacts, n_emails, n_phones FROM b JOIN k ON b.entity_id = k.entity_id WHERE n_emails > 0")
def q_outreach_targets(parties, entities, deals, contacts):
    return R.rollup_parties(parties, entities, deals, "buyer").join(R.contact_flags(contacts), "entity_id").filter("n_emails > 0").select("entity_id", "n_deals", "volume", "n_contacts", "n_emails", "n_phones")


DRAFT = f"WITH {RECENT}, t AS (SELECT entity_id, string_agg(concat(address_raw, ' for $', CAST(CAST(round(sale_price) AS BIGINT) AS VARCHAR)), '; ' ORDER BY rank) AS said FROM recent WHERE sale_price IS NOT NULL GROUP BY 1) SELECT e.entity_id, concat('Hello ', e.display_name, ', we saw ', said, '.') AS draft FROM entities e JOIN t ON e.entity_id = t.entity_id"


@query("entities", "deal_parties", "deals", sql=DRAFT)
def q_outreach_drafts(entities, parties, deals):
    line = F.concat("address_raw", F.lit(" for $"), F.round("sale_price").cast("bigint").cast("string"))
    items = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    said = recent_deals(parties, deals).filter("sale_price IS NOT NULL").groupBy("entity_id").agg(F.array_join(F.transform(items, lambda x: x["line"]), "; ").alias("said"))
    return entities.join(said, "entity_id").select("entity_id", F.concat(F.lit("Hello "), "display_name", F.lit(", we saw "), "said", F.lit(".")).alias("draft"))


@query("review_queue", sql="SELECT review_id, issue_class, severity, count(*) OVER (PARTITION BY issue_class) AS in_class FROM review_queue WHERE status = 'open'")
def q_review_list(reviews):
    found = reviews.filter("status = 'open'")
    n = found.groupBy("issue_class").agg(F.count(F.lit(1)).alias("in_class"))  # a count a class, not a window: a hot class is pre-aggregated
    return found.join(F.broadcast(n), "issue_class").select("review_id", "issue_class", "severity", "in_class")


@query("uploads", "upload_rows", sql="SELECT u.upload_id, u.status, count(r.row_num) AS n_rows, count(*) FILTER (WHERE r.status = 'review') AS in_review, count(*) FILTER (WHERE r.status = 'imported') AS imported FROM uploads u LEFT JOIN upload_rows r ON r.upload_id = u.upload_id GROUP BY u.upload_id, u.status")
def q_uploads_history(uploads, rows):
    n = rows.groupBy("upload_id").agg(F.count("row_num").alias("n_rows"), F.count_if(c("status") == "review").alias("in_review"), F.count_if(c("status") == "imported").alias("imported"))
    return uploads.join(n, "upload_id", "left").select("upload_id", "status", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("n_rows", "in_review", "imported")])


@query("source_runs", sql="SELECT CAST(started_on AS VARCHAR) AS started_on, job, status, n FROM source_runs WHERE status <> 'ok' ORDER BY source_runs.started_on DESC, job LIMIT 100")
def q_source_runs(runs):
    return runs.filter("status <> 'ok'").orderBy(c("started_on").desc(), "job").limit(100).select(c("started_on").cast("string").alias("started_on"), "job", "status", "n")


# Audits -------------------------------------------------------------------------------------------------------------


@query("deals", "properties", "entities", "contacts", sql="SELECT 'deals' AS name, count(*) AS n FROM deals UNION ALL SELECT 'properties', count(*) FROM properties UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'contacts', count(*) FROM contacts UNION ALL SELECT 'deals without price', count(*) FROM deals WHERE sale_price IS NULL")
def dq_totals(deals, properties, entities, contacts):
    count = lambda n, df: df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    parts = [("deals", deals), ("properties", properties), ("entities", entities), ("contacts", contacts), ("deals without price", deals.filter("sale_price IS NULL"))]
    out = count(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(count(*p))
    return out


@query("deals", sql="SELECT address_norm, borough, sale_price, CAST(sale_date AS VARCHAR) AS sale_date, count(*) AS n FROM (SELECT address_norm, borough, round(sale_price / 100000) AS sale_price, CAST(date_trunc('year', sale_date) AS DATE) AS sale_date FROM deals) GROUP BY address_norm, borough, sale_price, sale_date HAVING count(*) > 1")
def dq_duplicate_deals(deals):
    coarse = deals.select("address_norm", "borough", F.round(c("sale_price") / 100000).alias("sale_price"), F.trunc("sale_date", "year").cast("string").alias("sale_date"))
    return coarse.groupBy("address_norm", "borough", "sale_price", "sale_date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("uploads", sql="SELECT upload_id, status FROM uploads WHERE status IN ('failed', 'resolving', 'staged')")
def dq_problem_uploads(uploads):
    return uploads.filter(c("status").isin("failed", "resolving", "staged"))


CHECKS = """SELECT 'deal without property' AS name, count(*) AS failures FROM deals d WHERE NOT EXISTS (SELECT 1 FROM properties p WHERE p.property_id = d.property_id)
UNION ALL SELECT 'party without entity', count(*) FROM deal_parties p WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.entity_id = p.entity_id)
UNION ALL SELECT 'price not positive', count(*) FROM deals WHERE sale_price <= 0
UNION ALL SELECT 'deed party without gate', count(*) FROM deal_parties p JOIN deals d ON d.deal_id = p.deal_id WHERE source_system = 'acris' AND NOT amount_gate_passed"""


@query("deals", "properties", "deal_parties", "entities", sql=CHECKS)
def dq_invariants(deals, properties, parties, entities):
    bad = {
        "deal without property": deals.join(properties, "property_id", "left_anti"),
        "party without entity": parties.join(entities, "entity_id", "left_anti"),
        "price not positive": deals.filter("sale_price <= 0"),
        "deed party without gate": parties.join(deals, "deal_id").filter("source_system = 'acris' AND NOT amount_gate_passed"),
    }
    out = None
    for name, df in bad.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("failures"))
        out = one if out is None else out.unionByName(one)
    return out


@query("deal_parties", "deals", sql="SELECT p.deal_id, role FROM deal_parties p JOIN deals d ON d.deal_id = p.deal_id WHERE source_system <> 'acris' AND NOT amount_gate_passed AND confidence < 5")
def dq_gate_check(parties, deals):
    return parties.join(deals, "deal_id").filter("source_system <> 'acris' AND NOT amount_gate_passed AND confidence < 5").select("deal_id", "role")


@query("deals", sql="SELECT deal_id, asset_type FROM deals WHERE asset_type IN ('Condo', 'Co-op', 'Single Family', 'Hotel')")
def dq_no_residential(deals):
    return deals.filter(c("asset_type").isin("Condo", "Co-op", "Single Family", "Hotel")).select("deal_id", "asset_type")


@query("deals", "orders", sql="SELECT (SELECT count(*) FROM {orders}) AS source_rows, count(*) AS loaded, count(sale_price) AS priced, count(*) FILTER (WHERE units > 0 AND sale_price IS NOT NULL) AS with_ppu FROM deals")
def dq_load_assertions(deals, orders):
    a = orders.agg(F.count(F.lit(1)).alias("source_rows"))
    b = deals.agg(F.count(F.lit(1)).alias("loaded"), F.count("sale_price").alias("priced"), F.count_if((c("units") > 0) & c("sale_price").isNotNull()).alias("with_ppu"))
    return a.crossJoin(b)  # one row each


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

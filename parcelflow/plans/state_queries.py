"""Scans, merges, resolution, matching, extraction and incremental queries, each with its SQL where SQL can say it."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelflow.functions import classify as C
from parcelflow.functions import normalize as N
from parcelflow.operators import extract as E
from parcelflow.operators import matching as M
from parcelflow.operators import merge as G
from parcelflow.operators import relational as R
from parcelflow.operators import similarity as S
from parcelflow.plans.function_queries import DOC_URL, NORM, case
from parcelflow.plans.views import frame, with_views
from parcelflow.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = lambda n: F.col(n)


#: Deals up to 1998 are stored; the later ones are the batch that comes in.
OLD, NEW = "created_on < DATE '1999-01-01'", "created_on >= DATE '1999-01-01'"


def query(*views: str, sql: str | None = None, also: tuple[str, ...] = ()):
    def register(f):
        def run(spark, sf_dir):
            return f(*[frame(spark, sf_dir, v) for v in views])

        for name in (f.__name__, *also):
            QUERIES[name] = run
            if sql:
                SQL[name] = with_views(sql)
        return f

    return register


# Scans and sinks ----------------------------------------------------------------------------------------------------


@query("deed_masters", sql="SELECT document_id, document_amt FROM deed_masters WHERE document_amt >= 100000 AND deal_date >= DATE '1997-01-01' ORDER BY deal_date DESC, document_id LIMIT 400")
def scan_deed_masters(masters):
    return masters.filter((c("document_amt") >= 100000) & (c("deal_date") >= F.lit("1997-01-01").cast("date"))).orderBy(c("deal_date").desc(), "document_id").limit(400).select("document_id", "document_amt")


@query("lineitem", sql="SELECT l_orderkey AS document_id, l_partkey AS lot FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM {lineitem}) WHERE rn = 1")
def scan_legals_first(lineitem):
    best = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return lineitem.groupBy(c("l_orderkey").alias("document_id")).agg(best.alias("b")).select("document_id", c("b.l_partkey").alias("lot"))


@query("deal_parties", "entities", sql="SELECT p.deal_id, min(CASE WHEN role = 'seller' THEN display_name END) AS seller, min(CASE WHEN role = 'buyer' THEN display_name END) AS buyer, string_agg(DISTINCT mailing_address, ', ' ORDER BY mailing_address) AS mailing FROM deal_parties p JOIN entities e ON e.entity_id = p.entity_id GROUP BY p.deal_id")
def scan_parties_pivot(parties, entities):
    j = parties.join(entities, "entity_id")
    mailing = F.array_join(F.array_sort(F.collect_set("mailing_address")), ", ")
    return j.groupBy("deal_id").agg(*[F.min(F.when(c("role") == r, c("display_name"))).alias(r) for r in ("seller", "buyer")], F.when(mailing != "", mailing).alias("mailing"))


@query("deals", "properties", sql="SELECT d.deal_id, p.bldg_class, p.units, p.sqft FROM deals d JOIN properties p ON p.property_id = d.property_id")
def scan_lots(deals, properties):
    return deals.select("deal_id", "property_id").join(properties.select("property_id", "bldg_class", "units", "sqft"), "property_id").select("deal_id", "bldg_class", "units", "sqft")


@query("deals", "properties", sql="SELECT d.deal_id, p.property_id FROM deals d JOIN properties p ON p.borough = d.borough AND split_part(p.address_norm, ' ', 1) = split_part(d.address_norm, ' ', 1) WHERE contains(p.address_norm, split_part(d.address_norm, ' ', 2))")
def scan_rolling_sales(deals, properties):
    d = deals.select("deal_id", "borough", F.split_part("address_norm", F.lit(" "), F.lit(1)).alias("number"), F.split_part("address_norm", F.lit(" "), F.lit(2)).alias("token"))
    p = properties.select("property_id", "borough", F.split_part("address_norm", F.lit(" "), F.lit(1)).alias("number"), "address_norm")
    return d.join(p, ["borough", "number"]).filter(c("address_norm").contains(c("token"))).select("deal_id", "property_id")


@query("entities", "supplier", sql="WITH r AS (SELECT upper(s_name) AS name, s_suppkey, row_number() OVER (PARTITION BY upper(s_name) ORDER BY s_suppkey) AS rn FROM {supplier}) SELECT e.entity_id, r.s_suppkey AS registry_id FROM entities e JOIN r ON r.name = e.norm_name AND r.rn = 1")
def scan_registry(entities, supplier):
    first = supplier.groupBy(F.upper("s_name").alias("norm_name")).agg(F.min("s_suppkey").alias("registry_id"))
    return entities.join(first, "norm_name").select("entity_id", "registry_id")


@query("deals", sql="SELECT deal_id, address_raw, sale_price, source_system FROM deals WHERE source_system IN ('traded', 'crexi')")
def scan_partner_deals(deals):
    return deals.filter(c("source_system").isin("traded", "crexi")).select("deal_id", "address_raw", "sale_price", "source_system")


@query("pages", sql="SELECT page_id, url, length(html) AS n FROM {pages}")
def scan_pages_html(pages):
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query("upload_rows", sql="SELECT concat('{', string_agg(concat('\"', status, '\":', CAST(n AS VARCHAR)), ',' ORDER BY status), '}') AS stats FROM (SELECT status, count(*) AS n FROM upload_rows GROUP BY status)")
def sink_run_stats(rows):
    return T.run_stats(rows)


# Merges -------------------------------------------------------------------------------------------------------------



@query("deals", sql="WITH s AS (SELECT address_norm, borough, min(units) AS units, CAST(NULL AS INT) AS sqft FROM deals WHERE created_on < DATE '1999-01-01' GROUP BY 1, 2), b AS (SELECT address_norm, borough, arg_min(units, deal_id) FILTER (WHERE units IS NOT NULL) AS units, arg_min(sqft, deal_id) FILTER (WHERE sqft IS NOT NULL) AS sqft FROM deals WHERE created_on >= DATE '1999-01-01' GROUP BY 1, 2) SELECT coalesce(s.address_norm, b.address_norm) AS address_norm, coalesce(s.borough, b.borough) AS borough, coalesce(s.units, b.units) AS units, coalesce(s.sqft, b.sqft) AS sqft, s.address_norm IS NULL AS is_new FROM s FULL JOIN b ON s.address_norm = b.address_norm AND s.borough = b.borough")
def upsert_properties(deals):
    stored = deals.filter(OLD).groupBy("address_norm", "borough").agg(F.min("units").alias("units")).withColumn("sqft", F.lit(None).cast("int"))
    batch = deals.filter(NEW).select("address_norm", "borough", "units", "sqft", c("deal_id").alias("ord"))
    return G.upsert_fill(stored, batch, ["address_norm", "borough"], ["units", "sqft"])


@query("raw_names", "entities", sql=f"WITH b AS (SELECT id, name, {NORM} AS norm_name FROM raw_names) SELECT norm_name, arg_min(name, id) AS display_name FROM b WHERE norm_name IS NOT NULL AND norm_name NOT IN (SELECT norm_name FROM entities) GROUP BY norm_name")
def upsert_entities(names, entities):
    return G.new_entities(entities, names.select(N.norm_entity(c("name")).alias("norm_name"), c("name").alias("display_name"), c("id").alias("ord")))


#: The rules one row after another: what is contested (a deed id or key that another passed row of the batch has) goes through a recursion in order that holds the claims so far.
MERGE = """WITH b AS (SELECT *, CASE WHEN doc IS NOT NULL THEN concat('D', doc) END AS doc_id, CAST(trunc(coalesce(sale_price, 0)) AS BIGINT) AS whole,
  CASE WHEN borough IS NOT NULL THEN concat(address_norm, '|', borough, '|', coalesce(CAST(sale_price AS VARCHAR), '-'), '|', coalesce(CAST(sale_date AS VARCHAR), '-')) END AS claim FROM reports),
s AS (SELECT concat('D', deal_id % 4000) AS doc_id, concat(address_norm, '|', borough, '|', coalesce(CAST(sale_price AS VARCHAR), '-'), '|', coalesce(CAST(sale_date AS VARCHAR), '-')) AS claim FROM deals WHERE created_on < DATE '1999-01-01' AND deal_id % 3 = 0),
c AS (SELECT *, CASE WHEN asset_type = 'Condo' THEN 'rejected_banned_type' WHEN regexp_matches(bldg_class, '^(A[0-9A-Z]?|B[0-9A-Z]?|RG)$') THEN 'rejected_one_two_family' WHEN regexp_matches(bldg_class, '^R[0-9A-Z]?$') THEN 'rejected_condo_class' END AS why FROM b),
x AS (SELECT addr_norm AS address_norm, CAST(trunc(price) AS BIGINT) AS whole, -1 AS since FROM exclusion_ledger UNION ALL SELECT address_norm, whole, ord FROM c WHERE why IN ('rejected_one_two_family', 'rejected_condo_class')),
m AS (SELECT address_norm, whole, min(since) AS since FROM x GROUP BY 1, 2),
g AS (SELECT c.*, CASE WHEN m.since < c.ord THEN 'rejected_excluded' ELSE why END AS gate, doc_id IN (SELECT doc_id FROM s) AS doc_held, coalesce(claim IN (SELECT claim FROM s), false) AS key_held FROM c LEFT JOIN m ON m.address_norm = c.address_norm AND m.whole = c.whole),
o AS (SELECT ord, doc_id, claim, count(*) OVER (PARTITION BY doc_id) > 1 AND doc_id IS NOT NULL OR count(*) OVER (PARTITION BY claim) > 1 AND claim IS NOT NULL AS contested FROM g WHERE gate IS NULL AND NOT coalesce(doc_held, false) AND NOT key_held),
q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord) AS i FROM o WHERE contested),
f(one, i, docs, claims, won) USING KEY (one) AS (
  SELECT 1, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])
  UNION
  SELECT 1, nr, CASE WHEN take AND doc_id IS NOT NULL THEN list_append(docs, doc_id) ELSE docs END, CASE WHEN take AND claim IS NOT NULL THEN list_append(claims, claim) ELSE claims END, CASE WHEN take THEN list_append(won, ord) ELSE won END
  FROM (SELECT f.docs, f.claims, f.won, q.ord, q.doc_id, q.claim, q.i AS nr, NOT (list_contains(docs, coalesce(q.doc_id, '')) OR list_contains(claims, coalesce(q.claim, ''))) AS take FROM f JOIN q ON q.i = f.i + 1) z
),
w AS (SELECT unnest(won) AS ord FROM f UNION SELECT ord FROM o WHERE NOT contested),
d AS (SELECT doc_id, min(g.ord) AS winner FROM w JOIN g ON g.ord = w.ord WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT g.ord, CASE WHEN gate IS NOT NULL THEN gate WHEN g.ord IN (SELECT ord FROM w) THEN CASE WHEN source_system IN ('traded', 'crexi') AND coalesce(bldg_class, '') = '' AND units <= 2 AND asset_type = 'Multifamily' THEN 'merged_flagged' ELSE 'merged' END
  WHEN coalesce(doc_held, false) OR coalesce(d.winner < g.ord, false) THEN 'duplicate_doc' ELSE 'duplicate_key' END AS status FROM g LEFT JOIN d ON d.doc_id = g.doc_id"""


def _merged(deals, ledger, reports):
    stored = deals.filter(OLD).filter("deal_id % 3 = 0").withColumn("doc_id", F.concat(F.lit("D"), (c("deal_id") % 4000).cast("string")))
    return G.merge_status(stored, reports.withColumn("doc_id", F.concat(F.lit("D"), c("doc").cast("string"))), ledger)


@query("deals", "exclusion_ledger", "reports", sql=MERGE)
def merge_deals(deals, ledger, reports):
    """Late deals, and second and third reports of many of them under other deed ids or prices, so that rows wait for one another. A third of the early deals is stored."""
    return _merged(deals, ledger, reports)


@query("deals", "exclusion_ledger", "reports", sql=f"SELECT status, count(*) AS n FROM (WITH RECURSIVE{MERGE.removeprefix('WITH')}) GROUP BY status")
def sync_upsert_batch(deals, ledger, reports):
    return _merged(deals, ledger, reports).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


COARSE = "SELECT deal_id, property_id % 300 AS property_id, round(sale_price / 200000) AS sale_price, date_trunc('year', sale_date) AS sale_date, created_on FROM deals"
TOLERANT = f"""WITH a AS ({COARSE}), s AS (SELECT * FROM a WHERE created_on < DATE '1995-01-01'), b AS (SELECT * FROM a WHERE created_on >= DATE '1995-01-01'),
g AS (SELECT property_id, sale_price, count(*) AS n, bool_or(sale_date IS NULL) AS nul, list(sale_date) AS dates FROM s GROUP BY 1, 2),
o AS (SELECT b.*, g.n, g.nul, g.dates, row_number() OVER w AS place, first_value(b.sale_date IS NULL) OVER w AS first_null, row_number() OVER (PARTITION BY b.property_id, b.sale_price, b.sale_date ORDER BY deal_id) AS nth FROM b LEFT JOIN g ON g.property_id IS NOT DISTINCT FROM b.property_id AND g.sale_price IS NOT DISTINCT FROM b.sale_price WINDOW w AS (PARTITION BY b.property_id, b.sale_price ORDER BY deal_id))
SELECT deal_id AS ord, CASE WHEN CASE WHEN nul THEN false WHEN n > 0 THEN sale_date IS NOT NULL AND nth = 1 AND NOT list_contains(dates, sale_date) ELSE place = 1 OR (NOT first_null AND sale_date IS NOT NULL AND nth = 1) END THEN 'inserted' ELSE 'duplicate' END AS status FROM o"""


@query("deals", sql=TOLERANT)
def merge_deals_null_tolerant(deals):
    a = deals.select(c("deal_id").alias("ord"), (c("property_id") % 300).alias("property_id"), F.round(c("sale_price") / 200000).alias("sale_price"), F.trunc("sale_date", "year").alias("sale_date"), "created_on")
    return G.null_tolerant_status(a.filter("created_on < DATE '1995-01-01'"), a.filter("created_on >= DATE '1995-01-01'"))


@query("deals", sql="""WITH s AS (SELECT deal_id, concat('D', deal_id % 3000) AS doc, concat('K', deal_id % 1700) AS code, property_id, sale_price FROM deals WHERE created_on < DATE '1999-01-01'), b AS (SELECT deal_id AS ord, CASE WHEN deal_id % 3 = 0 THEN concat('D', deal_id % 3000) END AS doc, CASE WHEN deal_id % 5 = 0 THEN concat('K', deal_id % 1700) END AS code, property_id, sale_price FROM deals WHERE created_on >= DATE '1999-01-01'),
m AS (SELECT ord, 0 AS rule, s.deal_id AS matched FROM b JOIN s ON b.doc = s.doc UNION ALL SELECT ord, 1, s.deal_id FROM b JOIN s ON b.code = s.code UNION ALL SELECT ord, 2, s.deal_id FROM b JOIN s ON b.property_id = s.property_id AND b.sale_price IS NOT DISTINCT FROM s.sale_price),
r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY rule, matched) AS rn FROM m) SELECT b.ord, r.matched, r.rule FROM b LEFT JOIN r ON r.ord = b.ord AND rn = 1""")
def ingest_deals_conflict(deals):
    n = c("deal_id")
    code = lambda p, m: F.concat(F.lit(p), (n % m).cast("string"))
    stored = deals.filter(OLD).select("deal_id", code("D", 3000).alias("doc"), code("K", 1700).alias("code"), "property_id", "sale_price")
    batch = deals.filter(NEW).select(n.alias("ord"), F.when(n % 3 == 0, code("D", 3000)).alias("doc"), F.when(n % 5 == 0, code("K", 1700)).alias("code"), "property_id", "sale_price")
    return G.match_by_priority(stored, batch, [["doc"], ["code"], ["property_id", "sale_price"]], "deal_id")


@query("deals", "properties", sql="SELECT deal_id, concat_ws(',', CASE WHEN u <> d.units THEN 'units' END, CASE WHEN q <> d.sqft THEN 'sqft' END) AS fields FROM (SELECT *, CASE WHEN deal_id % 7 = 0 THEN units + 1 ELSE units END AS u, CASE WHEN deal_id % 11 = 0 THEN sqft * 2 ELSE sqft END AS q FROM deals) d WHERE (u <> d.units) OR (q <> d.sqft)")
def field_conflict_flag(deals, properties):
    held = properties.select("property_id", c("units").alias("u0"), c("sqft").alias("q0"))
    n = c("deal_id")
    said = deals.select(n, "property_id", F.when(n % 7 == 0, c("units") + 1).otherwise(c("units")).alias("u"), F.when(n % 11 == 0, c("sqft") * 2).otherwise(c("sqft")).alias("q"))
    return said.join(held, "property_id").select("deal_id", G.differing([("units", c("u0"), c("u")), ("sqft", c("q0"), c("q"))]).alias("fields")).filter("fields <> ''")


PARTY = """WITH h AS (SELECT deal_id, role, entity_id FROM deal_parties WHERE amount_gate_passed), b AS (SELECT deal_id * 4 + i AS ord, deal_id, CASE WHEN i = 2 THEN 'broker' ELSE role END AS role, CASE WHEN i = 1 THEN 'n/a' ELSE entity_id END AS name, CASE WHEN i = 3 THEN 'X9' ELSE entity_id END AS entity_id, amount_gate_passed OR i = 3 AS gate FROM deal_parties, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE role = 'buyer'),
o AS (SELECT b.*, h.entity_id AS held, name <> 'n/a' AND b.role IN ('buyer', 'seller') AND gate AS ok FROM b LEFT JOIN h ON h.deal_id = b.deal_id AND h.role = b.role), f AS (SELECT *, first_value(entity_id) OVER w AS first_id, row_number() OVER w AS place FROM o WINDOW w AS (PARTITION BY deal_id, role, ok ORDER BY ord))
SELECT ord, CASE WHEN name = 'n/a' THEN 'placeholder' WHEN role NOT IN ('buyer', 'seller') THEN 'bad_role' WHEN NOT ok THEN 'gate_failed' WHEN coalesce(held, first_id) <> entity_id THEN 'conflict' WHEN held IS NOT NULL OR place > 1 THEN 'same' ELSE 'attached' END AS status FROM f"""


@query("deal_parties", sql=PARTY)
def attach_party(parties):
    i = c("i")
    b = parties.filter("role = 'buyer'").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    b = b.select((c("deal_id") * 4 + i).alias("ord"), "deal_id", F.when(i == 2, "broker").otherwise(c("role")).alias("role"), F.when(i == 1, "n/a").otherwise(c("entity_id")).alias("name"), F.when(i == 3, "X9").otherwise(c("entity_id")).alias("entity_id"), (c("amount_gate_passed") | (i == 3)).alias("gate"))
    return G.attach_party(parties.filter("amount_gate_passed").select("deal_id", "role", "entity_id"), b)


@query("deals", sql="SELECT deal_id, CASE WHEN sqft IS NULL AND q IS NOT NULL THEN 'filled' WHEN abs(sqft - q) > 0.2 * sqft THEN 'flagged' ELSE 'kept' END AS sqft_status FROM (SELECT deal_id, sqft, CASE WHEN deal_id % 6 = 0 THEN 5000 WHEN deal_id % 6 = 1 THEN sqft END AS q FROM deals)")
def rolling_fill(deals):
    n = c("deal_id")
    q = F.when(n % 6 == 0, 5000).when(n % 6 == 1, c("sqft"))
    return deals.select("deal_id", G.fill_or_flag(c("sqft"), q).alias("sqft_status"))


@query("review_queue", sql="SELECT DISTINCT object_type, object_id, issue_class FROM (SELECT object_type, object_id // 2 AS object_id, issue_class FROM review_queue) b WHERE NOT EXISTS (SELECT 1 FROM review_queue r WHERE r.status = 'open' AND r.object_type = b.object_type AND r.object_id = b.object_id AND r.issue_class = b.issue_class)")
def queue_review_once(reviews):
    keys = ["object_type", "object_id", "issue_class"]
    batch = reviews.select("object_type", F.expr("object_id div 2").alias("object_id"), "issue_class")
    return G.queue_once(reviews.filter("status = 'open'"), batch, keys)


@query("contacts", sql="WITH b AS (SELECT contact_id AS ord, entity_id, phone, CASE WHEN contact_id % 2 = 0 THEN email END AS email FROM contacts), s AS (SELECT * FROM contacts WHERE confidence >= 60) SELECT ord, CASE WHEN s.contact_id IS NULL THEN 'inserted' WHEN (s.phone IS NULL AND b.phone IS NOT NULL) OR (s.email IS NULL AND b.email IS NOT NULL) THEN 'filled' ELSE 'same' END AS status FROM b LEFT JOIN s ON s.entity_id = b.entity_id AND (s.phone = b.phone OR s.email = b.email) AND coalesce(s.phone = b.phone, true) AND coalesce(s.email = b.email, true)")
def contact_upsert(contacts):
    b = contacts.select(c("contact_id").alias("ord"), "entity_id", "phone", F.when(c("contact_id") % 2 == 0, c("email")).alias("email")).alias("b")
    s = contacts.filter("confidence >= 60").alias("s")
    same = [c(f"s.{f}") == c(f"b.{f}") for f in ("phone", "email")]
    met = (c("s.entity_id") == c("b.entity_id")) & (same[0] | same[1]) & F.coalesce(same[0], F.lit(True)) & F.coalesce(same[1], F.lit(True))
    filled = (c("s.phone").isNull() & c("b.phone").isNotNull()) | (c("s.email").isNull() & c("b.email").isNotNull())
    return b.join(s, met, "left").select("ord", F.when(c("s.contact_id").isNull(), "inserted").when(filled, "filled").otherwise("same").alias("status"))


@query("raw_names", "entities", "contacts", sql="SELECT DISTINCT e.entity_id, concat('555-', CAST(n.id AS VARCHAR)) AS phone FROM (SELECT id, upper(trim(name)) AS name FROM raw_names) n JOIN entities e ON e.norm_name = replace(replace(n.name, ' L.L.C.', ''), 'THE ', '') WHERE NOT EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = e.entity_id AND k.phone IS NOT NULL)")
def contact_harvest(names, entities, contacts):
    staged = names.select(F.replace(F.replace(F.upper(F.trim("name")), F.lit(" L.L.C."), F.lit("")), F.lit("THE "), F.lit("")).alias("norm_name"), F.concat(F.lit("555-"), c("id").cast("string")).alias("phone"))
    met = staged.join(entities, "norm_name").select("entity_id", "phone").dropDuplicates()
    return met.join(contacts.filter("phone IS NOT NULL"), "entity_id", "left_anti")


@query("entities", "contacts", sql="SELECT entity_id FROM entities e WHERE mailing_address IS NULL AND NOT EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = e.entity_id AND source = 'registry') ORDER BY entity_key, entity_id LIMIT 100")
def dos_targets(entities, contacts):
    return entities.filter("mailing_address IS NULL").join(contacts.filter("source = 'registry'"), "entity_id", "left_anti").orderBy("entity_key", "entity_id").limit(100).select("entity_id")


@query("interactions", sql="SELECT count(*) AS n FROM (SELECT DISTINCT entity_id, occurred_at, notes FROM interactions WHERE channel IN ('call', 'email') EXCEPT SELECT entity_id, occurred_at, notes FROM interactions WHERE channel NOT IN ('call', 'email'))")
def interaction_append(interactions):
    key = ["entity_id", "occurred_at", "notes"]
    fresh = interactions.filter("channel IN ('call', 'email')").dropDuplicates(key).join(interactions.filter("channel NOT IN ('call', 'email')"), key, "left_anti")
    return fresh.agg(F.count(F.lit(1)).alias("n"))


@query("review_queue", sql="SELECT review_id, CASE review_id % 3 WHEN 0 THEN 'merged' WHEN 1 THEN 'dismissed' ELSE 'resolved' END AS outcome FROM review_queue WHERE status = 'open' AND severity = 'high'")
def review_decisions_apply(reviews):
    n = c("review_id")
    # Two decisions on some items: the first counts.
    decided = reviews.filter("severity = 'high'").select(n, F.explode(F.array(F.struct(F.lit(1).alias("at"), F.when(n % 3 == 0, "confirm_merge").when(n % 3 == 1, "dismiss").otherwise("resolve").alias("act")), F.struct(F.lit(2).alias("at"), F.lit("dismiss").alias("act")))).alias("d"))
    first = decided.groupBy("review_id").agg(F.min_by("d.act", "d.at").alias("act"))
    names = C.lookup({"confirm_merge": "merged", "dismiss": "dismissed", "resolve": "resolved"}, c("act"))
    return reviews.filter("status = 'open'").join(first, "review_id").select("review_id", names.alias("outcome"))


@query("upload_rows", sql="SELECT upload_id, CASE WHEN max(CASE WHEN status = 'review' THEN 1 ELSE 0 END) = 1 THEN 'review_pending' ELSE 'imported' END AS status FROM upload_rows GROUP BY upload_id")
def upload_status_rollup(rows):
    return rows.groupBy("upload_id").agg(F.when(F.max(F.when(c("status") == "review", 1).otherwise(0)) == 1, "review_pending").otherwise("imported").alias("status"))


@query("deals", "properties", sql="SELECT property_id FROM properties p WHERE NOT EXISTS (SELECT 1 FROM deals d WHERE d.property_id = p.property_id AND NOT (sale_price IS NULL AND units IS NULL))")
def malformed_cleanup(deals, properties):
    kept = deals.filter("NOT (sale_price IS NULL AND units IS NULL)")
    return properties.join(kept, "property_id", "left_anti").select("property_id")


@query("deals", "exclusion_ledger", sql="SELECT DISTINCT address_norm AS addr_norm, coalesce(sale_price, 0) AS price FROM deals d WHERE bldg_class = 'C0' AND NOT EXISTS (SELECT 1 FROM exclusion_ledger x WHERE x.addr_norm = d.address_norm AND x.price = coalesce(d.sale_price, 0))")
def exclusion_append(deals, ledger):
    batch = deals.filter("bldg_class = 'C0'").select(c("address_norm").alias("addr_norm"), F.coalesce("sale_price", F.lit(0.0)).alias("price"))
    return G.queue_once(ledger, batch, ["addr_norm", "price"])


@query("source_runs", sql="SELECT CAST(started_on AS VARCHAR) AS started_on, job, CASE WHEN status = 'running' THEN 'timeout' ELSE status END AS status FROM source_runs")
def stale_run_timeout(runs):
    stale = (c("status") == "running") & (c("started_on").cast("timestamp") < F.lit("2024-06-01").cast("timestamp") - F.expr("interval 1 hour"))
    return runs.select(c("started_on").cast("string").alias("started_on"), "job", F.when(stale, "timeout").otherwise(c("status")).alias("status"))


@query("fetch_ledger", sql="SELECT url, arg_max(disposition, page_id) AS disposition FROM fetch_ledger GROUP BY url")
def fetch_ledger_upsert(ledger):
    return G.latest_by(ledger, "url", "disposition", "page_id")


# Similarity and resolution ------------------------------------------------------------------------------------------

GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"


def grams(x: str) -> str:
    return GRAMS.format(x=x)


def sim(a: str, b: str) -> str:
    return f"CAST(len(list_intersect({grams(a)}, {grams(b)})) AS DOUBLE) / len(list_distinct(list_concat({grams(a)}, {grams(b)})))"


@query("upload_rows", sql=f"SELECT upload_id, row_num, round({sim('owner', chr(39) + 'Customer 12' + chr(39))}, 6) AS sim FROM upload_rows")
def trgm_similarity(rows):
    return rows.select("upload_id", "row_num", F.round(S.similarity(c("owner"), F.lit("Customer 12")), 6).alias("sim"))


PLACEHOLDER = "lower(trim({x})) = 'n/a'"


def near_sql(left: str, right: str, least: float, strict: bool = False) -> str:
    """(id, entity_id, sim) of the names in left (id, name) and right (entity_id, name), compared all with all."""
    pairs = f"SELECT id, entity_id, CAST(len(list_intersect(n.g, e.g)) AS DOUBLE) / len(list_distinct(list_concat(n.g, e.g))) AS sim FROM (SELECT id, {grams('name')} AS g FROM ({left}) WHERE name IS NOT NULL) n, (SELECT entity_id, {grams('name')} AS g FROM ({right}) WHERE name IS NOT NULL) e"
    return f"SELECT id, entity_id, sim FROM ({pairs}) WHERE sim {'>' if strict else '>='} {least}"


ASKED_NAMES = f"SELECT row_num AS id, upper(owner) AS name FROM asked WHERE NOT {PLACEHOLDER.format(x='owner')}"
FIRM_NAMES = "SELECT entity_id, norm_name AS name FROM firms"


def _asked_names(asked):
    return asked.filter(~N.is_placeholder(c("owner"))).select(c("row_num").alias("id"), F.upper("owner").alias("name"))


@query("asked", "firms", sql=f"SELECT id, entity_id, round(sim, 6) AS sim FROM ({near_sql(ASKED_NAMES, FIRM_NAMES, 0.45)})", also=("join_theta_similarity",))
def trgm_join(asked, firms):
    got = S.trigram_join(_asked_names(asked), firms.select("entity_id", c("norm_name").alias("name")), 0.45, "id", "entity_id")
    return got.select("id", "entity_id", F.round("sim", 6).alias("sim"))


TIERS = f"""WITH q AS ({ASKED_NAMES}), x AS (SELECT q.id, entity_id, 'exact' AS tier, 1.0 AS sim FROM q JOIN firms e ON e.norm_name = q.name), r1 AS (SELECT * FROM q WHERE id NOT IN (SELECT id FROM x)),
a AS (SELECT r1.id, entity_id, 'alias' AS tier, 1.0 AS sim FROM r1 JOIN firm_aliases l ON l.alias_norm = r1.name), r2 AS (SELECT id, name FROM r1 WHERE id NOT IN (SELECT id FROM a)),
u AS (SELECT * FROM x UNION ALL SELECT * FROM a UNION ALL SELECT id, entity_id, 'trigram', sim FROM ({near_sql("SELECT * FROM r2", FIRM_NAMES, 0.45, True)})),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, entity_id) AS rank FROM u) SELECT id, entity_id, tier, round(CAST(sim AS DOUBLE), 6) AS sim, rank FROM k WHERE rank <= 5"""


@query("asked", "firms", "firm_aliases", sql=TIERS)
def resolve_exact_alias_trgm(asked, firms, aliases):
    return S.resolve_tiered(_asked_names(asked), firms, aliases, 0.45).withColumn("sim", F.round("sim", 6))


HISTORY = "SELECT DISTINCT q.entity_id, d.property_id, d.borough, d.asset_type FROM deal_parties q JOIN deals d ON d.deal_id = q.deal_id"
SCORED = f"""WITH h AS ({HISTORY}), s AS (SELECT id, entity_id, max(sim) AS name_score FROM ({near_sql(ASKED_NAMES, FIRM_NAMES + " UNION ALL SELECT entity_id, alias_norm FROM firm_aliases", 0.28)}) GROUP BY 1, 2),
t AS (SELECT DISTINCT z.id, h.entity_id FROM ({near_sql("SELECT row_num AS id, address_norm AS name FROM asked", "SELECT property_id AS entity_id, address_norm AS name FROM properties", 0.72)}) z JOIN h ON h.property_id = z.entity_id),
j AS (SELECT s.id, s.entity_id, name_score, display_name, is_spv_suspect, t.id IS NOT NULL AS here, EXISTS (SELECT 1 FROM h WHERE h.entity_id = s.entity_id AND h.borough = a.borough) AS known, EXISTS (SELECT 1 FROM h WHERE h.entity_id = s.entity_id AND lower(h.asset_type) = lower(a.asset)) AS dealt
  FROM s JOIN asked a ON a.row_num = s.id JOIN firms f ON f.entity_id = s.entity_id LEFT JOIN t ON t.id = s.id AND t.entity_id = s.entity_id),
c AS (SELECT *, round(least(1.0, greatest(0.0, name_score + CASE WHEN here THEN 0.25 ELSE 0 END + CASE WHEN known THEN 0.08 ELSE 0 END + CASE WHEN dealt THEN 0.08 ELSE 0 END - CASE WHEN is_spv_suspect AND NOT here THEN 0.06 ELSE 0 END)), 4) AS score FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, name_score DESC, display_name, entity_id) AS rank FROM c) SELECT id, entity_id, score, rank FROM k WHERE rank <= 5"""


def _scored(asked, firms, aliases, parties, deals, properties):
    wanted = asked.filter(~N.is_placeholder(c("owner"))).select(c("row_num").alias("id"), F.upper("owner").alias("name"), c("address_norm").alias("address"), "borough", "asset")
    history = parties.join(deals, "deal_id").select("entity_id", "property_id", "borough", "asset_type")
    return S.resolve_scored(wanted, firms, aliases, properties, history)


@query("asked", "firms", "firm_aliases", "deal_parties", "deals", "properties", sql=f"SELECT *, max(score) OVER (PARTITION BY id) >= 0.55 AS review FROM ({SCORED})")
def resolve_scored(asked, firms, aliases, parties, deals, properties):
    """The best five candidates of each name; a best score of 0.55 sends the name to review."""
    return _scored(asked, firms, aliases, parties, deals, properties).withColumn("review", F.max("score").over(Window.partitionBy("id")) >= 0.55)


@query("asked", "firms", "firm_aliases", "deal_parties", "deals", "properties", sql=f"WITH b AS (SELECT id, score FROM ({SCORED}) WHERE rank = 1) SELECT row_num, CASE WHEN {PLACEHOLDER.format(x='owner')} THEN 'rejected' WHEN upper(owner) IN (SELECT norm_name FROM firms) THEN 'exact' WHEN upper(owner) IN (SELECT alias_norm FROM firm_aliases) THEN 'alias' WHEN score >= 0.55 THEN 'review' ELSE 'new_entity' END AS outcome FROM asked LEFT JOIN b ON b.id = row_num")
def upload_resolve(asked, firms, aliases, parties, deals, properties):
    """What becomes of each uploaded row: rejected placeholders, exact and alias hits, review where a candidate scores 0.55, else a new entity. Only rows without a hit are scored."""
    named = asked.select("*", F.upper("owner").alias("name"))
    exact, alias = firms.select(c("norm_name").alias("name"), F.lit(True).alias("exact")).distinct(), aliases.select(c("alias_norm").alias("name"), F.lit(True).alias("alias")).distinct()
    j = named.join(exact, "name", "left").join(alias, "name", "left")
    best = _scored(j.filter("exact IS NULL AND alias IS NULL"), firms, aliases, parties, deals, properties).filter("rank = 1").select(c("id").alias("row_num"), "score")
    outcome = F.when(N.is_placeholder(c("owner")), "rejected").when(c("exact"), "exact").when(c("alias"), "alias").when(c("score") >= 0.55, "review").otherwise("new_entity")
    return j.join(best, "row_num", "left").select("row_num", outcome.alias("outcome"))


# Deeds --------------------------------------------------------------------------------------------------------------

DEED = """WITH d AS (SELECT document_id, document_amt AS amount, CAST(deal_date + day_shift * INTERVAL 1 DAY AS DATE) AS deed_day, property_id FROM deed_masters WHERE document_amt > 0),
m AS (SELECT t.deal_id AS target_id, d.document_id, sale_price, coalesce(abs(date_diff('day', deed_day, sale_date)), 9999) AS days FROM deals t JOIN d ON d.property_id = t.property_id WHERE CASE WHEN coalesce(sale_price > 0, false) THEN abs(amount - sale_price) / sale_price <= 0.03 ELSE amount >= 200000 AND coalesce(abs(date_diff('day', deed_day, sale_date)), 9999) <= 240 END),
r AS (SELECT *, row_number() OVER w AS rn, lead(days) OVER w AS second FROM m WINDOW w AS (PARTITION BY target_id ORDER BY days, document_id))
SELECT target_id, document_id FROM r WHERE rn = 1 AND CASE WHEN coalesce(sale_price > 0, false) THEN days <= 400 ELSE second IS NULL OR days < second END"""


@query("deals", "deed_masters", sql=DEED)
def match_deed(deals, masters):
    t = deals.select(c("deal_id").alias("target_id"), c("sale_price").alias("price"), c("sale_date").alias("day"), "property_id")
    d = masters.select("document_id", c("document_amt").alias("amount"), F.date_add("deal_date", c("day_shift")).alias("deed_day"), "property_id")
    return M.match_deed(t, d, ["property_id"])


@query("deals", "deal_parties", sql="SELECT d.deal_id FROM deals d LEFT JOIN (SELECT deal_id, count(DISTINCT role) AS n FROM deal_parties GROUP BY 1) p ON p.deal_id = d.deal_id WHERE source_system <> 'acris' AND coalesce(n, 0) < 2 ORDER BY d.sale_date DESC NULLS LAST, d.deal_id LIMIT 300")
def phase2_targets(deals, parties):
    n = parties.groupBy("deal_id").agg(F.countDistinct("role").alias("n"))
    return deals.filter("source_system <> 'acris'").join(n, "deal_id", "left").filter(F.coalesce("n", F.lit(0)) < 2).orderBy(c("sale_date").desc_nulls_last(), "deal_id").limit(300).select("deal_id")


@query("deals", "properties", sql="SELECT d.deal_id, p.property_id FROM deals d JOIN properties p ON p.borough = d.borough AND p.address_norm = d.address_norm")
def legals_lookup(deals, properties):
    keyed = lambda df, i: df.select(i, "borough", N.house_number(c("address_raw")).alias("number"), N.street_of(c("address_raw")).alias("street"))
    return keyed(deals, "deal_id").join(keyed(properties, "property_id"), ["borough", "number", "street"]).select("deal_id", "property_id")


FRESH = "SELECT m.document_id, CASE WHEN document_amt IS NULL OR document_amt < 150000 THEN 'below_floor' WHEN p.bldg_class IN ('C0', 'C3', 'C6', 'C8') OR (p.bldg_class LIKE 'C%' AND p.units <= 4) THEN 'class_rejected' ELSE 'ok' END AS reason FROM deed_masters m JOIN properties p ON p.property_id = m.property_id"


@query("deed_masters", "properties", sql=FRESH)
def fresh_candidates(masters, properties):
    j = masters.select("document_id", "document_amt", "property_id", F.concat(F.lit("C"), c("o_custkey").cast("string")).alias("buyer"), F.concat(F.lit("S"), c("suppkey").cast("string")).alias("seller")).join(properties, "property_id")
    typed = j.withColumn("asset_type", C.classify_asset(c("bldg_class"), F.lit(None).cast("string"), c("units")))
    return M.fresh_reason(typed, 150000).select("document_id", "reason")


@query("deed_masters", "properties", sql=f"SELECT reason, count(*) AS n FROM ({FRESH}) GROUP BY reason")
def fresh_ingest(masters, properties):
    return fresh_candidates(masters, properties).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("deals", "fetch_ledger", sql="SELECT deal_id FROM deals d WHERE (sqft IS NULL OR units IS NULL) AND NOT EXISTS (SELECT 1 FROM fetch_ledger l WHERE l.page_id = d.deal_id) ORDER BY d.sale_date DESC NULLS LAST, deal_id LIMIT 400")
def rolling_targets(deals, ledger):
    return deals.filter("sqft IS NULL OR units IS NULL").join(ledger.select(c("page_id").alias("deal_id")), "deal_id", "left_anti").orderBy(c("sale_date").desc_nulls_last(), "deal_id").limit(400).select("deal_id")


@query("deals", "properties", sql="SELECT d.deal_id, CASE WHEN count(DISTINCT p.sqft) = 1 THEN max(p.sqft) END AS sqft, CASE WHEN count(DISTINCT p.units) = 1 THEN max(p.units) END AS units FROM deals d JOIN properties p ON p.address_norm = d.address_norm WHERE (d.sqft IS NULL OR d.units IS NULL) AND p.bldg_class NOT LIKE 'R%' GROUP BY d.deal_id")
def rolling_match(deals, properties):
    t = deals.filter("sqft IS NULL OR units IS NULL").select("deal_id", N.house_number(c("address_raw")).alias("number"), N.street_of(c("address_raw")).alias("street"))
    s = properties.select(N.house_number(c("address_raw")).alias("number"), N.street_of(c("address_raw")).alias("street"), "sqft", "units", "bldg_class")
    return M.rolling_match(t, s)


@query("deals", sql="SELECT deal_id, sale_price AS asking_price, CAST(NULL AS VARCHAR) AS sale_date, 'needs_review' AS parse_status FROM deals WHERE source_system = 'crexi'")
def listing_ingest(deals):
    return deals.filter("source_system = 'crexi'").select("deal_id", c("sale_price").alias("asking_price"), F.lit(None).cast("string").alias("sale_date"), F.lit("needs_review").alias("parse_status"))


# Extraction ---------------------------------------------------------------------------------------------------------


@query("pages", sql="SELECT page_id, link, min(pos) AS pos FROM (SELECT page_id, unnest(l) AS link, unnest(range(0, len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"#]+)\"', 1) AS l FROM {pages})) GROUP BY page_id, link")
def extract_page_links(pages):
    return E.page_links(pages).select("page_id", "link", c("pos").cast("bigint").alias("pos"))


@query("deals", "deal_parties", "entities", sql="SELECT d.deal_id, min(CASE WHEN role = 'buyer' THEN display_name END) AS buyer FROM deals d JOIN deal_parties p ON p.deal_id = d.deal_id JOIN entities e ON e.entity_id = p.entity_id GROUP BY d.deal_id")
def extract_party_structured(deals, parties, entities):
    nested = deals.select("deal_id").join(parties, "deal_id").join(entities, "entity_id").groupBy("deal_id").agg(F.array_sort(F.collect_list(F.struct("role", "display_name"))).alias("companies"))
    return nested.select("deal_id", F.get(F.filter("companies", lambda x: x["role"] == "buyer"), F.lit(0))["display_name"].alias("buyer"))


@query("customer", "supplier", sql="SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE concat('Supplier ', c_custkey) END AS buyer, CASE WHEN c_custkey % 2 = 0 THEN concat('Supplier ', c_custkey) ELSE c_name END AS seller FROM {customer}")
def parse_title_parties(customer, supplier):
    other = F.concat(F.lit("Supplier "), c("c_custkey").cast("string"))
    title = F.when(c("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" Acquires 12 Main St from "), other, F.lit(" for $3M"))).otherwise(F.concat("c_name", F.lit(" sells office to "), other, F.lit(" in Queens")))
    p = E.title_parties(title)
    return customer.select(c("c_custkey").alias("id"), p["buyer"].alias("buyer"), p["seller"].alias("seller"))


@query("raw_names", sql=r"SELECT id, CASE WHEN t <> '' AND NOT (regexp_matches(t, '\b(sells?|site|nearly|building)\b', 'i') AND NOT regexp_matches(t, '\b(LLC|INC|LP|CORP|TRUST|GROUP|REALTY|CAPITAL|PARTNERS)\b', 'i')) THEN t END AS party FROM (SELECT id, trim(regexp_replace(regexp_replace(concat(name, CASE WHEN id % 4 = 0 THEN ' site' ELSE ' ;,' END), '\s+', ' ', 'g'), '[\s,;:]+$', '')) AS t FROM raw_names)")
def clean_party_value(names):
    said = F.concat("name", F.when(c("id") % 4 == 0, " site").otherwise(" ;,"))
    return names.select("id", E.clean_party(said).alias("party"))


@query("deals", sql="SELECT deal_id, CASE WHEN deal_id % 3 = 0 THEN NULL ELSE concat('B', deal_id) END AS buyer, address_raw AS address FROM deals")
def parse_caption_kv(deals):
    n = c("deal_id").cast("string")
    caption = F.concat(F.lit("JUST SOLD\nAddress : "), "address_raw", F.when(c("deal_id") % 3 == 0, "\n").otherwise(F.concat(F.lit("\n  buyer: B"), n, F.lit(" \n"))), F.lit("Units: 4"))
    return deals.select("deal_id", E.caption_value(caption, E.CAPTION_LABELS["buyer"]).alias("buyer"), E.caption_value(caption, E.CAPTION_LABELS["address"]).alias("address"))


ASKED = "SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN concat('Best buyer for a $', conv_id + 1, ' million retail') WHEN 1 THEN 'phone of the seller' WHEN 2 THEN concat('recent sales over ', 150000 + conv_id) WHEN 3 THEN 'what was updated' WHEN 4 THEN 'most active buyers 5k' ELSE text END AS q FROM {conversations} WHERE role = 'user'"


def _asked(conversations):
    n, k = c("conv_id"), (c("conv_id") + c("turn")) % 6
    q = (
        F.when(k == 0, F.concat(F.lit("Best buyer for a $"), (n + 1).cast("string"), F.lit(" million retail"))).when(k == 1, "phone of the seller")
        .when(k == 2, F.concat(F.lit("recent sales over "), (150000 + n).cast("string"))).when(k == 3, "what was updated").when(k == 4, "most active buyers 5k").otherwise(c("text"))
    )
    return conversations.filter("role = 'user'").select("conv_id", "turn", q.alias("q"))


@query("conversations", sql=f"SELECT conv_id, turn, CASE {' '.join(f'WHEN regexp_matches(lower(q), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{t}{chr(39)}' for t, p in E.INTENTS)} END AS tool FROM ({ASKED})")
def question_intent(conversations):
    return _asked(conversations).select("conv_id", "turn", E.question_intent(c("q")).alias("tool"))


@query("contacts", sql="SELECT contact_id, CASE WHEN phone IS NULL THEN concat('{\"a\":\"1\",\"b\":\"', source, '\"}') ELSE concat('{\"a\":\"', phone, '\",\"b\":\"', source, '\"}') END AS provenance FROM contacts")
def json_merge(contacts):
    """Later keys win; keys without a value go."""
    later = F.map_filter(F.create_map(F.lit("a"), "phone", F.lit("b"), "source"), lambda k, v: v.isNotNull())
    early = F.map_filter(F.create_map(F.lit("a"), F.lit("1")), lambda k, v: ~F.array_contains(F.map_keys(later), k))
    return contacts.select("contact_id", F.to_json(F.map_concat(early, later)).alias("provenance"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

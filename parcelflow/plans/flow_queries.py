"""Whole flows: files landed and read back, streams run to their end, and enrichments made of several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import normalize as N
from parcelflow.operators import matching as M
from parcelflow.operators import relational as R
from parcelflow.operators import similarity as S
from parcelflow.plans.deal_queries import RECENT, recent_deals
from parcelflow.plans.function_queries import NORM
from parcelflow.plans.state_queries import ASKED_NAMES, DEED, FIRM_NAMES, TIERS, _asked_names, near_sql
from parcelflow.plans.views import frame, with_views
from parcelflow.sources import landing
from parcelflow.sources import tables as T
from parcelflow.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = lambda n: F.col(n)


def query(*views: str, sql: str | None = None):
    """Registers a function of (spark, views...)."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, *[frame(spark, sf_dir, v) for v in views])
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


# Files --------------------------------------------------------------------------------------------------------------

ROW = "SELECT deal_id, CASE WHEN confidence = 50 THEN 'Yonkers' WHEN confidence = 51 THEN NULL ELSE borough END AS borough, address_raw, asset_type, sale_price, units FROM deals"


def _landed_csv(spark, deals) -> str:
    """The deals as a 27-column file, as it would arrive."""
    borough = F.when(c("confidence") == 50, "Yonkers").when(c("confidence") == 51, None).otherwise(c("borough"))
    known = {"Address": c("address_raw"), "Borough": borough, "Asset Type": c("asset_type"), "Sale Price": c("sale_price"), "Units": c("units"), "Shortcode": c("deal_id"), "Buyer": F.concat(F.lit("Buyer "), c("o_custkey").cast("string")), "Seller": F.concat(F.lit("Seller "), c("suppkey").cast("string")), "sale_date_iso": c("sale_date")}
    path = landing.folder(spark, "canonical")
    deals.select(*[known.get(n, F.lit(None)).cast("string").alias(n) for n in T.CANONICAL]).write.option("header", True).option("escape", '"').csv(path)
    return path


@query("deals", sql=f"SELECT deal_id, borough, address_raw, sale_price, CAST(units AS DOUBLE) AS units FROM ({ROW}) WHERE borough IS NULL OR borough <> 'Yonkers'")
def scan_canonical_csv(spark, deals):
    got = T.canonical_csv(spark, _landed_csv(spark, deals))
    return got.select(c("Shortcode").cast("bigint").alias("deal_id"), c("Borough").alias("borough"), c("Address").alias("address_raw"), c("Sale Price").alias("sale_price"), c("Units").alias("units"))


LOAD = "SELECT 'deals' AS name, count(*) AS n FROM d UNION ALL SELECT 'properties', count(*) FROM (SELECT DISTINCT address_raw, borough FROM d) UNION ALL SELECT 'entities', count(*) FROM (SELECT o_custkey AS k, 'b' FROM d UNION SELECT suppkey, 's' FROM d) UNION ALL SELECT 'deal_parties', 2 * count(*) FROM d"


@query("deals", sql=f"WITH d AS (SELECT address_raw, CASE WHEN confidence = 51 THEN NULL ELSE borough END AS borough, o_custkey, suppkey FROM deals WHERE confidence <> 50) {LOAD}")
def load_canonical(spark, deals):
    """The file to star tables: natural keys are made distinct, parties refer to normalised names."""
    df = T.canonical_csv(spark, _landed_csv(spark, deals))
    names = df.select("Shortcode", F.explode(F.array(F.struct(F.lit("buyer").alias("role"), c("Buyer").alias("name")), F.struct(F.lit("seller").alias("role"), c("Seller").alias("name")))).alias("p"))
    parties = names.select("Shortcode", "p.role", N.norm_entity(c("p.name")).alias("norm_name")).filter("norm_name IS NOT NULL")
    star = {"deals": df, "properties": df.select("Address", "Borough").distinct(), "entities": parties.select("norm_name").distinct(), "deal_parties": parties.distinct()}
    out = None
    for name, t in star.items():
        one = t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("exclusion_ledger", sql="SELECT addr_norm, price, reason FROM exclusion_ledger")
def scan_exclusion_csv(spark, ledger):
    path = landing.folder(spark, "exclusions")
    price = F.when(c("price") != 0, c("price"))  # an unknown price is an empty field in the file
    ledger.select("addr_norm", price.alias("price"), "reason", *[F.lit(None).cast("string").alias(n) for n in ("evidence", "address", "borough", "source_url")]).write.option("header", True).csv(path)
    return T.exclusion_csv(spark, path).select("addr_norm", "price", "reason")


@query("deals", sql="SELECT CAST(deal_id AS VARCHAR) AS listing_id, address_raw AS address, asset_type, sale_price AS price FROM deals")
def scan_listings_json(spark, deals):
    path = landing.folder(spark, "listings")
    doc = deals.select(
        F.struct(F.lit("NY").alias("state"), c("address_raw").alias("address")).alias("location"), F.struct(F.array("asset_type").alias("property_types")).alias("property"),
        F.struct(c("deal_id").cast("string").alias("listing_id")).alias("listing"), F.struct(c("sale_price").alias("asking_price")).alias("pricing"),
    )
    doc.write.json(path)
    return T.listings_json(spark, path).select("listing_id", "address", "asset_type", "price")


@query("deals", "properties", "entities", sql="SELECT 'deals' AS name, count(*) AS n FROM deals UNION ALL SELECT 'properties', count(*) FROM properties UNION ALL SELECT 'entities', count(*) FROM entities")
def sink_tables(spark, deals, properties, entities):
    path, names = landing.folder(spark, "star"), ["deals", "properties", "entities"]
    T.write_tables(dict(zip(names, (deals, properties, entities))), path, "v1")
    out = None
    for n in names:
        one = spark.read.parquet(f"{path}/v1/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("deals", sql="SELECT CAST(deal_id AS VARCHAR) AS deal_id, concat(asset_type, '; ', borough) AS tags, concat('{\"m\":\"', market, '\"}') AS extra FROM deals")
def sink_csv_export(spark, deals):
    path = landing.folder(spark, "export")
    T.export_csv(deals.select("deal_id", F.array("asset_type", "borough").alias("tags"), F.struct(c("market").alias("m")).alias("extra")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


# Streams ------------------------------------------------------------------------------------------------------------


ARRIVED = "deal_id bigint, address_norm string, sale_price double, sale_date string, source_system string"


def _streamed(spark, deals) -> incremental.Store:
    """Deals land as files, some of them twice, and are merged by micro-batches into a stored table; a second run finds nothing new."""
    landed, table, check = (landing.folder(spark, n) for n in ("landed", "merged", "stream"))
    rows = deals.select("deal_id", "address_norm", "sale_price", c("sale_date").cast("string").alias("sale_date"), "source_system")
    rows.unionByName(rows.filter("source_system = 'crexi'")).repartition(6, "deal_id").write.parquet(landed)
    for _ in range(2):
        store = incremental.Store(spark, table, ARRIVED, "deal_id")  # as another process would open it
        incremental.ingest(spark, landed, ARRIVED, store.merge, check, files_per_batch=3).awaitTermination()
    return store


@query("deals", sql="SELECT source_system, count(*) AS n, round(sum(sale_price), 2) AS volume FROM deals GROUP BY source_system")
def st_incremental_ingest(spark, deals):
    return _streamed(spark, deals).rows().groupBy("source_system").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sale_price"), 2).alias("volume"))


@query("deals", sql="SELECT 'inserted' AS status, count(*) AS n FROM deals UNION ALL SELECT 'duplicate', count(*) FROM deals WHERE source_system = 'crexi'")
def st_batch_merge(spark, deals):
    return _streamed(spark, deals).stats().groupBy("status").agg(F.sum("n").alias("n"))


def _runs(spark, parts, flow, mode: str, schema: str):
    """Lands each part, then runs the flow over what has come since; all runs share a checkpoint. Returns what the runs wrote, with the number of its batch."""
    landed, out, check = (landing.folder(spark, n) for n in ("landed", "out", "stream"))
    for part in parts:
        part.write.mode("append").parquet(landed)
        incremental.run_to(flow(spark.readStream.schema(schema).parquet(landed)), out, check, mode)
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


@query("pages", sql="SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS pos FROM {pages} WHERE url IS NOT NULL GROUP BY 1")
def st_dedupe_discovery(spark, pages):
    """URLs are discovered in two runs, the pages of odd ids after those of even ones and once more; none is given out twice."""
    urls = pages.filter("url IS NOT NULL").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), c("page_id").cast("bigint").alias("pos"))
    half = urls.agg(F.max("pos")).first()[0] or 0
    early = urls.filter(c("pos") <= half // 2)
    return _runs(spark, [early, urls.filter(c("pos") > half // 2).unionByName(early)], incremental.first_seen, "append", "url string, pos bigint").select("url", "pos")


OUTCOME = "CASE WHEN page_id % {every} = 0 THEN 'fetch_error:HTTP' WHEN page_id % 7 = 0 THEN 'no_deal_node' ELSE 'ok' END"
FETCHED = f"SELECT url, page_id AS nr, {OUTCOME.format(every=5)} AS disposition FROM {{pages}} WHERE url IS NOT NULL"
AGAIN = f"SELECT url, page_id + 1000000000 AS nr, {OUTCOME.format(every=10)} AS disposition FROM {{pages}} WHERE url IS NOT NULL AND page_id % 3 <> 0"
RETRIED = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY nr) AS k FROM ({FETCHED} UNION ALL {AGAIN}) z), f AS (SELECT url, min(k) FILTER (WHERE disposition NOT LIKE 'fetch_error%') AS final, count(*) AS n FROM o GROUP BY url)
SELECT f.url, coalesce(final, n) AS attempts, o.disposition, final IS NULL AS eligible FROM f JOIN o ON o.url = f.url AND o.k = coalesce(final, n)"""


@query("pages", sql=RETRIED)
def st_retry_errors(spark, pages):
    """Two runs of fetches: those that failed transiently stay eligible and are counted, final ones are settled, whatever a later run says of them."""
    outcome = lambda every: F.when(c("page_id") % every == 0, "fetch_error:HTTP").when(c("page_id") % 7 == 0, "no_deal_node").otherwise("ok")
    known = pages.filter("url IS NOT NULL")
    first = known.select("url", c("page_id").cast("bigint").alias("nr"), outcome(5).alias("disposition"))
    second = known.filter("page_id % 3 <> 0").select("url", (c("page_id") + 1000000000).cast("bigint").alias("nr"), outcome(10).alias("disposition"))
    told = _runs(spark, [first, second], incremental.fetch_state, "update", "url string, nr bigint, disposition string")
    last = F.max_by(F.struct("attempts", "disposition", "eligible"), "batch").alias("s")
    return told.groupBy("url").agg(last).select("url", "s.*")


@query("deals", sql="SELECT CAST(day AS VARCHAR) AS day, kind, count(*) AS n FROM (SELECT created_on + update_lag * INTERVAL 1 DAY AS day, parse_status AS kind FROM deals) WHERE day >= TIMESTAMP '2001-07-03' GROUP BY 1, 2")
def st_window_recent(spark, deals):
    """The change feed as a stream: changes of the last thirty days counted in windows of a day. Two runs share the state of the windows; of each window the last count holds."""
    changes = deals.select(F.date_add("created_on", c("update_lag")).cast("timestamp").alias("changed_at"), c("parse_status").alias("kind")).filter("changed_at >= TIMESTAMP '2001-07-03'")
    parts = [changes.filter("changed_at < TIMESTAMP '2001-07-20'"), changes.filter("changed_at >= TIMESTAMP '2001-07-20'")]
    told = _runs(spark, parts, incremental.change_feed, "update", "changed_at timestamp, kind string")
    return told.groupBy(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "kind").agg(F.max_by("n", "batch").alias("n"))


LATE = f"WITH early AS ({DEED.replace('WHERE document_amt > 0)', 'WHERE document_amt > 0 AND suppkey >= 20)')}), every AS ({DEED}) SELECT target_id, document_id, 1 AS run FROM early UNION ALL SELECT target_id, document_id, 2 FROM every WHERE target_id NOT IN (SELECT target_id FROM early)"


@query("deals", "deed_masters", sql=LATE)
def st_late_enrichment(spark, deals, masters):
    """Some deeds arrive weeks late: a later run matches the targets that are still open against all deeds."""
    t = deals.select(c("deal_id").alias("target_id"), c("sale_price").alias("price"), c("sale_date").alias("day"), "property_id")
    d = masters.select("document_id", c("document_amt").alias("amount"), F.date_add("deal_date", c("day_shift")).alias("deed_day"), "property_id", "suppkey")
    first = M.match_deed(t, d.filter("suppkey >= 20").drop("suppkey"), ["property_id"])
    second = M.match_deed(t.join(first, "target_id", "left_anti"), d.drop("suppkey"), ["property_id"])
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))


# Enrichment ---------------------------------------------------------------------------------------------------------

GATED = "SELECT d.deal_id, d.sale_price, m.document_amt, coalesce(abs(date_diff('day', CAST(m.deal_date + m.day_shift * INTERVAL 1 DAY AS DATE), d.sale_date)), 9999) AS days FROM deals d JOIN deed_masters m ON m.document_id = d.deal_id"
PASS = "CASE WHEN coalesce(sale_price > 0, false) THEN coalesce(document_amt > 0 AND abs(document_amt - sale_price) <= sale_price * 0.03, false) ELSE days <= 60 END"


def _gated(deals, masters):
    days = F.coalesce(F.abs(F.datediff(F.date_add("deal_date", c("day_shift")), "sale_date")), F.lit(9999))
    d = deals.join(masters.select(c("document_id").alias("deal_id"), "document_amt", "deal_date", "day_shift"), "deal_id").withColumn("days", days)
    return d.withColumn("passed", R.amount_gate(c("document_amt"), c("sale_price"), c("days")))


@query("deals", "deed_masters", sql=f"SELECT deal_id, coalesce(sale_price, document_amt) AS sale_price, concat('parties from deed ', deal_id) AS notes FROM ({GATED}) WHERE {PASS}")
def acris_party_fill(spark, deals, masters):
    note = F.concat(F.lit("parties from deed "), c("deal_id").cast("string"))
    return _gated(deals, masters).filter("passed").select("deal_id", F.coalesce("sale_price", "document_amt").alias("sale_price"), N.append_note_once(F.lit(None).cast("string"), note).alias("notes"))


PHASE2 = f"WITH t AS (SELECT d.* FROM deals d LEFT JOIN (SELECT deal_id, count(DISTINCT role) AS n FROM deal_parties GROUP BY 1) p ON p.deal_id = d.deal_id WHERE source_system <> 'acris' AND coalesce(n, 0) < 2), m AS ({DEED}), g AS (SELECT deal_id FROM ({GATED}) WHERE {PASS}) SELECT count(*) AS targets, count(m.target_id) AS matched, count(*) FILTER (WHERE m.target_id IS NOT NULL AND g.deal_id IS NOT NULL) AS filled FROM t LEFT JOIN m ON m.target_id = t.deal_id LEFT JOIN g ON g.deal_id = t.deal_id"


@query("deals", "deal_parties", "deed_masters", sql=PHASE2)
def phase2_run(spark, deals, parties, masters):
    """Targets without both parties, matched to deeds, filled where the gate lets them: the run's counts."""
    n = parties.groupBy("deal_id").agg(F.countDistinct("role").alias("n"))
    targets = deals.filter("source_system <> 'acris'").join(n, "deal_id", "left").filter(F.coalesce("n", F.lit(0)) < 2)
    d = masters.select("document_id", c("document_amt").alias("amount"), F.date_add("deal_date", c("day_shift")).alias("deed_day"), "property_id")
    t = targets.select(c("deal_id").alias("target_id"), c("sale_price").alias("price"), c("sale_date").alias("day"), "property_id")
    matched = M.match_deed(t, d, ["property_id"]).select(c("target_id").alias("deal_id"), F.lit(True).alias("m"))
    passed = _gated(deals, masters).filter("passed").select("deal_id", F.lit(True).alias("g"))
    j = targets.select("deal_id").join(matched, "deal_id", "left").join(passed, "deal_id", "left")
    return j.agg(F.count(F.lit(1)).alias("targets"), F.count("m").alias("matched"), F.count_if(c("m") & c("g")).alias("filled"))


REG = "SELECT upper(s_name) AS name, min(s_suppkey) AS id, min(concat(CAST(s_suppkey AS VARCHAR), ' Registry Rd')) AS address, CASE WHEN min(s_suppkey) % 3 = 0 THEN 'REGISTERED AGENTS INC' WHEN min(s_suppkey) % 3 = 1 THEN upper(min(s_name)) ELSE concat('PERSON ', min(s_suppkey)) END AS person FROM {supplier} GROUP BY upper(s_name)"


def _registry(supplier):
    g = supplier.groupBy(F.upper("s_name").alias("norm_name")).agg(F.min("s_suppkey").alias("id"), F.min(F.concat(c("s_suppkey").cast("string"), F.lit(" Registry Rd"))).alias("address"))
    person = F.when(c("id") % 3 == 0, "REGISTERED AGENTS INC").when(c("id") % 3 == 1, c("norm_name")).otherwise(F.concat(F.lit("PERSON "), c("id").cast("string")))
    return g.withColumn("person", person)


@query("entities", "supplier", sql=f"SELECT e.entity_id, coalesce(e.mailing_address, r.address) AS mailing, CASE WHEN r.person <> e.norm_name AND r.person NOT LIKE '%REGISTERED AGENT%' THEN r.person END AS person FROM entities e JOIN ({REG}) r ON r.name = e.norm_name")
def registry_enrich(spark, entities, supplier):
    mill = c("person").rlike(r"(?i)\b(registered agents?|ct corporation|corporation service)\b")
    j = entities.join(_registry(supplier), "norm_name")
    return j.select("entity_id", F.coalesce("mailing_address", "address").alias("mailing"), F.when((c("person") != c("norm_name")) & ~mill, c("person")).alias("person"))


@query("entities", "supplier", "contacts", sql=f"SELECT e.entity_id, r.address AS mailing, NOT EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = e.entity_id AND k.source = 'registry') AS new_contact FROM entities e JOIN ({REG}) r ON r.name = e.norm_name WHERE e.mailing_address IS NULL")
def dos_apply(spark, entities, supplier, contacts):
    """Fills the missing mailing address; each entity gets one registry contact."""
    held = contacts.filter("source = 'registry'").select("entity_id", F.lit(True).alias("held")).distinct()
    return entities.filter("mailing_address IS NULL").join(_registry(supplier), "norm_name").join(held, "entity_id", "left").select("entity_id", c("address").alias("mailing"), c("held").isNull().alias("new_contact"))


BROKERS = "SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN upper(concat(c_name, ' LLC')) END AS company FROM {customer}"


@query("customer", "entities", "entity_aliases", "contacts", sql=f"WITH b AS ({BROKERS}), r AS (SELECT b.id, coalesce(a.entity_id, e.entity_id) AS entity_id FROM b LEFT JOIN entity_aliases a ON a.alias_norm = b.company LEFT JOIN entities e ON e.norm_name = b.name) SELECT id, entity_id FROM r WHERE entity_id IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM contacts WHERE phone IS NOT NULL)")
def broker_contacts(spark, customer, entities, aliases, contacts):
    """A broker's entity is found by the company, else by the name; those without a phone get a contact."""
    b = customer.select(c("c_custkey").alias("id"), F.upper("c_name").alias("norm_name"), F.when(c("c_mktsegment") == "BUILDING", F.upper(F.concat("c_name", F.lit(" LLC")))).alias("alias_norm"))
    j = b.join(aliases.select("alias_norm", c("entity_id").alias("by_company")), "alias_norm", "left").join(entities.select("norm_name", c("entity_id").alias("by_name")), "norm_name", "left")
    found = j.select("id", F.coalesce("by_company", "by_name").alias("entity_id")).filter("entity_id IS NOT NULL")
    return found.join(contacts.filter("phone IS NOT NULL"), "entity_id", "left_anti").select("id", "entity_id")


IMPORT = f"""WITH n AS (SELECT f.id, f.phone, nullif(lower(trim(f.email)), '') AS email, {NORM.replace('name', 'n.name')} AS owner FROM raw_fields f JOIN raw_names n ON n.id = f.id),
b AS (SELECT 'Buyer' AS role, concat('C', id) AS entity_id, owner, nullif(regexp_replace(phone, '[^0-9]', '', 'g'), '') AS phone, CAST(NULL AS VARCHAR) AS email FROM n UNION ALL SELECT 'Seller', concat('S', id), owner, NULL, email FROM n),
k AS (SELECT entity_id, bool_or(phone IS NULL) AS open_phone FROM contacts GROUP BY 1)
SELECT role, CASE WHEN owner IS NULL OR (phone IS NULL AND email IS NULL) THEN 'skipped' WHEN k.entity_id IS NULL THEN 'inserted' WHEN open_phone AND phone IS NOT NULL THEN 'updated' ELSE 'same' END AS status, count(*) AS n FROM b LEFT JOIN k ON k.entity_id = b.entity_id GROUP BY 1, 2"""


@query("raw_fields", "raw_names", "contacts", sql=IMPORT)
def contact_import(spark, fields, names, contacts):
    """Each row gives a buyer's and a seller's contact; placeholders and empty ones are skipped."""
    j = fields.select("id", "phone", "email").join(names, "id").withColumn("owner", N.norm_entity(c("name")))
    no = F.lit(None).cast("string")
    roles = F.array(
        F.struct(F.lit("Buyer").alias("role"), F.concat(F.lit("C"), c("id").cast("string")).alias("entity_id"), N.norm_phone(c("phone")).alias("phone"), no.alias("email")),
        F.struct(F.lit("Seller").alias("role"), F.concat(F.lit("S"), c("id").cast("string")).alias("entity_id"), no.alias("phone"), N.norm_email(c("email")).alias("email")),
    )
    b = j.select("owner", F.explode(roles).alias("r")).select("owner", "r.*")
    k = contacts.groupBy("entity_id").agg(F.bool_or(c("phone").isNull()).alias("open_phone"))
    status = (
        F.when(c("owner").isNull() | (c("phone").isNull() & c("email").isNull()), "skipped").when(c("open_phone").isNull(), "inserted")
        .when(c("open_phone") & c("phone").isNotNull(), "updated").otherwise("same")
    )
    return b.join(k, "entity_id", "left").groupBy("role", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# Resolution with more ---------------------------------------------------------------------------------------------

CONTEXT = f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, entity_id) AS place FROM ({near_sql(ASKED_NAMES, FIRM_NAMES, 0.55, True)})),
p AS (SELECT n.id, n.entity_id, sim FROM n JOIN firms f ON f.entity_id = n.entity_id WHERE place <= 10 AND NOT is_spv_suspect),
k AS (SELECT DISTINCT a.row_num AS id, r.entity_id FROM asked a JOIN deals d ON d.property_id = a.property_id JOIN deal_parties r ON r.deal_id = d.deal_id WHERE lower(trim(a.owner)) <> 'n/a'),
u AS (SELECT coalesce(p.id, k.id) AS id, coalesce(p.entity_id, k.entity_id) AS entity_id, CASE WHEN p.id IS NULL THEN 0.9 WHEN k.id IS NULL THEN p.sim ELSE p.sim + 1.0 END AS score FROM p FULL JOIN k ON k.id = p.id AND k.entity_id = p.entity_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, entity_id) AS rank FROM u) SELECT id, entity_id, round(CAST(score AS DOUBLE), 4) AS score, rank FROM r WHERE rank <= 5"""


@query("asked", "firms", "deal_parties", "deals", sql=CONTEXT)
def resolve_with_context(spark, asked, firms, parties, deals):
    """Names by trigrams, without suspected shell companies, and parties of deals at the address that came with the name: both, 1 more; the address alone, 0.9."""
    near = S.trigram_join(_asked_names(asked), firms.select("entity_id", c("norm_name").alias("name")), 0.55, "id", "entity_id").filter("sim > 0.55")
    near = R.top_per_group(near, ["id"], [c("sim").desc(), c("entity_id")], 10).drop("rank").join(firms.filter("NOT is_spv_suspect").select("entity_id"), "entity_id")
    # Dealt by property, then by id, so that pairs are made distinct and ranked where they are.
    at = parties.join(deals.select("deal_id", "property_id"), "deal_id").select("property_id", "entity_id").repartition("property_id").distinct()
    context = asked.filter(~N.is_placeholder(c("owner"))).select(c("row_num").alias("id"), "property_id").join(at, "property_id").select("id", "entity_id", F.lit(None).cast("double").alias("sim"), F.lit(True).alias("here"))
    met = near.select("id", "entity_id", "sim", F.lit(False).alias("here")).unionByName(context).repartition("id").groupBy("id", "entity_id").agg(F.max("sim").alias("sim"), F.max("here").alias("here"))
    score = F.when(c("sim").isNull(), 0.9).when(c("here"), c("sim") + 1.0).otherwise(c("sim"))
    both = met.select("id", "entity_id", score.alias("score"))
    return R.top_per_group(both, ["id"], [c("score").desc(), c("entity_id")], 5).select("id", "entity_id", F.round("score", 4).alias("score"), "rank")


BEST = f"b AS (SELECT id, entity_id, tier FROM ({TIERS}) WHERE rank = 1)"


def _best(asked, firms, aliases):
    return S.resolve_tiered(_asked_names(asked), firms, aliases, 0.45, 1)


@query("asked", "firms", "firm_aliases", "contacts", sql=f"WITH {BEST} SELECT b.id, b.entity_id, b.tier, e.mailing_address, EXISTS (SELECT 1 FROM contacts k WHERE k.entity_id = b.entity_id) AS has_contact FROM b JOIN firms e ON e.entity_id = b.entity_id")
def contact_lookup_tiered(spark, rows, entities, aliases, contacts):
    held = contacts.select("entity_id", F.lit(True).alias("h")).distinct()
    return _best(rows, entities, aliases).join(entities.select("entity_id", "mailing_address"), "entity_id").join(held, "entity_id", "left").select("id", "entity_id", "tier", "mailing_address", c("h").isNotNull().alias("has_contact"))


@query("asked", "firms", "firm_aliases", "contacts", sql=f"WITH {BEST} SELECT b.id, b.entity_id, string_agg(concat(CASE WHEN is_primary THEN '*' ELSE '' END, coalesce(phone, '-')), ',' ORDER BY is_primary DESC, k.confidence DESC, k.contact_id) AS contacts FROM b JOIN contacts k ON k.entity_id = b.entity_id GROUP BY b.id, b.entity_id")
def q_contact_lookup(spark, rows, entities, aliases, contacts):
    text = F.concat(F.when(c("is_primary"), "*").otherwise(""), F.coalesce("phone", F.lit("-")))
    items = F.array_sort(F.collect_list(F.struct((~c("is_primary")).alias("o"), (-c("confidence")).alias("k"), "contact_id", text.alias("t"))))
    return _best(rows, entities, aliases).join(contacts, "entity_id").groupBy("id", "entity_id").agg(F.array_join(F.transform(items, lambda x: x["t"]), ",").alias("contacts"))


@query("asked", "firms", "firm_aliases", "deal_parties", "deals", sql=f"WITH {BEST} SELECT b.id, p.entity_id, d.deal_id, d.asset_type, CAST(d.sale_date AS VARCHAR) AS sale_date FROM b JOIN deal_parties p ON p.entity_id = b.entity_id AND p.role = 'buyer' JOIN deals d ON d.deal_id = p.deal_id")
def q_entity_history(spark, rows, entities, aliases, parties, deals):
    mine = parties.filter("role = 'buyer'").select("entity_id", "deal_id")
    return _best(rows, entities, aliases).select("id", "entity_id").join(mine, "entity_id").join(deals, "deal_id").select("id", "entity_id", "deal_id", "asset_type", c("sale_date").cast("string").alias("sale_date"))


DRAFTS = f"WITH {RECENT}, t AS (SELECT entity_id, max(sale_price) AS top FROM recent WHERE sale_price IS NOT NULL GROUP BY 1) SELECT t.entity_id, e.display_name, t.top, concat('user', entity_key % 5) AS owner FROM t JOIN entities e ON e.entity_id = t.entity_id ORDER BY t.top DESC, t.entity_id LIMIT 200"


@query("entities", "deal_parties", "deals", sql=DRAFTS)
def q_outreach_drafts_list(spark, entities, parties, deals):
    top = recent_deals(parties, deals).filter("sale_price IS NOT NULL").groupBy("entity_id").agg(F.max("sale_price").alias("top"))
    j = top.join(entities, "entity_id").orderBy(c("top").desc(), "entity_id").limit(200)
    return j.select("entity_id", "display_name", "top", F.concat(F.lit("user"), (c("entity_key") % 5).cast("string")).alias("owner"))


@query("upload_rows", sql="SELECT upload_id, concat('{', string_agg(concat('\"', status, '\":', CAST(n AS VARCHAR)), ',' ORDER BY status), '}') AS stats FROM (SELECT upload_id, status, count(*) AS n FROM upload_rows GROUP BY 1, 2) GROUP BY upload_id")
def json_stats_object(spark, rows):
    n = rows.groupBy("upload_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("upload_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("stats"))


@query("pages", sql=r"SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, regexp_extract(html, '<html lang=.(\w+)', 1) AS lang, CASE WHEN NOT contains(html, '<article>') THEN 'no_deal_node' WHEN regexp_extract(html, '<h1>([^<]*)</h1>', 1) = '' THEN 'no_address' WHEN NOT contains(html, '</html>') THEN 'cut' ELSE 'ok' END AS status FROM {pages}")
def map_deal_page(spark, pages):
    """One record a page, with the reason where it gives none."""
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    status = F.when(~c("html").contains("<article>"), "no_deal_node").when(title == "", "no_address").when(~c("html").contains("</html>"), "cut").otherwise("ok")
    return pages.select("page_id", title.alias("title"), F.regexp_extract("html", r"<html lang=.(\w+)", 1).alias("lang"), status.alias("status"))


@query("deals", sql="SELECT deal_id, sale_price, (SELECT count(*) FROM deals) AS total FROM deals ORDER BY sale_price DESC NULLS LAST, deal_id LIMIT 200 OFFSET 200")
def limit_offset_page(spark, deals):
    page = R.sort_page(deals, "sale_price", ["sale_price"], "deal_id", page=2, per_page=5000)
    return page.select("deal_id", "sale_price").crossJoin(deals.agg(F.count(F.lit(1)).alias("total")))  # one row of totals


@query("deals", sql="SELECT deal_id, CAST(sale_date AS VARCHAR) AS sale_date FROM deals ORDER BY deals.sale_date NULLS LAST, deal_id LIMIT 50")
def sort_dynamic(spark, deals):
    return R.sort_page(deals, "no such column", ["sale_date"], "deal_id", descending=False).select("deal_id", c("sale_date").cast("string").alias("sale_date"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

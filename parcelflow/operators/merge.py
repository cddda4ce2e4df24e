"""Stateful merges as pure functions: (stored rows, an ordered batch) -> decisions.

Batches carry `ord`: an earlier row of a batch is visible to later ones, so each rule is put as a window over ord,
as an aggregate that takes the first row, or, where rows wait for one another, as rounds over the rows still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions.classify import residential_gate, small_unit_flag
from parcelflow.functions.normalize import is_placeholder, norm_contact_address, norm_email, norm_phone, norm_website
from parcelflow.sources import landing


def upsert_fill(stored: DataFrame, batch: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Stored rows with their nulls filled from the batch, and new rows for new keys; keys match null-safely. Of several batch
    rows with one key, each field takes the first value that isn't null."""
    first = batch.groupBy(*keys).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in fields])
    s, b = stored.alias("s"), first.alias("b")
    same = None
    for k in keys:
        test = F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = test if same is None else same & test
    s, b = s.withColumn("_s", F.lit(True)).alias("s"), b.withColumn("_b", F.lit(True)).alias("b")
    held = [F.when(F.col("s._s"), F.col(f"s.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    filled = [F.coalesce(f"s.{f}", f"b.{f}").alias(f) for f in fields]
    return s.join(b, same, "full").select(*held, *filled, F.col("s._s").isNull().alias("is_new"))


def new_entities(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (norm_name, display_name, ord): the names that aren't stored, with the first display name of each."""
    fresh = batch.filter("norm_name IS NOT NULL").groupBy("norm_name").agg(F.min_by("display_name", "ord").alias("display_name"))
    return fresh.join(stored, "norm_name", "left_anti")


def _ledger_key(price: Column) -> Column:
    """Exclusions are kept by whole amounts; an unknown price is 0."""
    return F.coalesce(price, F.lit(0)).cast("bigint")


def class_exclusions(batch: DataFrame) -> DataFrame:
    """(address_norm, _price, reason, since): what the batch's class rejections add to the exclusion ledger, and the ord from which they are in it. A banned type is rejected
    before its class is looked at and adds nothing."""
    gate = residential_gate(F.col("asset_type"), F.col("bldg_class"))
    rejected = batch.withColumn("_gate", gate).filter(F.col("_gate").isin("one_two_family", "condo_unit"))
    first = F.min(F.struct("ord", F.when(F.col("_gate") == "condo_unit", "condo").otherwise("one_two_family").alias("reason"))).alias("f")
    return rejected.groupBy("address_norm", _ledger_key(F.col("sale_price")).alias("_price")).agg(first).select("address_norm", "_price", "f.reason", F.col("f.ord").alias("since"))


def _claims(df: DataFrame, *more: str) -> DataFrame:
    """df with _doc and _key, what a row claims when it is stored: its deed id, and its property (address and borough), price and date. A row without an address or a borough is a
    property of its own and claims no key; unknown prices and dates are values."""
    known = F.col("address_norm").isNotNull() & F.col("borough").isNotNull()
    key = F.struct("address_norm", "borough", "sale_price", F.col("sale_date").cast("string").alias("sale_date"))
    doc = F.when(F.col("doc_id") != "", F.col("doc_id"))
    return df.select(*more, doc.alias("_doc"), F.when(known, F.to_json(key, {"ignoreNullFields": "false"})).alias("_key"))


def first_come(rows: DataFrame) -> DataFrame:
    """rows (ord, _doc, _key) -> those that are stored if they come one after another and a row is refused whose deed id or key a stored one has.

    A refused row claims nothing, so whether a row is stored depends on the rows before it that share a claim, on those before them, and so on. In each round the rows
    that come first of all open rows with their deed id and of all with their key are stored, and open rows that share a claim with these are refused. Claims are pre-aggregated before they
    are joined, so a hot one can be split. Rounds go on, each over the open rows only, until none is left: at least the first open row is stored each time; there are as many rounds as the
    longest chain of rows, each refused only for the sake of the one before (two or three in practice)."""
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = landing.folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    open_, won = kept(rows, "open"), None
    while not open_.isEmpty():
        out = open_
        for claim in ("_doc", "_key"):
            first = open_.filter(F.col(claim).isNotNull()).groupBy(claim).agg(F.min("ord").alias(f"_first{claim}"))
            out = out.join(first, claim, "left")
        wins = kept(out.filter(" AND ".join(f"({c} IS NULL OR ord = _first{c})" for c in ("_doc", "_key"))).select("ord", "_doc", "_key"), "won")
        won = wins if won is None else won.unionByName(wins)
        rest = open_.join(wins.select("ord"), "ord", "left_anti")
        for claim in ("_doc", "_key"):
            rest = rest.join(wins.filter(F.col(claim).isNotNull()).select(claim), claim, "left_anti")
        open_ = kept(rest, "open")
    return won if won is not None else open_


def merge_status(stored: DataFrame, batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """stored (doc_id, address_norm, borough, sale_price, sale_date), batch (ord and the same, asset_type, bldg_class, units, source_system), ledger (addr_norm, price) -> (ord, status),
    as if the rows came one after another:

    rejected_excluded, if the ledger has the address and price, or an earlier row was rejected for its class with the same; rejected_banned_type; rejected_one_two_family and
    rejected_condo_class, for the building's class; duplicate_doc, if a stored row or an earlier one that was merged has the deed id; duplicate_key, if one has the property, price
    and date; else merged, or merged_flagged where small units lack class evidence. ord is unique. Rows that are not merged claim neither deed id nor key."""
    price = _ledger_key(F.col("sale_price"))
    out = batch.withColumn("_price", price)
    held = ledger.select(F.col("addr_norm").alias("address_norm"), _ledger_key(F.col("price")).alias("_price"), F.lit(True).alias("_out")).distinct()
    out = out.join(held, ["address_norm", "_price"], "left").join(class_exclusions(batch).drop("reason"), ["address_norm", "_price"], "left")
    gate = residential_gate(F.col("asset_type"), F.col("bldg_class"))
    excluded = F.coalesce("_out", F.lit(False)) | F.coalesce(F.col("since") < F.col("ord"), F.lit(False))
    gated = F.when(excluded, "rejected_excluded").when(gate == "banned_asset_type", "rejected_banned_type").when(gate == "one_two_family", "rejected_one_two_family").when(gate == "condo_unit", "rejected_condo_class")
    small = small_unit_flag(F.col("source_system"), F.col("bldg_class"), F.col("units"), F.col("asset_type"))
    out = out.withColumn("_gate", gated).withColumn("_small", small)
    out = _claims(out, "ord", "_gate", "_small")
    claimed = _claims(stored)
    docs = claimed.filter("_doc IS NOT NULL").select("_doc", F.lit(True).alias("_doc_held")).distinct()
    keys = claimed.filter("_key IS NOT NULL").select("_key", F.lit(True).alias("_key_held")).distinct()
    out = out.join(docs, "_doc", "left").join(keys, "_key", "left")
    won = first_come(out.filter("_gate IS NULL AND _doc_held IS NULL AND _key_held IS NULL").select("ord", "_doc", "_key"))
    by_doc = won.filter("_doc IS NOT NULL").select("_doc", F.col("ord").alias("_winner"))
    out = out.join(by_doc, "_doc", "left").join(won.select("ord", F.lit(True).alias("_won")), "ord", "left")
    earlier = F.coalesce("_doc_held", F.lit(False)) | F.coalesce(F.col("_winner") < F.col("ord"), F.lit(False))
    status = F.when(F.col("_gate").isNotNull(), F.col("_gate")).when(F.col("_won"), F.when(F.col("_small"), "merged_flagged").otherwise("merged")).when(earlier, "duplicate_doc").otherwise("duplicate_key")
    return out.select("ord", status.alias("status"))


def null_tolerant_status(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (ord, property_id, sale_price, sale_date): a row repeats a stored or an earlier row of its property and price if the
    dates are equal or either is unknown. In closed form for each (property, price): with any null date stored, every row repeats; with
    only known dates stored, a row is new if its date is known, not stored, and first in the batch; with nothing stored, the first row is new, and, if its
    date is known, so are later first occurrences of other known dates."""
    group = ["property_id", "sale_price"]

    def met(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
        right = right.withColumnsRenamed({k: f"_{name}_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_{name}_{k}")) for k in keys]
        return left.join(right, reduce(lambda a, b: a & b, same), "left").drop(*[f"_{name}_{k}" for k in keys])

    # Groups and dates are reduced before they are joined, so no group is gathered: neither its dates nor its rows.
    out = met(batch, stored.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("sale_date").isNull()).alias("_null")), group, "s")
    out = met(out, stored.filter("sale_date IS NOT NULL").select(*group, "sale_date").distinct().withColumn("_held", F.lit(True)), [*group, "sale_date"], "d")
    out = met(out, batch.groupBy(*group).agg(F.min(F.struct("ord", F.col("sale_date").isNull().alias("null"))).alias("_first")), group, "b")
    out = met(out, batch.groupBy(*group, "sale_date").agg(F.min("ord").alias("_first_of_date")), [*group, "sale_date"], "o")
    fresh_date = F.col("sale_date").isNotNull() & (F.col("_first_of_date") == F.col("ord"))
    new = F.when(F.col("_null"), False).when(F.col("_n") > 0, fresh_date & F.col("_held").isNull()).otherwise((F.col("_first.ord") == F.col("ord")) | ~F.col("_first.null") & fresh_date)
    return out.select("ord", F.when(F.coalesce(new, F.lit(False)), "inserted").otherwise("duplicate").alias("status"))


def match_by_priority(stored: DataFrame, batch: DataFrame, keys: list[list[str]], stored_id: str) -> DataFrame:
    """(ord, matched, rule): the stored row that a batch row matches by the first of several keys, the smallest of those with that key; a key with a null in it
    matches nothing unless it is the last one, which matches null-safely. The stored rows of a key are reduced to the smallest before they are joined, so no row meets more than one."""
    out = None
    for i, key in enumerate(keys):
        b, s = batch.select("ord", *key).alias("b"), stored.groupBy(*key).agg(F.min(stored_id).alias("matched")).alias("s")
        test = None
        for k in key:
            one = F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}")) if i == len(keys) - 1 else F.col(f"b.{k}") == F.col(f"s.{k}")
            test = one if test is None else test & one
        met = b.join(s, test).select("b.ord", "s.matched", F.lit(i).alias("rule"))
        out = met if out is None else out.unionByName(met)
    best = out.groupBy("ord").agg(F.min(F.struct("rule", "matched")).alias("m"))
    return batch.select("ord").join(best, "ord", "left").select("ord", F.col("m.matched").alias("matched"), F.col("m.rule").alias("rule"))


def differing(pairs: list[tuple[str, Column, Column]]) -> Column:
    """The names whose stored and incoming values are both known and differ, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(a != b, name) for name, a, b in pairs])), ",")


def attach_party(held: DataFrame, batch: DataFrame) -> DataFrame:
    """held (deal_id, role, entity_id), batch (ord, deal_id, role, name, entity_id, gate): one status for each row: placeholder, bad_role, gate_failed, conflict with the
    role's holder (stored, or the first that the batch attaches), same, or attached."""
    ok = ~is_placeholder(F.col("name")) & F.col("role").isin("buyer", "seller") & F.coalesce("gate", F.lit(False))
    out = batch.join(held.select("deal_id", "role", F.col("entity_id").alias("_held")), ["deal_id", "role"], "left").withColumn("_ok", ok)
    first = F.first("entity_id").over(Window.partitionBy("deal_id", "role", "_ok").orderBy("ord"))
    place = F.row_number().over(Window.partitionBy("deal_id", "role", "_ok").orderBy("ord"))
    out = out.withColumn("_first", first).withColumn("_place", place)
    holder = F.coalesce("_held", "_first")
    status = (
        F.when(is_placeholder(F.col("name")), "placeholder").when(~F.col("role").isin("buyer", "seller"), "bad_role").when(~F.col("_ok"), "gate_failed")
        .when(holder != F.col("entity_id"), "conflict").when(F.col("_held").isNotNull() | (F.col("_place") > 1), "same").otherwise("attached")
    )
    return out.select("ord", status.alias("status"))


def fill_or_flag(stored: Column, incoming: Column, tolerance: float = 0.2) -> Column:
    """filled, flagged where both are known and differ by more than the tolerance, else kept."""
    return F.when(stored.isNull() & incoming.isNotNull(), "filled").when(F.abs(stored - incoming) > tolerance * stored, "flagged").otherwise("kept")


def queue_once(open_items: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's items that aren't open yet, each once."""
    return batch.select(*keys).dropDuplicates(keys).join(open_items.select(*keys), keys, "left_anti")


def latest_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def dedupe_contacts(contacts: DataFrame) -> DataFrame:
    """contacts (contact_id, entity_id, role, phone, email, website, mailing_address, is_primary, created) -> (entity_id, keep_id, removed): contacts of one entity and role are the same if their
    normalised phones, mails, websites and addresses are, unknown ones being alike. The primary one stays, then the one with most known (phone and mail 4, website 2, address 1), then the oldest.
    The survivor is a minimum, so the copies of a hot contact are reduced before they are shuffled."""
    full = sum((F.when(F.col(f).isNotNull(), w).otherwise(0) for f, w in (("phone", 4), ("email", 4), ("website", 2), ("mailing_address", 1))), F.lit(0))
    best = F.min(F.struct((~F.col("is_primary")).alias("second"), (-full).alias("less"), "created", "contact_id"))
    blank = lambda x: F.coalesce(x, F.lit(""))
    same = [blank(norm_phone(F.col("phone"))).alias("p"), blank(norm_email(F.col("email"))).alias("m"), blank(norm_website(F.col("website"))).alias("w"), blank(norm_contact_address(F.col("mailing_address"))).alias("a")]
    groups = contacts.groupBy("entity_id", "role", *same).agg(best.alias("best"), (F.count(F.lit(1)) - 1).alias("removed"))
    return groups.select("entity_id", F.col("best.contact_id").alias("keep_id"), "removed")

"""Deed matching and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Prices within 3 % of each other lie in the same or in neighbouring bands of this width in their logarithms (ln 0.97 is -0.0305); days within 240 of each other, in such bands of 241 days.
PRICE_BAND, DAY_BAND = 0.0306, 241


def _price_band(price: Column) -> Column:
    return F.floor(F.log(price) / PRICE_BAND).cast("bigint")


def _day_band(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / DAY_BAND).cast("bigint")


def _near(band: Column) -> Column:
    return F.explode(F.array(band - 1, band, band + 1))


def match_deed(targets: DataFrame, deeds: DataFrame, keys: list[str]) -> DataFrame:
    """targets (target_id, price, day, *keys), deeds (document_id, amount, deed_day, *keys) -> (target_id, document_id).

    A priced target takes, of the deeds within 3 % of its price, the nearest in time, at most 400 days away (9999 for an unknown date). One
    without a price takes the nearest deed of at least 200,000 within 240 days, if no other is as near.

    A band join: priced targets meet the deeds of their property in their band of prices and its neighbours, others those in their band of days and its neighbours, so
    a property with many deeds is not met by each of its targets with all of them."""
    priced = F.coalesce(F.col("price") > 0, F.lit(False))
    days = F.coalesce(F.abs(F.datediff("day", "deed_day")), F.lit(9999))
    held = deeds.filter("amount > 0")
    by_price = targets.filter(priced).withColumn("_band", _near(_price_band(F.col("price")))).join(held.withColumn("_band", _price_band(F.col("amount"))), [*keys, "_band"])
    by_price = by_price.filter(F.abs(F.col("amount") - F.col("price")) / F.col("price") <= 0.03).select("target_id", "document_id", days.alias("_days"), F.lit(True).alias("_priced"))
    by_day = targets.filter(~priced & F.col("day").isNotNull()).withColumn("_band", _near(_day_band(F.col("day")))).join(held.filter("amount >= 200000").withColumn("_band", _day_band(F.col("deed_day"))), [*keys, "_band"])
    by_day = by_day.select("target_id", "document_id", days.alias("_days"), F.lit(False).alias("_priced")).filter("_days <= 240")
    w = Window.partitionBy("target_id").orderBy("_days", "document_id")
    ranked = by_price.unionByName(by_day).withColumn("_rank", F.row_number().over(w)).withColumn("_second", F.lead("_days").over(w))
    best = ranked.filter("_rank = 1").filter(F.when(F.col("_priced"), F.col("_days") <= 400).otherwise(F.col("_second").isNull() | (F.col("_days") < F.col("_second"))))
    return best.select("target_id", "document_id")


def fresh_reason(deeds: DataFrame, least: float) -> DataFrame:
    """Adds reason: why a deed is no candidate, or ok."""
    same = F.col("buyer").eqNullSafe(F.col("seller"))
    reason = (
        F.when(F.col("address_norm").isNull() | ~F.col("address_norm").rlike(r"^\d"), "bad_address")
        .when(F.coalesce(F.col("document_amt") < least, F.lit(True)), "below_floor")
        .when(F.col("asset_type").isNull(), "class_rejected").when(same, "same_party").otherwise("ok")
    )
    return deeds.withColumn("reason", reason)


def rolling_match(targets: DataFrame, sales: DataFrame) -> DataFrame:
    """targets (deal_id, number, street), sales (number, street, sqft, units, bldg_class) -> (deal_id, sqft, units): values on which all candidates agree;
    condominium classes don't count, nor do values below one."""
    met = targets.join(sales.filter(~F.coalesce(F.col("bldg_class").startswith("R"), F.lit(False))), ["number", "street"])
    agreed = []
    for name in ("sqft", "units"):
        value = F.when(F.col(name) > 0, F.col(name))
        agreed.append(F.when(F.countDistinct(value) == 1, F.max(value)).alias(name))
    return met.groupBy("deal_id").agg(*agreed)

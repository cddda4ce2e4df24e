"""Filters, rankings and roll-ups over deals, parties and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.sources import landing

MIN_MAX = ["sale_price", "units", "sqft", "sale_date"]


def filter_deals(deals: DataFrame, q: str | None = None, has_buyer: bool | None = None, confidence_min: int | None = None, ppsf_max: float | None = None, **equal_or_range) -> DataFrame:
    """Optional predicates, folded into one condition: text on three columns (q; % and _ are wildcards), equality by column name,
    <column>_min and <column>_max on price, units, sqft and date. Empty strings count as no filter."""
    test = F.lit(True)
    if q:
        test &= F.col("address_raw").ilike(f"%{q}%") | F.col("buyer").ilike(f"%{q}%") | F.col("seller").ilike(f"%{q}%")
    for name, value in equal_or_range.items():
        if value in (None, ""):
            continue
        base = name.removesuffix("_min").removesuffix("_max")
        if base not in MIN_MAX or base == name:
            test &= F.col(name) == value
        else:
            test &= F.col(base) >= value if name.endswith("_min") else F.col(base) <= value
    if ppsf_max is not None:
        test &= F.col("sale_price") / F.when(F.col("sqft") > 0, F.col("sqft")) <= ppsf_max
    if confidence_min is not None:
        test &= F.col("confidence") >= confidence_min
    if has_buyer is not None:
        test &= F.col("buyer").isNotNull() == has_buyer
    return deals.filter(test)


def sort_page(df: DataFrame, sort: str, allowed: list[str], tie: str, descending: bool = True, page: int = 1, per_page: int = 50) -> DataFrame:
    """One page in a stable order; an unknown sort column falls back to the first allowed one; per_page is kept in 1 to 200."""
    column = F.col(sort if sort in allowed else allowed[0])
    size = min(200, max(1, per_page))
    return df.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_last(), tie).offset((max(1, page) - 1) * size).limit(size)


def first_party(parties: DataFrame, role: str) -> DataFrame:
    return parties.filter(F.col("role") == role).groupBy("deal_id").agg(F.min("entity_id").alias(f"{role}_id"))


def with_parties(deals: DataFrame, parties: DataFrame, entities: DataFrame) -> DataFrame:
    """deals with the first buyer's and seller's name; one aggregation finds both, so deals are joined once."""
    first = parties.groupBy("deal_id").agg(*[F.min(F.when(F.col("role") == r, F.col("entity_id"))).alias(f"{r}_id") for r in ("buyer", "seller")])
    out = deals.join(first, "deal_id", "left")
    for r in ("buyer", "seller"):
        names = entities.select(F.col("entity_id").alias(f"{r}_id"), F.col("display_name").alias(r))
        out = out.join(names, f"{r}_id", "left")
    return out


def star(parties: DataFrame, entities: DataFrame, deals: DataFrame) -> DataFrame:
    return parties.join(deals, "deal_id").join(entities, "entity_id")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark keeps n rows of a group in each partition before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def latest_per_property(deals: DataFrame) -> DataFrame:
    return top_per_group(deals, ["property_id"], [F.col("sale_date").desc_nulls_last(), F.col("deal_id").desc()]).drop("rank")


def rollup_parties(parties: DataFrame, entities: DataFrame, deals: DataFrame, role: str) -> DataFrame:
    """One row for each entity in a role: deals, volume, price range, dates, and the sets of its asset types and boroughs."""
    joined = star(parties.filter(F.col("role") == role), entities, deals)
    return joined.groupBy("entity_id", "display_name", "is_spv_suspect").agg(
        F.countDistinct("deal_id").alias("n_deals"),
        F.round(F.coalesce(F.sum("sale_price"), F.lit(0.0)), 2).alias("volume"),
        F.min("sale_price").alias("min_price"),
        F.max("sale_price").alias("max_price"),
        F.min("sale_date").cast("string").alias("first_date"),
        F.max("sale_date").cast("string").alias("last_date"),
        F.array_join(F.array_sort(F.collect_set("asset_type")), ",").alias("asset_types"),
        F.array_join(F.array_sort(F.collect_set("borough")), ",").alias("boroughs"),
    )


def contact_flags(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_contacts"), F.count("email").alias("n_emails"), F.count("phone").alias("n_phones"), F.bool_or(F.col("phone").isNotNull() | F.col("email").isNotNull()).alias("reachable")
    )


def amount_gate(deed_amount: Column, price: Column, days: Column) -> Column:
    """The deed is positive and within 3 % of the price, or, where no price is known, at most 60 days away."""
    priced = F.coalesce(price > 0, F.lit(False))
    near = (deed_amount > 0) & (F.abs(deed_amount - price) <= price * 0.03)
    return F.when(priced, F.coalesce(near, F.lit(False))).otherwise(F.coalesce(days <= 60, F.lit(False)))


def amount_gate_sync(deed_amount: Column, price: Column) -> Column:
    """The batch variant: a deed amount is required, and so is a price."""
    return F.coalesce((deed_amount > 0) & (price > 0) & (F.abs(deed_amount - price) <= price * 0.03), F.lit(False))


def exact_median(df: DataFrame, group: list[str], value: str, name: str = "median", buckets: int = 1024) -> DataFrame:
    """The exact median of each group (of an even number of values the mean of the middle two), null where a group has no value; nulls don't count.

    Values are first counted within (group, value), so a hot group's values are spread and its repeats reduced. Then histograms narrow down: a round counts each group's values in
    `buckets` equal ranges, at most so many rows a group, and the next looks into the range that holds the middle only. A round's ranges end at values that occur, so each round
    splits what is left, and the last has one value, or two neighbouring ones."""
    spark = df.sparkSession

    def kept(d: DataFrame, label: str) -> DataFrame:
        path = landing.folder(spark, label)
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    key = F.struct(*group, F.lit(1).alias("_one")).alias("_g")
    counted = kept(df.groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k")), "values")
    known = counted.filter("_v IS NOT NULL")
    state = known.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.lit(0).cast("bigint").alias("_before"), F.sum("_k").alias("_n"))
    done, now = None, kept(state, "ranges")
    for _ in range(200):
        # Settled: one value is left in the range.
        one = now.filter("_low = _high").select("_g", F.col("_low").alias("_m"))
        done = one if done is None else done.unionByName(one)
        now = now.filter("_low < _high")
        if now.isEmpty():
            break
        inside = known.join(now, "_g").filter("_v BETWEEN _low AND _high")
        at = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * buckets), F.lit(buckets - 1))
        histogram = inside.groupBy("_g", "_n", "_before", at.alias("_b")).agg(F.sum("_k").alias("_k"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
        w = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        histogram = histogram.withColumn("_below", F.col("_before") + F.coalesce(F.sum("_k").over(w), F.lit(0)))
        holds = lambda rank: (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_k"))
        lower, upper = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
        middle = histogram.filter(holds(lower) | holds(upper)).groupBy("_g", "_n").agg(F.count(F.lit(1)).alias("_ranges"), F.min("_last").alias("_a"), F.max("_first").alias("_z"), F.min("_first").alias("_low"), F.max("_last").alias("_high"), F.min("_below").alias("_before"))
        middle = kept(middle, "ranges")
        # The two middle values lie on both sides of a border: the last of one range and the first of the next.
        done = done.unionByName(middle.filter("_ranges = 2").select("_g", ((F.col("_a") + F.col("_z")) / 2).alias("_m")))
        now = middle.filter("_ranges = 1").select("_g", "_low", "_high", "_before", "_n")
    else:
        raise ArithmeticError("a range of values is too wide for double arithmetic")
    groups = counted.select("_g").distinct()
    return groups.join(done, "_g", "left").select(*[F.col(f"_g.{c}").alias(c) for c in group], F.col("_m").alias(name))

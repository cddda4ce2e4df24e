"""Readers of landed files, each with a fixed schema, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = [
    "Sale Date", "sale_date_iso", "Post Date", "Address", "Borough", "Market", "Asset Type", "Buyer", "Seller", "Sale Price", "Units", "Sq Ft", "PPU", "PPSF", "Source URL", "Shortcode",
    "Confidence", "Parse Status", "Notes", "Buyer Address", "Buyer Phone", "Buyer Email", "Buyer Website", "Seller Address", "Seller Phone", "Seller Email", "Seller Website",
]
NUMERIC = {"Sale Price", "Units", "Sq Ft", "PPU", "PPSF", "Confidence"}
LISTING = "location struct<state:string,county:string,city:string,address:string,full_address:string>, property struct<property_types:array<string>>, listing struct<listing_id:string,listing_status:string,updated_at:string>, pricing struct<asking_price:double>, relationships struct<agents:array<struct<full_name:string,phone:string,brokerage:struct<name:string>>>>, source_context struct<listing_url:string>"


def canonical_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 27-column deal file; rows outside the five boroughs go, those without one stay."""
    schema = T.StructType([T.StructField(n, T.DoubleType() if n in NUMERIC else T.StringType()) for n in CANONICAL])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.filter(F.col("Borough").isNull() | F.col("Borough").isin("Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"))


def exclusion_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("addr_norm string, price double, reason string, evidence string, address string, borough string, source_url string").option("header", True).csv(path)
    return df.withColumn("price", F.coalesce("price", F.lit(0.0)))


def listings_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested listings flattened; each agent list becomes distinct (name, company) with the first known phone."""
    df = spark.read.schema(LISTING).json(path)
    return df.select(
        F.col("listing.listing_id").alias("listing_id"), F.coalesce("location.full_address", "location.address").alias("address"), F.col("location.state").alias("state"), F.col("location.county").alias("county"), F.col("location.city").alias("city"),
        F.get("property.property_types", F.lit(0)).alias("asset_type"), F.col("pricing.asking_price").alias("price"), F.col("source_context.listing_url").alias("url"), F.col("relationships.agents").alias("agents"),
    )


def listing_agents(listings: DataFrame) -> DataFrame:
    each = listings.select("listing_id", F.posexplode("agents").alias("pos", "a")).select("pos", F.trim("a.full_name").alias("name"), F.trim("a.brokerage.name").alias("company"), "a.phone")
    return each.filter("name <> ''").groupBy("name", "company").agg(F.min_by("phone", F.when(F.col("phone").isNotNull(), F.struct("pos", "phone"))).alias("phone"))


def upload_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header: each row as a map of its texts, numbered in file order. The number comes from the file's own order, so the file is read as one split: uploads are small files, many of them in parallel."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    pairs = [x for n in df.columns for x in (F.lit(n), F.col(f"`{n}`"))]
    return df.select(F.create_map(*pairs).alias("raw"), (F.monotonically_increasing_id() + 1).alias("row_num"))


def csv_cells(spark: SparkSession, path: str, most: int = 64) -> DataFrame:
    """CSV files, each with a header row of its own, as (file, row_num, is_header, values): up to `most` columns, rows numbered in the order of the file. A file is read as
    one split, since only so its quoted line breaks and its first row are sure: uploads are small files, many of them in parallel."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(most)])
    df = spark.read.schema(schema).option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    place = F.monotonically_increasing_id()
    cells = df.select(F.col("_metadata.file_path").alias("file"), place.alias("_at"), F.array(*[F.col(f.name) for f in schema.fields]).alias("values"))
    first = cells.groupBy("file").agg(F.min("_at").alias("_first"))
    return cells.join(first, "file").select("file", (F.col("_at") - F.col("_first")).alias("row_num"), (F.col("_at") == F.col("_first")).alias("is_header"), "values")


def sitemap_urls(spark: SparkSession, index: str, files: str, pattern: str) -> DataFrame:
    """Sitemap files that an index names -> (url, lastmod): each URL that fits the pattern once, with one slash at its end and its latest date. A named file that is missing is
    passed over. A file is known by its name, less the ending, in the path."""
    named = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(index)
    wanted = named.select(F.regexp_extract("loc", r"([^/]+)\.xml$", 1).alias("name")).filter("name <> ''").distinct()
    entries = spark.read.format("xml").option("rowTag", "url").option("recursiveFileLookup", True).schema("loc string, lastmod string").load(files).select("loc", "lastmod", F.col("_metadata.file_path").alias("file"))
    entries = entries.withColumn("name", F.element_at(F.split("file", "/"), -2)).join(wanted, "name", "left_semi").filter(F.col("loc").rlike(pattern))
    return entries.groupBy(F.concat(F.rtrim("loc", F.lit("/")), F.lit("/")).alias("url")).agg(F.max("lastmod").alias("lastmod"))


def write_tables(tables: dict[str, DataFrame], path: str, version: str) -> None:
    """Each table as Parquet in a folder of its version; a version that exists is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with quoted header; arrays joined by "; ", structs and maps as JSON."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            columns.append(F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            columns.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            columns.append(F.col(f.name))
    df.select(*columns).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def run_stats(statuses: DataFrame, key: str = "status") -> DataFrame:
    """One row of JSON: how many rows each status has, keys in order."""
    n = statuses.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))).alias("stats"))

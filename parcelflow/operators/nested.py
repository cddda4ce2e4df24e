"""Search in JSON that pages carry, and the mapping of uploaded files whose headers nobody fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.operators.extract import sniff_mapping
from parcelflow.sources import landing

#: Where the page's data lies, and the two places that deals are looked for first.
DATA_SCRIPT = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'
LISTED, SINGLE = "$.props.pageProps.initialValues.dealsWithCount.deals", "$.props.pageProps.deal"


def embedded_json(html: Column) -> Column:
    """The page's data as a VARIANT; null where there is none or it is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, DATA_SCRIPT, 1), F.lit("")))


def is_deal(v: Column) -> Column:
    """An object that names a price or a closing date, be it null, and has a list of properties."""
    named = F.try_variant_get(v, "$.salePrice", "variant").isNotNull() | F.try_variant_get(v, "$.closingDate", "variant").isNotNull()
    return F.coalesce(named & F.try_variant_get(v, "$.properties", "array<variant>").isNotNull(), F.lit(False))


def _children(df: DataFrame, key: str) -> DataFrame:
    """(key, path, v) -> each element of an array and each value of an object, with its place in the path. Objects give their keys in order of name."""
    return df.sparkSession.sql(f"SELECT t.{key}, array_append(t.path, e.pos) AS path, e.value AS v FROM {{t}} t, LATERAL variant_explode(t.v) e", t=df)


def deal_nodes(docs: DataFrame, key: str, depth: int = 8) -> DataFrame:
    """docs (key, doc: VARIANT) -> (key, path, node): the deals of the list that pages keep them in, if it has any; else the page's one deal; else every deal that a walk down to the given depth
    meets, which does not enter deals. path: the places from the root, for a listed deal its place in the list.

    The walk takes a step for all documents at once and ends when nothing is left to enter; the documents and each step's rows, the containers of one depth, are written, so nothing is parsed or
    done twice."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = landing.folder(docs.sparkSession, name)
        df.write.parquet(path)
        return docs.sparkSession.read.schema(df.schema).parquet(path)

    docs = kept(docs.select(key, "doc").filter("doc IS NOT NULL"), "documents")
    listed = docs.select(key, F.posexplode_outer(F.try_variant_get("doc", LISTED, "array<variant>")).alias("pos", "node")).filter(is_deal(F.col("node")))
    listed = listed.select(key, F.array("pos").alias("path"), "node")
    single = docs.select(key, F.array(F.lit(0)).alias("path"), F.try_variant_get("doc", SINGLE, "variant").alias("node")).filter(is_deal(F.col("node"))).join(listed.select(key).distinct(), key, "left_anti")
    out = kept(listed.unionByName(single), "placed")
    open_ = docs.join(out.select(key).distinct(), key, "left_anti").select(key, F.array().cast("array<int>").alias("path"), F.col("doc").alias("v"))
    for level in range(depth + 1):
        held = kept(open_.select("*", is_deal(F.col("v")).alias("deal")), "walk")
        out = out.unionByName(held.filter("deal").select(key, "path", F.col("v").alias("node")))
        rest = held.filter("NOT deal")
        if level == depth or rest.isEmpty():
            break
        below = _children(rest.select(key, "path", "v"), key)
        holds = F.try_variant_get("v", "$", "map<string,variant>").isNotNull() | F.try_variant_get("v", "$", "array<variant>").isNotNull()
        open_ = below.filter(holds)
    return out


def assigned(headers: DataFrame, exact: bool = False) -> DataFrame:
    """headers (file, pos, name) -> (file, pos, name, field, score): each header's best field, and each field once a file: the best score, then the leftmost header has it."""
    fields = sniff_mapping(headers.select("name").distinct(), exact)
    met = headers.join(fields, "name")
    w = Window.partitionBy("file", "field").orderBy(F.col("score").desc(), "pos")
    return met.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("file", "pos", "name", "field", "score")


def mapped_rows(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """cells (file, values: array, ...), mapping: what assigned() gives -> cells with a map `mapped` of field to value; fields that the file lacks, and files without any, have none. The mapping has
    a few rows a file."""
    by_file = mapping.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", "pos"))).alias("places"))
    j = cells.join(by_file, "file", "left")
    return j.withColumn("mapped", F.transform_values("places", lambda _, pos: F.get(F.col("values"), pos))).drop("places")

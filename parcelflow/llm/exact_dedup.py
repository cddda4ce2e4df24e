"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, so that a new batch meets it in a sort-merge anti-join without the
index being shuffled; what is new is appended. Digests are SHA-256 of the text without ASCII white space.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import SPACE_CHARS, scratch, shared_dir, without


def digest(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "").cast("binary"), 256))


class DigestIndex:
    """digest, keep_id, n_chars, batch of every text seen so far.

    The files in the folder path are the index; its numbers of buckets and type of ids lie in _meta beside them. Any session that opens the path registers the folder as a table
    and appends to it; nothing is ever overwritten. One writer at a time. Without a path, the index is a new folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, (path or shared_dir(spark, "digest_index")).rstrip("/")
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        meta = f"{self.path}/_meta"
        try:
            self.buckets, self.id_type = spark.read.schema("buckets int, id_type string").parquet(meta).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self.buckets, self.id_type = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), id_type
            spark.createDataFrame([(self.buckets, self.id_type)], "buckets int, id_type string").coalesce(1).write.parquet(meta)
        self.schema = f"digest binary, keep_id {self.id_type}, n_chars bigint, batch string"
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        spark.catalog.refreshTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The same as plain files: both sides of a join are then dealt out anew, and a hot digest can be split."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def add(self, marked: DataFrame, batch: str) -> None:
        """marked (doc_id, digest, n_chars) -> appends the digests that the index lacks, under the batch's name.
        Of equal texts, the row with the most characters, then the smallest doc_id stays (null last). A batch that is added again under its name, after a failure
        or a whole run, changes nothing that it appended before."""
        best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
        fresh = marked.groupBy("digest").agg(best.alias("best")).join(self.table().hint("merge").select("digest"), "digest", "left_anti")
        fresh = fresh.select("digest", F.col("best.doc_id").cast(self.id_type).alias("keep_id"), (-F.col("best.n")).alias("n_chars"), F.lit(batch).alias("batch"))
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def mark(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", digest(F.col("text")).alias("digest"), F.length(text).cast("bigint").alias("n_chars"))


def _judged(docs: DataFrame, index: DigestIndex | None, batch: str, parts: int) -> DataFrame:
    """One row for each (digest, doc_id, n_chars) of docs, with how often it occurs (copies), the rows that share its digest (group_size), keep_id, and whether it is the one that stays (best).

    Texts are digested once, into a narrow table. That goes into the index in parts by length, the longest texts first: so the
    row that stays, which is the longest of its group, is in the first part that holds its digest, and the anti-join drops the group's rows of later parts."""
    index = index or DigestIndex(docs.sparkSession, id_type=docs.schema["doc_id"].dataType.simpleString())
    marked = scratch(mark(docs), "digests")
    bounds = marked.agg(F.percentile_approx("n_chars", F.array(*[F.lit(i / parts) for i in range(1, parts)]))).first()[0] if parts > 1 else None
    edges = [None, *sorted(set(bounds or []), reverse=True), None]
    for i, (high, low) in enumerate(zip(edges, edges[1:])):
        part = marked if high is None else marked.filter(F.col("n_chars") <= high)
        index.add(part if low is None else part.filter(F.col("n_chars") > low), f"{batch}/{i}")
    counted = marked.groupBy("digest", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("copies"))
    sizes = marked.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    held = index.rows().select("digest", "keep_id", F.col("n_chars").alias("best_chars"), F.col("batch").startswith(f"{batch}/").alias("mine")).join(sizes, "digest")
    best = F.col("mine") & (F.col("n_chars") == F.col("best_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return counted.join(held, "digest").withColumn("best", best)


def assign(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0", parts: int = 3) -> DataFrame:
    """docs -> (doc_id, keep_id, group_size, kept, digest): one row for each row.

    Null counts as the empty text. Of rows that repeat both text and doc_id, one is kept. Of texts that the index held
    before, no row is kept. Extra columns are ignored; an empty table gives no rows. batch names these rows in the index: see DigestIndex.add.

    Rows are first counted by (digest, doc_id, n_chars), so repeated rows shrink before the shuffle; the join with the
    index is by digest, on narrow rows, and adaptive execution splits a hot digest."""
    judged = _judged(docs, index, batch, parts)
    each = judged.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return each.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"), "digest")


def keep_new(docs: DataFrame, index: DigestIndex | None = None, batch: str = "0", parts: int = 3) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; nulls, repeats and empty tables as in assign().

    What goes is decided on narrow rows. Usually no id that goes is also an id that stays, so ids alone say which rows go, and
    the texts needn't be shuffled (see common.without); else rows are told apart by id, digest and length."""
    judged = scratch(_judged(docs, index, batch, parts).select("digest", "doc_id", "n_chars", "copies", "best"), "judged")
    kept, gone = judged.filter("best"), judged.filter("NOT best")
    repeated = kept.filter("copies > 1").select("digest", "doc_id", "n_chars")
    twice = gone.select("doc_id").filter("doc_id IS NOT NULL").join(kept.select("doc_id"), "doc_id", "left_semi")
    if repeated.isEmpty() and twice.isEmpty() and gone.filter("doc_id IS NULL").isEmpty():
        return without(docs, scratch(gone.select("doc_id").distinct(), "gone"))
    keyed = docs.select(F.struct("*").alias("row"), digest(F.col("text")).alias("own_digest"), F.length(F.coalesce("text", F.lit(""))).alias("own_chars"))

    def rows(k: DataFrame, how: str) -> DataFrame:
        same = (F.col("own_digest") == F.col("digest")) & (F.col("own_chars") == F.col("n_chars")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
        return keyed.join(k.select("digest", "doc_id", "n_chars"), same, how)

    out = rows(kept.filter("copies = 1"), "left_semi")
    if not repeated.isEmpty():
        out = out.unionByName(rows(repeated, "left_semi").dropDuplicates(["own_digest"]))
    return out.select("row.*")

"""What several of the text operators share: tables, scratch folders and white space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name that the driver and every executor can reach: below spark.checkpoint.dir, or, where that is
    unset and all runs on one machine (tests), below a temporary folder of this session. On a cluster without it: an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="parcelflow-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to a shared folder and reads it back: the lineage ends there, and a lost executor costs
    only the tasks it held."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of at most so many rows, and that end with the row that reaches so many bytes: so neither a Python worker nor the buffers outside the heap hold many long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fold_of(doc_id, modulus: int):
    """crc32 of the decimal text of doc_id, modulo modulus (null where doc_id is null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


#: Ids up to this number (16 bytes each in a broadcast relation, 32 MB in all) travel to the rows they drop.
BROADCAST_IDS = 2_000_000


def row_key(*columns: str):
    """Tells rows apart whose ids repeat or are null: whether doc_id is null, doc_id, columns, SHA-256 of the text (null counts as empty). Orders by doc_id, null last."""
    text = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *columns, text.alias("digest"))


def ids_tell_rows(docs: DataFrame) -> bool:
    """Whether no doc_id is null or repeats."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty()


def without(docs: DataFrame, gone: DataFrame, on: str = "doc_id", most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose id isn't in gone (distinct ids, already written to a table). The ids are counted: up to `most` they are
    broadcast and the texts stay where they are; beyond, both sides are shuffled by id. The result is the same."""
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[on] == gone[on], "left_anti")

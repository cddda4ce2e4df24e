"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of their ids. A keyed Feistel network permutes the smallest range of 2^k numbers that holds all n row numbers; a number that it
sends to n or beyond is sent on until it lies below n (cycle walking), which makes a permutation of 0 .. n - 1. The permuted number gives the shard (remainder) and
the slot (quotient), so shards differ by one row at most, slots have no gaps, and anyone who knows (n, shards, key) can say where a row
lies, and which row lies in a slot, without reading anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import scratch

ROUNDS = 6
#: The multipliers of the SplitMix64 finaliser.
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    """A permutation of 0 .. 2^bits - 1, or its inverse. The halves have bits // 2 and the rest; rounds change them in turn."""
    low = np.uint64(bits // 2)
    high = np.uint64(bits - bits // 2)
    a, b = x >> low, x & np.uint64((1 << int(low)) - 1)
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if r % 2:
            b = b ^ (_mixed(a, key * 64 + r) & np.uint64((1 << int(low)) - 1))
        else:
            a = a ^ (_mixed(b, key * 64 + r) & np.uint64((1 << int(high)) - 1))
    return (a << low) | b


def permuted(rows: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Where a permutation of 0 .. n - 1 that the key chooses sends each row number (uint64); back: which row number it sends there."""
    bits = max(1, (n - 1).bit_length())
    with np.errstate(over="ignore"):
        out = _network(rows.astype(np.uint64), bits, key, back)
        while (outside := out >= np.uint64(n)).any():
            out[outside] = _network(out[outside], bits, key, back)
    return out


def place_of(row: int, n: int, shards: int, key: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    to = int(permuted(np.array([row], np.uint64), n, key)[0])
    return to % shards, to // shards


def row_at(shard: int, slot: int, n: int, shards: int, key: int = 0) -> int:
    """The row number that lies in a slot: the inverse of place_of."""
    return int(permuted(np.array([slot * shards + shard], np.uint64), n, key, back=True)[0])


def numbered(df: DataFrame, *order: Column, name: str = "row") -> DataFrame:
    """df with a column `name`: 0, 1, ... without gaps, in the order given. Rows that agree in all of it are numbered in any order, so give an order that tells
    all but repeated rows apart.

    One range shuffle sorts the rows, which are then written; a partition's rows are counted, and only these counts (one row a partition) are summed up. The last sort key
    is a hash of where a row was read, so that repeated rows, however many, spread over partitions."""
    spread = F.xxhash64(F.monotonically_increasing_id())
    keyed = df.select("*", spread.alias("_spread")).repartitionByRange(*order, F.col("_spread")).sortWithinPartitions(*order, "_spread").drop("_spread")
    at = F.monotonically_increasing_id()
    placed = scratch(keyed.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def placed(rows: DataFrame, shards: int, key: int = 0) -> DataFrame:
    """rows with a column row (0 .. n - 1, each once) -> with shard and slot instead of it."""
    n = rows.count()
    kept = [c for c in rows.columns if c != "row"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "row")

    def run(batches):
        for b in batches:
            to = permuted(b.column("row").to_numpy(zero_copy_only=False), n, key)
            shard, slot = to % np.uint64(shards), to // np.uint64(shards)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(shard.astype(np.int32)), pa.array(slot.astype(np.int64))], [*kept, "shard", "slot"])

    return rows.mapInArrow(run, f"{schema}, shard int, slot bigint")


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_last(), F.col("digest"), F.col("size")]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, digest): UTF-8 bytes of the text plus 1, its CRC-32 and its hash. A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"))


def assign(docs: DataFrame, shards: int = 16, key: int = 0) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, size, text_crc32, shard, slot), a row for each row; texts stay where they are.

    Rows are numbered by doc_id, null last, then by hash and size of the text, so ties (repeated or null ids) have a fixed order; rows that repeat in all of it are
    interchangeable. A null text counts as empty (size 1), extra columns are ignored, an empty table gives no rows. With fewer rows than shards some shards stay empty."""
    return placed(numbered(sizes(docs), *_order()).drop("digest"), shards, key)


def write(docs: DataFrame, path: str, shards: int = 16, key: int = 0, slots_a_file: int = 1 << 20) -> DataFrame:
    """Writes the rows of docs as Parquet to path/shard=k/, each file a stretch of slots in their order, and returns what is read back: the columns of docs in a
    struct `row`, shard and slot. Texts are shuffled twice, once to be numbered and once to their slots; a shard is split over as many tasks as its slots need, however large it is. Nulls and ties: see assign."""
    kept = docs.select(F.struct("*").alias("row_"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    out = placed(numbered(kept, *_order()).select("row_", "row"), shards, key).withColumnRenamed("row_", "row")
    stretch = F.floor(F.col("slot") / slots_a_file)
    out.repartition("shard", stretch).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)

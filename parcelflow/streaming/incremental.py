"""Incremental ingest with Structured Streaming: new files are discovered, merged in micro-batches and recorded, and a second run finds nothing. All state lies in storage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest(spark: SparkSession, source: str, schema: str, merge: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 8):
    """Runs merge(batch, id) over the files that came since the checkpoint, then ends. merge must bear a repeat of the last batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Store:
    """Rows with a key each, merged batch by batch into a folder; what was merged is known from the folder alone, whichever process reads it.

    rows/batch=N: the rows that batch N added. keys: (key, batch) of all added rows, a table bucketed by key, so a batch meets the keys and never the old rows, and the keys aren't shuffled.
    commits/batch=N: the batch's counts, written last. A batch that has a commit is done, and a repeat of it changes nothing; one without is not read, and its repeat takes its place:
    keys that a broken attempt left under the same number don't count against it. Batch numbers are those of one stream's checkpoint. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int | None = None):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        kind = dict(spark.createDataFrame([], schema).dtypes)[key]
        self.keys = "keys_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        place = f"{self.path}/keys-{n}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.keys} (key {kind}, batch bigint) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {n} BUCKETS LOCATION '{place}'")
        spark.catalog.refreshTable(self.keys)
        self.buckets = n

    def _read(self, name: str, schema: str) -> DataFrame:
        """An empty table, where the folder does not exist yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{name}")

    def stats(self) -> DataFrame:
        """(status, n, batch) of each committed batch."""
        return self._read("commits", "status string, n bigint")

    def rows(self) -> DataFrame:
        """All rows of committed batches."""
        return self._read("rows", self.schema).join(self.stats().select("batch").distinct(), "batch", "left_semi").drop("batch")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Adds the rows whose key no earlier batch added, one a key; a null key is a key. For foreachBatch."""
        if not self.stats().filter(F.col("batch") == number).isEmpty():
            return
        held = self.spark.table(self.keys).filter(F.col("batch") < number).select("key")
        one = batch.dropDuplicates([self.key])
        fresh = one.join(held, one[self.key].eqNullSafe(held["key"]), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        added = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/batch={number}")
        added.select(F.col(self.key).alias("key"), F.lit(number).cast("bigint").alias("batch")).repartition(self.buckets, "key").write.insertInto(self.keys)
        self.spark.catalog.refreshTable(self.keys)
        n_in, n_new = batch.count(), added.count()
        counts = self.spark.createDataFrame([("inserted", n_new), ("duplicate", n_in - n_new)], "status string, n bigint")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={number}")


def first_seen(urls: DataFrame) -> DataFrame:
    """A stream (url, pos) -> each URL once, with its smallest pos in the batch that first has it. The seen-set is the stream's state: it outlives runs over one
    checkpoint and never expires. Where files land in the order of pos, that is the URL's first place."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = min(int(f["pos"].min()) for f in frames)
        if not state.exists:
            state.update((True,))
            yield pd.DataFrame({"url": [key[0]], "pos": [first]})

    return urls.groupBy("url").applyInPandasWithState(run, "url string, pos bigint", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def fetch_state(outcomes: DataFrame) -> DataFrame:
    """A stream of fetch outcomes (url, nr, disposition) -> (url, attempts, disposition, eligible), a row for each URL a batch speaks of: how often it was tried,
    what came of it, and whether it is tried again. A URL's state is kept across runs. Outcomes count in the order of nr; transient errors (fetch_error...) leave a URL eligible; after any other disposition it is
    final, and what comes later is ignored."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, last = state.get if state.exists else (0, "fetch_error")
        for disposition in pd.concat(list(frames)).sort_values("nr")["disposition"]:
            if not last.startswith("fetch_error"):
                break
            attempts, last = attempts + 1, disposition
        state.update((attempts, last))
        yield pd.DataFrame({"url": [key[0]], "attempts": [attempts], "disposition": [last], "eligible": [last.startswith("fetch_error")]})

    out = "url string, attempts bigint, disposition string, eligible boolean"
    return outcomes.groupBy("url").applyInPandasWithState(run, out, "attempts bigint, disposition string", "update", GroupStateTimeout.NoTimeout)


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Runs a stream over what has come since the checkpoint; each batch's rows go to a folder of its number, which a repeat overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def discovered(urls: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each URL once, remembered as long as late rows may repeat it."""
    return urls.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["url"])


def change_feed(changes: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Changes in each window of event time."""
    w = F.window("changed_at", window)
    return changes.withWatermark("changed_at", delay).groupBy(w, "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def not_final(urls: DataFrame, ledger: DataFrame) -> DataFrame:
    """URLs without a final disposition: those that failed transiently are tried again."""
    return urls.join(ledger.filter(~F.col("disposition").startswith("fetch_error")).select("url"), "url", "left_anti")

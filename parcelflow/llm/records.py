"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames: the payload's length (8 bytes), the masked CRC-32 of those 8 bytes, the payload, the
masked CRC-32 of the payload; all little-endian. A payload is doc_id (8 bytes), flags (1 byte: bit 0 no doc_id, bit 1
ids are 4 bytes wide instead of 2), the number of ids (4 bytes) and the ids. The index file beside it has an offset
(8 bytes) and a number of ids (4 bytes) for each frame, so records can be read in any order. A checksum is masked by
rotation and a constant, so that a checksum stored inside checked data does not match by itself.

Files are written by the tasks through pyarrow's file systems (a local or mounted folder, s3, gcs, or hdfs where libhdfs
is installed), each under a name of its own attempt and then renamed: a task that is run again replaces its files by equal ones.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import shared_dir, small_batches
from parcelflow.llm.wordbpe import WordEncoder

HEAD, ENTRY = struct.Struct("<qBI"), struct.Struct("<QI")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian, width (2 or 4) bytes each."""
    payload = HEAD.pack(doc_id or 0, (doc_id is None) | (width == 4) << 1, len(ids) // width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def entry(offset: int, n: int) -> bytes:
    return ENTRY.pack(offset, n)


def read_frame(stream) -> tuple[int | None, np.ndarray] | None:
    """The next record as (doc_id, ids as unsigned 32-bit integers); None at the end of the file."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("a record's length is damaged")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked_crc(payload := body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("a record's content is damaged")
    doc_id, flags, n = HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, HEAD.size).astype("<u4")
    return None if flags & 1 else doc_id, ids


def open_dir(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class RecordFile:
    """One data file with its index: len(), [i] for shuffled reads, run() for a stretch, iteration in order."""

    def __init__(self, uri: str, name: str):
        self.fs, base = open_dir(uri)
        self.path = f"{base}/{name}"
        with self.fs.open_input_stream(f"{self.path}.idx") as f:
            self.entries = np.frombuffer(f.read(), np.dtype([("offset", "<u8"), ("ids", "<u4")]))

    def __len__(self) -> int:
        return len(self.entries)

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        with self.fs.open_input_file(f"{self.path}.rec") as f:
            f.seek(int(self.entries[i]["offset"]))
            return read_frame(f)

    def ids_before(self, i: int) -> int:
        return int(self.entries["ids"][:i].sum(dtype=np.int64))

    def run(self, first: int, count: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """The records from first on, at most count, in order."""
        if first >= len(self):
            return
        with self.fs.open_input_file(f"{self.path}.rec") as f:
            f.seek(int(self.entries[first]["offset"]))
            with pa.BufferedInputStream(f, 1 << 20) as ahead:
                for _ in range(min(count, len(self) - first)):
                    yield read_frame(ahead)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        return self.run(0, len(self))


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 2) -> str:
    """Encodes every text, appends end_id and writes the records in ascending doc_id order (null first; rows that repeat a doc_id by a
    hash of their text) to files part-NNNNNN.rec and .idx in the folder out; returns the folder.

    doc_id must be an integer or null (other types are cast and raise an error where they can't be). A null text counts as empty: its record has the end
    id only. Extra columns are ignored; an empty table gives no files.

    Texts are dealt out by ranges of doc_id once, sorted, encoded and written by the same task. manifest/ in the folder
    lists the files with their numbers of records and ids; it is written last."""
    spark = docs.sparkSession
    out = out or shared_dir(spark, "records")
    small_batches(spark)

    def run(batches):
        part = TaskContext.get().partitionId()
        fs, base = open_dir(out)
        fs.create_dir(base, recursive=True)
        name, mine = f"part-{part:06d}", f"_{part:06d}-{uuid.uuid4().hex}"
        enc, n_docs, n_ids, at = encoder(tokenizer), 0, 0, 0
        end = enc.pack([end_id])
        with fs.open_output_stream(f"{base}/{mine}.rec") as data, fs.open_output_stream(f"{base}/{mine}.idx") as index:
            for b in batches:
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode_batch(b.column("text"))):
                    ids += end
                    record = frame(doc_id, ids, enc.width)
                    n = len(ids) // enc.width
                    data.write(record)
                    index.write(entry(at, n))
                    at, n_docs, n_ids = at + len(record), n_docs + 1, n_ids + n
        for kind in ("idx", "rec"):
            if n_docs:
                fs.move(f"{base}/{mine}.{kind}", f"{base}/{name}.{kind}")
            else:
                fs.delete_file(f"{base}/{mine}.{kind}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"name": [name], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [at]})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    listed = placed.mapInArrow(run, "name string, n_docs bigint, n_ids bigint, n_bytes bigint")
    listed.write.parquet(f"{out}/manifest")
    return out


def read(spark: SparkSession, out: str, records_a_task: int = 10_000) -> DataFrame:
    """(name, doc_id, start, ids binary: unsigned 32-bit little-endian) of every record; start counts all ids before
    it. A damaged record raises an error. Each task finds its stretch of a file by the index."""
    w = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = spark.read.parquet(f"{out}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
    stretches = files.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.lit(records_a_task).cast("bigint"))))
    n = max(1, stretches.count())

    def run(batches):
        for b in batches:
            for name, start, first in zip(*(b.column(c).to_pylist() for c in ("name", "start", "first"))):
                file = RecordFile(out, name)
                start, got, size = start + file.ids_before(first), [], 0
                for doc_id, ids in file.run(first, records_a_task):
                    got.append((name, doc_id, start, ids.tobytes()))
                    start, size = start + len(ids), size + len(ids)
                    if size > 1 << 20:
                        yield batch(got)
                        got, size = [], 0
                if got:
                    yield batch(got)

    def batch(got):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["name", "doc_id", "start", "ids"])

    return stretches.select("name", "start", "first").repartition(n, "name", "first").mapInArrow(run, "name string, doc_id bigint, start bigint, ids binary")

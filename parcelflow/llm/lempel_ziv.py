"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (LZ78: each phrase is the longest known one plus a byte). The set of
phrases is hashed, and a signature of 128 minima (one permutation, 128 bins, 8 bits of each) stands for the set: the share of equal
minima estimates the sets' Jaccard likeness, which follows how well one text compresses the other (Raff and Nicholas,
2017).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import scratch, small_batches

BINS = 128
MASK, PRIME, BASIS = (1 << 64) - 1, 0x100000001B3, 0xCBF29CE484222325  # the constants of 64-bit FNV-1a


def parse(data: bytes, nodes: dict[int, int], hashes: list[int], state: int = 0) -> int:
    """Goes on parsing from state; nodes maps (phrase, byte) to a longer phrase, hashes has each phrase's hash, that of
    the empty one first. Returns the state at the end."""
    get = nodes.get
    for c in data:
        key = state << 8 | c
        longer = get(key)
        if longer is None:
            nodes[key] = len(hashes)
            hashes.append((hashes[state] ^ c) * PRIME & MASK)
            state = 0
        else:
            state = longer
    return state


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def signature(hashes: list[int]) -> bytes:
    """128 bytes; empty for no phrases. An empty bin borrows from the next one that isn't, mixed with the distance."""
    if len(hashes) < 2:
        return b""
    h = mix(np.array(hashes[1:], np.uint64))
    low = np.full(BINS, np.iinfo(np.uint64).max)
    np.minimum.at(low, (h & np.uint64(BINS - 1)).astype(np.int64), h >> np.uint64(7))
    full = np.flatnonzero(low != np.iinfo(np.uint64).max)
    at = np.searchsorted(full, np.arange(BINS)) % len(full)
    step = (full[at] - np.arange(BINS)) % BINS
    return (mix(low[full[at]] + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(255)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; two texts without phrases are alike, and one without is unlike any other."""
    if not a or not b:
        return float(a == b)
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))  # 8 bits are equal by chance once in 256


def fingerprint(text: str | None) -> bytes:
    hashes = [BASIS]
    parse((text or "").encode(), {}, hashes)
    return signature(hashes)


def with_edit(text: str, following: str) -> tuple[bytes, str, bytes]:
    """The text's signature, its edited text and that one's signature. The edit replaces the last quarter of the code
    points, so the parse of the first three quarters serves both."""
    k = len(text) // 4
    head, tail, other = text[: len(text) - k].encode(), text[len(text) - k :].encode(), following[:k].encode()
    nodes, hashes = {}, [BASIS]
    state = parse(head, nodes, hashes)
    n = len(hashes)
    parse(tail, nodes, hashes, state)
    own = signature(hashes)
    for _ in range(len(hashes) - n):
        nodes.popitem()  # the last ones put in
    del hashes[n:]
    parse(other, nodes, hashes, state)
    return own, (head + other).decode(), signature(hashes)


DONE, TAIL, HEAD = 0, 1, 2
FIELDS = [("kind", pa.int8(), "tinyint"), ("part", pa.int32(), "int"), ("doc_id", pa.int64(), "bigint"), ("n_chars", pa.int64(), "bigint"), ("edited_sha256", pa.binary(), "binary"), ("fp", pa.binary(), "binary"), ("edited_fp", pa.binary(), "binary"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"), ("text", pa.string(), "string")]
SCHEMA = ", ".join(f"{n} {s}" for n, _, s in FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), FIELDS)], [n for n, _, _ in FIELDS])


def _judge(part: int, doc_id, text: str, following: str) -> list:
    """A row without near_next and text."""
    own, edited, other = with_edit(text, following)
    return [DONE, part, doc_id, len(text), hashlib.sha256(edited.encode()).digest(), own, other, likeness(own, other)]


def _inner(batches):
    """Each row of a sorted partition beside the next one; the first and the last row's texts go on to _borders."""
    part, before, waiting, out, size = TaskContext.get().partitionId(), None, None, [], 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            text = text or ""
            if before is None:
                out.append((HEAD, part, doc_id, None, None, None, None, None, None, text))
            else:
                row = _judge(part, *before, text)
                if waiting:
                    out.append((*waiting, likeness(waiting[5], row[5]), None))
                waiting = row
            before, size = (doc_id, text), size + 1
            if len(out) >= 500:
                yield _batch(out)
                out = []
    if before is not None:
        if waiting:
            out.append((*waiting, likeness(waiting[5], fingerprint(before[1])), None))
        out.append((TAIL, part, before[0], None, None, None, None, None, None, before[1]))
        yield _batch(out)


def _borders(batches):
    for b in batches:
        rows = []
        for part, doc_id, text, following in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "text", "following"))):
            row = _judge(part, doc_id, text, following)
            rows.append((*row, likeness(row[5], fingerprint(following)), None))
        if rows:
            yield _batch(rows)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, n_chars, edited_sha256, fp, edited_fp binary, near_edited, near_next): one row for each row.

    The next document follows in ascending doc_id (null first; rows that repeat a doc_id by a hash of their text), the first
    follows the last; a lone row follows itself. Null counts as the empty text. Extra columns are ignored; an empty table gives no rows.

    Texts are dealt out by ranges of doc_id and sorted once; each task sees its rows in a row. Where a partition ends, the
    last row meets the first one of the next partition that has rows in a second, small job (two rows a partition)."""
    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    found = scratch(placed.mapInArrow(_inner, SCHEMA), "lempel_ziv")
    # One narrow row a partition: which partition's head follows which partition's tail.
    parts = found.filter(F.col("kind") == HEAD).select("part")
    w = Window.orderBy("part")
    order = parts.select("part", F.lead("part").over(w).alias("next"), F.min("part").over(w).alias("first")).select("part", F.coalesce("next", "first").alias("next"))
    heads = found.filter(F.col("kind") == HEAD).select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = found.filter(F.col("kind") == TAIL).select("part", "doc_id", "text")
    ends = tails.join(order, "part").join(heads, "next").select("part", "doc_id", "text", "following").mapInArrow(_borders, SCHEMA)
    columns = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
    return found.filter(F.col("kind") == DONE).select(*columns).unionByName(ends.select(*columns))

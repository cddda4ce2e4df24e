"""A training corpus from the table of documents: five stages, each written as Parquet and read by the next.

quality: drops what the rule ensemble rejects. exact: of equal texts one row stays. near: of texts whose five-word shingles are 0.8 alike or more, one document stays.
mix: documents repeat or go so that sources meet their target weights. encode: ids of the byte-level BPE.

In every stage a null text counts as empty, rows may repeat, and an empty table gives no rows; see the operators for ties.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import bpe, exact_dedup, mixing, quality, simhash
from parcelflow.llm.common import fold_of, shared_dir, table
from parcelflow.llm.queries import BYTE_BPE, THRESHOLD

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the labelled rows of the whole table, applied to docs; an empty text is judged by its zero statistics."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    return quality.keep(docs, model, THRESHOLD).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for ASCII white space, the longest stays, then the smallest doc_id; of rows that repeat both, one."""
    return exact_dedup.keep_new(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays, null last, then by the text's hash; empty texts are one group."""
    return simhash.keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of blocks takes them; a null source is a source of its own, documents without words stay once."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row; no ids for an empty text. Workers go on to other stages, so they remember less and keep no tables."""
    return bpe.encode_decode(docs, public_tokenizers.path(BYTE_BPE), keep=False, remember=50_000, pairs=60_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", good), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]
#: Trained scores, hashed draws and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, f"pipeline_{name}")
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
        docs = out
    return docs

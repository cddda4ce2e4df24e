"""Measures the near stage against exact likeness: python -m tests.llm.near_recall [folder of tables].

All pairs of documents with a word shingle in common are compared exactly; for each step of likeness it prints how many pairs there are, and how many of them share a group."""

from __future__ import annotations

import sys
import tempfile
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import simhash
from parcelflow.llm.common import table
from tests.llm.test_text_operators import shingle_set

STEPS = (0.7, 0.75, 0.8, 0.85, 0.9, 1.01)


def recall(docs: DataFrame) -> dict[tuple[float, float], tuple[int, int]]:
    """(from, below) -> (pairs, pairs that share a group). For tables that fit the driver, as a test's do."""
    rows = docs.select("doc_id", "text").collect()
    sets, groups, holders = {r.doc_id: shingle_set(r.text) for r in rows}, {r.doc_id: r.component_id for r in simhash.like_groups(docs).collect()}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for held in holders.values() for k, a in enumerate(held) for b in held[:k])
    pairs, together = Counter(), Counter()
    for (a, b), n in shared.items():
        likeness = n / (len(sets[a]) + len(sets[b]) - n)
        for step in zip(STEPS, STEPS[1:]):
            if step[0] <= likeness < step[1]:
                pairs[step] += 1
                together[step] += groups[a] == groups[b]
    return {s: (pairs[s], together[s]) for s in zip(STEPS, STEPS[1:])}


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    for (low, high), (n, found) in recall(table(spark, folder, "documents")).items():
        print(f"{low:.2f} to {min(high, 1):.2f}: {found} of {n} pairs share a group")
    spark.stop()


if __name__ == "__main__":
    main()

"""Merkle manifest of a dataset, and proofs for many rows at once by octopus multiproofs.

Each row is a leaf. A source's leaves, in the order of their ids, are the bottom of a tree of runs of three; the sources' roots are the bottom of one more
tree, whose root stands for the dataset. The manifest is two tables: the leaves, and every node above them.

Nodes have coordinates (tree, level, pos). Blocks of 3^7 neighbouring nodes are hashed level by level within one task, and only their tops go up, so a tree of 10^11
leaves takes four passes, each over 1/2187 of the one before. For proofs the same blocks are the leaf partitions: a partition finds the smallest set of
coordinates from which, with its own leaves, every path to the root follows, all partitions' coordinates are met with the manifest in one join, and the partition derives
what its leaves share, and from it each leaf's own proof.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import scratch
from parcelflow.llm.sharding import numbered

RUN, HEIGHT = 3, 7
BLOCK = RUN**HEIGHT
#: The tree of the sources' roots.
TOP = -1
NODE = "tree bigint, level int, pos bigint, digest binary"


def joined(digests: Iterable[bytes]) -> bytes:
    """H of digests, concatenated as hex text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def encoded(value: Column, kind: str) -> Column:
    """- if null, else the value's UTF-8 bytes, a colon, and the value; a whole number in decimal."""
    text = value if kind == "string" else value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(docs: DataFrame, text: Column) -> Column:
    """SHA-256 of a row's encoded fields, as 32 bytes; text stands for the column text."""
    kinds = dict(docs.dtypes)
    parts = [encoded(F.col(c), kinds[c]) for c in ("doc_id", "source", "lang", "n_chars")] + [encoded(text, "string")]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def widths(n: int) -> list[int]:
    """How many nodes each level of a tree over n leaves has; the last level has one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // RUN))
    return out


def leaves(docs: DataFrame, **extra: Column) -> DataFrame:
    """docs -> (tree, source, pos, n, doc_id, leaf, extra columns), written: pos is a row's place among the n of its source, tree the source's place among sources.

    Order: source, null first; doc_id, null last; then the leaf, so ties are settled, and rows that tie in it are alike. Sources are numbered from their first rows; they
    are met by source, where a hot source's rows can be split."""
    rows = docs.select("doc_id", "source", leaf(docs, F.col("text")).alias("leaf"), *[e.alias(k) for k, e in extra.items()])
    rows = numbered(rows, F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), F.col("leaf").asc())
    by_source = scratch(numbered(rows.groupBy("source").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), F.col("source").asc_nulls_first(), name="tree"), "sources").alias("s")
    r = rows.alias("r")
    met = r.join(by_source, F.col("r.source").eqNullSafe(F.col("s.source")))
    return scratch(met.select("s.tree", "r.source", (F.col("r.row") - F.col("s.first")).alias("pos"), "s.n", "r.doc_id", "r.leaf", *[f"r.{k}" for k in extra]), "leaves")


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).cast("bigint")


def _grow(nodes: DataFrame) -> DataFrame:
    """nodes (tree, level, pos, n, digest), n: all nodes of the tree's level -> all nodes of the next HEIGHT levels, up to the tree's root."""

    def run(key, t):
        tree, level, block = key[0].as_py(), key[1].as_py(), key[2].as_py()
        order = sorted(zip(t.column("pos").to_pylist(), t.column("digest").to_pylist()))
        width, first, now = t.column("n")[0].as_py(), block * BLOCK, [d for _, d in order]
        levels, places, digests = [], [], []
        for _ in range(HEIGHT):
            if width == 1:
                break
            now, width, first, level = [joined(now[i : i + RUN]) for i in range(0, len(now), RUN)], -(-width // RUN), first // RUN, level + 1
            levels += [level] * len(now)
            places += range(first, first + len(now))
            digests += now
        return pa.table([pa.array([tree] * len(levels), pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array(digests, pa.binary())], ["tree", "level", "pos", "digest"])

    return nodes.groupBy("tree", "level", _block().alias("block")).applyInArrow(run, NODE)


def _trees(bottom: DataFrame) -> DataFrame:
    """bottom (tree, pos, n, digest) -> all nodes above, written pass by pass."""
    now, out, spark = bottom.select("tree", F.lit(0).alias("level"), "pos", "n", "digest").filter("n > 1"), None, bottom.sparkSession
    while not now.isEmpty():
        grown = scratch(_grow(now), "nodes")
        out = grown if out is None else out.unionByName(grown)
        highest = now.select("level").first()[0] + HEIGHT
        up = grown.filter(F.col("level") == highest)
        width = up.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        now = up.join(width, "tree").select("tree", "level", "pos", "n", "digest")
    return spark.createDataFrame([], NODE) if out is None else out


def build(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """held: what leaves() gives -> (nodes, subroots): nodes (tree, level, pos, digest) above the leaves, those of the top tree included, whose leaves are
    the subroots (tree, n, subroot); the tree of a single leaf has no node."""
    inner = _trees(held.select("tree", "pos", "n", F.col("leaf").alias("digest")))
    ones = held.filter("n = 1").select("tree", "n", F.col("leaf").alias("subroot"))
    height = inner.groupBy("tree").agg(F.max_by("digest", "level").alias("subroot")).join(held.groupBy("tree").agg(F.max("n").alias("n")), "tree")
    subroots = scratch(ones.unionByName(height.select("tree", "n", "subroot")), "subroots")
    count = subroots.count()
    top = _trees(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("bigint").alias("n"), F.col("subroot").alias("digest")))
    return inner.unionByName(top), subroots


def missing(places: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The smallest set of (level, pos) from which, with the leaves at places, every path to the root follows."""
    out, known = [], set(places)
    for level, width in enumerate(widths(n)[:-1]):
        up = {p // RUN for p in known}
        out += [(level, p) for r in sorted(up) for p in range(r * RUN, min((r + 1) * RUN, width)) if p not in known]
        known = up
    return out


def needs(wanted: DataFrame, trees: int) -> DataFrame:
    """wanted (tree, pos, n) -> (tree, level, pos, for_tree, for_block): the coordinates each leaf partition fetches, each once."""

    def run(key, t):
        tree, block = key[0].as_py(), key[1].as_py()
        below = missing(t.column("pos").to_pylist(), t.column("n")[0].as_py())
        above = missing([tree], trees)
        rows = [(tree, *c) for c in below] + [(TOP, *c) for c in above]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64()))]
        return pa.table([*columns, pa.array([tree] * len(rows), pa.int64()), pa.array([block] * len(rows), pa.int64())], ["tree", "level", "pos", "for_tree", "for_block"])

    return wanted.groupBy("tree", _block().alias("block")).applyInArrow(run, "tree bigint, level int, pos bigint, for_tree bigint, for_block bigint")


def fetched(asked: DataFrame, held: DataFrame, nodes: DataFrame, subroots: DataFrame) -> DataFrame:
    """asked: what needs() gives -> with digest. One join with the nodes, where a coordinate that many partitions ask for can be split; leaves and subroots are joined only if some are asked for."""
    asked = scratch(asked, "needs")
    keys = ["tree", "level", "pos"]
    out = asked.join(nodes, keys)
    low = asked.filter("level = 0")
    if not low.filter("tree >= 0").isEmpty():
        out = out.unionByName(low.join(held.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest")), keys))
    tops = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"))
    return out.unionByName(low.filter("tree < 0").join(tops, keys))


def prove(wanted: DataFrame, held: DataFrame, nodes: DataFrame, subroots: DataFrame) -> DataFrame:
    """wanted: rows of leaves(), with a column tampered (bytes, or null) -> (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests as hex. A path's siblings are
    those of its runs, level by level through the subroot to the root; folded_root follows from the tampered leaf, if there is one, and the original siblings."""
    trees = subroots.count()
    top = nodes.filter(F.col("tree") == TOP).agg(F.max_by("digest", "level")).first()[0] if trees > 1 else (subroots.first().subroot if trees else b"")
    root = bytes(top).hex()
    got = fetched(needs(wanted.select("tree", "pos", "n"), trees), held, nodes, subroots)
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(key, mine, other):
        tree = key[0].as_py()
        pos, n = mine.column("pos").to_pylist(), mine.column("n")[0].as_py()
        given: dict[tuple[int, int], dict[int, bytes]] = defaultdict(dict)
        for t, level, p, d in zip(*(other.column(c).to_pylist() for c in ("tree", "level", "pos", "digest"))):
            given[t, level][p] = d
        # Each level's known digests: the leaves, what was fetched, and what follows from these.
        levels, now, subroot = [], dict(zip(pos, mine.column("leaf").to_pylist())), ""
        for t, places in ((tree, widths(n)), (TOP, widths(trees))):
            for level, width in enumerate(places[:-1]):
                now |= given[t, level]
                levels.append((now, width))
                now = {r: joined(now[p] for p in range(r * RUN, min((r + 1) * RUN, width))) for r in {p // RUN for p in now}}
            if t == tree:
                subroot, now = now[0].hex(), {tree: now[0]}
        folded = next(iter(now.values())).hex()
        low, edge = len(widths(n)) - 1, []
        # What lies above the tree's root is the same for all of its leaves.
        at = tree
        for known, width in levels[low:]:
            r = at // RUN
            edge.append(([known[p] for p in range(r * RUN, min((r + 1) * RUN, width)) if p != at], at - r * RUN))
            at = r
        proofs, roots = [], []
        for p, changed in zip(pos, mine.column("tampered").to_pylist()):
            steps = []
            for known, width in levels[:low]:
                r = p // RUN
                steps.append(([known[q] for q in range(r * RUN, min((r + 1) * RUN, width)) if q != p], p - r * RUN))
                p = r
            steps += edge
            proofs.append(joined(d for around, _ in steps for d in around).hex())
            if changed is None:
                roots.append(folded)
                continue
            for around, place in steps:
                changed = joined([*around[:place], changed, *around[place:]])
            roots.append(changed.hex())
        m = len(pos)
        columns = [mine.column("doc_id"), pa.array([d.hex() for d in mine.column("leaf").to_pylist()]), pa.array([subroot] * m), pa.array([root] * m), pa.array(proofs), pa.array(roots), pa.array([x == root for x in roots])]
        return pa.table(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    blocks = wanted.withColumn("block", _block()).groupBy("tree", "block")
    return blocks.cogroup(got.select("for_tree", "for_block", "tree", "level", "pos", "digest").groupBy("for_tree", "for_block")).applyInArrow(run, schema)


def verify(docs: DataFrame, changed: Column) -> DataFrame:
    """Builds the manifest of docs and proves every row against it, those changed (a Boolean column) with the newlines of their text gone.

    Nulls in any column are encoded as such; a null doc_id comes last in its source, a null source first; repeated rows are leaves of their own; a dataset of one row is its own
    root, with a proof of no siblings; an empty table gives no rows; extra columns are not part of a leaf."""
    tampered = F.when(F.coalesce(changed, F.lit(False)), leaf(docs, F.translate("text", "\n", "")))
    held = leaves(docs, tampered=tampered)
    nodes, subroots = build(held)
    return prove(held, held, nodes, subroots)

"""SimHash near-duplicate detection with multi-index hashing.

A text's fingerprint has a bit for each of 64 majority votes over the XXH64 of its word shingles. Fingerprints that
differ in at most ``radius`` bits are linked; linked texts form a group. To find the links, fingerprints are cut into
segments: by the pigeonhole principle, two that differ in at most ``radius`` bits differ in some segment i in at most
``radii[i]`` bits, if the radii plus one sum to more than ``radius``. So a table holds each fingerprint under each of its segments,
every fingerprint looks up the small Hamming ball of each segment, and complete distances are checked on what it meets.

Only distinct fingerprints enter the search: thousands of copies are one entry, so a hot group costs one row, not pairs.

keep_one() drops near copies by Jaccard likeness of five-word shingles. 64 bits are too few to tell 0.8 from less, so its fingerprints are long and cut into many
segments, each a choice of bits, with balls of radius zero: at 0.8, where every bit differs with a chance of 0.15, a ball of radius one costs 24 more rows a
segment for what five more segments give. Distances far from the one of the wanted likeness decide; between, the sets of shingles are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import BROADCAST_IDS, ids_tell_rows, row_key, scratch, small_batches, without
from parcelflow.llm.components import components


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned 64-bit integer; 0 for a text without words or null."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    if len(found) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(x), seed) for x in zip(*(found[i:] for i in range(words)))]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp long): one row for each row, repeated or not, whole texts. Null and empty texts give zero, null ids stay null,
    extra columns are ignored, an empty table gives no rows."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            fps = np.array([simhash(t, words, seed) for t in b.column("text").to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint")


def split_radius(radius: int, segments: int) -> list[int]:
    """Radii whose sum of (r + 1) is radius + 1, as even as can be; a segment may get -1: it is not searched."""
    base, more = divmod(radius + 1, segments)
    return [base + (i < more) - 1 for i in range(segments)]


def _ball(masks, segment: int, part):
    return F.transform(masks, lambda m: F.struct(F.lit(segment).alias("segment"), part.bitwiseXOR(m).alias("key")))


def links(fps: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """fps (fp long, distinct, not null) -> (u, v), u < v, for every two that differ in at most radius bits; a pair that meets in several segments
    comes several times. Extra columns are ignored; an empty table gives no rows."""
    width = 64 // segments
    table, probe = [], []
    for i, r in enumerate(split_radius(radius, segments)):
        if r < 0:
            continue
        low, size = i * width, width if i < segments - 1 else 64 - i * width
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))
        ball = [sum(1 << b for b in bits) for n in range(r + 1) for bits in combinations(range(size), n)]
        table.append(F.struct(F.lit(i).alias("segment"), part.alias("key")))
        masks = F.array(*[F.lit(m).cast("bigint") for m in ball])
        probe.append(_ball(masks, i, part))
    held = fps.select(F.col("fp").alias("v"), F.explode(F.array(*table)).alias("s")).select("v", "s.segment", "s.key")
    asked = fps.select(F.col("fp").alias("u"), F.explode(F.concat(*probe)).alias("s")).select("u", "s.segment", "s.key")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    # A pair within a segment's radius is met from both ends, so u < v loses none.
    met = asked.join(held, ["segment", "key"]).filter(near)
    return met.select("u", "v")


def groups(docs: DataFrame, words: int = 3, radius: int = 2, segments: int = 2) -> DataFrame:
    """docs -> (doc_id, fp, component_id): one row for each row; component_id is the smallest doc_id of the group.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null doc_id are grouped, and
    a group of only such rows has a null component_id. Extra columns are ignored. An empty table gives no rows."""
    marked = scratch(fingerprints(docs, words), "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp"), radius, segments)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(low, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# Near copies by likeness ---------------------------------------------------------------------------------------------

#: Odd multipliers that join the hashes of neighbouring words, and the steps of a 64-bit mixer: fixed values.
_GOLDEN, _MIX_1, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX_1
    x = (x ^ x >> np.uint64(27)) * _MIX_2
    return x ^ x >> np.uint64(31)


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles (A-Z lower-cased; the whole sequence where there are fewer words)."""
    found = (text or "").encode().lower().split()
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = max(min(1, len(each)), len(each) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(each))):
        out = _mixed(out + each[i : i + n] + _GOLDEN)
    return np.unique(out)


def wide_simhash(text: str | None, words: int = 5, bits: int = 1024) -> bytes:
    """A fingerprint of so many bits: of each bit, whether over half of the distinct shingles' hashes set it. Zeros for a text without words."""
    hashes, lanes = shingle_hashes(text, words), np.arange(1, bits // 64 + 1, dtype=np.uint64) * _GOLDEN
    votes = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 255):  # a byte can count so many
        part = _mixed(hashes[i : i + 255, None] ^ lanes)
        votes += np.unpackbits(part.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes)).tobytes()


def wide_fingerprints(docs: DataFrame, words: int = 5, bits: int = 1024) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, text_hash, fp: 64 bits in each long, node: a hash of fp): one row for each row, repeated or not, whole texts. Null and empty
    texts give zeros, null ids stay null, extra columns are ignored, an empty table gives no rows."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            flat = np.frombuffer(b"".join(wide_simhash(t, words, bits) for t in b.column("text").to_pylist()), "<i8")
            fps = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * (bits // 64), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), fps], ["doc_id", "text_hash", "fp"])

    found = docs.select("doc_id", "text", _text_hash()).mapInArrow(run, f"doc_id {kind.simpleString()}, text_hash bigint, fp array<bigint>")
    return found.withColumn("node", F.xxhash64("fp"))


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = 5) -> DataFrame:
    """docs (text, ...) and wanted (node, text_hash; distinct) -> (node, hashes: the text's distinct shingle hashes, ascending). Null and empty texts have no hashes; copies give one
    row; texts that aren't wanted are read but not cut up. Extra columns are ignored; empty tables give no rows."""
    small_batches(docs.sparkSession)
    wanted = scratch(wanted.select("node", F.col("text_hash").alias("wanted_hash")), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    asked = docs.select("text", _text_hash()).join(wanted, F.col("text_hash") == F.col("wanted_hash")).select("node", "text")

    def run(batches):
        for b in batches:
            sets = [shingle_hashes(t, words).view("<i8") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return scratch(asked.mapInArrow(run, "node bigint, hashes array<bigint>").dropDuplicates(["node"]), "sets")


def most_bits(likeness: float, bits: int) -> int:
    """How many bits two sets of one size and this Jaccard likeness differ in, on average: the angle between them over pi."""
    return round(bits * math.acos(2 * likeness / (1 + likeness)) / math.pi)


def unsure_bits(likeness: float, bits: int, errors: float = 3.0) -> tuple[int, int]:
    """(surely near, surely far): distances at so many standard errors below and above the one of this likeness."""
    chance = most_bits(likeness, bits) / bits
    error = math.sqrt(bits * chance * (1 - chance))
    return round(bits * chance - errors * error), round(bits * chance + errors * error)


#: Fingerprints in a task that writes their segments: each gives a row a segment, and the task that reads these back counts nearly as many keys in memory.
SEGMENT_NODES = 4096


def segment_keys(fps: DataFrame, bits: int = 1024, segments: int = 128, width: int = 24, seed: int = 5, nodes: int = SEGMENT_NODES) -> DataFrame:
    """fps (node, fp) -> (node, key long): one row for each segment, a fixed choice of width bits; the key tells the segment and its bits. Partitions hold about `nodes`
    fingerprints each, however few tasks fps has. No fingerprints give no rows."""
    rng = np.random.default_rng(seed)
    chosen = np.stack([rng.choice(bits, width, replace=False) for _ in range(segments)])
    weights, number = 1 << np.arange(width, dtype=np.int64), np.arange(segments, dtype=np.int64) << width

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 250):
                part = b.slice(i, 250)
                set_bits = np.unpackbits(part.column("fp").flatten().to_numpy().view(np.uint8).reshape(part.num_rows, -1), axis=1)
                keys = set_bits[:, chosen].astype(np.int64) @ weights + number
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), segments)), pa.array(keys.ravel())], ["node", "key"])

    dealt = fps.select("node", "fp").repartition(-(-fps.count() // nodes) or 1, "node")
    return dealt.mapInArrow(run, "node bigint, key bigint")


def _within(pairs: DataFrame, fps: DataFrame, radius: int, bits: int) -> DataFrame:
    """The pairs (u, v, ...) whose whole fingerprints differ in at most radius bits, with the number of these (apart)."""
    a, b = (fps.select(F.col("node").alias(x), F.col("fp").alias(f"{x}_fp")) for x in ("u", "v"))
    distance = F.lit(0)
    for i in range(bits // 64):
        distance = distance + F.bit_count(F.col("u_fp")[i].bitwiseXOR(F.col("v_fp")[i]))
    return pairs.join(a, "u").join(b, "v").withColumn("apart", distance).filter(F.col("apart") <= radius).select(*pairs.columns, "apart")


def _met_blocks(rows: DataFrame, held: DataFrame, block: int) -> DataFrame:
    """rows (key, node, root) and held (node, weight, what: a struct) -> (key, a, b: lists of (node, root, what)): blocks of a key that are to be compared.

    Nodes of a key lie in blocks of about `block` by weight, so pairs are never rows: a root with more than that under a key has blocks of its own, which are not compared with one
    another, and all smaller ones share blocks. A block of a key meets each other block of it once, in a task that holds the two."""
    small_batches(rows.sparkSession)
    rows = rows.join(held.select("node", "weight"), "node")
    each = rows.groupBy("key", "root").agg(F.sum("weight").alias("n"))
    mixed = each.groupBy("key").agg(F.sum(F.when(F.col("n") <= block, F.col("n")).otherwise(0)).alias("mixed"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").drop("groups")
    sized = rows.join(each.join(mixed, "key"), ["key", "root"])
    own = F.col("n") > block
    dealt = sized.select("key", "node", "root", F.when(own, F.col("root")).alias("own"), F.pmod(F.xxhash64("node"), F.ceil(F.when(own, F.col("n")).otherwise(F.col("mixed")) / block)).alias("part"))
    held = scratch(dealt.join(held.select("node", "what"), "node").groupBy("key", "own", "part").agg(F.collect_list(F.struct("node", "root", "what")).alias("held")), "blocks")
    left, right = (held.select("key", *[F.col(k).alias(f"{side}_{k}") for k in ("own", "part", "held")]) for side in ("a", "b"))
    order = F.struct(F.coalesce("a_own", F.lit(0)), F.col("a_own").isNull(), "a_part") <= F.struct(F.coalesce("b_own", F.lit(0)), F.col("b_own").isNull(), "b_part")
    met = left.join(right, "key").filter(order & F.coalesce(F.col("a_own") != F.col("b_own"), F.lit(True)))
    return met.select("key", F.col("a_held").alias("a"), F.col("b_held").alias("b"))


def _side(column, i: int, bits: int):
    """(nodes, roots, fingerprints, what) of the i-th block of a column."""
    found = column.slice(i, 1).flatten()
    what = found.field("what")
    return found.field("node").to_numpy(zero_copy_only=False), found.field("root").to_numpy(zero_copy_only=False), what.field("fp").flatten().to_numpy().view("<u8").reshape(-1, bits // 64), what


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _columns(rows, **kinds: pa.DataType) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def compared(rows: DataFrame, fps: DataFrame, low: int, high: int, bits: int = 1024, block: int = 256) -> DataFrame:
    """rows (key, node, root) -> (link, key, x, y), distinct. Of every two nodes that share a key and have different roots: a link of their roots (null, x < y) where they differ in
    at most low bits, and for each of them an unsure row (key, its node, its root) where they differ in more, but at most high bits. No rows give none."""
    prints = fps.select("node", F.lit(1).alias("weight"), F.struct("fp").alias("what"))

    def run(batches):
        for b in batches:
            found = set()
            for i, key in enumerate(b.column("key").to_pylist()):
                (m, r, x, _), (n, s, y, _) = _side(b.column("a"), i, bits), _side(b.column("b"), i, bits)
                apart, other = _distances(x, y), r[:, None] != s[None]
                u, v = np.nonzero((apart <= low) & other)
                found.update((True, None, *pair) for pair in zip(np.minimum(r[u], s[v]).tolist(), np.maximum(r[u], s[v]).tolist()))
                unsure = (apart > low) & (apart <= high) & other
                for nodes, roots, some in ((m, r, unsure.any(1)), (n, s, unsure.any(0))):
                    found.update((False, key, *pair) for pair in zip(nodes[some].tolist(), roots[some].tolist()))
            yield _columns(found, link=pa.bool_(), key=pa.int64(), x=pa.int64(), y=pa.int64())

    return _met_blocks(rows, prints, block).mapInArrow(run, "link boolean, key bigint, x bigint, y bigint").distinct()


def exact_links(rows: DataFrame, held: DataFrame, low: int, high: int, likeness: float, bits: int = 1024, block_bytes: int = 65536) -> DataFrame:
    """rows (key, node, root) and held (node, fp, hashes) -> (r, s): roots that nodes of a Jaccard likeness of at least `likeness` link, of those that share a key and differ in more than
    low and at most high bits. Of links within two blocks that follow from others of them, some are left out. A long text's block holds little else. No rows give none."""
    what = held.select("node", (F.size("hashes") * 8 + bits // 8).alias("weight"), F.struct("fp", "hashes").alias("what"))

    def run(batches):
        for b in batches:
            links, up = set(), {}

            def top(x: int) -> int:
                while up.get(x, x) != x:
                    x = up[x]
                return x

            for i in range(b.num_rows):
                (_, r, x, p), (_, s, y, q) = _side(b.column("a"), i, bits), _side(b.column("b"), i, bits)
                apart = _distances(x, y)
                u, v = np.nonzero((apart > low) & (apart <= high) & (r[:, None] != s[None]))
                order = np.argsort(apart[u, v], kind="stable")  # the nearest first: what they link needs no more looking at
                p, q = p.field("hashes"), q.field("hashes")
                for j, k in zip(u[order].tolist(), v[order].tolist()):
                    one, two = top(int(r[j])), top(int(s[k]))
                    if one == two:
                        continue
                    a, c = p[j].values.to_numpy(), q[k].values.to_numpy()
                    if min(len(a), len(c)) >= likeness * max(len(a), len(c)):
                        both = np.intersect1d(a, c, assume_unique=True).size
                        if both >= likeness * (len(a) + len(c) - both):
                            up[max(one, two)] = min(one, two)
                            links.add((min(int(r[j]), int(s[k])), max(int(r[j]), int(s[k]))))
            yield _columns(links, r=pa.int64(), s=pa.int64())

    return _met_blocks(rows, what, block_bytes).select("a", "b").mapInArrow(run, "r bigint, s bigint").distinct()


def likeness_roots(fps: DataFrame, radius: int, bits: int = 1024, segments: int = 128, width: int = 24, rounds: int = 0, block: int = 256, exact: tuple[int, float, Callable] | None = None) -> DataFrame:
    """fps (node, fp; distinct) -> (node, root): the components of all links of at most radius bits between nodes that share a segment; nodes without a link are left out.

    First each node meets the smallest node of each of its buckets, so a crowd of thousands of near copies becomes a few groups for a row a member and bucket. In each round, the rows of a
    bucket are aggregated to one for each group in it, and one node of each group, chosen by a hash of the round, meets the bucket's first one. The rounds decide nothing: at last all
    nodes that share a bucket and are still in different groups are compared, in blocks (compared).

    exact: (high, likeness, sets). Then links are also those of up to `high` bits whose sets, sets(nodes) -> (node, hashes), are so alike; only nodes with such a distance to
    a node of another group, in a bucket of both, have their sets read (exact_links)."""
    high = exact[0] if exact else radius
    keys = scratch(segment_keys(fps, bits, segments, width), "segments")
    buckets = keys.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = scratch(keys.join(buckets, "key"), "buckets")
    asked = met.filter("node <> center").groupBy(F.col("center").alias("u"), F.col("node").alias("v")).agg((F.min("members") == 2).alias("alone"))
    near = scratch(_within(asked, fps, high, bits), "near")
    roots = scratch(components(near.filter(F.col("apart") <= radius)), "roots")
    more = met.filter("members > 2").select("key", "node")  # a pair has met

    def joined(links: DataFrame, name: str) -> DataFrame | None:
        """The roots after links (r, s) between roots, or None where there are none. Only the linked groups' roots go through components."""
        links = scratch(links, f"links_{name}")
        if links.isEmpty():
            return None
        merged = components(links.select(F.col("r").alias("u"), F.col("s").alias("v"))).select(F.col("node").alias("old"), F.col("root").alias("new"))
        merged = scratch(merged, f"merged_{name}")
        moved = roots.join(merged, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
        alone = merged.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
        return scratch(moved.unionByName(alone), f"roots_{name}")

    def several(rows: DataFrame, name: str) -> DataFrame:
        """rows (key, node) with the root, as it is now, of the node, where the key has several roots."""
        now = roots.select("node", "root")
        rooted = scratch(rows.join(now, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), f"rooted_{name}")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        return scratch(rooted.join(mixed, "key", "left_semi"), f"several_{name}")

    for i in range(1, rounds + 1):
        rows = several(more, str(i))
        more = rows.select("key", "node")
        one = rows.groupBy("key", "root").agg(F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("order"), "node")).alias("one"))
        first = one.groupBy("key").agg(F.min(F.struct("one", "root")).alias("first"))
        u, v = F.col("first.one.node"), F.col("one.node")
        asked = one.join(first, "key").filter(u != v).select(u.alias("u"), v.alias("v"), F.col("first.root").alias("r"), F.col("root").alias("s")).distinct()
        found = joined(_within(asked, fps, radius, bits), str(i))
        if found is None:
            break
        roots = found
    last = scratch(compared(several(more, "last"), fps, radius, high, bits, block), "compared")
    found = joined(last.filter("link").select(F.col("x").alias("r"), F.col("y").alias("s")), "last")
    roots = roots if found is None else found
    if exact is None:
        return roots
    # A bucket of two is settled by its pair's distance; where that leaves it open, the pair is a key of its own.
    pairs = near.filter((F.col("apart") > radius) & F.col("alone")).select(F.xxhash64("u", "v").alias("key"), F.explode(F.array("u", "v")).alias("node"))
    unsure = last.filter("NOT link").select("key", F.col("x").alias("node")).unionByName(pairs).distinct()
    unsure = scratch(unsure.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "unsure")
    if unsure.isEmpty():
        return roots
    held = fps.select("node", "fp").join(exact[2](unsure.select("node").distinct()), "node")
    found = joined(exact_links(unsure, held, radius, high, exact[1], bits), "exact")
    return roots if found is None else found


def like_groups(docs: DataFrame, words: int = 5, likeness: float = 0.8, bits: int = 1024, segments: int = 128, width: int = 24) -> DataFrame:
    """docs -> (doc_id, component_id): texts whose sets of word shingles have a Jaccard likeness of `likeness` or more are linked; component_id is
    the smallest doc_id of the group (null last).

    Pairs that share a segment of their long SimHash fingerprints meet. Distances three standard errors from that of `likeness` decide (unsure_bits); between, the sets are
    compared. Null and empty texts are alike. Extra columns are ignored; an empty table gives no rows."""
    marked = scratch(wide_fingerprints(docs, words, bits), "wide_simhash")
    fps = scratch(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash")), "distinct_simhash")
    near, far = unsure_bits(likeness, bits)
    sets = lambda nodes: shingle_sets(docs, fps.join(nodes, "node"), words)
    roots = likeness_roots(fps, near, bits, segments, width, exact=(far, likeness, sets))
    rooted = fps.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.select("doc_id", "node").join(rooted.join(low, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs without those that come after another row of their group (see like_groups): by doc_id, null last, then by the text's SHA-256. What stays is
    whole, with all columns, whatever their names. Rows that agree in doc_id and text stay together. Null and empty texts are alike; an empty table gives no rows.

    Where ids repeat or are null, rows are told apart by id and text."""
    if ids_tell_rows(docs):
        found = like_groups(docs, **settings)
        return without(docs, scratch(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone"))
    keyed = docs.select(row_key().alias("key"), F.struct("*").alias("row"))
    found = like_groups(keyed.select(F.col("key").alias("doc_id"), "row.text"), **settings)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.digest").alias("digest")).distinct()
    gone = scratch(gone, "gone")
    if gone.count() <= BROADCAST_IDS // 4:  # longer keys than ids alone
        gone = F.broadcast(gone)
    kept = keyed.join(gone, F.col("key.doc_id").eqNullSafe(F.col("id")) & (F.col("key.digest") == F.col("digest")), "left_anti")
    return kept.select("row.*")

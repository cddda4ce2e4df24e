"""URL filters: a blocked Bloom filter passes possible hits of a rule list to an exact hash join.

A listed entry is a canonical URL prefix: host and path. A page's keys are its host's listed domain suffixes joined with the path
prefixes that have a length listed there. The filter is a table of 512-bit blocks: a key's hash names one block and eight bits in
it. Keys whose bits are all set go on to the exact join, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without :// and for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def _bits(key: Column, blocks: int) -> list[Column]:
    """The block's number and a mask of one bit for each of the block's eight words."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    masks = [F.expr("shiftleft(1L, 0)") * 0 + F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(LANES)]
    return [F.pmod(h, F.lit(blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)]]


def bloom(keys: DataFrame, n: int, bits_a_key: int = 16) -> tuple[DataFrame, int]:
    """keys (key) -> the filter's rows (block, w0 .. w7) and its number of blocks. Built by bitwise or for each block."""
    blocks = max(1, -(-n * bits_a_key // (64 * LANES)))
    marked = keys.select(*_bits(F.col("key"), blocks))
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)]), blocks


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """pages (page_id, url, ...), rules (host, path, verdict) -> (page_id, host, path, rule, verdict): one row for each
    row of pages; the longest fitting rule wins, then block before allow; without one, default.

    A null url, or one without ://, has an empty host and path and fits no rule. Repeated rows and rules are harmless,
    rules with a null are ignored; an empty table gives no rows, and no rules give the default. Extra columns are ignored.

    Keys are made for distinct (host, path) only. The filter's size is known from the rules' number: it is broadcast up to broadcast_bytes and
    joined by block beyond that; survivors join the rules by key."""
    rules = rules.dropna(subset=["host", "path", "verdict"])
    listed = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max_by("verdict", F.struct((F.col("verdict") == "block"))).alias("listed_verdict"), F.first("host").alias("listed_host"))
    n = listed.count()
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not n:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Path prefixes are made only below listed hosts, and only of the lengths that the host's own rules have.
    hosts = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths"))
    distinct = parts.select("host", "path").distinct().filter("host <> ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = distinct.withColumn("suffix", F.explode(suffixes)).join(hosts, "suffix")
    length = F.explode(F.filter("lengths", lambda k: k <= F.length("path")))
    keys = below.select("host", "path", "suffix", length.alias("length")).withColumn("prefix", F.substring(F.col("path"), F.lit(1), F.col("length")))
    keys = keys.select("host", "path", "suffix", "prefix", F.concat("suffix", "prefix").alias("key"))
    table, blocks = bloom(listed.select("key"), n)
    if blocks * 8 * (LANES + 1) <= broadcast_bytes:
        table = F.broadcast(table)
    probe = keys.select("host", "path", "suffix", "prefix", "key", *[c.alias(f"m{i}" if i >= 0 else "block") for i, c in enumerate(_bits(F.col("key"), blocks), -1)])
    hit = F.lit(True)
    for i in range(LANES):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    maybe = probe.join(table, "block").filter(hit).select("host", "path", "suffix", "prefix", "key")
    sure = maybe.join(listed, "key")
    best = F.max(F.struct(F.length("key").alias("n"), (F.col("listed_verdict") == "block").alias("blocks"), F.col("key").alias("rule"), F.col("listed_verdict").alias("verdict")))
    found = sure.groupBy("host", "path").agg(best.alias("best"))
    return parts.join(found, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

"""Trigram similarity and entity resolution."""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.sources import landing


def trigrams(c: Column) -> Column:
    """The set of trigrams of a text's words, each lower-cased and padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_union(x, y))), F.lit(0.0))


def _at_least(c: Column) -> Column:
    """The smallest whole number that isn't below c; a product like 0.6 * 5 may lie just above 3."""
    return F.ceil(c - 1e-9)


def _sets(names: DataFrame) -> DataFrame:
    """The distinct names as (name_id, name, grams, n). Names that collide in name_id are told apart at the last, when whole sets are compared."""
    sets = names.select("name").distinct().withColumn("grams", trigrams(F.col("name"))).filter(F.size("grams") > 0)
    return sets.select(F.xxhash64("name").alias("name_id"), "name", "grams", F.size("grams").alias("n"))


class TrigramIndex:
    """An inverted index of names that stays in a folder: a batch of names only probes it, and new names are appended.

    Tables: postings (g, name_id, n), bucketed by trigram, with each name's number of trigrams; names (name_id, name, grams), bucketed; keys (name_id, name, key), bucketed, the keys that bear a name;
    frequencies (g, f). Buckets are met without the index being shuffled. Any session that opens the folder registers its tables. One writer at a time."""

    TABLES = {"postings": ("g string, name_id bigint, n int", "g"), "names": ("name_id bigint, name string, grams array<string>", "name_id"), "keys": ("name_id bigint, name string, key {key}", "name_id, name"), "frequencies": ("g string, f bigint", None)}

    def __init__(self, spark: SparkSession, path: str | None = None, key_type: str = "string", buckets: int | None = None):
        self.spark, self.path = spark, (path or landing.folder(spark, "trigram_index")).rstrip("/")
        meta = f"{self.path}/_meta"
        try:
            self.buckets, self.key_type = spark.read.schema("buckets int, key_type string").parquet(meta).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self.buckets, self.key_type = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), key_type
            spark.createDataFrame([(self.buckets, self.key_type)], "buckets int, key_type string").coalesce(1).write.parquet(meta)
        tag = hashlib.sha256(self.path.encode()).hexdigest()[:20]
        self.names = {t: f"trigrams_{t}_{tag}" for t in self.TABLES}
        for t, (columns, by) in self.TABLES.items():
            cluster = f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS" if by else ""
            place = f"{self.path}/{t}".replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.names[t]} ({columns.format(key=self.key_type)}) USING parquet {cluster} LOCATION '{place}'")
            spark.catalog.refreshTable(self.names[t])

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def add(self, names: DataFrame) -> TrigramIndex:
        """names (key, name): appends the keys, and the names that the index lacks. A key that is added twice under one name is held twice; null and empty names are left out."""
        keyed = names.select(F.xxhash64("name").alias("name_id"), "name", F.col("key").cast(self.key_type).alias("key")).filter(F.size(trigrams(F.col("name"))) > 0)
        fresh = _sets(names).join(self.table("keys").select("name_id", "name"), ["name_id", "name"], "left_anti")
        path = landing.folder(self.spark, "trigrams_new")
        fresh.write.parquet(path)
        fresh = self.spark.read.schema(fresh.schema).parquet(path)
        postings = fresh.select(F.explode("grams").alias("g"), "name_id", "n")
        self._append("postings", postings, "g")
        self._append("frequencies", postings.groupBy("g").agg(F.count(F.lit(1)).alias("f")))
        self._append("keys", keyed, "name_id", "name")
        self._append("names", fresh.select("name_id", "name", "grams"), "name_id")
        return self

    def _append(self, name: str, rows: DataFrame, *by: str) -> None:
        (rows.repartition(self.buckets, *by) if by else rows.coalesce(1)).write.insertInto(self.names[name])  # frequencies: a row a trigram
        self.spark.catalog.refreshTable(self.names[name])

    def candidates(self, sets: DataFrame, least: float) -> DataFrame:
        """sets (name_id, n, grams) -> (l, r): every pair that may have a likeness of at least `least`, and few others.

        Of a name with n trigrams the ceil(t n) - 1 most frequent are set aside: who is t alike shares at least one of the rest, and, as it shares
        ceil(t / (1 + t) (n + m)) in all, at least that many less those set aside. Pairs that share fewer go before any set is read. The index has at most a row for each trigram of letters, digits and
        blanks, some 50,000, in its frequencies, so these are broadcast."""
        freq = F.broadcast(self.table("frequencies").groupBy("g").agg(F.sum("f").alias("f")))
        each = sets.select(F.col("name_id").alias("l"), F.col("n").alias("ln"), F.explode("grams").alias("g")).join(freq, "g", "left")
        rank = F.row_number().over(Window.partitionBy("l").orderBy(F.coalesce("f", F.lit(0)), "g"))
        aside = _at_least(F.col("ln") * least) - 1
        rare = each.withColumn("rank", rank).filter((F.col("rank") <= F.col("ln") - aside) & F.col("f").isNotNull()).select("l", "ln", "g")
        held = self.table("postings").select("g", F.col("name_id").alias("r"), F.col("n").alias("rn"))
        sized = (F.col("ln") >= _at_least(F.col("rn") * least)) & (F.col("rn") >= _at_least(F.col("ln") * least))
        shared = rare.join(held, "g").filter(sized).groupBy("l", "r", "ln", "rn").agg(F.count(F.lit(1)).alias("shared"))
        enough = F.col("shared") >= _at_least((F.col("ln") + F.col("rn")) * (least / (1 + least))) - aside
        return shared.filter(enough).select("l", "r")

    def probe(self, asked: DataFrame, least: float, asked_id: str = "id", key: str = "key") -> DataFrame:
        """asked (id, name) -> (id, key, sim): every key with a name whose similarity is at least `least` (over 0). Distinct names are compared once; null and empty names match nothing."""
        path = landing.folder(self.spark, "asked_sets")
        sets = _sets(asked)
        sets.write.parquet(path)
        sets = self.spark.read.schema(sets.schema).parquet(path)
        l = sets.select(F.col("name_id").alias("l"), F.col("name").alias("l_name"), F.col("grams").alias("lg"))  # noqa: E741
        r = self.table("names").select(F.col("name_id").alias("r"), F.col("name").alias("r_name"), F.col("grams").alias("rg"))
        both = F.size(F.array_intersect("lg", "rg"))
        sim = both / (F.size("lg") + F.size("rg") - both)
        near = self.candidates(sets, least).join(l, "l").join(r, "r").select("l", "l_name", "r", "r_name", sim.alias("sim")).filter(F.col("sim") >= least)
        keys = self.table("keys").select(F.col("name_id").alias("r"), F.col("name").alias("r_name"), F.col("key").alias(key))
        who = asked.select(F.col(asked_id), F.col("name").alias("l_name"))
        return near.join(who, "l_name").join(keys, ["r", "r_name"]).select(asked_id, key, "sim")


#: Names of one trigram on either side that are compared at once, and pairs that are looked at together.
BLOCK, PAIRS = 50_000, 250_000
#: Cases and the places that are like theirs which resolve_scored broadcasts, some 30 MB; more are joined by a shuffle.
CASES = 2_000_000


def _landed(df: DataFrame, name: str) -> DataFrame:
    path = landing.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _landed_sets(names: DataFrame) -> DataFrame:
    """The distinct names as (no, name, grams), written: their numbers stay, and no set is made twice."""
    sets = names.select("name").distinct().select(F.monotonically_increasing_id().alias("no"), "name", trigrams(F.col("name")).alias("grams"))
    return _landed(sets, "name_sets").filter(F.size("grams") > 0)


def _fewest(n, m, least: float):
    """The fewest trigrams that sets of n and m share if they are `least` alike."""
    return np.maximum(np.ceil((n + m) * (least / (1 + least)) - 1e-9), 1).astype(np.int64)


def _fit(n, m, least: float):
    return (n >= np.ceil(m * least - 1e-9)) & (m >= np.ceil(n * least - 1e-9))


def _dealt(sets: DataFrame, side: int, ranked: list[str], mine: np.ndarray, theirs: np.ndarray, first: np.ndarray) -> DataFrame:
    """(no, tag, grams) -> (key, no, tag, grams): a row for each of the first[n] rarest of a name's n trigrams. key: the trigram, the cell of its grid and the side; grams: two bytes a trigram, by rarity.

    A trigram with many names has a grid of cells, mine times theirs, so that no cell has more than about BLOCK names of a side."""

    def rows(batches):
        known = pa.array(ranked)
        for batch in batches:
            lists = batch.column("grams")
            ends = lists.offsets.to_numpy().astype(np.int64)
            n, row = np.diff(ends), np.repeat(np.arange(len(lists)), np.diff(ends))
            codes = np.sort(row << 16 | pc.index_in(lists.flatten(), value_set=known).to_numpy().astype(np.int64)) & 0xFFFF
            at = np.arange(len(codes)) - np.repeat(ends[:-1] - ends[0], n)
            took = at < first[n][row]
            g, row = codes[took], row[took]
            no, tag = batch.column("no").to_numpy(), batch.column("tag").to_numpy()
            part = no[row] % mine[g]
            times = theirs[g]
            other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            g, row, part = (np.repeat(x, times) for x in (g, row, part))
            cell = part * theirs[g] + other if side else other * mine[g] + part
            binary = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(((ends - ends[0]) * 2).astype(np.int32)), pa.py_buffer(codes.astype(np.uint16))])
            yield pa.RecordBatch.from_arrays([pa.array(g << 40 | cell << 1 | side), pa.array(no[row]), pa.array(tag[row]), binary.take(pa.array(row))], ["key", "no", "tag", "grams"])

    return sets.select("no", "tag", "grams").mapInArrow(rows, "key bigint, no bigint, tag bigint, grams binary")


class _Names:
    """The names of a cell on one side: their trigrams, the place of the cell's trigram, and bits by which most pairs are told apart."""

    def __init__(self, no, tag, codes, n, g: int):
        self.no, self.tag, self.codes, self.n = no, tag, codes, n
        self.start = np.cumsum(n) - n
        self.place = np.flatnonzero(codes == g) - self.start
        self.bits, self.lost = self.sketch(2)
        self.entries: dict[int, tuple] = {}

    def sketch(self, words: int):
        """64 bits a word, which of them the trigrams fall on, and how many trigrams fall on those of others."""
        bit, word = np.left_shift(np.uint64(1), (self.codes & 63).astype(np.uint64)), self.codes >> 6 & words - 1
        bits = [np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), self.start) for k in range(words)]
        return bits, (self.n - sum(np.bitwise_count(x).astype(np.int64) for x in bits)).astype(np.uint16)

    @cached_property
    def wide(self):
        bits, lost = self.sketch(8)
        return np.stack(bits, 1), lost

    def seconds(self, m: int, least: float):
        """Of the names with m trigrams: the rarer trigrams after the cell's, with their places, sorted, and the names that have them."""
        if m not in self.entries:
            row = np.flatnonzero(self.n == m)
            key, row = _after(self, row, np.full(len(row), min(m - 1, m - int(np.ceil(m * least - 1e-9)) + 1)))
            order = np.argsort(key, kind="stable")
            self.entries[m] = key[order], row[order]
        return self.entries[m]

    def padded(self, row, blank: int):
        at = np.arange(self.n[row].max())
        inside = at < self.n[row][:, None]
        return np.where(inside, self.codes[np.where(inside, self.start[row][:, None] + at, 0)], blank)


def _after(names: _Names, row, last):
    """The trigrams of names at the places after the cell's up to `last`: trigram and place in one number, and the name."""
    times = np.maximum(last - names.place[row], 0)
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(names.place[row] + 1, times)
    row = np.repeat(row, times)
    return names.codes[names.start[row] + place].astype(np.int64) << 20 | place, row


def _paired(l: _Names, r: _Names, least: float):  # noqa: E741
    """Yields (i, j, fewest): names of l and r that may have a likeness of at least `least`, all pairs of an i together, and how many trigrams they share at least if so. Sets that share a trigrams, the first of them the cell's, share another one of the first
    n - a + 2 of the one and m - a + 2 of the other."""
    if len(l.no) * len(r.no) <= 4096:
        i, j = (x.ravel() for x in np.nonzero(_fit(l.n[:, None], r.n, least)))
        yield i, j, _fewest(l.n[i], r.n[j], least)
        return
    for m in np.unique(r.n):
        fewest = _fewest(l.n, m, least)
        fit = _fit(l.n, m, least) & (l.place <= l.n - fewest)
        one = np.flatnonzero(fit & (fewest == 1))
        row = np.flatnonzero(fit & (fewest > 1))
        every = np.flatnonzero(r.n == m)
        key, held = r.seconds(int(m), least) if len(row) else (None, None)
        want, row = _after(l, row, (l.n - fewest + 1)[row])
        want >>= 20
        low = np.searchsorted(key, want << 20) if len(row) else row
        high = np.searchsorted(key, want << 20 | (m - fewest[row] + 1), "right") if len(row) else row
        for first, count, named, at in ((low, high - low, row, held), (np.zeros_like(one), np.full(len(one), len(every)), one, every)):
            total = np.cumsum(count)
            ends = np.flatnonzero(np.append(named[1:] != named[:-1], True)) + 1 if len(named) else named
            begin = 0
            while begin < len(named):
                done = total[begin - 1] if begin else 0
                end = max(int(ends[np.searchsorted(ends, np.searchsorted(total, done + PAIRS, "right"), "right") - 1]) if total[-1] > done + PAIRS else len(named), int(ends[np.searchsorted(ends, begin, "right")]))
                c = count[begin:end]
                i = np.repeat(named[begin:end], c)
                yield i, at.take(np.arange(len(i)) + np.repeat(first[begin:end] - (np.cumsum(c) - c), c)), fewest.take(i)
                begin = end


def _alike(l: _Names, r: _Names, least: float):  # noqa: E741
    """Yields (l's no and tag, r's no, sim) of the pairs that are at least `least` alike and of whose shared trigrams the cell's is the rarest."""
    for i, j, fewest in _paired(l, r, least):
        most = np.minimum(l.lost.take(i), r.lost.take(j))
        for a, b in zip(l.bits, r.bits):
            most += np.bitwise_count(a.take(i) & b.take(j))
        left = np.flatnonzero(most >= fewest)
        if not len(left):
            continue
        i, j, fewest = i[left], j[left], fewest[left]
        most = np.bitwise_count(l.wide[0].take(i, 0) & r.wide[0].take(j, 0)).sum(1) + np.minimum(l.wide[1].take(i), r.wide[1].take(j))
        left = np.flatnonzero(most >= fewest)
        pairs = np.unique(i[left] * len(r.no) + j[left])
        step = max(1, 4_000_000 // int(l.n.max() * r.n.max()))
        for k in range(0, len(pairs), step):
            i, j = np.divmod(pairs[k : k + step], len(r.no))
            hit = (l.padded(i, 65535)[:, :, None] == r.padded(j, 65534)[:, None, :]).any(2)
            both = hit.sum(1)
            sim = both / (l.n[i] + r.n[j] - both)
            ok = (sim >= least) & (hit.argmax(1) == l.place[i])
            yield l.no[i[ok]], l.tag[i[ok]], r.no[j[ok]], sim[ok]


def _met(least: float):
    """Rows of _dealt, sorted by key -> (l, tag, r, sim). A cell's names on the right are held, those on the left come by batches."""

    def rows(batches):
        now, held, index, out, size = -1, [], None, [], 0
        for batch in batches:
            (key, no, tag), lists = (batch.column(x).to_numpy() for x in ("key", "no", "tag")), batch.column("grams")
            _, ends, data = lists.buffers()
            ends = np.frombuffer(ends, np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64) // 2
            codes = np.frombuffer(data, np.uint16, ends[-1]) if len(lists) else None
            cuts = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else []
            for a, b in zip(cuts, [*cuts[1:], len(key)]):
                cell, side = divmod(int(key[a]), 2)
                run = no[a:b], tag[a:b], codes[ends[a] : ends[b]].astype(np.int64), np.diff(ends[a : b + 1])
                if not side:
                    if cell != now:
                        now, held, index = cell, [], None
                    held.append(run)
                elif cell == now:
                    index = index or _Names(*(np.concatenate(x) for x in zip(*held)), cell >> 39)
                    for found in _alike(_Names(*run, cell >> 39), index, least):
                        out.append(found)
                        size += len(found[0])
                        if size >= 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["l", "tag", "r", "sim"])
                            out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["l", "tag", "r", "sim"])

    return rows


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left (no, grams, tag if there is one), right (no, grams) -> (l, tag, r, sim): every pair with a likeness of at least `least` (over 0), once. Numbers that come again are compared each time.

    Exact. Pairs that are alike share one of the rarest trigrams of both, so only these are dealt out (the lengths that the other side has tell how many). In the task of such a trigram, pairs are made
    by a second rare trigram, told apart by 128 bits, then by 512, and compared whole; only those that are alike leave it, so that neither pairs that share trigrams nor their counts are shuffled.
    At most some 50,000 trigrams are made of letters, digits and blanks; their counts and the lengths of the sets go through the driver."""
    left, right = (x if "tag" in x.columns else x.withColumn("tag", F.lit(0).cast("bigint")) for x in (left, right))
    each = left.select("grams", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select("grams", F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = sorted(each.select(F.explode("grams").alias("g"), "a", "b").groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect(), key=lambda x: (x.a * x.b, x.a + x.b, x.g))
    lengths = each.select(F.size("grams").alias("n"), "a", "b").groupBy("n").agg(F.max("a").alias("a"), F.max("b").alias("b")).collect()
    grids = [np.array([-(-x[k] // BLOCK) or 1 for x in counts], np.int64) for k in "ab"]
    firsts = []
    for mine, theirs in ("ab", "ba"):
        first = np.zeros(max((x.n for x in lengths), default=0) + 1, np.int64)
        others = np.array([x.n for x in lengths if x[theirs]], np.int64)
        for x in lengths:
            if x[mine] and len(fit := others[_fit(x.n, others, least)]):
                first[x.n] = x.n - _fewest(x.n, fit, least).min() + 1
        firsts.append(first)
    ranked = [x.g for x in counts]
    dealt = _dealt(left, 1, ranked, *grids, firsts[0]).unionByName(_dealt(right, 0, ranked, *grids[::-1], firsts[1]))
    return dealt.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(_met(least), "l bigint, tag bigint, r bigint, sim double")


def trigram_join(left: DataFrame, right: DataFrame, least: float, left_id: str = "l_id", right_id: str = "r_id") -> DataFrame:
    """left (l_id, name), right (r_id, name) -> every pair with a similarity of at least `least` (over 0), with sim. Exact; null and empty names match nothing. Where the right side stays, keep an index of it and probe that."""
    left = _landed(left.select(left_id, "name"), "asked_names")  # it may stand for long work, and is read twice
    l, r = _landed_sets(left), _landed_sets(right)  # noqa: E741
    who = left.join(l.select("name", F.col("no").alias("l")), "name").select(left_id, "l")
    keys = right.select(right_id, "name").join(r.select("name", F.col("no").alias("r")), "name").select(right_id, "r")
    return similar_sets(l, r, least).drop("tag").join(who, "l").join(keys, "r").select(left_id, right_id, "sim")


def resolve_tiered(names: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.45, top: int = 5) -> DataFrame:
    """names (id, name in normal form) -> (id, entity_id, tier, sim, rank): exact, else alias, else the best by trigrams."""
    exact = names.join(entities.select(F.col("norm_name").alias("name"), "entity_id"), "name").select("id", "entity_id", F.lit("exact").alias("tier"), F.lit(1.0).alias("sim"))
    rest = names.join(exact.select("id"), "id", "left_anti")
    alias = rest.join(aliases.select(F.col("alias_norm").alias("name"), "entity_id"), "name").select("id", "entity_id", F.lit("alias").alias("tier"), F.lit(1.0).alias("sim"))
    rest = rest.join(alias.select("id"), "id", "left_anti")
    near = trigram_join(rest.select("id", "name"), entities.select("entity_id", F.col("norm_name").alias("name")), least, "id", "entity_id").filter(F.col("sim") > least)
    near = near.select("id", "entity_id", F.lit("trigram").alias("tier"), "sim")
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "entity_id")
    return exact.unionByName(alias).unionByName(near).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def resolve_scored(asked: DataFrame, entities: DataFrame, aliases: DataFrame, properties: DataFrame, history: DataFrame, least: float = 0.28, top: int = 5) -> DataFrame:
    """asked (id, name, address, borough, asset) -> (id, entity_id, score, rank): the best candidates by name and history.

    A candidate's name or one of its aliases has a similarity of at least `least`; the greater one counts. Added: 0.25 where it was a party at a property whose address has a similarity of
    0.72 or more to the one asked for, 0.08 for a deal in the borough, 0.08 for one of the asset type; a suspected shell company without such a property loses 0.06. Scores lie within 0 and
    1. entities (entity_id, norm_name, display_name, is_spv_suspect), aliases (entity_id, alias_norm), properties (property_id, address_norm), history (entity_id, property_id, borough,
    asset_type): one row for each party of a deal."""
    number = F.monotonically_increasing_id().alias("no")
    # What candidates are judged by is made once: for each entity (numbered in the order that settles ties) the places, boroughs and asset types of its history, for each case of address, borough and
    # asset type asked for the places whose address is alike. A pair meets its entity by one shuffle and its case, which it bears as a tag, in a broadcast, unless the cases are many.
    who = _landed(entities.select("entity_id", "norm_name", "display_name", "is_spv_suspect").orderBy("display_name", "entity_id").select(number, "entity_id", "norm_name", "is_spv_suspect"), "entities")
    places = _landed_sets(properties.select(F.col("address_norm").alias("name")))
    at = history.join(properties.select("property_id", F.col("address_norm").alias("name")).join(places.select("name", F.col("no").alias("place")), "name"), "property_id", "left")
    known = at.groupBy("entity_id").agg(F.collect_set("place").alias("places"), F.collect_set("borough").alias("boroughs"), F.collect_set(F.lower("asset_type")).alias("assets"))
    entity = who.select("entity_id", F.col("no").alias("r"), "is_spv_suspect").join(known, "entity_id", "left").drop("entity_id")
    asked = _landed(asked.select("id", "name", "address", "borough", F.lower("asset").alias("asset")), "asked")
    spots = _landed_sets(asked.select(F.col("address").alias("name")))
    alike = similar_sets(spots, places, 0.72).groupBy("l").agg(F.collect_list("r").alias("alike")).join(spots.select(F.col("no").alias("l"), F.col("name").alias("address")), "l").drop("l")
    cases = _landed(asked.select("address", "borough", "asset").distinct().join(alike, "address", "left").select(number, "address", "borough", "asset", "alike"), "cases")
    case = F.struct("address", "borough", "asset")
    rows = _landed(asked.withColumn("case", case).join(cases.select(F.col("no").alias("tag"), case.alias("_case")), F.col("case").eqNullSafe(F.col("_case"))).select(number, "id", "tag", trigrams(F.col("name")).alias("grams")), "asked_sets")
    names = who.select("no", F.col("norm_name").alias("name")).unionByName(aliases.select("entity_id", F.col("alias_norm").alias("name")).join(who.select("entity_id", "no"), "entity_id").select("no", "name"))
    sets = _landed(names.select("no", trigrams(F.col("name")).alias("grams")), "entity_sets")
    near = similar_sets(rows.filter(F.size("grams") > 0), sets.filter(F.size("grams") > 0), least).repartition("r").groupBy("r", "l", "tag").agg(F.max("sim").alias("name_score"))
    size = cases.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("alike")), F.lit(0))).first()[0]
    asked_for = cases.select(F.col("no").alias("tag"), "borough", "asset", "alike")
    j = near.join(entity, "r").join(F.broadcast(asked_for) if size <= CASES else asked_for, "tag")
    here = F.coalesce(F.arrays_overlap("places", "alike"), F.lit(False))
    sum_ = F.col("name_score") + F.when(here, 0.25).otherwise(0.0) + F.when(F.array_contains("boroughs", F.col("borough")), 0.08).otherwise(0.0) + F.when(F.array_contains("assets", F.col("asset")), 0.08).otherwise(0.0) - F.when(F.col("is_spv_suspect") & ~here, 0.06).otherwise(0.0)
    scored = j.select("l", "r", "name_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum_)), 4).alias("score"))
    w = Window.partitionBy("l").orderBy(F.col("score").desc(), F.col("name_score").desc(), "r")
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return best.join(rows.select(F.col("no").alias("l"), "id"), "l").join(who.select(F.col("no").alias("r"), "entity_id"), "r").select("id", "entity_id", "score", "rank")

"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, document after document, are packed into blocks of a fixed length. Output shards of a fixed number of
slots draw how many of their slots each source gets: a multinomial draw, made slot by slot with independent uniform numbers. A source's slots, numbered over all shards,
run through pseudorandom permutations of its block numbers (a Feistel network keyed by source and round), one for each round, and blocks join documents by source and
block number. All draws are hashes of fixed seeds, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import BROADCAST_IDS, WORD, ids_tell_rows, row_key, scratch


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): words between ASCII white space, null counts 0; tie is a hash of the text, which tells apart rows whose ids repeat or are null."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("tie"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """by_source (source, source_size), one row each -> with weight and target.

    Sources weigh in code point order, null last, the weights repeating. A target is the smaller of most x source_size and
    weight x level, where the level makes all targets sum to all sizes: sources sorted by how soon they are full, the level is the
    first at which those that are full and those that aren't add up. Windows run over one narrow row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    full = F.col("source_size") * most / F.col("weight")
    every = Window.partitionBy()
    before = Window.orderBy(full, "weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select("*", F.sum("source_size").over(every).alias("all"), F.sum("weight").over(every).alias("weights"), F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full_size"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("full_weight"))
    # The level if exactly the sources before this one are full; it holds where this one isn't.
    level = (F.col("all") - F.col("full_size") * most) / (F.col("weights") - F.col("full_weight"))
    fits = level * F.col("weight") <= F.col("source_size") * most
    ranked = ranked.withColumn("level", F.min(F.when(fits, F.struct(full, level))).over(every)["col2"])
    target = F.least(F.col("source_size") * float(most), F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * float(most)))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def unit(*columns: Column) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(1 << 53)


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """Where a permutation of 0 .. n - 1 that the key chooses sends i.

    i is a place in a grid of a x b, a and b about the root of n; four rounds shift its row by a hash of its column and the other way round, which permutes the grid. A place
    at n or beyond, of which there are fewer than a, is sent on until it lies below n."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    b = F.ceil(n / a).cast("bigint")

    def step(x: Column) -> Column:
        row, column = F.floor(x / b), x % b
        for k in range(2):
            row = (row + F.pmod(F.xxhash64(*key, F.lit(2 * k), column), a)) % a
            column = (column + F.pmod(F.xxhash64(*key, F.lit(2 * k + 1), row), b)) % b
        return row * b + column

    once = step(i)
    # A walk outside never meets a place twice. In a grid of up to 64 rows it ends within 64 steps; in a larger one each step ends it but with a chance below 1 / 64.
    onward = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once, lambda x, _: F.when(x < n, x).otherwise(step(x)))
    return F.when(once < n, once).otherwise(onward)


def draws(shares: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """shares (source, wish > 0), n slots dealt over shards -> (shard, source, count): how many of a shard's slots each source gets, where it gets any.

    Each slot's uniform number falls into one source's stretch of [0, 1). Stretches are cut at the borders of a grid, at least as fine as there are sources, so slots
    find theirs in an equi-join on the grid's cell."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("wish").over(Window.partitionBy())
    high = F.when(F.lead("wish").over(order).isNull(), F.lit(1.0)).otherwise(F.sum("wish").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total)
    spread = shares.select("source", high.alias("high"))
    spread = scratch(spread.select("source", F.coalesce(F.lag("high").over(order), F.lit(0.0)).alias("low"), "high"), "stretches")
    cells = max(1024, spread.count())
    cell = F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))))
    stretches = spread.filter("low < high").withColumn("cell", cell)
    slots = shares.sparkSession.range(n).select(F.floor(F.col("id") * shards / n).cast("bigint").alias("shard"), unit(F.lit(seed), F.col("id")).alias("u"))
    met = slots.withColumn("cell", F.floor(F.col("u") * cells)).join(stretches, "cell").filter("low <= u AND u < high")
    return met.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("count"))


def mix(docs: DataFrame, block: int = 32, shard_slots: int = 4096, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7, rows_a_bin: int = 2000, run: int = 1024, slots_a_task: int = 50_000):
    """Returns (documents, slots).

    documents: (doc_id, source, size, source_size, target, taken): one row for each row of docs; taken is how many words
    the mix takes from it, repeats counted, never over most x size.
    slots: (shard, source, slot, round, block): which block of which source each slot of the output holds.

    A null text has no words, a null source is a source of its own, the last. Rows may repeat. Extra columns are ignored; an
    empty table gives no rows, and documents without words take none.

    A document's place in its source is a running sum; to keep a hot source out of one task, rows fall into bins by hash, sums run within (source, bin),
    and bins are then summed. The number of bins follows the number of rows."""
    sized = scratch(sizes(docs), "sizes")
    bins = max(1, sized.count() // rows_a_bin)
    sized = sized.withColumn("bin", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.lit(bins)))
    by_bin = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    by_source = by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    aims = scratch(targets(by_source, weights, most).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint")), "targets")

    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bin.select("source", "bin", F.coalesce(F.sum("bin_size").over(up_to), F.lit(0)).alias("bin_start"))
    within = Window.partitionBy("source", "bin").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    row = Window.partitionBy("source", "bin").orderBy("doc_id", "size", "tie")
    numbered = sized.select("*", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("in_bin"), F.row_number().over(row).alias("row"))
    s, b = numbered.alias("s"), starts.alias("b")
    same = F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.bin") == F.col("b.bin"))
    placed = s.join(b, same).select("s.doc_id", "s.source", "s.size", "s.bin", "s.row", (F.col("b.bin_start") + F.col("s.in_bin")).alias("start"))

    # A source's share of the slots: its target in blocks of its own mean length.
    wish = F.col("target") * F.col("blocks") / F.col("source_size")
    shares = aims.filter("source_size > 0").select("source", wish.alias("wish"))
    n = int(round(shares.agg(F.sum("wish")).first()[0] or 0))
    shards = max(1, round(n / shard_slots))
    drawn = draws(shares, n, shards, seed).alias("d")
    z = aims.alias("z")
    counts = drawn.join(z, F.col("d.source").eqNullSafe(F.col("z.source"))).select("d.shard", "d.source", "z.blocks", "d.count", F.floor(F.col("d.shard") / run).alias("run"))
    counts = scratch(counts, "draws")
    # Where a shard's slots begin among its source's: sums within runs of shards, then over runs.
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    by_run = counts.groupBy("source", "run").agg(F.sum("count").alias("count")).select("source", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("run_first")).alias("r")
    inside = Window.partitionBy("source", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("in_run", F.coalesce(F.sum("count").over(inside), F.lit(0))).alias("c")
    here = F.col("c.source").eqNullSafe(F.col("r.source")) & (F.col("c.run") == F.col("r.run"))
    counts = counts.join(by_run, here).select("c.shard", "c.source", "c.blocks", "c.count", (F.col("r.run_first") + F.col("c.in_run")).alias("first"))
    # No block more than most times: a source that is full keeps within its rounds.
    counts = counts.withColumn("last", F.least(F.col("first") + F.col("count"), F.col("blocks") * most) - 1).filter("last >= first")
    # The counts are few rows that unfold to many slots: they are dealt out by the number of slots, not by their own size.
    dealt = counts.repartition(max(1, n // slots_a_task), "source", "shard")
    slots = dealt.select("shard", "source", "blocks", F.explode(F.sequence("first", "last")).alias("slot"))
    slots = slots.withColumn("round", F.floor(F.col("slot") / F.col("blocks")))
    index = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source"), F.col("round"))
    slots = slots.withColumn("block", index).select("shard", "source", "slot", "round", "block")

    times = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    spans = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    held = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    spans = spans.select("doc_id", "source", "bin", "row", "block", held.alias("held")).alias("s")
    # Sizes are estimated without what an explode adds, so adaptive execution would broadcast the blocks' times, a row a block, by way of the driver.
    t = times.hint("merge").alias("t")
    met = spans.join(t, F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.block") == F.col("t.block")))
    taken = met.groupBy("s.source", "s.bin", "s.row").agg(F.sum(F.col("s.held") * F.col("t.times")).alias("taken"))
    p, k, z = placed.alias("p"), taken.alias("k"), aims.alias("z")
    mine = F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.bin") == F.col("k.bin")) & (F.col("p.row") == F.col("k.row"))
    whole = p.join(k, mine, "left").join(z, F.col("p.source").eqNullSafe(F.col("z.source")))
    documents = whole.select("p.doc_id", "p.source", "p.size", "z.source_size", "z.target", F.coalesce("k.taken", F.lit(0)).cast("bigint").alias("taken"))
    return documents, slots


def mixed_documents(docs: DataFrame, seed: int = 7, **settings) -> DataFrame:
    """docs as the mix takes them, whole: each row taken / size times on average, the fraction settled by a hash of
    doc_id. Rows without words, null texts among them, stay once. Columns are those of docs, whatever their names; an empty table gives no rows.

    Where ids repeat or are null, rows are told apart by id, source and text, and the hash is of all three; rows that agree in these are one row,
    taken as often as all of them."""
    unique = ids_tell_rows(docs)
    keyed = docs.select((F.col("doc_id") if unique else row_key("source")).alias("key"), F.struct("*").alias("row"))
    documents, _ = mix(keyed.select(F.col("key").alias("doc_id"), "row.source", "row.text"), seed=seed, **settings)
    ratio = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1.0)
    times = F.floor(ratio + unit(F.lit(seed + 2), F.col("doc_id"))).cast("int")
    plan = documents.groupBy(F.col("doc_id").alias("id")).agg(F.sum(times).alias("times"), F.count(F.lit(1)).alias("rows")).filter("times > 0")
    plan = scratch(plan, "mix_plan")
    small = plan.count() <= (BROADCAST_IDS if unique else BROADCAST_IDS // 4)  # else texts and plan are shuffled by key

    def met(p: DataFrame) -> DataFrame:
        return keyed.join(F.broadcast(p) if small else p, F.col("key").eqNullSafe(F.col("id")))

    joined = met(plan.filter("rows = 1"))
    if not unique and not (repeated := plan.filter("rows > 1")).isEmpty():
        joined = joined.unionByName(met(repeated).dropDuplicates(["key"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")

"""Readers, sinks, streams, and the merge rules against sequential folds."""

import datetime
import json
import random
import re
import statistics
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from parcelflow.operators import matching, merge, nested, relational, similarity
from parcelflow.sources import tables
from parcelflow.streaming import incremental


def test_canonical_csv(spark, tmp_path):
    head = ",".join(tables.CANONICAL)
    row = lambda b: ",".join({"Borough": b, "Sale Price": "1200000.5", "Address": '"1 Main St, ""A"""'}.get(n, "") for n in tables.CANONICAL)
    (tmp_path / "f.csv").write_text("\n".join([head, row("Queens"), row("Yonkers"), row("")]))
    got = tables.canonical_csv(spark, str(tmp_path / "f.csv")).select("Borough", "Sale Price", "Address").collect()
    assert [tuple(r) for r in got] == [("Queens", 1200000.5, '1 Main St, "A"'), (None, 1200000.5, '1 Main St, "A"')]


def test_exclusion_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("addr_norm,price,reason,evidence,address,borough,source_url\na,,x,,,,\nb,5,y,,,,\n")
    assert [r.price for r in tables.exclusion_csv(spark, str(tmp_path / "f.csv")).orderBy("addr_norm").collect()] == [0.0, 5.0]


def test_listings(spark, tmp_path):
    one = {"location": {"state": "NY", "address": "1 Main"}, "listing": {"listing_id": "7"}, "pricing": {"asking_price": 5.0}, "property": {"property_types": ["Retail"]}, "relationships": {"agents": [{"full_name": "A B", "phone": None, "brokerage": {"name": "F"}}, {"full_name": "A B", "phone": "1", "brokerage": {"name": "F"}}, {"full_name": ""}]}}
    (tmp_path / "f.json").write_text(json.dumps(one) + "\n" + json.dumps({"listing": {"listing_id": "8"}}))
    df = tables.listings_json(spark, str(tmp_path / "f.json"))
    assert [(r.listing_id, r.asset_type, r.price) for r in df.orderBy("listing_id").collect()] == [("7", "Retail", 5.0), ("8", None, None)]
    assert [tuple(r) for r in tables.listing_agents(df).collect()] == [("A B", "F", "1")]


def test_upload_and_export(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Owner,Phone\nAcme,1\nBeta,\n")
    got = [tuple(r) for r in tables.upload_csv(spark, str(tmp_path / "u.csv")).select("row_num", "raw").collect()]
    assert got == [(1, {"Owner": "Acme", "Phone": "1"}), (2, {"Owner": "Beta", "Phone": None})]
    df = spark.createDataFrame([(1, ["a", "b"], {"k": "v"})], "id int, tags array<string>, extra map<string,string>").coalesce(1)
    tables.export_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines() == ['"id","tags","extra"', '"1","a; b","{""k"":""v""}"']
    tables.write_tables({"t": df}, str(tmp_path / "star"), "v1")
    assert spark.read.parquet(str(tmp_path / "star/v1/t")).count() == 1


def test_stream_runs_once(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.range(10).write.parquet(source)
    run = lambda: incremental.ingest(spark, source, "id bigint", lambda df, i: seen.append(df.count()), str(tmp_path / "ck"))
    run().awaitTermination(120)
    assert sum(seen) == 10
    run().awaitTermination(120)
    assert sum(seen) == 10  # nothing new
    spark.range(3).write.mode("append").parquet(source)
    run().awaitTermination(120)
    assert sum(seen) == 13


def test_stream_operators(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT 'u' AS url, timestamp '2024-01-01 00:00:00' AS seen_at UNION ALL SELECT 'u', timestamp '2024-01-01 01:00:00' UNION ALL SELECT 'v', timestamp '2024-01-01 01:00:00'").write.parquet(source)
    stream = spark.readStream.schema("url string, seen_at timestamp").parquet(source)
    q = incremental.discovered(stream).writeStream.format("memory").queryName("urls").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.url for r in spark.table("urls").collect()) == ["u", "v"]
    changes = stream.select(F.col("seen_at").alias("changed_at"), F.lit("new").alias("kind"))
    q = incremental.change_feed(changes).writeStream.outputMode("complete").format("memory").queryName("feed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.table("feed").collect()] == [3]


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from parcelflow.streaming import incremental
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {path!r} + "/w").getOrCreate()
store = incremental.Store(spark, {path!r} + "/store", "id bigint, v string", "id")
seen = []
def merge(batch, number):
    if {dies} and number == 1:
        # Between the rows and the commit of the second batch: its keys are written, its commit isn't.
        store.spark.createDataFrame = lambda *a, f=store.spark.createDataFrame: os._exit(7) if a[1:] == ("status string, n bigint",) else f(*a)
    store.merge(batch, number)
incremental.ingest(spark, {path!r} + "/in", "id bigint, v string", merge, {path!r} + "/ck", files_per_batch=1).awaitTermination()
print("ROWS", sorted(map(tuple, store.rows().collect())), sorted((r.status, r.n) for r in store.stats().groupBy("status").sum("n").withColumnRenamed("sum(n)", "n").collect()))
"""


def test_ingest_survives_the_death_of_its_process(spark, tmp_path):
    """The process dies between the rows and the commit of a batch; another goes on from storage alone, repeats the batch, and a third finds nothing to do."""
    for k, ids in enumerate([[1, 2, 2], [2, 3], [3, 4, 5]]):
        spark.createDataFrame([(i, f"v{i}") for i in ids], "id bigint, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda dies: subprocess.run([sys.executable, "-c", KILLED.format(root=str(Path(__file__).resolve().parents[1]), path=str(tmp_path), dies=dies)], capture_output=True, text=True, timeout=300)
    assert run(True).returncode == 7
    assert incremental.Store(spark, str(tmp_path / "store"), "id bigint, v string", "id", 2).rows().count() == 2  # the first batch
    want = "ROWS [(1, 'v1'), (2, 'v2'), (3, 'v3'), (4, 'v4'), (5, 'v5')] [('duplicate', 3), ('inserted', 5)]"
    for _ in range(2):
        out = run(False)
        assert [x for x in out.stdout.splitlines() if x.startswith("ROWS")] == [want], out.stderr[-2000:]


def test_states_of_urls_outlive_runs(spark, tmp_path):
    def told(rows, schema, flow, mode, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        incremental.run_to(flow(spark.readStream.schema(schema).parquet(str(tmp_path / name))), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck"), mode)
        return spark.read.option("basePath", str(tmp_path / f"{name}-out")).parquet(str(tmp_path / f"{name}-out/batch=*"))

    schema = "url string, pos bigint"
    told([("a", 1), ("b", 2), ("a", 3)], schema, incremental.first_seen, "append", "urls")
    got = told([("b", 4), ("c", 6), ("c", 5)], schema, incremental.first_seen, "append", "urls")
    assert [(r.url, r.pos) for r in got.orderBy("pos").collect()] == [("a", 1), ("b", 2), ("c", 5)]
    schema = "url string, nr bigint, disposition string"
    told([("a", 1, "fetch_error:HTTP"), ("b", 1, "ok"), ("a", 2, "fetch_error:timeout")], schema, incremental.fetch_state, "update", "fetches")
    got = told([("a", 3, "no_deal_node"), ("a", 4, "ok"), ("b", 2, "fetch_error:HTTP"), ("c", 1, "fetch_error:HTTP")], schema, incremental.fetch_state, "update", "fetches")
    last = {r.url: (r.attempts, r.disposition, r.eligible) for r in got.orderBy("batch").collect()}
    assert last == {"a": (3, "no_deal_node", False), "b": (1, "ok", False), "c": (1, "fetch_error:HTTP", True)}


def test_null_tolerant_rule_equals_a_fold(spark):
    rng = random.Random(2)
    dates = [None, "2020-01-01", "2020-02-01", "2020-03-01"]
    stored, batch = [], []
    for g in range(60):
        stored += [(g, 1.0, rng.choice(dates)) for _ in range(rng.choice([0, 0, 1, 2]))]
        batch += [(g, 1.0, rng.choice(dates)) for _ in range(rng.randint(1, 5))]
    batch = [(i, *b) for i, b in enumerate(batch)]
    held, want = {}, {}
    for g, _, d in stored:
        held.setdefault(g, []).append(d)
    for i, g, _, d in batch:
        mine = held.setdefault(g, [])
        dup = any(x is None or d is None or x == d for x in mine)
        want[i] = "duplicate" if dup else "inserted"
        if not dup:
            mine.append(d)
    s = spark.createDataFrame(stored, "property_id int, sale_price double, sale_date string")
    b = spark.createDataFrame(batch, "ord int, property_id int, sale_price double, sale_date string")
    assert dict(map(tuple, merge.null_tolerant_status(s, b).collect())) == want


def test_trigram_join_is_exact(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 9))) for _ in range(60)] + [None, "", "!!"]
    left = spark.createDataFrame(list(enumerate(names)), "l_id int, name string")
    right = left.withColumnRenamed("l_id", "r_id")

    def grams(x):
        words = [f"  {w} " for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()]
        return {w[i : i + 3] for w in words for i in range(len(w) - 2)}

    for least in (0.3, 0.6, 1.0):
        want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if grams(a) and grams(b) and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= least}
        assert {(r.l_id, r.r_id) for r in similarity.trigram_join(left, right, least).collect()} == want


def test_trigram_join_shuffles_no_pairs_before_they_are_compared(spark, monkeypatch):
    """Pairs that only share a trigram stay in the task of that trigram (they were counted in a shuffle once); trigrams with many names are dealt over a grid, pairs are looked at in parts."""
    rng = random.Random(12)
    make = lambda: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 3)))
    names = [make() for _ in range(500)]
    left = spark.createDataFrame(list(enumerate(names[:300])), "l_id int, name string")
    right = spark.createDataFrame(list(enumerate(names[200:])), "r_id int, name string")
    sets = [{w[i : i + 3] for w in (f"  {x} " for x in n.split()) for i in range(len(w) - 2)} for n in names]
    alike = lambda a, b: len(a & b) / len(a | b)
    want = sorted((i, j, alike(a, b)) for i, a in enumerate(sets[:300]) for j, b in enumerate(sets[200:]) if alike(a, b) >= 0.4)
    monkeypatch.setattr(similarity, "BLOCK", 40)
    got = similarity.trigram_join(left, right, 0.4)
    assert sorted(map(tuple, got.collect())) == want
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    # One trigram's cell, without Spark: pairs in parts, each name's together.
    sets = [{w[i : i + 3] for w in (f"  {x} " for x in make().split()) for i in range(len(w) - 2)} for _ in range(2400)]
    ranked = sorted({g for s in sets for g in s}, key=lambda g: (sum(g in s for s in sets), g))
    codes, g = [sorted(ranked.index(g) for g in s) for s in sets], len(ranked) // 2
    l, r = ([(k, x) for k, x in enumerate(part) if g in x] for part in (codes[:1200], codes[1200:]))  # noqa: E741
    cell = lambda part: similarity._Names(np.array([k for k, _ in part]), np.zeros(len(part)), np.concatenate([x for _, x in part]).astype(np.int64), np.array([len(x) for _, x in part]), g)
    monkeypatch.setattr(similarity, "PAIRS", 50)
    parts = list(similarity._paired(cell(l), cell(r), 0.4))
    assert len(l) * len(r) > 4096 and len(parts) > 10 and max((len(i) for i, _, _ in parts if len(np.unique(i)) > 1), default=0) <= 50
    found = [(int(i), int(j)) for a, _, b, _ in similarity._alike(cell(l), cell(r), 0.4) for i, j in zip(a, b)]
    assert sorted(found) == [(i, j) for i, x in l for j, y in r if min(set(x) & set(y)) == g and alike(set(x), set(y)) >= 0.4] and len(found) > 20


def test_priority_match_reduces_stored_rows_before_they_are_joined(spark):
    """The smallest stored row of the first key that matches, nulls only in the last key; a key that many rows have on both sides makes no pairs."""
    rng = random.Random(4)
    pick = lambda: (rng.choice(["D1", "D2", None]), rng.choice([1, 2, 3, None]))
    stored, batch = [(i, *pick()) for i in rng.sample(range(1000), 12)], [(i, *pick()) for i in range(60)] + [(60, "D9", 9)]
    want = []
    for o, d, p in batch:
        met = [(r, i) for i, x, y in stored for r, same in ((0, d is not None and x == d), (1, y == p)) if same]
        r, i = min(met, default=(None, None))
        want.append((o, i, r))
    s, b = spark.createDataFrame(stored, "id int, doc string, place int"), spark.createDataFrame(batch, "ord int, doc string, place int")
    got = merge.match_by_priority(s, b, [["doc"], ["place"]], "id")
    assert sorted(map(tuple, got.collect())) == want
    many = spark.range(1, 20_001).selectExpr("id", "'D' AS doc", "CAST(id AS INT) AS place")
    hot = merge.match_by_priority(many, many.withColumnRenamed("id", "ord"), [["doc"], ["place"]], "id")
    assert hot._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3  # of each key's stored rows, and of the matches
    assert hot.agg(F.count("*"), F.sum("matched"), F.sum("rule")).first() == (20_000, 20_000, 0)


def test_scored_candidates_meet_their_history_once(spark, monkeypatch):
    """A candidate with many places is one row with them (a row each was joined to the places once), with cases broadcast or not; two names of an entity count as one, ties go by display name."""
    entities = spark.createDataFrame([("E1", "ABCDEFG", "z", False), ("E2", "ABCDEFG", "a", True), ("E3", "QQQQQQQ", "b", False)], "entity_id string, norm_name string, display_name string, is_spv_suspect boolean")
    aliases = spark.createDataFrame([("E1", "ABCDEFX"), ("E3", "ABCDEFG")], "entity_id string, alias_norm string")
    properties = spark.createDataFrame([(i, f"{i} large ring st") for i in range(1, 40)] + [(99, None)], "property_id int, address_norm string")
    history = spark.createDataFrame([("E1", i, "Bronx", "Retail") for i in range(1, 40)] + [("E3", 99, None, None)], "entity_id string, property_id int, borough string, asset_type string")
    asked = spark.createDataFrame([(1, "abcdefg", "12 large ring street", "Bronx", "RETAIL"), (2, "ABCDEFG", "9 cold bolt st", None, None), (3, None, "1 large ring st", "Bronx", None), (4, "zzz", None, None, None)], "id int, name string, address string, borough string, asset string")
    want = [(1, "E3", 1.0, 1), (1, "E1", 1.0, 2), (1, "E2", 0.94, 3), (2, "E3", 1.0, 1), (2, "E1", 1.0, 2), (2, "E2", 0.94, 3)]
    for most in (2_000_000, 0):
        monkeypatch.setattr(similarity, "CASES", most)
        got = similarity.resolve_scored(asked, entities, aliases, properties, history)
        assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[3])) == sorted(want, key=lambda r: (r[0], r[3])), most
        assert "arrays_overlap" in got._jdf.queryExecution().optimizedPlan().toString()


def test_context_pairs_are_shuffled_once_by_property_and_once_by_id(spark, sf_dir):
    """The distinct pairs of property and party stay where they meet the names, and those of name and firm where they are ranked (each was dealt out twice once)."""
    from parcelflow.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["resolve_with_context"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert not any(re.search(r"hashpartitioning\((property_id#\d+L?, entity_id|id#\d+L?, entity_id)", line) for line in dealt), dealt
    assert sum("REPARTITION_BY_COL" in line for line in dealt) >= 2


MERGE_ROW = "ord long, doc_id string, address_norm string, borough string, sale_price double, sale_date string, asset_type string, bldg_class string, units int, source_system string"


def merged_one_by_one(stored, batch, ledger):
    """The rules as a loop over rows: nothing that is refused leaves a claim, a class rejection leaves an exclusion."""
    docs, keys, out = {r[1] for r in stored if r[1]}, {r[2:6] for r in stored if r[2] is not None and r[3] is not None}, set(ledger)
    status = {}
    for n, doc, address, borough, price, day, kind, cls, units, source in sorted(batch):
        spot, cls = (address, int(price or 0)), (cls or "").strip()
        if spot in out:
            status[n] = "rejected_excluded"
        elif kind in ("Condo", "Co-op"):
            status[n] = "rejected_banned_type"
        elif cls[:1] in ("A", "B"):
            out.add(spot)
            status[n] = "rejected_one_two_family"
        elif cls[:1] == "R":
            out.add(spot)
            status[n] = "rejected_condo_class"
        elif doc and doc in docs:
            status[n] = "duplicate_doc"
        elif borough is not None and (address, borough, price, day) in keys:
            status[n] = "duplicate_key"
        else:
            small = not cls and source in ("traded", "crexi", "instagram", "upload") and units is not None and units <= 2 and kind in ("Multifamily", "", None)
            status[n] = "merged_flagged" if small else "merged"
            if doc:
                docs.add(doc)
            if borough is not None:
                keys.add((address, borough, price, day))
    return status


@pytest.mark.parametrize("seed, docs, addresses", [(3, 20, 4), (4, 300, 60), (5, 6, 2)])
def test_merge_status_equals_a_loop(spark, seed, docs, addresses):
    rng = random.Random(seed)

    def make(n):
        doc = rng.choice([None, "", *[f"D{rng.randrange(docs)}"] * 6])
        return (n, doc, f"{rng.randrange(addresses)} main st", rng.choice([None, "Queens", "Bronx"]), rng.choice([None, 1.0, 2.5, 3.0]), rng.choice([None, "2020-01-01", "2021-01-01"]), rng.choice(["Office", "Office", "Office", "Multifamily", None, "Condo"]), rng.choice([*["O1"] * 9, None, "", "A1", "R4"]), rng.choice([None, 1, 20]), rng.choice(["traded", "upload", "acris"]))

    stored, batch = [make(n) for n in range(5)], [make(n) for n in range(20, 520)]
    ledger = spark.createDataFrame([("0 main st", 2.0)], "addr_norm string, price double")
    got = merge.merge_status(spark.createDataFrame(stored, MERGE_ROW), spark.createDataFrame(random.Random(1).sample(batch, 500), MERGE_ROW), ledger).collect()
    assert {r.ord: r.status for r in got} == merged_one_by_one(stored, batch, {("0 main st", 2)}) and len(got) == 500
    assert len({r.status for r in got}) == 8 or seed != 3


def test_merge_status_of_a_chain_and_of_a_rejected_class(spark):
    """Each row is refused or not for the sake of the one before; and a class rejection meets a later row with the same address and price."""
    chain = [(n, f"D{(n + 1) // 2}", f"{n // 2} main st", "Queens", 1.0, None, "Office", "O1", 9, "deed") for n in range(9)]
    classes = [(100, "E1", "x", "Queens", 3.0, None, "Office", "A1", 9, "deed"), (101, "E2", "x", "Bronx", 3.2, None, "Office", "O1", 9, "deed"), (102, "E3", "x", "Bronx", 4.0, None, "Office", "O1", 9, "deed")]
    none = spark.createDataFrame([], "addr_norm string, price double")
    got = merge.merge_status(spark.createDataFrame([], MERGE_ROW), spark.createDataFrame(chain + classes, MERGE_ROW), none).collect()
    assert {r.ord: r.status for r in got} == merged_one_by_one([], chain + classes, set())
    assert {r.ord: r.status for r in got}[101] == "rejected_excluded"
    empty = spark.createDataFrame([], MERGE_ROW)
    assert merge.merge_status(empty, empty, none).collect() == []




def test_trigram_index_is_probed_without_a_shuffle_of_its_side(spark, tmp_path):
    """Names appended in two parts, by two handles of one folder, are found as if they were one; the plan of a probe has no exchange above the index's tables."""
    rng = random.Random(8)
    make = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(2))
    names = [(i, make()) for i in range(300)] + [(300, None), (301, ""), (302, "aa bb"), (303, "aa bb")]
    held = spark.createDataFrame(names, "key long, name string")
    index = similarity.TrigramIndex(spark, str(tmp_path / "index"), "bigint")
    index.add(held.filter("key < 150"))
    similarity.TrigramIndex(spark, str(tmp_path / "index")).add(held.filter("key >= 150"))
    asked = spark.createDataFrame([(i, make()) for i in range(60)] + [(60, "aa bb"), (61, None), (62, "aa bb")], "id long, name string")
    index = similarity.TrigramIndex(spark, str(tmp_path / "index"))
    whole = similarity.trigram_join(asked, held, 0.4, "id", "key").collect()
    got = index.probe(asked, 0.4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and {(60, 302), (60, 303), (62, 302)} <= {(r.id, r.key) for r in got}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.probe(asked, 0.4)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for table in ("postings", "names", "keys"):
        at = next(i for i, line in enumerate(plan) if "FileScan" in line and f"trigrams_{table}_" in line)
        above, now = [], depth(plan[at])
        for line in reversed(plan[:at]):
            if depth(line) < now:
                now = depth(line)
                above.append(line)
                if "Join" in line:
                    break
        assert "Join" in above[-1] and not any("Exchange" in line for line in above), above


def test_deal_nodes_at_any_depth(spark):
    """The listed place, then the single one, then a walk that does not enter deals and ends at its depth."""
    deal = lambda n: {"properties": [{"displayAddress": f"{n} main st"}], "salePrice": n}
    deep = lambda n, levels: deal(n) if not levels else ({"k": deep(n, levels - 1), "b": 2} if levels % 2 else [None, deep(n, levels - 1)])
    docs = {f"depth {k}": (deep(k, k), [k]) for k in range(0, 9)} | {
        "too deep": (deep(9, 9), []), "inside a deal": ({"x": deal(1) | {"more": deal(2)}}, [1]), "null price": ({"a": {"closingDate": None, "properties": []}}, [None]),
        "no list": ({"a": {"salePrice": 1, "properties": {}}}, []), "several": ({"z": [deal(3), {"y": deal(4)}], "a": deal(5)}, [3, 4, 5]), "scalar": (7, []), "null": (None, []),
        "listed": ({"props": {"pageProps": {"initialValues": {"dealsWithCount": {"deals": [deal(1), {}, deal(2)]}}, "deal": deal(3)}}, "x": deal(4)}, [1, 2]),
        "none listed": ({"props": {"pageProps": {"initialValues": {"dealsWithCount": {"deals": [{}]}}, "deal": deal(3)}}, "x": deal(4)}, [3]),
    }
    page = lambda d: f'<script>x</script><script id="__NEXT_DATA__" type="application/json">{json.dumps(d)}</script>'
    rows = [(k, page(d)) for k, (d, _) in docs.items()] + [("no script", "<html>"), ("broken", page(1).replace(">1<", ">{<")), ("no page", None)]
    pages = spark.createDataFrame(rows, "name string, html string")
    got = {}
    for r in nested.deal_nodes(pages.select("name", nested.embedded_json(F.col("html")).alias("doc")), "name").select("name", F.try_variant_get("node", "$.salePrice", "int").alias("price")).collect():
        got.setdefault(r.name, []).append(r.price)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: v for k, (_, v) in docs.items() if v}


def test_uploaded_rows_by_what_their_headers_say(spark, tmp_path):
    files = {"a.csv": 'Owner,Work Phone,owner\n"Main, ""LLC""",1,x\n"two\nlines",,y\n', "b.csv": "Zip,E-Mail\n1,a@b\n", "c.csv": "Phone\n", "d.csv": "note,Contact Name,Last Contacted\nhi,Ann,2020\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    cells = tables.csv_cells(spark, str(tmp_path))
    headers = cells.filter("is_header").select("file", F.posexplode("values").alias("pos", "name")).filter("name IS NOT NULL")
    mapping = nested.assigned(headers)
    assert {(r.file[-5:], r.name, r.field, r.score) for r in mapping.collect()} == {
        ("a.csv", "Owner", "entity_name", 3), ("a.csv", "Work Phone", "phone", 1), ("b.csv", "E-Mail", "email", 3), ("c.csv", "Phone", "phone", 3),
        ("d.csv", "note", "interaction_notes", 3), ("d.csv", "Contact Name", "person_name", 3), ("d.csv", "Last Contacted", "last_contact_date", 3),
    }
    rows = nested.mapped_rows(cells.filter("NOT is_header"), mapping).collect()
    got = {(r.file[-5:], r.row_num): {k: v for k, v in (r.mapped or {}).items() if v} for r in rows}
    assert got == {("a.csv", 1): {"entity_name": 'Main, "LLC"', "phone": "1"}, ("a.csv", 2): {"entity_name": "two\nlines"}, ("b.csv", 1): {"email": "a@b"}, ("d.csv", 1): {"interaction_notes": "hi", "person_name": "Ann", "last_contact_date": "2020"}}


def test_sitemaps(spark, tmp_path):
    (tmp_path / "index").mkdir()
    (tmp_path / "index/i.xml").write_text("<sitemapindex><sitemap><loc>https://x/one.xml</loc></sitemap><sitemap><loc>https://x/gone.xml</loc></sitemap></sitemapindex>")
    for name in ("one", "other"):
        (tmp_path / f"files/{name}").mkdir(parents=True)
        (tmp_path / f"files/{name}/f.xml").write_text(f"<urlset><url><loc>https://x/sale/{name}</loc><lastmod>2020-01-01</lastmod></url><url><loc>https://x/sale/{name}/</loc><lastmod>2021-01-01</lastmod></url><url><loc>https://x/sale/late-{name}</loc></url><url><loc>https://x/about</loc></url></urlset>")
    got = tables.sitemap_urls(spark, str(tmp_path / "index"), str(tmp_path / "files"), "/sale/").collect()
    assert sorted(map(tuple, got)) == [("https://x/sale/late-one/", None), ("https://x/sale/one/", "2021-01-01")]


def test_match_deed_equals_a_search(spark):
    rng = random.Random(6)
    day = lambda: None if rng.random() < 0.1 else datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(-900, 900))
    targets = [(i, rng.choice([None, 0.0, round(10 ** rng.uniform(4, 6), 2)]), day(), rng.randrange(4)) for i in range(300)]
    deeds = [(1000 + i, rng.choice([0.0, 150000.0, round(10 ** rng.uniform(4, 6.3), 2)]), day(), rng.randrange(4)) for i in range(300)]
    deeds += [(2000 + i, round(p * f, 4), d, k) for i, p, d, k in targets if p for f in (0.97, 0.9699, 1.03, 1.0301)]
    want = {}
    for i, price, when, place in targets:
        near = []
        for doc, amount, deed_day, where in deeds:
            days = abs((when - deed_day).days) if when and deed_day else 9999
            if where == place and amount > 0 and (abs(amount - price) / price <= 0.03 if price else amount >= 200000 and days <= 240):
                near.append((days, doc))
        near.sort()
        if near and (near[0][0] <= 400 if price else len(near) == 1 or near[0][0] < near[1][0]):
            want[i] = near[0][1]
    t = spark.createDataFrame(targets, "target_id long, price double, day date, place int")
    d = spark.createDataFrame(deeds, "document_id long, amount double, deed_day date, place int")
    assert dict(map(tuple, matching.match_deed(t, d, ["place"]).collect())) == want and len(want) > 50


def test_exact_median(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([None, 1.0, -5.0, rng.uniform(-1e9, 1e9), float(rng.randrange(9)), 1e-300])) for _ in range(900)]
    rows += [("one", 1, 2.5), ("same", 1, 7.0), ("same", 1, 7.0), ("none", 1, None), ("two", 1, 1.0), ("two", 1, 2.0), ("near", 1, 1.0), ("near", 1, 1.0000000000000002), ("near", 1, 1.0000000000000002), ("far", 1, -1e300), ("far", 1, 1e300), ("far", 1, 5.0)]
    want = {}
    for k in {r[:2] for r in rows}:
        v = [r[2] for r in rows if r[:2] == k and r[2] is not None]
        want[k] = statistics.median(v) if v else None
    df = spark.createDataFrame(rows, "g string, h int, v double")
    for buckets in (2, 1024):
        got = {(r.g, r.h): r.median for r in relational.exact_median(df, ["g", "h"], "v", buckets=buckets).collect()}
        assert got == want
    assert relational.exact_median(df.limit(0), ["g"], "v").collect() == []

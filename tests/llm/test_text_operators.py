"""The text operators against brute force, round trips and the libraries they follow, on small fixtures with the odd cases in them."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelflow.llm import bpe, common, components, exact_dedup, html_extract, lempel_ziv, mixing, quality, queries, records, simhash, toxicity, urls, wordbpe

ODD = [None, "", " \t\n", "a", "one two", "Same text here again", "Same  text\nhere again ", "same text here again", "x" * 3000, "word " * 5000, "ß İ Σς é ́ \U0001f600 中文 <|endoftext|> | 12 ***"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, digest string, size int, label double, _copy int"


def documents(spark, texts, ids=None):
    """Extra columns have names that the operators use themselves."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 3 else f"s{k % 3}", 1, "x", "y", 1, 0.5, 9) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def texts_like(n, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,", "eta.", "the", "of", "12", "theta!"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) for _ in range(n)]


# 8 and 2: tokenizers -------------------------------------------------------------------------------------------------


def fuzzed(n=300, seed=5):
    rng = random.Random(seed)
    letters = "abcdeéßñ  \n\t'stlm.!?0129\x00́‍\U0001f600中ſİΣς\x1c\x85\xa0 |<>$#*"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_byte_bpe_equals_library():
    library, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.BacktrackingBPE(public_tokenizers.path("byte_bpe_50k.json"))
    for text in fuzzed() + [t or "" for t in ODD] + texts_like(50) + ["ABAB" * 400, " " * 500 + "a", "a<|endoftext|><|endoftext|> b"]:
        want = library.encode(text, add_special_tokens=False).ids
        got = mine.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert mine.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_byte_bpe_small_memory():
    mine = bpe.BacktrackingBPE(public_tokenizers.path("byte_bpe_50k.json"), remember=3, pairs=3)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in texts_like(20):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text).ids


def test_encode_decode_rows(spark):
    got = rows(bpe.encode_decode(documents(spark, ODD), public_tokenizers.path("byte_bpe_50k.json")))
    assert len(got) == len(ODD)
    for doc_id, n, ids, sha, decoded in got:
        assert n == len(ids) // 4 and sha == hashlib.sha256(ids).hexdigest() and decoded == hashlib.sha256((ODD[doc_id] or "").encode()).hexdigest()
    assert rows(bpe.encode_decode(documents(spark, ODD).limit(0), public_tokenizers.path("byte_bpe_50k.json"))) == []


def test_word_encoder_equals_library():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a<|endoftext|>b <|startoftext|>", "don't 's '", "word... x.,! ##a.# a1b2 Été! ÀÖ×÷ ªµº ﬁ İ", "l'été; L'ÉTÉ:", "'LL 'Re ''d"]
    texts = fuzzed() + [t or "" for t in ODD] + texts_like(50) + odd + ["word, " * 300_000]
    for remember, most in ((50, 1000), (500_000, 4 << 20)):
        mine = wordbpe.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), remember=remember)
        got = list(mine.encode_batch(pa.array(texts), most))
        assert len(got) == len(texts)
        for text, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]
        assert list(mine.encode_batch(pa.array([None, "a"]))) == [b"", mine.encode("a")] and list(mine.encode_batch(pa.array([], pa.string()))) == []


def test_records_round_trip(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD + texts_like(60)
    ids = [5, None, 3, 3, *range(10, 10 + len(texts) - 4)]
    out = records.write(documents(spark, texts, ids).repartition(3), public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(rows(records.read(spark, out, records_a_task=7)), key=lambda r: r[2])
    by_id = sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r[1] for r in got] == [i for i, _ in by_id]
    at = 0
    for name, doc_id, start, data in got:
        want = [library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in by_id if i == doc_id]
        assert start == at and np.frombuffer(data, "<u4").tolist() in want
        at += len(data) // 4
    file = records.RecordFile(out, got[0][0])
    order = list(range(len(file)))
    random.Random(1).shuffle(order)
    whole = list(file)
    for i in order:  # shuffled reads by the index
        assert file[i][0] == whole[i][0] and (file[i][1] == whole[i][1]).all()
    digests = sorted(rows(queries.records_digest(records.read(spark, out))), key=lambda r: r[1])
    assert digests == [(i, start, len(data) // 4, zlib.crc32(data)) for _, i, start, data in got]
    empty = records.write(documents(spark, ODD).limit(0), public_tokenizers.path("word_bpe_49k.json"))
    assert rows(records.read(spark, empty)) == []


def test_damaged_record_is_noticed(tmp_path):
    good = records.frame(7, b"\x01\x00\x02\x00", 2)
    for i in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[i] ^= 1
        (tmp_path / "f").write_bytes(bad)
        with pytest.raises(ValueError), open(tmp_path / "f", "rb") as f:
            records.read_frame(f)


# 3: Lempel-Ziv -------------------------------------------------------------------------------------------------------


def brute_phrases(data):
    seen, phrase = set(), b""
    for i in range(len(data)):
        phrase += data[i : i + 1]
        if phrase not in seen:
            seen.add(phrase)
            phrase = b""
    return seen


def test_parse_finds_the_phrases():
    for text in [t or "" for t in ODD[:8]] + texts_like(20):
        nodes, hashes = {}, [lempel_ziv.BASIS]
        lempel_ziv.parse(text.encode(), nodes, hashes)
        want = set()
        for p in brute_phrases(text.encode()):
            h = lempel_ziv.BASIS
            for c in p:
                h = (h ^ c) * lempel_ziv.PRIME & lempel_ziv.MASK
            want.add(h)
        assert set(hashes[1:]) == want


def test_compare_with_next(spark):
    texts = ODD + texts_like(40)
    got = {r[0]: r[1:] for r in rows(lempel_ziv.compare_with_next(documents(spark, texts).repartition(5)))}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        fp, other, nxt = (lempel_ziv.fingerprint(t) for t in (text, edited, following))
        assert tuple(got[i]) == (len(text), hashlib.sha256(edited.encode()).digest(), fp, other, lempel_ziv.likeness(fp, other), lempel_ziv.likeness(fp, nxt))
    assert rows(lempel_ziv.compare_with_next(documents(spark, ["lone text"])))[0][-1] == 1.0
    assert rows(lempel_ziv.compare_with_next(documents(spark, ODD).limit(0))) == []


def test_likeness_follows_the_sets():
    a, b = texts_like(2, seed=8)
    a, b = a * 8, b * 8
    x, y = brute_phrases(a.encode()), brute_phrases(b.encode())
    want = len(x & y) / len(x | y)
    assert abs(lempel_ziv.likeness(lempel_ziv.fingerprint(a), lempel_ziv.fingerprint(b)) - want) < 0.2


# 4: exact ------------------------------------------------------------------------------------------------------------


def test_exact_assign(spark):
    texts = ODD + ["Same text hereagain", None, "a"]
    ids = [*range(len(texts) - 2), None, 3]
    got = rows(exact_dedup.assign(documents(spark, texts, ids)))
    key = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    assert len(got) == len(texts)
    seen = {}
    for doc_id, keep_id, size, kept, digest in got:
        group = [(i, t) for i, t, k in zip(ids, texts, key) if hashlib.sha256(k.encode()).digest() == digest]
        best = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert keep_id == best[0] and size == len(group)
        seen[digest] = seen.get(digest, 0) + kept
    assert set(seen.values()) == {1}  # also for the repeated row


def test_index_grows(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = rows(exact_dedup.keep_new(documents(spark, ["a b", "c", "ab", None]), index, "one"))
    assert sorted(r[1] or "" for r in first) == ["", "a b", "c"]
    for _ in range(2):  # the second time as after a failure: nothing is added twice, and the same rows stay
        second = rows(exact_dedup.keep_new(documents(spark, ["d", "a  b", "d ", "d "], [9, 8, 7, 7]), index, "two"))
        assert [r[1] for r in second] == ["d "]
        assert index.table().count() == 4
    plan = index.table().select("digest").hint("merge").join(index.table(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the bucketed side isn't shuffled


def test_index_outlives_its_session(spark, tmp_path):
    """Another process opens the folder with other settings, finds what the first one held, and overwrites nothing."""
    path = f"{tmp_path}/digests"
    code = f"""
import tempfile
from pyspark.sql import SparkSession
from parcelflow.llm import exact_dedup
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id bigint, text string")
print(exact_dedup.keep_new(docs, exact_dedup.DigestIndex(spark, {path!r}), "first").count())
"""
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == ["3"], out.stderr
    index = exact_dedup.DigestIndex(spark, path, buckets=7)
    assert index.buckets == 3 and index.table().count() == 3
    got = exact_dedup.keep_new(documents(spark, ["a", " b", "d"], [7, 8, 9]), index, "second")
    assert [r.text for r in got.collect()] == ["d"] and index.table().count() == 4
    assert sorted(r.keep_id for r in index.rows().collect()) == [1, 2, 3, 9]


def test_exact_by_parts(spark):
    """The parts by length, and so the anti-join, change nothing; extra columns keep their values, whatever their names."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", " ", "  "]) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    docs = documents(spark, texts).withColumnsRenamed({"fp": "row", "size": "own_digest", "label": "n.chars"})
    got = [sorted(rows(exact_dedup.assign(docs, parts=n)), key=lambda r: r[0]) for n in (1, 2, 5)]
    assert got[0] == got[1] == got[2]
    kept = {r[0] for r in got[0] if r[3]}
    for d in (docs, docs.unionByName(docs.filter("doc_id = 7"))):
        new = exact_dedup.keep_new(d)
        assert new.columns == docs.columns and sorted(rows(new), key=str) == sorted((r for r in rows(docs) if r[0] in kept), key=str)


def test_exact_of_one_id_and_other_spaces(spark):
    docs = documents(spark, ["ab", "a b", "c", "c d", "cd", "c d", None, " "], [1, 1, 2, 3, 3, 3, None, None])
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.keep_new(docs).collect()) == [(0, " "), (1, "a b"), (2, "c"), (3, "c d")]


# 5: SimHash ----------------------------------------------------------------------------------------------------------


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force():
    for text in [t for t in ODD if t is None or len(t) < 4000] + texts_like(30) + fuzzed(50):
        assert simhash.simhash(text) == brute_simhash(text)


def test_links_lose_none(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {0, *base}
    for b in base:
        for _ in range(4):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5))))
    signed = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for segments in (2, 3):
        assert {tuple(r) for r in simhash.links(df, 2, segments).collect()} == want
    wide = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert {tuple(r) for r in simhash.links(df, 4, 2).collect()} == wide


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3), (300, 301)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(rows(components.components(spark.createDataFrame(edges, "u bigint, v bigint"))))
    assert got == {x: find(x) for x in parent}
    assert rows(components.components(spark.createDataFrame([], "u bigint, v bigint"))) == []
    # Stars need no step: one look settles them. A chain needs more.
    star = spark.createDataFrame([(9, 1), (1, 5), (8, 2), (8, 2)], "u bigint, v bigint")
    assert dict(rows(components.components(star, max_steps=1))) == {1: 1, 5: 1, 9: 1, 2: 2, 8: 2}
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(3, 2), (2, 1)], "u bigint, v bigint"), max_steps=1)


def test_simhash_groups(spark):
    texts = ODD + texts_like(10) + texts_like(10)
    got = {r[0]: r[1:] for r in rows(simhash.groups(documents(spark, texts)))}
    fps = [brute_simhash(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i in group:
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    group[j] = group[i] = min(group[i], group[j])
    assert {i: v[1] for i, v in got.items()} == dict(enumerate(group))
    assert simhash.groups(documents(spark, ODD).limit(0)).count() == 0


def shingle_set(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(found[i : i + words]) for i in range(max(min(1, len(found)), len(found) - words + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_copies(n, base, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def distinct_text(n, seed):
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(5000)}" for _ in range(n))


def test_wide_simhash_equals_brute_force():
    for text in [t for t in ODD if t is None or len(t) < 4000] + texts_like(10) + [distinct_text(700, 1)]:
        hashes = [int(h) for h in simhash.shingle_hashes(text)]
        assert len(hashes) == len(shingle_set(text))
        bits = np.unpackbits(np.frombuffer(simhash.wide_simhash(text), np.uint8))
        for lane in range(16):
            mixed = simhash._mixed(np.array(hashes, np.uint64) ^ np.uint64((lane + 1) * 0x9E3779B97F4A7C15 % 2**64)) if hashes else np.array([], np.uint64)
            for byte in range(8):
                for bit in range(8):
                    n = sum(int(h) >> (8 * byte + 7 - bit) & 1 for h in mixed)
                    assert bits[64 * lane + 8 * byte + bit] == (2 * n > len(hashes))


def test_likeness_roots_lose_no_link_of_a_segment(spark):
    """Against all pairs that share a segment and are near enough: the same groups, in a crowd of near copies of several texts and of texts between them."""
    texts = [x for k in range(4) for x in near_copies(40, distinct_text(60, k), k)] + [distinct_text(60, 90 + k) for k in range(40)]
    fps = simhash.wide_fingerprints(documents(spark, texts)).select("node", "fp").distinct().cache()
    bits = {r.node: np.unpackbits(np.array(r.fp, "<i8").view(np.uint8)) for r in fps.collect()}
    keys = {}
    for r in simhash.segment_keys(fps, segments=12, width=16).collect():
        keys.setdefault(r.key, []).append(r.node)
    parent = {n: n for n in bits}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for bucket in keys.values():
        for i, a in enumerate(bucket):
            for b in bucket[:i]:
                if int((bits[a] != bits[b]).sum()) <= 90:
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    want = {n: find(n) for n in bits}
    for rounds, block in ((1, 256), (0, 8)):
        got = {r.node: r.root for r in simhash.likeness_roots(fps, 90, segments=12, width=16, rounds=rounds, block=block).collect()}
        assert {n: got.get(n, n) for n in bits} == want and len(set(want.values())) > 40


def test_segments_are_written_in_small_partitions(spark):
    """However few tasks hold the fingerprints, a task writes the segments of some thousands; and each node still has a row for each segment."""
    fps = spark.range(12_000).coalesce(1).select(F.col("id").alias("node"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.xxhash64("id", i)).alias("fp"))
    keys = simhash.segment_keys(fps, segments=3)
    sizes = [r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 36_000 == keys.distinct().count() and max(sizes) < 1.5 * 3 * 4096
    assert simhash.segment_keys(fps.limit(0)).count() == 0


def test_arrow_batches_are_small_in_bytes(spark):
    common.small_batches(spark)
    rows = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 9


def test_compared_links_equal_all_pairs_of_a_bucket(spark):
    """One group much larger than a block, small ones that share blocks, a key of one group and a node under several keys."""
    rng = np.random.default_rng(4)
    center = rng.integers(0, 2, 1024)
    flipped = [np.where(rng.random(1024) < share, 1 - center, center) for share in [0.04] * 60 + [0.1] * 25 + [0.5] * 5]
    fps = [(i, np.packbits(x.astype(np.uint8)).view("<i8").tolist()) for i, x in enumerate(flipped)]
    rows = [(1, i, 0 if i < 60 else i - i % 3) for i in range(90)] + [(2, i, 0 if i < 60 else i - i % 3) for i in range(0, 90, 4)] + [(3, i, 0) for i in range(10)]
    root = {(k, n): r for k, n, r in rows}
    want = set()
    for k, a in root:
        for l, b in root:
            if k == l and root[k, a] < root[l, b] and int((flipped[a] != flipped[b]).sum()) <= 130:
                want.add((root[k, a], root[l, b]))
    table, prints = spark.createDataFrame(rows, "key bigint, node bigint, root bigint"), spark.createDataFrame(fps, "node bigint, fp array<bigint>")
    for block in (4, 16, 256):
        assert sorted((r.x, r.y) for r in simhash.compared(table, prints, 130, 130, block=block).collect() if r.link) == sorted(want)
    assert want and simhash.compared(table.limit(0), prints, 130, 130).count() == 0


def reworded(text, share, seed):
    """The text with that share of its words replaced by words of its own."""
    rng = random.Random(seed)
    return " ".join(f"r{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_groups_equal_exact_likeness_of_all_pairs_of_a_bucket(spark):
    """Copies from 0.6 to 0.95 alike: a pair that shares a segment is linked if surely near by its bits, or between the bounds and 0.8 alike by its sets."""
    texts = [reworded(distinct_text(120, k), 0.005 * (i % 9), 100 * k + i) for k in range(3) for i in range(40)] + [distinct_text(120, 70 + k) for k in range(10)]
    docs = documents(spark, texts)
    marked = {r.node: r for r in simhash.wide_fingerprints(docs).collect()}
    near, far = simhash.unsure_bits(0.8, 1024)
    bits, sets = {n: np.unpackbits(np.array(r.fp, "<i8").view(np.uint8)) for n, r in marked.items()}, {n: shingle_set(texts[r.doc_id]) for n, r in marked.items()}
    fps = simhash.wide_fingerprints(docs).groupBy("node").agg(F.first("fp").alias("fp"), F.min("text_hash").alias("text_hash")).cache()
    keys = {}
    for r in simhash.segment_keys(fps, segments=24, width=12).collect():
        keys.setdefault(r.key, []).append(r.node)
    parent, unsure = {n: n for n in bits}, set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(max(a, b), min(a, b)) for bucket in keys.values() for i, a in enumerate(bucket) for b in bucket[:i]}:
        apart = int((bits[a] != bits[b]).sum())
        if apart <= near or (apart <= far and jaccard(sets[a], sets[b]) >= 0.8):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        if near < apart <= far:
            unsure.add(jaccard(sets[a], sets[b]) >= 0.8)
    want = {n: find(n) for n in bits}
    assert unsure == {True, False} and 13 < len(set(want.values())) < len(want) - 20
    asked = lambda nodes: simhash.shingle_sets(docs, fps.join(nodes, "node"))
    for block in (256, 8):
        got = {r.node: r.root for r in simhash.likeness_roots(fps, near, segments=24, width=12, block=block, exact=(far, 0.8, asked)).collect()}
        assert {n: got.get(n, n) for n in bits} == want


def test_exact_links_and_unsure_rows(spark):
    """Blocks of every size give the same groups as all pairs; unsure rows are those with a partner between the bounds; no rows give none."""
    rng = np.random.default_rng(6)
    center = rng.integers(0, 2, 1024)
    flipped = [np.where(rng.random(1024) < share, 1 - center, center) for share in [0.05] * 30 + [0.09] * 20 + [0.5] * 4]
    hashes = [sorted(rng.choice(60, 40 + i % 20, replace=False).tolist()) for i in range(len(flipped))]
    held = spark.createDataFrame([(i, np.packbits(x.astype(np.uint8)).view("<i8").tolist(), h) for i, (x, h) in enumerate(zip(flipped, hashes))], "node bigint, fp array<bigint>, hashes array<bigint>")
    rows = [(k, i, 0 if i < 20 else i - i % 2) for k in (1, 2) for i in range(0, 54, k)]
    table, root = spark.createDataFrame(rows, "key bigint, node bigint, root bigint"), {(k, n): r for k, n, r in rows}
    pairs = [(k, a, b) for k, a in root for l, b in root if k == l and root[k, a] != root[l, b] and 110 < int((flipped[a] != flipped[b]).sum()) <= 160]
    want_rows = sorted({(k, n, root[k, n]) for k, a, b in pairs for n in (a, b)})
    want = {(root[k, a], root[k, b]) for k, a, b in pairs if jaccard(set(hashes[a]), set(hashes[b])) >= 0.7}

    def groups(links):
        parent = {r: r for r in root.values()}
        find = lambda x: x if parent[x] == x else find(parent[x])
        for a, b in links:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        return {r: find(r) for r in parent}

    for block in (4, 256):
        assert sorted((r.key, r.x, r.y) for r in simhash.compared(table, held, 110, 160, block=block).collect() if not r.link) == want_rows
    for block_bytes in (600, 65536):
        got = {tuple(r) for r in simhash.exact_links(table, held, 110, 160, 0.7, block_bytes=block_bytes).collect()}
        assert got <= {(min(p), max(p)) for p in want} and groups(got) == groups(want)
    assert 0 < len(want) and simhash.exact_links(table.limit(0), held, 110, 160, 0.7).count() == 0


def test_shingle_sets(spark):
    texts = ["a b c d e f", "a b c d e f", None, "", "not wanted " * 9, "A b"]
    marked = simhash.wide_fingerprints(documents(spark, texts)).groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("doc_id"))
    got = {r.node: r.hashes for r in simhash.shingle_sets(documents(spark, texts), marked.filter("doc_id <> 4")).collect()}
    assert got == {r.node: simhash.shingle_hashes(texts[r.doc_id]).view("<i8").tolist() for r in marked.collect() if r.doc_id != 4} and len(got) == 3
    assert simhash.shingle_sets(documents(spark, texts).limit(0), marked).count() == 0


def test_keep_one_of_near_copies(spark):
    texts = near_copies(150, distinct_text(300, 3), 3) + [distinct_text(300, 50 + i) for i in range(20)] + near_copies(5, distinct_text(80, 7), 7) + ["Lone short text", "lone SHORT text", None, ""]
    docs = documents(spark, texts)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    sets = [shingle_set(t) for t in texts]
    for i, x in enumerate(sets):
        near = [jaccard(x, y) for y in sets[:i]]
        if not near or max(near) < 0.7:
            assert i in kept, i
        if near and max(near) > 0.88:
            assert i not in kept, i
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(rows(got), key=str) == sorted((r for r in rows(docs) if r[0] in kept), key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_of_repeated_and_null_ids(spark):
    near, other = texts_like(2)
    docs = documents(spark, [near, near + " ", other, near, None, "", other, "lone", "lone"], [1, 5, 5, None, None, None, None, 6, 6])
    kept = rows(simhash.keep_one(docs).select("doc_id", "text"))
    # Beside (1, near), the row that holds the other text stays though its id goes elsewhere; rows that agree in id and text stay.
    assert sorted(kept, key=str) == sorted([(1, near), (5, other), (6, "lone"), (6, "lone"), (None, None), (None, "")], key=str)


# 6: URLs -------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")]
    cases = [None, "", "nothing", "http://", "http://A.Example.ORG/es/x?y", "https://example.org/en/12", "ftp://notexample.org/es/", "http://x.com/de/1#a", "http://com/fr/", "http://x.com?/de/", "http://x.com/DE/", "a://b://c.org/z", "http://org", "http://x.com\n/de/", "http://x.net/de/", "//x.com/de/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(cases + cases)], "page_id int, url string, host string, rule string")
    got = {r[0]: r[1:] for r in rows(urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")))}
    assert len(got) == 2 * len(cases)
    for i, u in enumerate(cases + cases):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert tuple(got[i]) == (host, path, best[1], best[2]), u
    assert {r[4] for r in rows(urls.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")))} == {"allow"}
    long_list = spark.range(300).select(F.lit("org").alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("p"), F.col("id").cast("int"))).alias("path"), F.lit("block").alias("verdict"))
    other = spark.createDataFrame([(1, "http://a.com/" + "p" * 400), (2, "http://b.org/pppq")], "page_id int, url string")
    assert {r.page_id: r.rule for r in urls.judge(other, long_list).collect()} == {1: None, 2: "org/ppp"}
    shuffled = rows(urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), broadcast_bytes=0))
    assert {r[0]: r[1:] for r in shuffled} == got


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(2000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("key"))
    table, blocks = urls.bloom(keys, 2000)
    probe = spark.range(20000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("key"), "id")
    bits = urls._bits(F.col("key"), blocks)
    probe = probe.select("id", bits[0], *[b.alias(f"m{i}") for i, b in enumerate(bits[1:])])
    hit = F.lit(True)
    for i in range(8):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    found = {r[0] for r in probe.join(table, "block").filter(hit).select("id").collect()}
    assert set(range(2000)) <= found and len(found) < 2600


# 7: mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * w[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 5000, None: 10}, {"a": 1, "b": 1, "c": 1000, "d": 7, "é": 300}, {"x": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def mixed_sources(spark):
    rng = random.Random(9)
    texts = [None if i % 50 == 0 else " ".join("w" for _ in range(rng.randint(0, 400))) for i in range(600)]
    docs = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") < 300, "big").when(F.col("doc_id") < 310, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    return texts, docs


def test_mix(spark):
    texts, docs = mixed_sources(spark)
    documents_, slots = mixing.mix(docs, block=16, shard_slots=256, rows_a_bin=40, run=3)
    got = documents_.collect()
    assert len(got) == 600
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len((texts[r.doc_id] or "").split()) and r.taken <= 3 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert target == pytest.approx(brute_targets(sizes))
    n = sum(target.values()) / 16
    for s in sizes:  # within four standard deviations of the draw, and two blocks
        p = target[s] / sum(target.values())
        assert abs(taken[s] - target[s]) < 16 * (4 * (n * p * (1 - p)) ** 0.5 + 2), s
    # What is taken, once more from the slots: blocks of 16 words over a source's documents in a row, in the order of their starts.
    held = [tuple(r) for r in slots.select("source", "round", "block").collect()]
    assert len(held) == len(set(held))  # each round of a source takes each block once
    times = {}
    for source, _, block in held:
        times[source, block] = times.get((source, block), 0) + 1
    for s in sizes:
        assert sum(t for (source, _), t in times.items() if source == s) * 16 >= taken[s]
        assert taken[s] == sum(t * min(16, sizes[s] - 16 * b) for (source, b), t in times.items() if source == s)
        assert max((b for source, b in times if source == s), default=0) <= (sizes[s] - 1) // 16
    again, _ = mixing.mix(docs.repartition(7), block=16, shard_slots=256, rows_a_bin=40, run=3)
    assert sorted(rows(again), key=str) == sorted((tuple(r) for r in got), key=str)
    assert mixing.mix(docs.limit(0))[0].count() == 0
    assert {r.taken for r in mixing.mix(documents(spark, [None, ""]))[0].collect()} == {0}


def test_permutation(spark):
    for n in [*range(1, 40), 63, 64, 65, 100, 1000, 4097]:
        df = spark.range(n).select(*[mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(k)).alias(f"p{k}") for k in (1, 2)])
        got = df.collect()
        assert sorted(r.p1 for r in got) == list(range(n)) == sorted(r.p2 for r in got), n
        if n > 30:
            assert sum(r.p1 == r.p2 for r in got) < n / 4 and sum(a.p1 + 1 == b.p1 for a, b in zip(got, got[1:])) < n / 4


def test_draws_are_multinomial(spark):
    """Counts over shards vary as independent draws do: a chi-square sum over 400 shards and 4 sources, and each source's variance."""
    wish = {"a": 5.0, "b": 2.5, None: 2.0, "c": 0.5}
    shards, each = 400, 100
    got = mixing.draws(spark.createDataFrame(list(wish.items()), "source string, wish double"), shards * each, shards, 3).collect()
    counts = {(r.shard, r.source): r["count"] for r in got}
    total, chi = sum(wish.values()), 0.0
    assert all(sum(counts.get((s, k), 0) for k in wish) == each for s in range(shards))
    for k, w in wish.items():
        p = w / total
        x = np.array([counts.get((s, k), 0) for s in range(shards)])
        chi += float(((x - each * p) ** 2).sum() / (each * p))
        assert 0.75 < x.var() / (each * p * (1 - p)) < 1.3 and abs(x.mean() - each * p) < 4 * (each * p / shards) ** 0.5
    freedom = shards * (len(wish) - 1)
    assert abs(chi - freedom) < 5 * (2 * freedom) ** 0.5
    many = spark.range(3000).select(F.col("id").cast("string").alias("source"), F.lit(1.0).alias("wish"))
    assert mixing.draws(many, 20000, 5, 3).agg(F.sum("count")).first()[0] == 20000


def test_mixed_documents(spark):
    docs = documents(spark, texts_like(200))
    docs = docs.withColumnsRenamed({"fp": "_id", "digest": "key", "size": "row", "label": "times"})
    got = mixing.mixed_documents(docs, block=8)
    assert got.columns == docs.columns
    assert 0 < got.count() <= 600 and set(rows(got)) <= set(rows(docs))  # every column keeps its value


def test_mixed_documents_of_repeated_ids(spark):
    """Rows without an id, and rows that repeat one, are taken by their own share: sources meet their targets as those of distinct ids do."""
    texts = [f"{t} {i}" for i, t in enumerate(texts_like(400))]
    ids = [None if i % 2 else i // 40 for i in range(400)]
    sources = F.when(F.regexp_extract("text", r"(\d+)$", 1).cast("int") % 10 < 8, "a").otherwise("z")
    docs = documents(spark, texts + ["same words here now 5"] * 2, ids + [3, 3]).withColumn("source", sources)
    sizes, mixed = {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    times = {}
    for r in mixing.mixed_documents(docs, block=8).collect():
        mixed[r.source] = mixed.get(r.source, 0) + len(r.text.split())
        times[r.text] = times.get(r.text, 0) + 1
    want = brute_targets(sizes)
    assert all(abs(mixed[s] - want[s]) < 0.1 * want[s] for s in want), (mixed, want)
    assert max(times.values()) <= 6 and len(set(times.values())) > 1


# 9: HTML -------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T {0}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu {0}</a></li></ul></nav><!-- x --><div class="ad">Buy {0}</div>
<article><h1>Head &amp; {0}</h1><p><b>First   line {0}.<br><p>Second &lt;{0}&gt;</p><div class="comments"><p>Nice!</p></div><form>Mail <input></form></article><aside>Side</aside><footer>&copy; {0}</footer></body></html>"""


def test_html(spark):
    cases = [PAGE.format(i) for i in range(20)] + [None, "", "plain text", "<p>unclosed <b>bold<p>next", "<!-- never closed", "<script>x", "<article>" + "<p>long words</p>" * 3000]
    pages = spark.createDataFrame([(i, None if i == 3 else "http://h.example/x", h, "t", "h") for i, h in enumerate(cases)], "page_id bigint, url string, html string, text string, host string")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    for i in range(20):
        assert got[i] == f"Head & {i}\n\nFirst line {i}.\n\nSecond <{i}>"
    assert [got[i] for i in range(20, 26)] == ["", "", "plain text", "unclosed bold\n\nnext", "", ""]
    assert got[26] == "\n\n".join(["long words"] * 3000)
    joined = {r.page_id: r.text for r in html_extract.main_text(pages, broadcast_bytes=0).collect()}
    assert joined == got
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_html_template_decides(spark):
    """The slot is given whole, texts that all pages share included; teasers beside it go; an article's slot needs half of what varies only."""
    story = "Story {0} " + "about things {0} " * 20
    shapes = {
        "a": ("<html><body><article><h1>Head {0}</h1><p>" + story + "</p><p>Read <b>more</b> with us</p></article></body></html>", "Head {0}\n\n" + story.strip() + "\n\nRead more with us"),
        "b": ("<html><body><div class='text'><p>" + story + "</p></div><div class='cards'><article>Card {0}</article></div></body></html>", story.strip()),
        "c": ("<html><body><div>" + "Teaser {0} and more {0} " * 9 + "</div><article><p>" + story + "</p></article></body></html>", story.strip()),
        "d": ("<html><body><div class='w-1/2 x=y a.b'><div class='w-1/2'>Legal notice, the same everywhere. " + "It is long. " * 40 + "</div><div class='w-1/2'><p>" + story + "</p></div></div></body></html>", story.strip()),
    }
    rows = [(i, f"http://{host}.example/", page.format(i)) for host, (page, _) in shapes.items() for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (1 << 20, 0):
        got = {(r.url[7], r.page_id): r.text for r in html_extract.main_text(pages, broadcast_bytes=size).collect()}
        assert got == {(host, i): want.format(i) for host, (_, want) in shapes.items() for i in range(20)}


@pytest.mark.parametrize("classes", ["", " class='w-1/2'", " class='a=b'", " class='x.y #0'"])
def test_html_copies_and_shared_paragraphs(spark, classes):
    """Identical pages, however many, have their article; so have pages whose articles end alike; class names may hold any character."""
    page = "<html><body><nav><li>Menu {0}</li></nav><div" + classes + "><article><h1>Head {0}</h1><p>" + "Some text {0}. " * 12 + "</p><p>Sources: own research.</p></article></div><footer>f</footer></body></html>"
    text = lambda i: f"Head {i}\n\n" + ("Some text {0}. " * 12).format(i).strip() + "\n\nSources: own research."
    rows = [(0, "http://copies.example/", page.format(0))] * 10 + [(k, "http://mixed.example/", page.format(0)) for k in range(9)]
    rows += [(i, "http://differ.example/", page.format(i)) for i in range(10)] + [(i, "http://few.example/", page.format(i)) for i in range(7)] + [(40, "http://mixed.example/", page.format(1)), (1, "http://one.example/", page.format(1))]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    want = [(i, url, text(int(html.split("Menu ")[1].split("<")[0]))) for i, url, html in rows]
    assert sorted((r.page_id, r.url, r.text) for r in got) == sorted(want)


def test_html_template_is_whole(spark):
    """A host's template may have any number of texts."""
    page = "<html><body>" + "".join(f"<div><p>Fixed line {i}</p></div>" for i in range(600)) + "<div><p>Story {0}</p></div></body></html>"
    pages = spark.createDataFrame([(i, "http://h.example/", page.replace("{0}", str(i))) for i in range(20)], "page_id bigint, url string, html string")
    assert {r.text for r in html_extract.main_text(pages).collect()} == {f"Story {i}" for i in range(20)}


def random_page(rng, shape):
    part = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "menu", "fixed"]) for _ in range(rng.randint(1, 12)))
    out = ["<html><body>"]
    for kind in shape:
        if kind == "fixed":
            out.append("<div><p>fixed words here for ever</p></div>")
        elif kind == "maybe":
            out.append("<div class='maybe'>" + part() + "</div>" if rng.random() < 0.5 else "")
        elif kind == "text":
            out.append("<section><div>" + "".join(f"<p>{part()}</p>" for _ in range(rng.randint(1, 4))) + "</div></section>")
        else:
            out.append("<article><h1>" + part() + "</h1><p>" + part() + "</p></article>")
    return "".join(out) + "</body></html>"


def test_html_template_equals_brute_force(spark):
    """Classes by whole occurrence vectors over the host's different pages; the slot is that of the hashed sums, and the texts are the slot's."""
    rng, rows, hosts = random.Random(4), [], {}
    for h in range(12):
        shape = [rng.choice(["fixed", "maybe", "text", "article"]) for _ in range(rng.randint(1, 4))]
        hosts[f"h{h}.example"] = [random_page(rng, shape) for _ in range(rng.randint(2, 9))]
        rows += [(len(rows) + i, f"http://h{h}.example/", p) for i, p in enumerate(hosts[f"h{h}.example"] * (1 + h % 2))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for lists, share in ((True, 0.95), (False, 0.5)):
        want = {}
        for host, own in hosts.items():
            own = [p for p in own]
            per_page = [html_extract.tokens(p, lists) for p in own]
            every = {t: v[:2] for found in per_page for t, v in found.items()}
            vectors = {t: tuple(found.get(t, [0, 0, 0, 0])[2] for found in per_page) for t in every}
            on = {t: sum(map(bool, v)) for t, v in vectors.items()}
            found = {t: (*every[t], (on[t], sum(vectors[t]), vectors[t]), sum(f.get(t, [0, 0, 0, 0])[3] for f in per_page)) for t in every if on[t] * 2 >= len(own)}
            slot = html_extract.deduce(found, share) if len(set(own)) > 1 else None
            for p in own:
                want[host, p] = html_extract.extract(p, slot, lists)
        got = html_extract.main_text(pages.repartition(3), lists=lists, share=share).collect()
        by_id = {i: (u[7:-1], p) for i, u, p in rows}
        assert all(r.text == want[by_id[r.page_id]] for r in got) and len(got) == len(rows)


def test_html_slot_is_found_inwards():
    once, twice = (9, 9, 1, 1), (9, 18, 2, 2)
    page, body, div, aside, p, word = 0, 1, 2, 3, 4, 5
    found = {page: (-1, 1, once, 100), body: (page, 1, once, 100), div: (body, 1, once, 70), aside: (body, 1, once, 30), p: (div, 0, twice, 70), word: (aside, 3, once, 30)}
    assert html_extract.deduce(found) == div  # the aside's words are template
    assert html_extract.deduce(found | {word: (aside, 3, twice, 30)}) == body  # they vary, so both are the slot
    assert html_extract.deduce(found | {word: (aside, 3, twice, 30), div: (body, 2, once, 70)}) == div  # a main element
    assert html_extract.deduce(found | {div: (body, 1, twice, 70)}) == body  # not once a page
    assert html_extract.deduce(found | {div: (77, 1, once, 70)}) == body  # does not nest


def test_html_given_pages_by_the_template_alone(spark, sf_dir):
    """Without asking names, on hosts of three pages or more, the slot is the article."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    many = pages.withColumn("host", urls.host_of(F.col("url")))
    ids = [r.page_id for r in many.join(many.groupBy("host").count().filter("count >= 3"), "host").select("page_id").collect()]
    both = [{r.page_id: r.text for r in html_extract.main_text(pages, lists=lists, share=share).collect()} for lists, share in ((True, 0.95), (False, 0.5))]
    assert sum(both[0][i] == both[1][i] for i in ids) >= 0.95 * len(ids)


# 1 and 10: classifiers -----------------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng, out, labels = random.Random(12), [], []
    words = ["river", "stone", "garden", "letter", "window", "music", "forest", "bridge", "paper", "winter"]
    for i in range(n):
        text = [rng.choice(words) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(20, 80))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            text = [w + "###" for w in text]
        if toxic:
            text[3] = "grumbold"
            text[9] = "Grumb0ld!" if i % 10 else "grumbоld"  # a digit, and a Cyrillic letter
        out.append(" ".join(text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return documents(spark, out), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def accuracy(scores, labels, column):
    j = scores.join(labels, "doc_id").select(((F.col("score") >= 0.3).cast("int") == F.col(column)).cast("double").alias("ok"))
    return j.agg(F.avg("ok")).first()[0]


def test_quality(spark):
    docs, labels = labelled(spark)
    use = common.fold_of(F.col("doc_id"), 5) != 0
    model = quality.fit(docs, labels, use)
    held = docs.filter(~use)
    assert accuracy(quality.scores(held, model), labels, "quality") > 0.97
    assert len(model.rules) > 0
    odd = documents(spark, ODD)
    assert all(0 <= r.score <= 1 for r in quality.scores(odd, model).collect()) and quality.scores(odd.limit(0), model).count() == 0
    kept = quality.keep(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    one_sided = quality.fit(docs, labels.filter("quality = 1"), use)
    assert one_sided.rules == [] and 0.9 < [r.score for r in quality.scores(odd.limit(1), one_sided).collect()][0] <= 1


def test_toxicity(spark):
    docs, labels = labelled(spark)
    use = common.fold_of(F.col("doc_id"), 4) != 2
    lexicon = toxicity.fit(docs, labels, use)
    assert ("grumbold", False) in lexicon.weights
    assert accuracy(toxicity.scores(docs.filter(~use), lexicon), labels, "toxic") == 1.0
    odd = documents(spark, ODD)
    assert all(0 <= r.score <= 1 for r in toxicity.scores(odd, lexicon).collect()) and toxicity.scores(odd.limit(0), lexicon).count() == 0
    assert toxicity.fit(docs, labels.limit(0), use).score("you idiot") > 0.3


def test_seed_word_of_clean_texts_goes(spark):
    docs, labels = labelled(spark)
    clean = F.col("doc_id").isin([r.doc_id for r in labels.filter("toxic = 0").collect()])
    docs = docs.withColumn("text", F.when(clean, F.concat("text", F.lit(" basura"))).otherwise(F.col("text")))
    weights = toxicity.fit(docs, labels, F.lit(True)).weights
    assert ("basura", False) not in weights and ("escoria", False) in weights and ("grumbold", False) in weights


def test_lexicon_matching():
    lexicon = toxicity.Lexicon({("trash", False): 1.0, ("gru", True): 2.0, ("loser", False): 3.0, ("idiot", False): 4.0, ("estúpido", False): 5.0})
    spans = lambda t: [h[:2] for h in lexicon.hits(t)]
    assert spans("Trash, tra5h and \u0442r\u0430sh") == [(0, 5), (7, 12), (17, 22)]
    assert spans("trashy atrash") == [] and spans("a trash can") == [] and spans("GRUmble") == [(0, 3)]
    assert spans("1oser 1diot l0ser estupido ESTÚPIDO") == [(0, 5), (6, 11), (12, 17), (18, 26), (27, 35)]
    assert spans("sore loser, loser; sore l0ser") == [(12, 17)]
    assert spans("") == [] and toxicity.Lexicon({}, []).hits("trash") == []
    assert lexicon.score("trash") > lexicon.score("trash " + "fine " * 200)


def test_lexicon_equals_plain_search():
    """Every entry and exception looked for at every place, on texts made of pieces of them."""
    rng = random.Random(7)
    weights = {("trash", False): 1.0, ("tra", True): 0.5, ("loser", False): 3.0, ("idi", True): 4.0, ("clown", False): 2.0}
    exceptions = ["trash can", "class clown", "sore loser", "clown class clown"]
    lexicon = toxicity.Lexicon(weights, exceptions)
    pieces = ["trash", "tra5h", " can", "class ", "clown", "sore ", "loser", "1oser", "idiot", "id1", " ", "x", ". ", "é", "Trás"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        want = set()
        for one in ("i", "l"):
            folded = toxicity.fold(text, one)

            def places(entry, start, folded=folded):
                for b in range(len(folded)):
                    e = b + len(entry)
                    if folded.startswith(entry, b) and not (b and folded[b - 1].isalpha()) and (start or e == len(folded) or not folded[e].isalpha()):
                        yield b, e

            excused = [p for phrase in exceptions for p in places(phrase, False)]
            want |= {(b, e, w) for (entry, start), w in weights.items() for b, e in places(entry, start) if not any(x <= b and e <= y for x, y in excused)}
        assert set(lexicon.hits(text)) == want, text


def test_toxic_sample_is_the_same_however_dealt(spark):
    docs, labels = labelled(spark)
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.concat("text", F.lit(" again"))))
    labels = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 1000))
    one, other = (toxicity.fit(docs.repartition(n), labels.repartition(n), F.lit(True)) for n in (1, 7))
    assert one.weights == other.weights and one.curve == pytest.approx(other.curve)


def test_byte_bpe_with_little_memory(spark):
    """What a worker remembers changes no result, nor whether it keeps the tables."""
    docs, path = documents(spark, [*texts_like(8), *ODD]), public_tokenizers.path(queries.BYTE_BPE)
    little = rows(bpe.encode_decode(docs, path, keep=False, remember=3, pairs=2))
    assert sorted(little, key=str) == sorted(rows(bpe.encode_decode(docs, path)), key=str) and len(little) == docs.count()


def test_very_long_texts(spark):
    """Texts of some MB through the operators that read whole texts."""
    texts = ["word river " * 400_000, "x" * 4_000_000, "idiot. " * 300_000, "short"]
    docs = documents(spark, texts)
    stats = {r.doc_id: r for r in quality.with_statistics(docs).collect()}
    assert stats[0].log_words == pytest.approx(np.log1p(800_000)) and stats[1].log_chars == pytest.approx(np.log1p(4_000_000))
    scores = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.Lexicon({("idiot", False): 4.0})).collect()}
    assert scores[2] > 0.9 > scores[0] and 0 <= scores[1] < 0.1
    assert {r.doc_id: r["size"] for r in mixing.sizes(docs).collect()} == {0: 800_000, 1: 1, 2: 300_000, 3: 1}
    assert len({r.fp for r in simhash.fingerprints(docs).collect()}) == 4 and len({r.node for r in simhash.wide_fingerprints(docs).collect()}) == 4


def brute_statistics(text):
    """The sixteen statistics from their descriptions, one character and word at a time."""
    words, size = text.split(), len(text.encode())
    if not words:
        return [np.log1p(len(text)), *[0.0] * 15]
    m, raw = len(words), text.encode()
    count = lambda test: sum(1 for c in raw if test(chr(c)))
    symbol = lambda c: "!" <= c <= "~" and not c.isalnum() and c not in ".,;:'\"()-"
    spaces, digits, symbols, points = count(lambda c: c in " \n\t\r"), count(lambda c: c in "0123456789"), count(symbol), count(lambda c: c in ".,;:'\"()-")
    lower = text.lower().split()
    lines = [x for x in text.split("\n") if x.strip()]
    marked = sum(1 for w in words if quality._MARKED.search(w.encode())) if symbols else 0
    top = max(lower.count(w) for w in set(lower))
    return [np.log1p(len(text)), np.log1p(m), (len(text) - spaces) / m, (size - spaces - digits - symbols - points) / size, digits / size, count(lambda c: "A" <= c <= "Z") / size, symbols / size, text.count("|") / m, marked / m, sum(w.isupper() for w in words) / m, len(set(lower)) / m, sum(a == b for a, b in zip(words, words[1:])) / m, np.log1p(m / len(lines)), len(set(lines)) / len(lines), top / m, raw.count(b". ") / m]


def test_statistics_equal_brute_force():
    for text in [t for t in ODD if t and len(t) < 4000] + texts_like(20) + fuzzed(150) + ["ab## ## |x| A B. C\nA B. C\n\n a a a"]:
        assert quality.statistics(text) == pytest.approx(brute_statistics(text)), text
    assert quality.statistics(None) == quality.statistics("")


def test_rules_follow_the_trees(spark):
    """A tree's leaf rules hold for the rows that the tree itself sends to that leaf, and the score is the logistic sum of the rules that hold."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    docs, labels = labelled(spark, 300)
    rows_ = quality.with_statistics(docs).join(labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").withColumn("features", array_to_vector(F.array(*quality.STATS))).cache()
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=3, maxDepth=3, seed=1).fit(rows_)
    rules = quality.tree_rules(forest)
    values = [[r[s] for s in quality.STATS] for r in rows_.collect()]

    def holds(rule, v):
        return all(low < v[quality.STATS.index(name)] <= high for name, low, high in rule.bounds)

    def leaf(node, v, bounds=()):
        if node.getClass().getSimpleName() != "InternalNode":
            return bounds
        i, at = node.split().featureIndex(), node.split().threshold()
        return leaf(node.leftChild(), v, (*bounds, (i, at, True))) if v[i] <= at else leaf(node.rightChild(), v, (*bounds, (i, at, False)))

    for tree in forest.trees:
        root = tree._call_java("rootNode")
        for v in values[:60]:
            path = leaf(root, v)
            bounds = {}
            for i, at, left in path:
                low, high = bounds.get(quality.STATS[i], (-np.inf, np.inf))
                bounds[quality.STATS[i]] = (low, min(high, at)) if left else (max(low, at), high)
            if path:
                rule = quality.Rule(tuple((k, *x) for k, x in sorted(bounds.items())))
                assert rule in rules and holds(rule, v)
    model = quality.RuleModel(-0.5, [(r, 0.3 * (-1) ** i) for i, r in enumerate(rules)])
    got = {r.doc_id: r.score for r in quality.scores(docs, model).collect()}
    for r, v in zip(rows_.collect(), values):
        total = -0.5 + sum(w for rule, w in model.rules if holds(rule, v))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-total)))
    clash = docs.withColumnsRenamed({"fp": "row", "size": "log_chars", "label": "_log_words"})
    kept = quality.keep(clash, model, 0.45)
    assert kept.columns == clash.columns and sorted(rows(kept), key=str) == sorted((r for r in rows(clash) if got[r[0]] >= 0.45), key=str)


def test_crc_fold(spark):
    got = rows(spark.range(50).select("id", common.fold_of(F.col("id"), 5)))
    assert all(f == zlib.crc32(str(i).encode()) % 5 for i, f in got)


def test_without_either_way(spark):
    docs = documents(spark, ODD, [*range(len(ODD) - 1), None])
    gone = spark.createDataFrame([(1,), (3,), (99,)], "doc_id bigint")
    small, large = (common.without(docs, gone, most=n) for n in (10, 0))
    assert small.columns == large.columns == docs.columns
    assert sorted(rows(small), key=str) == sorted(rows(large), key=str) and small.count() == len(ODD) - 2

"""Sharding, phrase mining and the Merkle manifest against brute force, with the odd cases in the rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import merkle, phrases, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, pos int, tree int, digest string, size int, phrase string, n int"
ODD = [None, "", "\n", "a\nb\n\nc", "one two", "one two", "x" * 3000, "word. " * 4000, "é ́ 中文 \U0001f600\n", " \t\n"]


def table(spark, rows):
    """rows (doc_id, text, lang, source, n_chars); extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 1, "y", 1, "z", 2) for r in rows], SCHEMA)


def odd_rows():
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 1 else f"s{i % 3}", None if i % 5 == 0 else i) for i, t in enumerate(ODD)]
    return rows + [rows[5]] * 40 + [(None, None, None, None, None)] * 30 + [(3, "other text", "de", "é", 4), (3, "third", "de", "é", 4)] + [(i, "a\nb", "fr", "s0", 3) for i in range(20, 30)]


# 11 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 255, 1000, 4097])
def test_permutation_is_whole_and_has_an_inverse(n):
    rows = np.arange(n, dtype=np.uint64)
    for key in (0, 9):
        to = sharding.permuted(rows, n, key)
        assert sorted(to.tolist()) == list(range(n))
        assert (sharding.permuted(to, n, key, back=True) == rows).all()
    assert n < 16 or sharding.permuted(rows, n, 0).tolist() != sharding.permuted(rows, n, 9).tolist()
    for row in range(0, n, 97):
        assert sharding.row_at(*sharding.place_of(row, n, 7), n, 7) == row


def test_permutation_spreads_neighbours():
    to = sharding.permuted(np.arange(16_000, dtype=np.uint64), 16_000, 0).astype(np.int64)
    assert abs(np.corrcoef(np.arange(16_000), to)[0, 1]) < 0.03
    pairs = Counter(zip((to[:-1] % 16).tolist(), (to[1:] % 16).tolist()))
    assert sum((n - 62.5) ** 2 / 62.5 for n in pairs.values()) < 350  # 255 degrees of freedom


def test_shards(spark):
    rows = odd_rows()
    got = sharding.assign(table(spark, rows), 16, key=4).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    # A row's place follows from its number alone: rows by doc_id, null last.
    n, by_place = len(rows), {(r.shard, r.slot): r.doc_id for r in got}
    ids = sorted((d for d, *_ in rows), key=lambda d: (d is None, d))
    assert all(by_place[sharding.place_of(i, n, 16, 4)] == d for i, d in enumerate(ids))
    again = sharding.assign(table(spark, random.Random(1).sample(rows, n)).repartition(5), 16, key=4).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.assign(table(spark, rows).limit(0)).collect() == []
    few = sharding.assign(table(spark, rows[:3]), 16).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_written_shards(spark, tmp_path):
    rows = odd_rows()
    got = sharding.write(table(spark, rows), str(tmp_path / "shards"), 4, slots_a_file=8)
    back = got.collect()
    assert Counter(tuple(r.row)[:5] for r in back) == Counter(rows)
    where = {(r.shard, r.slot) for r in sharding.assign(table(spark, rows), 4).collect()}
    assert {(r.shard, r.slot) for r in back} == where
    per_file = got.select(F.input_file_name().alias("f"), "slot").collect()
    for f in {r.f for r in per_file}:
        slots = [r.slot for r in per_file if r.f == f]
        assert slots == sorted(slots)


# 12 ------------------------------------------------------------------------------------------------------------------


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for mark in ".,;:!?\n\x0b\x0c\r":
        low = low.replace(mark, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in low.split("\n")]


def mined(rows, top, least):
    out = set()
    for lang in {r[2] or "und" for r in rows}:
        f = Counter(" ".join(p[i : i + k]) for r in rows if (r[2] or "und") == lang for p in pieces(r[1]) for k in range(1, 5) for i in range(len(p) - k + 1))
        n = sum(c for g, c in f.items() if " " not in g)
        good = {g: c for g, c in f.items() if " " in g and c >= least}
        kept = []
        for g, a in good.items():
            w = g.split(" ")
            if any(100 * c >= 80 * a and len(x.split(" ")) > len(w) and f" {g} " in f" {x} " for x, c in good.items()):
                continue
            score, k = min((2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            kept.append((-score, -a, g.encode(), a, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out |= {(lang, i + 1, g.decode(), a, x, y, n, -s) for i, (s, _, g, a, x, y) in enumerate(sorted(kept)[:top])}
    return out


def phrase_rows(seed, n=250):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "é", "the", "of", "a", "ß\x1cx", " nb", "zeta", "eta", "12"]
    sets = ["the beta of a", "Alpha beta gamma zeta", "12 é eta", "of the"]
    out = [(i, None, "en", "s", 1) for i in range(2)] + [(3, "", None, "s", 1), (4, " .,;\t", "de", "s", 1)]
    for i in range(n):
        parts = [rng.choice(words) if rng.random() < 0.7 else rng.choice(sets) for _ in range(rng.randint(1, 25))]
        out.append((i, "".join(p + rng.choice([" ", "  ", "\t", " ", ". ", "\n", "! "]) for p in parts), rng.choice(["en", "en", "en", None, "fr"]), "s", 1))
    return out


@pytest.mark.parametrize("top, least, ahead", [(5, 4, 1), (400, 3, 2)])
def test_phrases_equal_brute_force(spark, top, least, ahead):
    """Small tops make thresholds rise and frontiers stay unexpanded; an `ahead` of 1 makes them widen."""
    rows = phrase_rows(top)
    got = phrases.mine(table(spark, rows).repartition(5), top=top, least=least, ahead=ahead).collect()
    assert set(map(tuple, got)) == mined(rows, top, least) and len(got) == len(set(map(tuple, got)))


def test_phrases_of_nothing(spark):
    rows = phrase_rows(1, 3)
    assert phrases.mine(table(spark, rows).limit(0)).collect() == []
    assert phrases.mine(table(spark, rows)).collect() == []
    long = [(1, "one two three four. " * 30_000, "en", "s", 1)]
    assert {tuple(r) for r in phrases.mine(table(spark, long)).collect()} == mined(long, 2000, 30)


def test_words():
    for _, text, *_ in phrase_rows(8):
        got = [[]]
        for w in phrases.words_of((text or "").encode()):
            if w == b"\n":
                got.append([])
            else:
                got[-1].append(w.decode())
        assert [p for p in got if p] == [p for p in pieces(text) if p]


# 13 ------------------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    doc_id, _, lang, source, n_chars = r
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(one, (doc_id, source, lang, n_chars, text)))


def tree_of(low):
    levels = [low]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels


def path_of(levels, at):
    out = []
    for now in levels[:-1]:
        first = at // 3 * 3
        out.append((now[first:at], now[at + 1 : first + 3]))
        at //= 3
    return out


def proved(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, ordered = [], []
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r, r[1])))
        ordered.append(mine)
        trees.append(tree_of([leaf_of(r, r[1]) for r in mine]))
    top = tree_of([t[-1][0] for t in trees])
    out = []
    for k, (mine, tree) in enumerate(zip(ordered, trees)):
        for i, r in enumerate(mine):
            steps = path_of(tree, i) + path_of(top, k)
            changed = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf_of(r, r[1].replace("\n", "") if changed else r[1])
            for a, b in steps:
                now = h(*a, now, *b)
            out.append((r[0], tree[0][i], tree[-1][0], top[-1][0], h(*(d for a, b in steps for d in a + b)), now, now == top[-1][0]))
    return out


def changed():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0


def test_manifest_of_odd_rows(spark):
    rows = odd_rows()
    want = proved(rows)
    got = merkle.verify(table(spark, rows).repartition(4), changed()).collect()
    assert Counter(map(tuple, got)) == Counter(want) and {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("rows", [[], [(7, "a\nb", "en", "s", 3)], [(1, "a\n", None, None, None), (2, "b", "en", "s", 1)], [(i, f"t\n{i}", "en", "s", 1) for i in range(4)]])
def test_manifest_of_few_rows(spark, rows):
    got = merkle.verify(table(spark, rows), changed()).collect()
    assert Counter(map(tuple, got)) == Counter(proved(rows) if rows else [])


def test_manifest_over_blocks_and_proofs_of_some_rows(spark):
    """More leaves than a block has, so that tops go up a second pass and siblings are fetched; and proofs for few leaves, whose siblings lie in other blocks and among leaves."""
    rows = [(i, f"t\n{i}" if i % 3 else f"t{i}", "en", "hot" if i % 7 else f"s{i % 5}", i) for i in range(8000)]
    want = Counter(proved(rows))
    docs = table(spark, rows)
    assert Counter(map(tuple, merkle.verify(docs, changed()).collect())) == want
    held = merkle.leaves(docs, tampered=F.when(changed(), merkle.leaf(docs, F.translate("text", "\n", ""))))
    nodes, subroots = merkle.build(held)
    some = {5, 6, 700, 3999, 7000, 7993, 7999}
    got = merkle.prove(held.filter(F.col("doc_id").isin(some)), held, nodes, subroots).collect()
    assert Counter(map(tuple, got)) == Counter({r: n for r, n in want.items() if r[0] in some})


def test_multiproof_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 90)
        places = rng.sample(range(n), rng.randint(1, n))
        got = merkle.missing(places, n)
        levels = merkle.widths(n)
        known = set(places)
        want = set()
        for level, width in enumerate(levels[:-1]):
            runs = {p // 3 for p in known}
            want |= {(level, p) for p in range(width) if p // 3 in runs and p not in known}
            known = runs
        assert set(got) == want and len(got) == len(want)
        assert len(places) < n or not got

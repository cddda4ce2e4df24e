"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word from frequent words. What a phrase may still become is bounded by counts that are known before: whatever begins with p and its
first word w has at most f(p) occurrences and a score of at most 2000000 f(p) / (f(w) + f(p)); whatever ends with s and its last word w has at most
2000000 f(s) / (f(w) + f(s)). The frontier of each language is expanded down to a threshold: phrases are counted only where a prefix or a suffix may still reach it. A phrase that scores the
threshold itself is among these, so all longer phrases that could drop it are counted too. If fewer phrases than wanted survive at or above the threshold,
the language's threshold is lowered and its frontier expanded further; else everything not expanded is worse than the last one wanted, ties included.

Each growth step reads the texts once. Which n-grams to count is told by filters of a bounded size (Bloom filters over the known
phrases; what they let through wrongly falls to the least count or is dropped by exact joins), so nothing that grows with the data is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import scratch

LEAST, LONGEST, SCALE, DROP_AT = 30, 4, 2_000_000, 80
#: Fixed values of the contract: what ends a piece, what parts words, letters that are lowered.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
#: Bits of a filter at most (16 MB), and for each phrase in it.
FILTER_BITS, BITS_EACH = 1 << 27, 16
#: Bytes of text that are counted at once, and words that a worker remembers by hash.
CHUNK, REMEMBERED = 4 << 20, 1 << 17
COUNTS = "lang string, phrase string, n bigint"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in order, with an end of line between pieces."""
    return [w for w in text.translate(FOLD).replace(b"\n", b" \n ").split(b" ") if w]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: list[np.ndarray], lang: str) -> np.ndarray:
    """Hashes of phrases, given the hashes of their first, second, ... words."""
    h = np.full(len(words[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            h = _mix(h * np.uint64(3) + w)
    return h


class Filter:
    """Phrases as two bits each of a field of at most FILTER_BITS bits, built by tasks and joined by bit_or in Spark."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(h: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """The word of 64 bits, and the two bits in it."""
        at = (h >> np.uint64(24)) % np.uint64(n_words)
        one = np.uint64(1)
        return at, (one << (h & np.uint64(63))) | (one << ((h >> np.uint64(6)) & np.uint64(63)))

    def has(self, h: np.ndarray) -> np.ndarray:
        at, bits = self.places(h, len(self.words))
        return (self.words[at] & bits) == bits

    @classmethod
    def of(cls, phrases: DataFrame) -> Filter:
        """phrases (lang, phrase): distinct phrases, written. At most FILTER_BITS / 64 rows of two numbers reach the driver."""
        n_words = min(FILTER_BITS, 1 << max(10, (phrases.count() * BITS_EACH).bit_length())) // 64

        def run(batches):
            for b in batches:
                langs, texts = np.array(b.column("lang").to_pylist(), object), b.column("phrase").to_pylist()
                ats, bits = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
                for lang in set(langs):
                    mine = [texts[i].encode().split(b" ") for i in np.flatnonzero(langs == lang)]
                    for k in {len(m) for m in mine}:
                        h = gram_hashes([np.array([xxhash.xxh64_intdigest(m[j]) for m in mine if len(m) == k], np.uint64) for j in range(k)], lang)
                        at, bit = cls.places(h, n_words)
                        ats.append(at)
                        bits.append(bit)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ats).astype(np.int64)), pa.array(np.concatenate(bits).view(np.int64))], ["at", "bits"])

        field = np.zeros(n_words, np.uint64)
        got = phrases.mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        field[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return cls(field)


def _runs(ids: np.ndarray, k: int) -> np.ndarray:
    """Where a phrase of k words begins: no end of a piece (-1) within."""
    good, n = ids >= 0, max(0, len(ids) - k + 1)
    out = good[:n].copy()
    for j in range(1, k):
        out &= good[j : j + n]
    return np.flatnonzero(out)


def counted(docs: DataFrame, k: int, wanted: Callable[[str, list[np.ndarray]], np.ndarray] | None) -> DataFrame:
    """docs (lang, text) -> (lang, phrase, n): all occurrences of the phrases of k words that wanted lets through; wanted gets the language and the hashes of the first, second, ... words of
    many places.

    Within a chunk of text phrases are told apart by numbers (a phrase is the number of its first k - 1 words and that of its last), so counts are exact whatever
    hashes do. Spark adds the chunks' counts, within each task before it shuffles."""

    def chunk(lang: str, text: bytes, known: dict[bytes, int]) -> tuple[list[str], list[int]]:
        words = words_of(text)
        names = list(dict.fromkeys(words))
        number = dict(zip(names, range(len(names))))
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        del words
        if (end := number.get(b"\n")) is not None:
            ids[ids == end] = -1
        if k == 1:
            n = np.bincount(ids[ids >= 0], minlength=len(names)).tolist()
            return [w.decode() for w, c in zip(names, n) if c], [c for c in n if c]
        hashes = np.empty(len(names), np.uint64)
        for i, w in enumerate(names):
            if (h := known.get(w)) is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashes[i] = h
        if len(known) > REMEMBERED:
            known.clear()
        at = _runs(ids, k)
        if wanted is not None and len(at):
            at = at[wanted(lang, [hashes[ids[at + j]] for j in range(k)])]
        if not len(at):
            return [], []
        group = ids[at]
        for j in range(1, k):
            _, first, group, n = np.unique(group << 32 | ids[at + j], return_index=True, return_inverse=True, return_counts=True)
        parts = [[names[i] for i in ids[at[first] + j]] for j in range(k)]
        return [b" ".join(p).decode() for p in zip(*parts)], n.tolist()

    def run(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            held: dict[str, list[bytes]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(b.column("lang"), b.column("text")):
                lang, text = lang.as_py(), (text.as_buffer() or b"")
                held.setdefault(lang, []).append(bytes(text))
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= CHUNK:
                    yield from out(lang, b"\n".join(held.pop(lang)), known)
                    size.pop(lang)
            for lang, texts in held.items():
                yield from out(lang, b"\n".join(texts), known)

    def out(lang: str, text: bytes, known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        phrases, n = chunk(lang, text, known)
        if phrases:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    return docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(25,0)")


def _ratio(a: Column | str, whole: Column) -> Column:
    """floor(SCALE a / whole), whole as a decimal: exact beyond 64 bits."""
    return F.call_function("div", _wide(a) * F.lit(SCALE).cast("decimal(8,0)"), whole).cast("bigint")


def _head(k: int) -> Column:
    return F.substring_index("phrase", " ", k)


def _but_first() -> Column:
    return F.expr("substr(phrase, instr(phrase, ' ') + 1)")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrases (lang, phrase, a) -> with l, r, score of the lowest-scoring cut, of equals the first; phrases of which counts (lang, phrase, n) lacks a part are left out."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("rest")))
    each = phrases.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    each = each.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    each = each.withColumn("score", _ratio("a", _wide("l") + _wide("r")))
    low = F.min(F.struct("score", "k", "l", "r"))
    whole = F.size(F.split("phrase", " ")) - 1
    return each.groupBy("lang", "phrase", "a").agg(low.alias("low"), F.count(F.lit(1)).alias("cuts")).filter(F.col("cuts") == whole).select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def bounded(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases (lang, phrase, n) -> with ahead, the most that a phrase which begins so can score, and behind, the most that one which ends so can."""
    out = phrases.withColumns({"_w": _head(1), "_z": _head(-1)})
    w, z = (words.select("lang", F.col("phrase").alias(k), F.col("n").alias(k + "n")) for k in ("_w", "_z"))
    out = out.join(w, ["lang", "_w"]).join(z, ["lang", "_z"])
    return out.select("lang", "phrase", "n", _ratio("n", _wide("_wn") + _wide("n")).alias("ahead"), _ratio("n", _wide("_zn") + _wide("n")).alias("behind"))


def longer(above: DataFrame) -> DataFrame:
    """above (lang, phrase, n) -> (lang, phrase, longest_n): the most occurrences of a phrase one word longer than it that contains it. Counts fall as phrases grow, so longer ones
    need not be asked."""
    sides = F.array(_head_but_last(), _but_first())
    return above.select("lang", F.explode(sides).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest_n"))


def _head_but_last() -> Column:
    return F.expr("substr(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)")


def mine(docs: DataFrame, top: int = 2000, least: int = LEAST, ahead: int = 2, widen: int = 4) -> DataFrame:
    """docs (lang, text, ...) -> (lang, rank, phrase, a, l, r, n, score): the first `top` surviving phrases of each language.

    A null lang is `und`, a null text is empty; a language without candidates gives no rows, and neither does an empty table; extra columns are ignored; repeated rows count as
    often as they occur. Ties: score and a descending, then the phrase's bytes ascending. A language's first threshold is the score of its `ahead` x top-th phrase of two words,
    each further one that of a phrase `widen` times as far down; it is zero where there are not so many."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    every = scratch(counted(texts, 1, None), "words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = scratch(every.filter(F.col("n") >= least), "frequent")
    frequent = Filter.of(words)
    one = lambda f: lambda lang, h: f.has(gram_hashes(h[:1], lang)) & f.has(gram_hashes(h[1:], lang))
    pairs = scratch(counted(texts, 2, one(frequent)).filter(F.col("n") >= least), "pairs")
    two = scratch(scored(pairs.withColumnRenamed("n", "a"), words), "scored_pairs")
    known_pairs = scratch(bounded(pairs, words), "bounded_pairs")
    pair_filter = Filter.of(pairs)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc()))

    done, reach, open_langs = None, ahead * top, two.select("lang").distinct()
    while True:
        # Thresholds of the languages that are not settled: the score of the reach-th pair, or 0.
        nth = two.join(open_langs, "lang", "left_semi").select("lang", "score", place.alias("place")).filter(F.col("place") <= reach)
        limits = scratch(nth.groupBy("lang").agg(F.when(F.max("place") == reach, F.min("score")).otherwise(F.lit(0)).cast("bigint").alias("limit")), "limits")
        got = _above(texts.join(limits.select("lang"), "lang", "left_semi"), limits, words, two, known_pairs, pair_filter, least)
        ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))).filter(F.col("rank") <= top)
        ranked = scratch(ranked, "surviving")
        n = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        short = limits.filter("limit > 0").join(n, "lang", "left").filter(F.coalesce("found", F.lit(0)) < top).select("lang")
        settled = ranked.join(short, "lang", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        open_langs, reach = scratch(short, "open"), reach * widen
        if open_langs.isEmpty():
            break
    return done.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _above(texts: DataFrame, limits: DataFrame, words: DataFrame, two: DataFrame, known_pairs: DataFrame, pair_filter: Filter, least: int) -> DataFrame:
    """The surviving phrases (lang, phrase, a, l, r, score) that score their language's limit or more."""

    def grown(k: int, known: DataFrame, extra: Filter | None) -> DataFrame:
        """Phrases of k words that may reach the limit, or that contain a phrase of k - 1 words which reaches it."""
        may = known.join(limits, "lang")
        begin, end = (Filter.of(scratch(may.filter(F.col(side) >= F.col("limit")).select("lang", "phrase"), side)) for side in ("ahead", "behind"))

        def wanted(lang: str, h: list[np.ndarray]) -> np.ndarray:
            a, b = gram_hashes(h[:-1], lang), gram_hashes(h[1:], lang)
            out = begin.has(a) | end.has(b)
            return out & extra.has(a) & extra.has(b) if extra is not None else out

        return scratch(counted(texts, k, wanted).filter(F.col("n") >= least), f"phrases_{k}")

    pairs = known_pairs.select("lang", "phrase", "n")
    counts, by_size = words.unionByName(pairs), [two.join(limits.select("lang"), "lang", "left_semi")]
    held, known = [pairs], known_pairs
    for k in range(3, LONGEST + 1):
        more = grown(k, known, pair_filter if k == 3 else None)
        held.append(more)
        counts = counts.unionByName(more)
        known = bounded(more, words)
    # A phrase that reaches the limit has had all its parts counted; one that lacks a part is below it.
    for more in held[1:]:
        by_size.append(scored(more.withColumnRenamed("n", "a"), counts))
    out = None
    for i, candidates in enumerate(by_size):
        good = candidates.join(limits, "lang").filter("score >= limit").drop("limit")
        if i + 1 < len(held):
            kill = longer(held[i + 1])
            good = good.join(kill, ["lang", "phrase"], "left").filter(F.col("longest_n").isNull() | (_wide("longest_n") * 100 < _wide("a") * DROP_AT)).drop("longest_n")
        good = good.select("lang", "phrase", "a", "l", "r", "score")
        out = good if out is None else out.unionByName(good)
    return out

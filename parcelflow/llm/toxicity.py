"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accented letters, look-alike letters of other scripts and digits that stand for letters become plain
letters (1 both i and l), invisible characters go. Entries match whole words or beginnings of words. A hit inside an exception phrase doesn't
count. The sum of hits' weights, and that sum for each hundred words, go through a logistic curve.

The lexicon is a seed list plus words and word beginnings that labelled rows single out; weights and curve come from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import scratch, small_batches
from parcelflow.llm.quality import labelled_sample

#: Look-alikes of Latin letters: fixed values.
LOOKALIKES = dict(zip("абсԁеһіјӏмпорԛѕтԝхуѵαβεηικνορτυχ", "abcdehijlmnopqstwxyvabenikvoptux"))
DIGITS = dict(zip("0134578", "oieastb"))
INVISIBLE = "­​‌‍⁠﻿"
#: Letters of Latin-1 and Latin Extended-A with an accent become the plain ones.
ACCENTS = {c: d for c in map(chr, range(0xC0, 0x180)) if (d := unicodedata.normalize("NFD", c)[0]) != c}
FOLD = {ord(k): v for k, v in (ACCENTS | LOOKALIKES | DIGITS).items()} | {ord(c): None for c in INVISIBLE}
SIGNS = re.compile(r"[@$](?=\w)")

#: Common insults, counted before any label is seen: (entry, matches word beginnings too).
SEED = [(w, False) for w in "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile dumbass bastard dummkopf idioten arschloch abschaum connard imbécile abruti idiota estúpido imbécil basura escoria".split()]
#: Phrases in which an entry is harmless.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "take out the trash", "pathetic fallacy", "clown fish", "sore loser", "pond scum", "disgusting smell", "class clown", "village idiot"]


def fold(text: str, one: str = "i") -> str:
    """one: the letter that 1 stands for."""
    if one != "i":
        text = text.replace("1", one)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(FOLD)
    return SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)


_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Lexicon:
    """weights: (entry, matches word beginnings too) -> weight; curve: intercept and slopes of the score."""

    weights: dict[tuple[str, bool], float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}  # built again in each worker

    def automaton(self):
        if self._automaton is None:
            a, held = ahocorasick.Automaton(), {}
            for (entry, start), weight in self.weights.items():
                held.setdefault(fold(entry), []).append((len(fold(entry)), start, weight))
            for phrase in self.exceptions:
                held.setdefault(fold(phrase), []).append((len(fold(phrase)), False, None))
            for key, values in held.items():
                a.add_word(key, values)
            if held:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the folded text, without those inside an exception phrase."""
        if not len(self.automaton()):
            return []
        found = self._hits(fold(text))
        if "1" in text:
            found = sorted({*found, *self._hits(fold(text, "l"))})
        return found

    def _hits(self, folded: str) -> list[tuple[int, int, float]]:
        found, excused = [], []
        for last, values in self.automaton().iter(folded):
            for size, start_only, weight in values:
                begin, end = last - size + 1, last + 1
                if begin and folded[begin - 1].isalpha():
                    continue
                if not start_only and end < len(folded) and folded[end].isalpha():
                    continue
                (found if weight is not None else excused).append((begin, end, weight))
        if excused:
            # Of the phrases that begin at or before a hit, the one that reaches farthest decides.
            excused.sort(key=lambda x: x[0])
            begins, reach = [x[0] for x in excused], list(accumulate((x[1] for x in excused), max))
            found = [h for h in found if not (k := bisect_right(begins, h[0])) or reach[k - 1] < h[1]]
        return found

    def features(self, text: str | None) -> tuple[float, float]:
        """log(1 + weights), log(1 + weights for a hundred words)."""
        total = sum(w for _, _, w in self.hits(text or ""))
        return math.log1p(total), math.log1p(100 * total / (len((text or "").split()) + 10))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.curve[0] + self.curve[1] * a + self.curve[2] * b))))


def _terms(text: str, shortest: int, longest: int) -> set[tuple[str, bool]]:
    words = set(_WORDS.findall(fold(text)))
    out = {(w, False) for w in words if len(w) >= 3}
    out.update((w[:k], True) for w in words for k in range(shortest, min(len(w), longest) + 1))
    return out


def _count_terms(sample: DataFrame, only: set | None, shortest: int, longest: int) -> DataFrame:
    """(term, start, ones, zeros): in how many sampled texts of either label a term occurs; summed in each batch first."""

    def run(batches):
        for b in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                terms = _terms(text or "", shortest, longest)
                counts[int(label)].update(terms if only is None else terms & only)
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array([counts[i][k] for k in keys], pa.int64()) for i in (1, 0))], ["term", "start", "ones", "zeros"])

    each = sample.select("text", "label").mapInArrow(run, "term string, start boolean, ones bigint, zeros bigint")
    return each.groupBy("term", "start").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def _decorrelated(sample: DataFrame) -> DataFrame:
    """One row for each set of near copies, roughly: rows whose five-word shingles have the same smallest hash count once.
    Copies of one text would else make all its words look telling. The row with the smallest doc_id counts, however the rows are dealt out."""

    def run(batches):
        for b in batches:
            keys = []
            for text in b.column("text").to_pylist():
                words = (text or "").lower().split()
                runs = zip(*(words[i:] for i in range(5))) if len(words) >= 5 else [words]
                keys.append(min(xxhash.xxh64_intdigest(" ".join(r)) for r in runs) >> 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("label"), pa.array(keys, pa.int64())], ["doc_id", "text", "label", "key"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    keyed = sample.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {kind}, text string, label double, key bigint")
    return keyed.groupBy("key", "label").agg(F.min(F.struct("doc_id", "text")).alias("row")).select("row.text", "label")


def choose(counts: dict[tuple[str, bool], tuple[int, int]], ones: int, zeros: int, chance: float = 0.05, lift: float = 50.0) -> dict[tuple[str, bool], float]:
    """The entries that labels single out, with log-odds weights.

    A term must be so much more frequent in texts of label 1 that chance alone gives such a term less than once in 1 / chance vocabularies (Chernoff bound),
    and at least lift times likelier there. A beginning gives way to a longer one that is as frequent; what begins with a chosen beginning is covered by it."""
    share, pool = ones / (ones + zeros), max(len(counts), 100_000)

    def stands_out(c: tuple[int, int]) -> bool:
        n, p = sum(c), c[0] / sum(c)
        if p <= share or (c[0] / ones) < lift * (c[1] / zeros):
            return False
        gap = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0)
        return n * gap > math.log(pool / chance)

    longer: dict[str, str] = {}
    for (t, start), c in counts.items():
        if start and len(t) > 1:
            head = longer.get(t[:-1])
            if head is None or c[0] > counts[(head, True)][0]:
                longer[t[:-1]] = t
    chosen: dict[tuple[str, bool], float] = {}
    covered: set[str] = set()
    for (t, start), c in sorted(counts.items(), key=lambda x: (len(x[0][0]), x[0])):
        if any(t[:k] in covered for k in range(1, len(t) + 1)) or not stands_out(c):
            continue
        if start:
            while (nxt := longer.get(t)) and counts[(nxt, True)][0] >= 0.95 * counts[(t, True)][0]:
                t = nxt
            whole = counts.get((t, False), (0, 0))
            if whole[0] >= 0.95 * counts[(t, True)][0]:
                start = False
            c = counts[(t, True)]
        weight = math.log(((c[0] + 0.5) / (ones + 1)) / ((c[1] + 0.5) / (zeros + 1)))
        chosen[(t, start)] = max(0.1, weight)
        if start:
            covered.add(t)
        else:
            covered.add(t) if (t, True) in counts else None
    return chosen


def _curve(features: np.ndarray, labels: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method on a bounded sample's two features."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hessian, x.T @ (labels - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", most_rows: int = 20_000, shortest: int = 4, longest: int = 12) -> Lexicon:
    """Learns the lexicon from at most most_rows labelled rows for which use holds. Without rows of both labels, the seed
    list with equal weights is returned. Null texts count as empty, labels of null or of null ids are ignored, repeated labels and documents count once."""
    small_batches(docs.sparkSession)
    sample = scratch(_decorrelated(labelled_sample(docs, labels, label, use, most_rows)), "toxic_sample")
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    seed = {(e, s): 4.0 for e, s in SEED}
    if not 0 < ones < n:
        return Lexicon(seed)
    ones, zeros = int(ones), int(n - ones)
    # No rarer term can stand out; so this is a bounded list, whatever the vocabulary.
    least = max(3, math.ceil(math.log(2e6) / -math.log(ones / n)), ones // 500)
    frequent = _count_terms(sample.filter("label = 1"), None, shortest, longest).filter(F.col("ones") >= least)
    terms = {(r.term, r.start): r.ones for r in frequent.collect()}
    counted = {k: (fold(k[0]), k[1]) for k in seed}
    against = _count_terms(sample.filter("label = 0"), set(terms) | set(counted.values()), shortest, longest)
    zero_counts = {(r.term, r.start): r.zeros for r in against.collect()}
    learned = choose({k: (v, zero_counts.get(k, 0)) for k, v in terms.items()}, ones, zeros)
    lexicon = Lexicon({k: v for k, v in seed.items() if zero_counts.get(counted[k], 0) <= 0.02 * zeros} | learned)

    def run(batches):
        for b in batches:
            f = [lexicon.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column("label")], ["a", "b", "label"])

    rows = np.array(sample.select("text", "label").mapInArrow(run, "a double, b double, label double").collect(), float)
    lexicon.curve = _curve(rows[:, :2], rows[:, 2])
    return lexicon


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs -> (doc_id, score): one row for each row, over whole texts; a null or empty text has no hits and the
    curve's lowest score. Extra columns are ignored; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([lexicon.score(t) for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, score double")

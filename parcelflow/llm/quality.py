"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled rows; every path from a root is a rule, a conjunction of bounds on
statistics. A logistic model with an L1 penalty keeps the few rules that matter (Friedman and Popescu, 2008), and these
compile into one Spark column expression that scores every row.

The forest is Spark's. The weights are fitted by Newton steps in the one task that holds the sample: Spark's own fit runs a job for each look at the loss (93 of them
on check_s), and each job's broadcasts take large chunks of the driver's heap.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parcelflow.llm.common import scratch, small_batches

STATS = ["log_chars", "log_words", "word_chars", "letters", "digits", "upper", "symbols", "bars", "marked_words", "shouted_words", "distinct_words", "repeated_words", "line_words", "distinct_lines", "top_word", "stops"]

_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-")
_MARKED = re.compile(rb"[^\w\s.,;:'\")\x80-\xff]{2,}$|^[^\w\x80-\xff]{2,}")


def statistics(text: str | None) -> list[float]:
    """The STATS of one whole text; zeros for an empty one or null. Shares are of characters, words or lines."""
    text = text or ""
    words = text.split()
    if not words:
        return [math.log1p(len(text)), *[0.0] * (len(STATS) - 1)]
    n, m, raw = len(text), len(words), text.encode()
    size = len(raw)
    spaces = sum(raw.count(c) for c in (b" ", b"\n", b"\t", b"\r"))
    digits = size - len(raw.translate(None, b"0123456789"))
    symbols = size - len(raw.translate(None, _SYMBOLS))
    points = size - len(raw.translate(None, b".,;:'\"()-"))
    lower = text.lower()
    shouted = sum(map(str.isupper, words))
    counts: dict[str, int] = {}
    for w in lower.split():
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n), math.log1p(m), (n - spaces) / m, (size - spaces - digits - symbols - points) / size, digits / size,
        (size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size, symbols / size, raw.count(b"|") / m,
        sum(1 for w in words if _MARKED.search(w.encode())) / m if symbols else 0.0, shouted / m, len(counts) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, math.log1p(m / len(lines)), len(set(lines)) / len(lines), max(counts.values()) / m, raw.count(b". ") / m,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, one double for each of STATS), one row for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            columns = list(zip(*map(statistics, b.column("text").to_pylist()))) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", *STATS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, above, at most), all of which must hold."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for statistic, low, high in self.bounds:
            name = prefix + statistic
            if low > -math.inf:
                out = out & (F.col(name) > low)
            if high < math.inf:
                out = out & (F.col(name) <= high)
        return out

    def holds(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        """The same over arrays of statistics."""
        return np.logical_and.reduce([(stats[s] > low) & (stats[s] <= high) for s, low, high in self.bounds])


@dataclass
class RuleModel:
    """score(): 1 / (1 + exp(-(intercept + weights of the rules that hold)))."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, prefix: str = "") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(prefix), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def tree_rules(forest) -> list[Rule]:
    """Every path of every tree, of any length, without repeats."""
    out: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            out[Rule(tuple((k, *v) for k, v in sorted(bounds.items())))] = None
        if node.getClass().getSimpleName() != "InternalNode":
            return
        name, at = STATS[node.split().featureIndex()], node.split().threshold()
        low, high = bounds.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), bounds | {name: (low, min(high, at))})
        walk(node.rightChild(), bounds | {name: (max(low, at), high)})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(out)


def lasso(held: np.ndarray, label: np.ndarray, penalty: float, steps: int = 60) -> tuple[float, np.ndarray]:
    """(intercept, weights) that minimise the mean logistic loss of label (0 or 1, both occur) plus penalty times the sum of the weights' sizes; held: rows by rules, 0 or 1.

    Proximal Newton: each step minimises the loss's quadratic model plus the penalty, coordinate by coordinate, and is halved until the whole falls."""
    n, k = held.shape
    x, price = np.column_stack([held, np.ones(n)]), np.append(np.full(k, penalty), 0.0)
    w = np.append(np.zeros(k), math.log(label.mean() / (1 - label.mean())))

    def whole(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - label * z).mean() + price @ np.abs(w))

    best = whole(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope, bend = x.T @ (p - label) / n, np.zeros((k + 1, k + 1))
        for i in range(0, n, 2048):  # bounded memory
            part = x[i : i + 2048]
            bend += (part.T * (p * (1 - p))[i : i + 2048]) @ part / n
        bend[np.diag_indices(k + 1)] += 1e-8
        move, pull = np.zeros(k + 1), slope.copy()
        for _ in range(200):
            most = 0.0
            for j in range(k + 1):
                at, a = w[j] + move[j], bend[j, j]
                to = at - pull[j] / a
                by = math.copysign(max(abs(to) - price[j] / a, 0.0), to) - at
                if by:
                    move[j] += by
                    pull += bend[j] * by
                    most = max(most, abs(by))
            if most < 1e-7:
                break
        t = 1.0
        while (now := whole(w + t * move)) > best and t > 1e-4:
            t /= 2
        if now >= best:
            break
        w, fell, best = w + t * move, best - now, now
        if fell < 1e-10:
            break
    return float(w[k]), w[:k]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, most_rows: int) -> DataFrame:
    """docs with a column label, of at most most_rows labelled rows for which use holds, chosen by a hash of doc_id. The
    chosen ids are few by that bound, and so are broadcast; of the texts only the sample is shuffled. A doc_id with several labels counts once, as 1 if any is 1; with
    several texts, the first in code point order counts."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & use).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", most_rows: int = 20_000, trees: int = 12, depth: int = 3, penalty: float = 0.0002) -> RuleModel:
    """Grows the trees and fits the weights. Without labelled rows of both kinds, the score is the share of label 1
    (one half without any). Null texts count as empty, labels of null or of null ids are ignored; see labelled_sample for repeats."""
    rows = scratch(with_stats_and_label(labelled_sample(docs, labels, label, use, most_rows)), "quality_sample")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        p = (ones + 0.5) / (n + 1)
        return RuleModel(math.log(p / (1 - p)))
    # The bounded sample in one sorted partition: the same rows give the same trees, however they came.
    rows = rows.repartition(1).sortWithinPartitions("label", *STATS).withColumn("features", array_to_vector(F.array(*STATS))).cache()
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="0.5").fit(rows)
    rules = tree_rules(forest)
    if not rules:
        p = (ones + 0.5) / (n + 1)
        return RuleModel(math.log(p / (1 - p)))

    def run(batches):
        found = pa.Table.from_batches(list(batches))
        stats = {name: found.column(name).to_numpy() for name in STATS}
        intercept, weights = lasso(np.column_stack([r.holds(stats) for r in rules]), found.column("label").to_numpy(), penalty)
        yield pa.RecordBatch.from_arrays([pa.array([intercept]), pa.array([weights])], ["intercept", "weights"])

    small_batches(rows.sparkSession)
    found = rows.select("label", *STATS).mapInArrow(run, "intercept double, weights array<double>").first()
    rows.unpersist()
    return RuleModel(found.intercept, [(r, w) for r, w in zip(rules, found.weights) if abs(w) > 1e-9])


def with_stats_and_label(sample: DataFrame) -> DataFrame:
    """Keeps the label through the statistics as part of the key."""
    keyed = sample.select(F.struct("doc_id", "label").alias("doc_id"), "text")
    stats = with_statistics(keyed)
    return stats.select("doc_id.label", *STATS)


def scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs -> (doc_id, score): one row for each row, over whole texts. A null or empty text is scored by its zero statistics.
    Extra columns are ignored; an empty table gives no rows."""
    return with_statistics(docs).select("doc_id", model.score().alias("score"))


def keep(docs: DataFrame, model: RuleModel, threshold: float) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns, whatever their names: the rules are evaluated beside the
    row, so nothing is shuffled. A null or empty text is scored by its zero statistics, repeated rows are judged alike; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"))

    def run(batches):
        for b in batches:
            columns = list(zip(*map(statistics, b.column("row").field("text").to_pylist()))) or [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(c, pa.float64()) for c in columns)], ["row", *STATS])

    beside = rows.mapInArrow(run, StructType([*rows.schema, *(StructField(s, DoubleType()) for s in STATS)]))
    return beside.filter(model.score() >= threshold).select("row.*")

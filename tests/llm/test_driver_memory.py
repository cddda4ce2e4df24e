"""What must stay small in the driver: jobs of a fit (each broadcasts), and what joins send through it."""

import re

import numpy as np
from pyspark.sql import functions as F

from parcelflow.llm import common, mixing, quality


def test_fit_needs_few_jobs(spark, sf_dir):
    """Spark's own fit of the weights ran a job for each look at the loss."""
    context = spark.sparkContext
    context.setJobGroup("quality fit", "")
    model = quality.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), F.lit(True))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert model.rules and 0 < len(context.statusTracker().getJobIdsForGroup("quality fit")) <= 40


def test_lasso_is_at_the_minimum():
    rng = np.random.default_rng(3)
    held = rng.random((500, 12)) < 0.4
    held[:, 11] = ~held[:, 0]  # a rule and its opposite
    label = (held[:, 1] & held[:, 2] | (rng.random(500) < 0.1)).astype(float)
    penalty = 0.01
    intercept, weights = quality.lasso(held, label, penalty)
    apart = 1 / (1 + np.exp(-(intercept + held @ weights))) - label
    slope = held.T @ apart / len(label)
    assert abs(apart.mean()) < 1e-5
    assert np.all(np.abs(slope) <= penalty + 1e-5) and np.allclose(slope[weights != 0], -penalty * np.sign(weights[weights != 0]), atol=1e-5)
    assert 0 < np.count_nonzero(weights) < 12


def test_rules_hold_alike(spark):
    rows = [(float(a), float(b)) for a in range(4) for b in range(4)]
    rule = quality.Rule((("letters", 0.0, 2.0), ("upper", -np.inf, 1.0)))
    got = [r[0] for r in spark.createDataFrame(rows, "letters double, upper double").select(rule.column()).collect()]
    a, b = np.array(rows).T
    assert rule.holds({"letters": a, "upper": b}).tolist() == got == [0 < x <= 2 and y <= 1 for x, y in rows]


def test_blocks_are_not_broadcast(spark, sf_dir):
    """The times of the blocks are a row a block: they meet the documents in a merge join."""
    documents, _ = mixing.mix(common.table(spark, sf_dir, "documents"))
    documents.collect()
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin(\(\w+=\w+\))? \[[^\]]*block#", plan)

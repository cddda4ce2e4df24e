"""Each stage of the corpus pipeline against a brute-force version on its own input, and the whole run."""

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parcelflow.llm import common, quality
from parcelflow.llm.queries import THRESHOLD
from tests.llm.test_text_operators import brute_targets, jaccard, shingle_set

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The given documents, with the odd cases added."""
    rows = [(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (10**6 + 2, " ", "en", "src1", 1), (10**6 + 3, "lone", None, "src1", 4), (10**6 + 3, "lone", None, "src1", 4), (10**6 + 4, "x" * 2000, "de", "zz", 2000)]
    extra = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).unionByName(extra)


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"]


def test_good(spark, docs, sf_dir):
    got = STAGE["quality"](spark, docs, sf_dir)
    assert got.columns == corpus_pipeline.COLUMNS
    model = quality.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), common.fold_of(F.col("doc_id"), 5) != 0)
    want = sorted(r.doc_id for r in quality.scores(docs, model).collect() if r.score >= THRESHOLD)
    assert sorted(r.doc_id for r in got.collect()) == want and 0 < len(want) < docs.count()


def test_exact(spark, docs, sf_dir):
    got = STAGE["exact"](spark, docs, sf_dir)
    best = {}
    for r in docs.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        rank = (-len(r.text or ""), r.doc_id)
        best[key] = min(best.get(key, (rank, r)), (rank, r), key=lambda x: x[0])
    assert sorted(map(str, got.collect())) == sorted(str(r) for _, r in best.values())


def test_exact_of_distinct_ids(spark, docs, sf_dir):
    once = docs.dropDuplicates(["doc_id"])
    assert STAGE["exact"](spark, once, sf_dir).count() == STAGE["exact"](spark, docs, sf_dir).count()


def test_near(spark, docs, sf_dir):
    """Exact likeness of all pairs decides what must stay and what must go."""
    rows = docs.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    sets = [shingle_set(r.text) for r in rows]
    kept = {r.doc_id for r in STAGE["near"](spark, docs, sf_dir).collect()}
    must_go = 0
    for i, r in enumerate(rows):
        near = max((jaccard(sets[i], s) for s in sets[:i]), default=0.0)
        if near < 0.8:
            assert r.doc_id in kept
        else:
            assert r.doc_id not in kept
            must_go += 1
    assert must_go > 0
    texts = {r.doc_id: r for r in rows}
    assert all(r == texts[r.doc_id] for r in STAGE["near"](spark, docs, sf_dir).collect())


def test_mix(spark, docs, sf_dir):
    got, sizes, mixed = STAGE["mix"](spark, docs, sf_dir), {}, {}
    assert got.columns == corpus_pipeline.COLUMNS
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in got.collect():
        mixed[r.source] = mixed.get(r.source, 0) + len((r.text or "").split())
    want = brute_targets(sizes)
    assert abs(sum(mixed.values()) - sum(want.values())) < 0.15 * sum(want.values())
    heavy = max(want, key=want.get)
    assert abs(mixed[heavy] - want[heavy]) < 0.5 * want[heavy]


def test_encode(spark, docs, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in STAGE["encode"](spark, docs, sf_dir).collect())
    assert got == [(i, library.encode(t, add_special_tokens=False).ids) for i, t in texts]


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(got.columns)


def test_empty(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name

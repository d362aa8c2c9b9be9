"""Each stage of the pipeline on its own input, and the whole of it."""

import collections
import re

import corpus_pipeline
import pytest

from huegrid.llm import decontamination, packing, toxicity
from huegrid.llm.common import written

from .test_operators import brute_components


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        out.append((name, docs))
    return out


def test_columns(steps):
    for _, df in steps[1:-1]:
        assert df.columns == steps[0][1].columns
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(steps[-1][1].columns)


def test_toxic_documents_go(spark, sf, steps):
    docs = steps[0][1]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in toxicity.with_score(docs, model, keep=["doc_id"]).where("score < 0.5").collect()}
    assert {r.doc_id for r in steps[1][1].collect()} == want and len(want) > 0.7 * docs.count()


def test_one_of_each_group_stays(steps):
    texts = {r.doc_id: r.text for r in steps[1][1].collect()}
    want = {i for i, (_, c) in brute_components(texts).items() if i == c}
    assert {r.doc_id for r in steps[2][1].collect()} == want


def test_contaminated_documents_go(spark, sf, steps):
    plain = lambda t: b" ".join(decontamination.plain_words(t))
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r.text for r in steps[k][1].collect()} for k in (2, 3))
    gone = {i for i, t in before.items() if any(x in plain(t) for x in items if len(x.split()) >= 8)}
    assert gone <= set(before) - set(after) and len(set(before) - set(after)) <= len(gone) + 0.02 * len(before)


def test_secrets_are_masked_and_all_documents_stay(steps):
    before, after = ({r.doc_id: r for r in steps[k][1].collect()} for k in (3, 4))
    assert set(before) == set(after)
    for i, r in after.items():
        assert not re.search(r'token = "[0-9a-f]{40}"', r.text) and r.n_chars == len(r.text)
        if "[SECRET]" not in r.text:
            assert r.text == before[i].text


def test_packing_covers_what_is_left(steps):
    encoder, total = packing.encoder_of(None), collections.Counter()
    for r in steps[5][1].collect():
        total[r.doc_id] += r.length
    assert total == {r.doc_id: len(encoder.encode(r.text)) // 4 + 1 for r in steps[4][1].collect()}


def test_odd_documents_pass(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "no id", "en", "s", 5), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = written(stage(spark, docs, sf), "odd")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == [(False, 1), (False, 2), (False, 3), (True, 0)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).where("start = 0").count() == 4
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
    assert none.count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0

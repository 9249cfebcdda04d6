from __future__ import annotations

import numpy as np
import pytest

from noisefleet.llm import quality_trees as q


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    return q.fit(x, y), x, y


def walk(m: q.Trees, x: np.ndarray) -> float:
    total = m.base
    for node in m.roots:
        while m.left[node] != node:
            node = m.left[node] if x[m.feature[node]] <= m.threshold[node] else m.right[node]
        total += m.value[node]
    return total


def test_flat_traversal_equals_walking_each_tree(model):
    m, x, _ = model
    assert np.allclose(m.margin(x[:200], at_once=64), [walk(m, r) for r in x[:200]])


def test_trees_learn_an_interaction(model):
    m, x, y = model
    assert ((m.score(x) >= 0.5) == (y > 0)).mean() > 0.97


def test_fit_is_repeatable_and_needs_two_labels(model):
    m, x, y = model
    assert np.array_equal(q.fit(x, y).value, m.value)
    assert np.allclose(q.fit(x[:0], y[:0]).score(x[:3]), 0.5)
    assert q.fit(x, np.ones(len(x))).score(x[:3]).min() > 0.9


def test_statistics_of_empty_and_odd_texts():
    assert q.statistics_of(None) == q.statistics_of("") == q.statistics_of(" \n ") == [0.0] * len(q.STATISTICS)
    assert len(q.statistics_of("a")) == len(q.STATISTICS) and np.isfinite(q.statistics_of("é | \x00")).all()


def test_awkward_rows(spark, awkward, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (6, None), (None, 1), (10, 0)], "doc_id bigint, quality int")
    got = q.classify(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    none = labels.where("false")
    assert {r.score for r in q.classify(awkward, none).collect()} == {0.5}
    assert q.classify(docs().where("false"), labels).count() == 0
    assert q.keep_good(awkward, labels).columns == awkward.columns


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = q.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_sample_is_bounded_and_leaves_held_out_rows_alone(spark):
    labels = spark.range(20000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    some = q.labelled_sample(labels, bound=2000)
    assert 1500 < some.count() < 2500 and some.where(q.held_out(some["doc_id"])).count() == 0


def test_a_repeated_doc_id_trains_once(spark, monkeypatch):
    texts = ["a b c\n" * 4, "x, y z. " * 5, "one two three four. " * 9, ""]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    often = labels.where(~q.held_out(labels["doc_id"])).first().doc_id
    docs = spark.createDataFrame([(often, t) for t in texts * 300] + [(i, texts[i % 4]) for i in range(12)], "doc_id bigint, text string")
    learnt = q.labelled_sample(labels).count()
    seen = []
    monkeypatch.setattr(q, "fit", lambda x, y: seen.append((x, y)))
    q.train(docs, labels)
    (x, y), = seen
    assert 0 < len(x) == len(y) == learnt

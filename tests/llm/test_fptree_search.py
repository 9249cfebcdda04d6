from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from noisefleet.llm import fptree_search

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id bigint, text string, score int, rank string"


def brute(docs, items, k=20):
    def terms(t):
        return RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                found.append((-s, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=20):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, n int, terms string").repartition(3)
    qs = spark.createDataFrame([(*i, 1, "x") for i in items], ITEM)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in fptree_search.search(df, qs, k).collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 3 else f"ü{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, odds, k=rng.randrange(0, 60)))) for i in range(n)]


def test_like_brute_force(spark):
    docs = corpus(1500, 1)
    # groups of copies, so that scores tie over many documents
    docs += [(5000 + i, docs[7][1]) for i in range(60)] + [(9000 - i, docs[20][1]) for i in range(40)]
    items = [(i, t) for i, t in corpus(30, 2)] + [(100, docs[7][1]), (101, "w0 W0 w0; ü3-w4"), (102, "nothing known")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        assert found(spark, docs, items) == brute(docs, items)
        assert found(spark, docs, items, 3) == brute(docs, items, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(fptree_search, "ITEMS", 4)
    docs, items = corpus(80, 3), corpus(11, 4)
    assert found(spark, docs, items) == brute(docs, items)


def test_awkward_rows(spark):
    docs = [(1, "same words here"), (1, "same words here"), (None, "same words"), (2, None), (3, ""), (4, " -- "), (5, "word " * 30_000),
            (6, "É é İ \x00 a\U0001f600b"), (7, "here")]
    items = [(1, "same words"), (1, "same words"), (None, "here"), (2, None), (3, ""), (4, "WORD word é"), (5, "a\U0001f600b")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, []) == []
    assert found(spark, [], items) == []
    assert found(spark, [(2, None)], items) == []


@pytest.mark.parametrize("n", [1, 33, 700])
def test_every_bound_holds(n):
    rng = np.random.default_rng(n)
    runs = [np.unique(rng.zipf(1.5, rng.integers(1, 30)) % 80) for _ in range(n)]
    ends = np.cumsum([len(r) for r in runs])
    terms, tfs, m = np.concatenate(runs), rng.integers(1, 9, ends[-1]), rng.integers(75, 400, n)
    tree = fptree_search.Tree(np.arange(n), ends, terms, tfs, m)
    weight = rng.integers(0, 2000, 81)
    exact = fptree_search.scores(weight, tree.terms, tree.tfs, tree.owner, tree.m, 0, n)
    every = np.arange(len(tree.lo))
    bounds = fptree_search.scores(weight, tree.node_terms, tree.node_tfs, tree.node_owner, tree.least, 0, len(every))
    for i in every:
        assert bounds[i] >= exact[tree.lo[i]:tree.hi[i]].max()
        assert tree.hi[i] - tree.lo[i] <= fptree_search.BUCKET or tree.after[i] > tree.first[i]
    leaves = [(tree.lo[i], tree.hi[i]) for i in every if tree.first[i] == tree.after[i]]
    assert sorted(x for lo, hi in leaves for x in range(lo, hi)) == list(range(n))
    assert sorted(tree.docs.tolist()) == list(range(n))

"""Ranked lexical search over document FP-trees, by branch and bound.

Documents are reduced to the terms that some item asks for, each with its frequency. Each task files its
documents, batch by batch, in a tree: terms in order of document frequency, most frequent first, so that
documents share paths. A node holds, of the documents under it, the highest frequency of every term and the
smallest length measure m. As a score grows with frequency and falls with m, the score made of these is a bound
for all of them. Each item walks the tree depth first, best bound first, and leaves out subtrees whose bound is
under its k-th best score so far, which goes on from tree to tree. Small subtrees are buckets, scored exactly.

Text is read once per ``ITEMS`` items: the vectors are written and read for the counts (documents, terms,
document frequencies), then for the trees. Items come to the driver in such blocks, never all at once. A task
hands on at most k documents per item; the k best of these are the result.

Scores are whole numbers: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), m is 75 + (25 n N) div L, and
an item's terms add w ((10^9 tf) div (1000 tf + 12 m)), repeats included.

Defined cases: null and empty texts have no terms, count no document and are never found; every row is a document
and every item row an item, repeated ones too (equal scores by doc_id, null last); an item without a known term has
no row; no documents or no items give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noisefleet.llm.common import stored

# Items a block, documents a bucket, terms by which documents are filed.
ITEMS, BUCKET, FILED = 1000, 32, 24
NO_ID = (1 << 63) - 1
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII; only A-Z become small. In UTF-8, what is beyond ASCII is bytes beyond 127."""
    return TERM.findall((text or "").encode().lower())


def value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def highest(terms: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms, ascending, and the highest frequency of each."""
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    return terms[starts], np.maximum.reduceat(tfs[order], starts)


class Tree:
    """FP-tree of documents given by ``ends`` of their runs in ``terms`` (ranks by document frequency, ascending) and ``tfs``.

    Nodes are numbered by level, so that the children of a node lie together; node i holds the documents of
    ``lo[i]:hi[i]`` and has the children ``first[i]:after[i]``, a bucket none.
    """

    def __init__(self, docs: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> None:
        starts = np.r_[0, ends[:-1]]
        paths = np.full((len(docs), FILED), -1, np.int64)
        for at in range(FILED):
            has = ends - starts > at
            paths[has, at] = terms[starts[has] + at]
        order = np.lexsort(paths.T[::-1])
        paths, sizes = paths[order], (ends - starts)[order]
        self.docs, self.m = docs[order], m[order]
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        at = np.repeat(starts[order] - self.start, sizes) + np.arange(len(terms))
        self.terms, self.tfs = terms[at], tfs[at]
        self.owner = np.repeat(np.arange(len(docs)), sizes)
        differs = paths[1:] != paths[:-1]
        shared = np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), FILED)]
        self.grow(shared)
        self.summarise()

    def grow(self, shared: np.ndarray) -> None:
        """Nodes from the number of terms that each document's path shares with the one before."""
        self.lo, self.hi, self.first, self.after = [0], [len(self.docs)], [0], [0]
        node = 0
        while node < len(self.lo):
            lo, hi = self.lo[node], self.hi[node]
            self.first[node] = self.after[node] = len(self.lo)
            if hi - lo > BUCKET:
                inner = shared[lo + 1:hi]
                least = inner.min()
                # equal paths are cut anywhere
                cuts = np.arange(lo + BUCKET, hi, BUCKET) if least == FILED else lo + 1 + np.flatnonzero(inner == least)
                at = lo
                for a, b in zip([lo, *cuts], [*cuts, hi]):
                    # small neighbours share a bucket
                    if b - at > BUCKET and a > at:
                        self.add(at, a)
                        at = a
                self.add(at, hi)
                self.after[node] = len(self.lo)
            node += 1

    def add(self, lo: int, hi: int) -> None:
        self.lo.append(int(lo))
        self.hi.append(int(hi))
        self.first.append(0)
        self.after.append(0)

    def summarise(self) -> None:
        """Highest frequencies and smallest m under every node, from the lowest upwards."""
        n = len(self.lo)
        found: list = [None] * n
        self.least = np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            a, b = self.first[i], self.after[i]
            if a == b:
                part = slice(self.start[self.lo[i]], self.end[self.hi[i] - 1])
                found[i], self.least[i] = highest(self.terms[part], self.tfs[part]), self.m[self.lo[i]:self.hi[i]].min()
            else:
                found[i] = highest(np.concatenate([f[0] for f in found[a:b]]), np.concatenate([f[1] for f in found[a:b]]))
                self.least[i] = self.least[a:b].min()
        sizes = np.array([len(f[0]) for f in found])
        self.node_end = np.cumsum(sizes)
        self.node_terms, self.node_tfs = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        self.node_owner = np.repeat(np.arange(n), sizes)

    def search(self, weight: np.ndarray, best: Best) -> None:
        """Hand all documents to ``best`` that may belong to it; ``weight`` is the item's, 0 for other terms."""
        stack = [(0, None)]
        while stack:
            node, bound = stack.pop()
            if bound is not None and bound < best.least:
                continue
            a, b = self.first[node], self.after[node]
            if a == b:
                lo, hi = self.lo[node], self.hi[node]
                part = slice(self.start[lo], self.end[hi - 1])
                best.add(self.docs[lo:hi], scores(weight, self.terms[part], self.tfs[part], self.owner[part], self.m, lo, hi))
                continue
            part = slice(self.node_end[a - 1] if a else 0, self.node_end[b - 1])
            bounds = scores(weight, self.node_terms[part], self.node_tfs[part], self.node_owner[part], self.least, a, b)
            order = np.argsort(bounds, kind="stable")
            stack += [(a + i, bounds[i]) for i in order[np.searchsorted(bounds[order], max(best.least, 1)):].tolist()]


def scores(weight: np.ndarray, terms: np.ndarray, tfs: np.ndarray, owner: np.ndarray, m: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Sums for the owners ``lo:hi`` of the terms."""
    w = weight[terms]
    hit = np.flatnonzero(w)
    out = np.zeros(hi - lo, np.int64)
    np.add.at(out, owner[hit] - lo, w[hit] * value(tfs[hit], m[owner[hit]]))
    return out


class Best:
    """The ``k`` best documents of an item; ``least`` is what one must score to enter."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.docs = self.scores = np.empty(0, np.int64)

    def add(self, docs: np.ndarray, found: np.ndarray) -> None:
        keep = found >= self.least
        if keep.any():
            docs, found = np.r_[self.docs, docs[keep]], np.r_[self.scores, found[keep]]
            order = np.lexsort((docs, -found))[:self.k]
            self.docs, self.scores = docs[order], found[order]
            if len(order) == self.k:
                self.least = max(1, int(self.scores[-1]))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): number of terms of each document, and the frequencies of those of the vocabulary (numbered from 1)."""
    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch["text"]:
                found = terms_of(text)
                ids, times = np.unique(np.fromiter(filter(None, map(vocabulary.get, found)), np.int32), return_counts=True)
                n.append(len(found))
                terms.append(ids)
                tfs.append(times.astype(np.int32))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "terms": terms, "tfs": tfs})
    known = docs.select(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("doc_id"), docs["text"].alias("text"))
    return known.mapInPandas(reduced, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def search_block(docs: DataFrame, items: Sequence[Row], k: int) -> DataFrame:
    """(item, doc_id, score) of the best ``k`` documents a task for each of ``items`` (item_id, text), by their number."""
    asked = [terms_of(r["text"]) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for a in asked for t in a}), 1)}
    held = stored(vectors(docs, vocabulary), "fptree-vectors")
    total, length = held.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the vocabulary's size at most
        df[r["term"]] = r["count"]
    rank = np.zeros(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weights = [math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()]
    # per item: ranks of its terms, and their weights times their number
    wanted = []
    for a in asked:
        ids, times = np.unique([vocabulary[t] for t in a] or [0], return_counts=True)
        wanted.append((rank[ids], np.array([weights[i] for i in ids.tolist()], np.int64) * times * (ids > 0)))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k) for _ in wanted]
        weight = np.zeros(len(rank), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["terms"].map(len).to_numpy()
            terms = rank[np.concatenate(batch["terms"].to_list())]
            tfs = np.concatenate(batch["tfs"].to_list()).astype(np.int64)
            order = np.lexsort((terms, np.repeat(np.arange(len(batch)), sizes)))
            m = 75 + (25 * batch["n"].to_numpy(np.int64) * total) // length
            tree = Tree(batch["doc_id"].to_numpy(np.int64), np.cumsum(sizes), terms[order], tfs[order], m)
            for (ranks, values), b in zip(wanted, best):
                weight[ranks] = values
                tree.search(weight, b)
                weight[ranks] = 0
        yield pd.DataFrame({"item": np.repeat(np.arange(len(best)), [len(b.docs) for b in best]),
                            "doc_id": np.concatenate([b.docs for b in best]), "score": np.concatenate([b.scores for b in best])})
    return held.where("size(terms) > 0").mapInPandas(found, "item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text)."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()),
                           T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    rows = items.select("item_id", "text").toLocalIterator()
    while block := list(islice(rows, ITEMS)):
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        found = search_block(docs, block, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)],
                                      T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        out = out.unionByName(stored(found.join(names, "item").select(
            "item_id", "rank", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "score"), "fptree-found"))
    return out

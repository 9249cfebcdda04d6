"""Nearest neighbours by cosine from randomly rotated one-bit codes.

Each vector, scaled to length 1, is turned by one seeded random rotation; the index keeps the signs of its
coordinates as packed bits and one correction scalar, the inner product of the vector with its code. A query's
inner product with a code, divided by that scalar, estimates its cosine with the vector, and the error stays
within ``spread`` * sqrt((1 - c^2) / c^2) / sqrt(dim - 1) with a probability that ``spread`` sets (1.9: about 97 in
100). A query first scores its best estimates exactly; every vector whose estimate plus bound reaches the
worst of those is then scored exactly too, in double precision on the original vectors.

Equal vectors are alike to every query, so of each distinct vector only the k + 1 smallest ids take part (one
may be the query itself): no neighbour is lost, and large groups of copies cost nothing. Queries and
vectors meet in blocks of bounded size, each a task's work; the answers of a query's blocks are merged.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components, and rows without an
id take no part, neither as query nor as candidate; vectors are compared only with vectors of their own
length; repeated rows of one id never answer that id; ties go to the smaller id; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 1.9
SEED = 42
VECTORS_PER_BLOCK = 16384
QUERIES_PER_BLOCK = 2048
QUERIES_AT_ONCE = 64

INDEX = "vec_id bigint, dim int, embedding array<float>, code binary, scale double"
ANSWERS = "query_id bigint, vec_id bigint, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for every call."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part."""
    v = vectors.select(vectors[id_column].cast("bigint").alias("vec_id"), vectors[vector_column].cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)).withColumn(
        "dim", F.size("embedding"))


def index(vectors: DataFrame, seed: int = SEED) -> DataFrame:
    """The codes of (vec_id, dim, embedding): packed signs and the correction scalar of every row."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                turned = (x / _length(x)[:, None]) @ rotation(int(dim), seed)
                bits = np.packbits(turned > 0, axis=1)
                scale = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                yield part.assign(code=[b.tobytes() for b in bits], scale=scale)
    return vectors.select("vec_id", "dim", "embedding").mapInPandas(rows, INDEX)


def _length(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths; scaled first, so that very small and very large components neither vanish nor overflow."""
    most = np.abs(x).max(axis=1)
    y = x / most[:, None]
    return most * np.sqrt((y * y).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def answer_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, spread: float, seed: int) -> pd.DataFrame:
    """The k nearest of one block of vectors for one block of queries."""
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    dim = int(queries["dim"].iat[0])
    ids, x = vectors["vec_id"].to_numpy(np.int64), np.stack(vectors["embedding"].to_numpy()).astype(np.float64)
    packed = np.frombuffer(b"".join(vectors["code"]), np.uint8).reshape(len(ids), -1)
    signs = (np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1) / math.sqrt(dim)
    scale = vectors["scale"].to_numpy(np.float64)
    error = spread * np.sqrt(np.maximum(0, 1 - scale**2)) / scale / math.sqrt(max(1, dim - 1))
    names, q = queries["vec_id"].to_numpy(np.int64), np.stack(queries["embedding"].to_numpy()).astype(np.float64)
    turned = ((q / _length(q)[:, None]) @ rotation(dim, seed)).astype(np.float32)
    found = []
    for start in range(0, len(names), QUERIES_AT_ONCE):
        some = slice(start, start + QUERIES_AT_ONCE)
        own = names[some][:, None] == ids
        guess = np.where(own, -np.inf, (turned[some] @ signs.T) / scale)
        best = np.argpartition(guess, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k):]
        row = np.repeat(np.arange(len(best)), best.shape[1])
        exact = cosines(q[some][row], x[best.ravel()]).reshape(best.shape)
        worst = np.where(np.take_along_axis(own, best, axis=1), np.inf, exact).min(axis=1)
        # the vectors that set the bar stay, whatever their own bound; estimates are rounded to single precision, which the margin covers
        chosen = guess + error + 1e-5 >= worst[:, None]
        np.put_along_axis(chosen, best, True, axis=1)
        row, column = np.nonzero(~own & chosen)
        scores = cosines(q[some][row], x[column])
        order = np.lexsort((ids[column], -scores, row))
        row, column, scores = row[order], column[order], scores[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < k
        found.append(pd.DataFrame({"query_id": names[some][row[top]], "vec_id": ids[column[top]], "score": scores[top]}))
    return pd.concat(found)


def search(vectors: DataFrame, is_query, k: int = 5, spread: float = SPREAD, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all vectors for each that ``is_query`` (a condition on vec_id) names."""
    usable_vectors = usable(vectors)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = usable_vectors.dropDuplicates(["vec_id", "embedding"]).withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1)
    queries = usable_vectors.where(is_query).dropDuplicates(["vec_id", "embedding"])
    n = usable_vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    vector_blocks, query_blocks = (max(1, math.ceil(c / size)) for c, size in ((n["n"], VECTORS_PER_BLOCK), (n["q"], QUERIES_PER_BLOCK)))
    spread_over = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.withColumn("qb", spread_over(query_blocks)).withColumn("vb", each(vector_blocks))
    right = index(distinct, seed).withColumn("vb", spread_over(vector_blocks)).withColumn("qb", each(query_blocks))
    answers = left.groupBy("qb", "vb", "dim").cogroup(right.groupBy("qb", "vb", "dim")).applyInPandas(
        lambda a, b: answer_block(a, b, k, spread, seed), ANSWERS)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # a query id with several vectors, or an id met with several: its best score counts
    best = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counts over the whole text, as shares, so that they mean the same at any length. Trees are
grown on quantile bins of a bounded sample of labelled rows (``SAMPLE``: about that many, chosen by a hash of
doc_id, so a rerun and any layout of the table choose the same), level by level, each split by the gain of the
logistic loss read off per-bin sums. The model is flattened into five arrays over all nodes of all trees; scoring
walks a batch of documents through all trees at once with numpy indexing.

Labels are the only use of labels; doc_id picks who is held out and sampled and is no input of a score.

Defined cases: null and empty texts have all statistics 0 and are scored like any text; repeated labels of a
doc_id count by their mean, at a tie as 1; null labels are ignored; without labels every score is 0.5; repeated
rows get equal scores; a null doc_id is not held out; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisefleet.llm.common import text_batches

SAMPLE = 20000
TREES, DEPTH, BINS = 60, 4, 64
RATE, RIDGE, LEAST_HESSIAN = 0.2, 1.0, 4.0

STATISTICS = (
    "word_length", "upper_share", "digit_share", "symbol_share", "bang_share", "bar_share", "stop_share", "comma_share", "other_share",
    "wide_share", "short_words", "long_words", "distinct_words", "same_next", "top_word", "distinct_threes", "distinct_lines",
    "closed_lines", "words_per_line", "capital_words", "lower_words", "plain_words",
)


def statistics_of(text: str | None) -> list[float]:
    """The statistics of a text, in the order of STATISTICS."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda chars: int(seen[list(chars)].sum())
    upper, lower, digits = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum())
    letters = upper + lower + int(seen[0xC0:].sum())
    dense = size - of(b" \t\n\r\x0b\x0c")
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        dense / n, upper / max(1, upper + lower), digits / dense, of(b"#*$%&<>@^_~=+{}[]\\/") / dense, of(b"!?") / dense, of(b"|") / dense, of(b".") / n,
        of(b",;:") / n, 1 - (letters + digits) / dense, int(seen[0xC0:].sum()) / dense, float((lengths <= 2).mean()), float((lengths > 14).mean()),
        len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
        len(set(lines)) / len(lines), sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines) / len(lines), n / len(lines),
        sum(map(bytes.istitle, words)) / n, sum(map(bytes.islower, words)) / n, sum(map(bytes.isalpha, words)) / n,
    ]


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees: a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray, at_once: int = 4096) -> np.ndarray:
        out = np.empty(len(x))
        for start in range(0, len(x), at_once):
            part = x[start:start + at_once]
            row = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[start:start + at_once] = self.base + self.value[node].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosted trees for labels 0 and 1. The order of rows decides nothing but rounding; sort them beforehand."""
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    parts: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(parts["feature"]))
            margin += _grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-12), depth, bins, parts)
    if not roots:
        roots, parts = [0], {"feature": [0], "threshold": [0.0], "left": [0], "right": [0], "value": [0.0]}
    a = {k: np.array(v, np.float64 if k in ("threshold", "value") else np.int32) for k, v in parts.items()}
    return Trees(**a, roots=np.array(roots, np.int32), depth=depth, base=base)


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, bins: int, parts: dict[str, list]) -> np.ndarray:
    """Append one tree to ``parts``; returns what it adds to each row's margin."""
    n, features = binned.shape
    added = np.zeros(n)

    def node(rows: np.ndarray, left_depth: int) -> int:
        me = len(parts["feature"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", me), ("right", me), ("value", 0.0)):
            parts[k].append(v)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if left_depth:
            at = (binned[rows] + np.arange(features) * bins).ravel()
            sum_g = np.bincount(at, np.repeat(g[rows], features), features * bins).reshape(features, bins).cumsum(axis=1)
            sum_h = np.bincount(at, np.repeat(h[rows], features), features * bins).reshape(features, bins).cumsum(axis=1)
            rest_g, rest_h = total_g - sum_g, total_h - sum_h
            gain = sum_g**2 / (sum_h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - total_g**2 / (total_h + RIDGE)
            gain = np.where((sum_h >= LEAST_HESSIAN) & (rest_h >= LEAST_HESSIAN), gain, 0)
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, b] > best[0] and b < len(edges[f]):
                best = (gain[f, b], int(f), int(b))
        if best[1] < 0:
            parts["value"][me] = -RATE * total_g / (total_h + RIDGE)
            added[rows] = parts["value"][me]
            return me
        _, f, b = best
        parts["feature"][me], parts["threshold"][me] = f, float(edges[f][b])
        goes = binned[rows, f] <= b
        parts["left"][me] = node(rows[goes], left_depth - 1)
        parts["right"][me] = node(rows[~goes], left_depth - 1)
        return me

    node(np.arange(n), depth)
    return added


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> DataFrame:
    """(doc_id, y) of about ``bound`` labelled documents that are not held out, or of all if they are fewer."""
    known = labels.where(labels["doc_id"].isNotNull() & labels[label].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    n = known.count()
    if n <= bound:
        return known
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (bound / n)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Trees:
    """Fit on the statistics of the sampled documents, the least of a repeated doc_id; only those numbers reach the driver."""
    sample = labelled_sample(labels, label, bound)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [statistics_of(t) for t in b["text"]]})

    # the sample is bounded, so it is sent to every task and no text is shuffled
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = picked.mapInPandas(rows, "doc_id bigint, y int, x array<double>")
    # of a doc_id on many rows one, so that the bound holds for rows too
    with text_batches(docs.sparkSession):
        table = found.groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas()
    if not len(table):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = np.stack(table["x"].to_numpy())
    order = np.lexsort((*x.T, table["doc_id"].to_numpy()))
    return fit(x[order], table["y"].to_numpy(np.float64)[order])


def scored(text: Column, model: Trees) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics_of(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))))
    return score(text)


def classify(docs: DataFrame, labels: DataFrame, columns: Sequence[str] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """``columns`` of ``docs`` with held_out, score and predicted (1 if score >= ``least``)."""
    model = train(docs, labels)
    found = docs.select(*[docs[f"`{c}`"] for c in columns], held_out(docs["doc_id"]).alias("held_out"), scored(docs["text"], model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that are not rejected, with the columns of ``docs``."""
    return docs.where(scored(docs["text"], train(docs, labels)) >= least)

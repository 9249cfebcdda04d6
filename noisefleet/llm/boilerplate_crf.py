"""Quality rules by line labels: a linear-chain conditional random field marks lines as content or boilerplate.

Every non-blank line of a text is described by a few yes/no features (length, case, symbols, repeats, closing
mark). Viterbi decoding finds the most probable labelling of the whole sequence; the share of words in
content lines decides whether the text is retained. Base rules stand before it.

The weights are trained here, by maximum likelihood with gradients from forward-backward sums, on lines of a
bounded, hashed sample of labelled documents (``SAMPLE``; the lines of a good document count as content, those of a
bad one as boilerplate). Sequences are handled in groups of equal length as matrices, so numpy does the work.

Defined cases: null and empty texts have no words, fail the base rules and are not kept; repeated rows get equal
rows; without labels every line is content; ties in decoding go to content; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 3000
LEAST_WORDS = 50
LEAST_CONTENT = 0.5
RIDGE, STEPS, RATE = 1e-3, 150, 0.5
CONTENT, BOILERPLATE = 0, 1
# What the base rules count.
SYMBOLS, BLANK = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
DIGITS, LETTERS = b"0123456789", bytes(c for c in range(256) if c > 127 or chr(c).isalpha())
CLOSING = (b".", b"!", b"?", b":", b";", b'"', b"'")

FEATURES = (
    "always", "one_word", "few_words", "many_words", "symbols_some", "symbols_many", "bars", "bangs", "mostly_upper", "digits_many",
    "closed", "same_next_word", "few_distinct_words", "repeated_line", "odd_words", "first_line", "last_line",
)
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def line_features(line: bytes, words: list[bytes], repeated: bool, first: bool, last: bool) -> list[bool]:
    n, chars = len(words), len(line.translate(None, BLANK))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    return [
        True, n == 1, n <= 4, n >= 12, symbols >= 1, symbols * 4 >= n, line.count(b"|") * 4 >= n, line.count(b"!!") * 4 >= n,
        2 * sum(map(bytes.isupper, words)) > n and chars > 1, (len(line) - len(line.translate(None, DIGITS))) * 5 > chars,
        words[-1][-1:] in CLOSING, 4 * sum(map(eq, words, words[1:])) > n, n >= 8 and 2 * len(set(words)) < n, repeated,
        len(line.translate(None, BLANK + LETTERS)) * 5 > chars, first, last,
    ]


def split_text(text: str | None) -> tuple[list[bytes], list[list[bytes]]]:
    """The lines with a word, and the words of each; of bytes, whose white space is the ASCII one."""
    lines = [(line, line.split()) for line in (text or "").encode().split(b"\n")]
    return [x for x, w in lines if w], [w for _, w in lines if w]


def base_counts(text: str, lines: list[bytes], words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, its lines with a word and its words."""
    return (len(words), len(text) - sum(map(text.count, BLANK.decode())), sum(map(text.count, SYMBOLS.decode())),
            len(lines) - len(set(lines)), repeated_words(words))


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    code = pd.factorize(np.array(words, object))[0].astype(np.int64)
    at = code[:n]
    for k in range(1, window):
        at = pd.factorize(at * (len(words) + 1) + code[k:n + k])[0]
    twice = np.bincount(at)[at] > 1
    inside = np.zeros(len(words), bool)
    for k in range(window):
        inside[k:n + k] |= twice
    return int(inside.sum())


@dataclass(frozen=True)
class Field:
    """``emit``: weight of each feature for boilerplate against content. ``move``: weight of label after label."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most probable labels of a sequence (lines x features)."""
        gain = (x @ self.emit).tolist()
        (stay, go), (leave, last) = self.move.tolist()
        content, boilerplate, back = 0.0, gain[0], [(0, 0)]
        for g in gain[1:]:
            a, b, c, d = content + stay, boilerplate + leave, content + go, boilerplate + last
            back.append((int(b > a), int(d > c)))
            content, boilerplate = max(a, b), max(c, d) + g
        label, out = int(boilerplate > content), []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return np.array(out[::-1], np.int8)


def fit(sequences: Sequence[tuple[np.ndarray, int]], steps: int = STEPS) -> Field:
    """Weights for sequences (features, label of all their lines), by gradient ascent with adaptive steps."""
    width = len(FEATURES)
    if len({y for _, y in sequences}) < 2:
        return Field(np.zeros(width), np.zeros((2, 2)))
    groups: dict[int, list[tuple[np.ndarray, int]]] = {}
    for x, y in sequences:
        groups.setdefault(len(x), []).append((x, y))
    batches = [(np.stack([x for x, _ in g]).astype(np.float64), np.array([y for _, y in g])) for _, g in sorted(groups.items())]
    total = sum(len(x) for x, _ in sequences)
    # each label's documents weigh the same in all, whatever their numbers
    mass = np.array([sum(len(x) for x, y in sequences if y == k) for k in (0, 1)], float)
    weigh = total / 2 / mass
    theta, seen = np.zeros(width + 4), np.full(width + 4, 1e-8)
    for _ in range(steps):
        gradient = -RIDGE * total * theta
        for x, y in batches:
            gradient += _gradient(x, y, theta, weigh[y])
        gradient /= total
        seen += gradient**2
        theta = theta + RATE * gradient / np.sqrt(seen)
    return Field(theta[:width], theta[width:].reshape(2, 2))


def _gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Observed less expected feature sums of sequences of one length, each with one label throughout."""
    n, length, width = x.shape
    emit, move = theta[:width], theta[width:].reshape(2, 2)
    score = np.stack([np.zeros((n, length)), x @ emit], axis=2)
    ahead, behind = np.empty_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    for t in range(1, length):
        ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1) + score[:, t]
    for t in range(length - 2, -1, -1):
        behind[:, t] = np.logaddexp.reduce(move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
    whole = np.logaddexp.reduce(ahead[:, -1], axis=1)
    share = np.exp(ahead[..., 1] + behind[..., 1] - whole[:, None])
    out = np.empty(width + 4)
    out[:width] = np.einsum("nt,ntf,n->f", y[:, None] - share, x, weight)
    pairs = np.zeros((2, 2))
    if length > 1:
        joint = np.exp(ahead[:, :-1, :, None] + move + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        pairs = -np.einsum("ntab,n->ab", joint, weight)
        for k in (0, 1):
            pairs[k, k] += (length - 1) * weight[y == k].sum()
    out[width:] = pairs.ravel()
    return out


def described(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    seen: set[bytes] = set()
    rows = []
    for i, line in enumerate(lines):
        rows.append(line_features(line, words[i], line in seen, i == 0, i == len(lines) - 1))
        seen.add(line)
    return np.array(rows, np.float64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE, longest: int = 400) -> Field:
    """Fit on about ``bound`` labelled documents, cut into sequences of ``longest`` lines; only features reach the driver."""
    known = labels.where(labels["doc_id"].isNotNull() & labels[label].isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (bound / n)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, y, text in zip(b["doc_id"], b["y"], b["text"]):
                x = described(*split_text(text)).astype(np.uint8)
                out += [(doc, y, x[k:k + longest].tobytes()) for k in range(0, len(x), longest)]
            yield pd.DataFrame(out, columns=["doc_id", "y", "x"])

    # the sample is bounded, so it is sent to every task and no text is shuffled
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInPandas(rows, "doc_id bigint, y int, x binary").toPandas()
    found = found.assign(x=found["x"].map(bytes)).sort_values(["doc_id", "x"])
    return fit([(np.frombuffer(x, np.uint8).reshape(-1, len(FEATURES)), CONTENT if y else BOILERPLATE) for x, y in zip(found["x"], found["y"])])


def judge(docs: DataFrame, model: Field, least_words: int = LEAST_WORDS, least_content: float = LEAST_CONTENT) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share (of words, null without any) and kept of (doc_id, text)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {BASE}, base_failed boolean, content_share double, kept boolean"
    names = [c.split()[0] for c in BASE.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, failed, shares = [], [], []
            for text in batch["text"]:
                lines, by_line = split_text(text)
                words = list(chain.from_iterable(by_line))
                counts.append(base_counts(text or "", lines, words))
                failed.append(len(words) < least_words or 100 * counts[-1][4] > 50 * len(words))
                if lines:
                    sizes = np.array([len(w) for w in by_line])
                    shares.append(float(sizes[model.decode(described(lines, by_line)) == CONTENT].sum() / sizes.sum()))
                else:
                    shares.append(None)
            out = pd.DataFrame(counts, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            kept = [not f and s >= least_content for f, s in zip(failed, shares)]
            yield out.assign(base_failed=failed, content_share=pd.Series(shares, dtype="float64"), kept=kept)

    return docs.select("doc_id", "text").mapInPandas(rows, schema)

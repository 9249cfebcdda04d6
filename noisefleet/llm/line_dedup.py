"""Line dedup: overlapping documents are found through shared rare lines and aligned with patience diff; blocks
they have in common are deleted from the later document (the larger doc_id).

Lines are compared by a 64-bit hash of the line without the white space around it; lines without a word are
passed over. A block is a run of lines, next to each other in both documents, that the alignment matches; it
is deleted if it holds ``least_words`` words or more, so short formulas stay where they are.

Who is aligned with whom:

- A line counts only if another document has it and it lies in a run of such lines with ``least_words`` words; no
  block can lie elsewhere.
- From each such line on, and back from each, the shortest run of neighbouring lines with ``least_words`` words is
  hashed. Every line of a block lies in a run inside the block, so documents with a common block share run hashes.
- Every later holder of a run is aligned with the run's first holder, however common the run is.
- Holders of a rare run (``rare`` or fewer holders) are aligned with the holder before them too, which finds blocks
  that the first holder has in another order.

That is four partners per line and document at most, and no group is ever paired with itself. A line is deleted
only where an earlier document has it, so its first holder keeps it. What stays is a block that patience passes
over in the first holder because other common lines cross it there, if over ``rare`` documents hold its runs.

Defined cases: a null text stays null, an empty one empty; a null doc_id comes last; rows with equal doc_id and
text are one document and get one result; rows with one doc_id and different texts are not compared with each
other; a text left without a word becomes empty; an empty table gives no rows; all columns of the input are
kept, whatever their names, with ``text`` (and ``n_chars``, if there) changed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.llm.common import WORD, stored, text_batches

LEAST_WORDS = 20
RARE = 64
AROUND = " \t\r\x0b\x0c"


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched positions of two sequences, rising in both: common ends first, then the longest rising chain of what
    is unique in both, then the same between the links of the chain. Where nothing is unique, occurrences are numbered."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        at = {x: k for k, x in enumerate(a[i:i_end], i) if in_a[x] == 1 and in_b[x] == 1}
        chain = rising([(at[x], k) for k, x in enumerate(b[j:j_end], j) if x in at])
        if not chain:  # nothing is unique in both: the n-th occurrence of each stands for itself
            at = {x: k for k, x in enumerate(nth(a[i:i_end]), i)}
            chain = rising([(at[x], k) for k, x in enumerate(nth(b[j:j_end]), j) if x in at])
        if chain:
            for (p, q), (r, s) in zip([(i - 1, j - 1), *chain], [*chain, (i_end, j_end)]):
                todo.append((p + 1, r, q + 1, s))
            found += chain
    return sorted(found)


def nth(x: Sequence[int]) -> list[tuple[int, int]]:
    """Each element with the number of equal ones before it."""
    seen: Counter = Counter()
    out = []
    for v in x:
        out.append((v, seen[v]))
        seen[v] += 1
    return out


def rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that rises in the first member, by sorting into piles; the second member rises already."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (x, _) in enumerate(pairs):
        p = bisect_left(tops, x)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(x)
            piles.append(k)
        else:
            tops[p], piles[p] = x, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_lines(first: Sequence[tuple], later: Sequence[tuple], least_words: int = LEAST_WORDS) -> list[int]:
    """Line numbers of ``later`` in aligned blocks. Lines are (place among lines with a word, number, hash, words)."""
    out, block, words, last = [], [], 0, None
    for i, j in [*patience([x[2] for x in first], [x[2] for x in later]), (-1, -1)]:
        here = (first[i][0], later[j][0]) if i >= 0 else None
        if last is None or here != (last[0] + 1, last[1] + 1):
            out += block if words >= least_words else []
            block, words = [], 0
        if here:
            block.append(later[j][1])
            words += later[j][3]
        last = here
    return out


def shortest_runs(place: np.ndarray, hashes: np.ndarray, words: np.ndarray, least_words: int = LEAST_WORDS) -> list[int]:
    """Hashes of the shortest runs of neighbouring lines with ``least_words`` words, from each line on and back from each."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.arange(len(place))
    stretch = np.asarray(place, np.int64) - at  # equal for lines next to each other
    end = np.maximum(np.searchsorted(total, total[:-1] + least_words), at + 1)
    begin = np.minimum(np.searchsorted(total, total[1:] - least_words, "right") - 1, at)
    found = [(i, j) for i, j in zip(at.tolist(), end.tolist()) if j <= len(at)] + [(i, j + 1) for i, j in zip(begin.tolist(), at.tolist()) if i >= 0]
    raw, stretch = np.asarray(hashes, np.int64).tobytes(), stretch.tolist()
    digests = {xxhash.xxh64_intdigest(raw[8 * i:8 * j]) for i, j in set(found) if stretch[i] == stretch[j - 1]}
    return np.array(sorted(digests), np.uint64).view(np.int64).tolist()


def shared_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text_hash, place, line, hash, words) of the lines that count."""
    numbered = F.transform(F.split("text", "\n"), lambda s, i: F.struct(i.alias("line"), F.btrim(s, F.lit(AROUND)).alias("s")))
    full = F.filter(numbered, lambda x: x["s"] != "")
    placed = F.transform(full, lambda x, i: F.struct(i.alias("place"), x["line"].alias("line"), F.xxhash64(x["s"]).alias("hash"),
                                                     F.regexp_count(x["s"], F.lit(WORD)).cast("int").alias("words")))
    lines = stored(docs.select(*_keys(docs), F.explode_outer(placed).alias("x")).select("id", "text_hash", "x.*").where("place is not null"), "lines")
    held = lines.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("hash")
    # nothing but the join is done where a common line meets, so Spark can split its rows; one plan at every size
    shared = lines.join(stored(held, "shared-hashes").hint("merge"), "hash")
    in_doc = Window.partitionBy("id", "text_hash").orderBy("place")
    once = F.coalesce(F.lag("place").over(in_doc) != F.col("place"), F.lit(True))  # repeated rows repeat their lines
    runs = shared.withColumns({"once": once, "run": F.col("place") - F.dense_rank().over(in_doc)}).where("once")
    whole = Window.partitionBy("id", "text_hash", "run")
    return runs.withColumn("in_run", F.sum("words").over(whole)).where(F.col("in_run") >= least_words).drop("once", "run", "in_run")


def _keys(docs: DataFrame) -> list:
    return [F.coalesce(docs["doc_id"].cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(docs["text"]).alias("text_hash")]


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, rare: int = RARE) -> DataFrame:
    """(id, text_hash, gone): line numbers to delete from each document that loses any."""
    lists = stored(shared_lines(docs, least_words).groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("place", "line", "hash", "words"))).alias("lines")), "line-lists")

    @F.pandas_udf("array<bigint>")
    def hashed(place: pd.Series, hashes: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([shortest_runs(p, h, w, least_words) for p, h, w in zip(place, hashes, words)])

    runs = stored(lists.select("id", "text_hash", F.explode(hashed("lines.place", "lines.hash", "lines.words")).alias("run")), "line-runs")
    held = runs.groupBy("run").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    shared = stored(runs.join(stored(held, "shared-runs").hint("merge"), "run"), "held-runs")
    earlier = Window.partitionBy("run").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)
    before = shared.where(F.col("n") <= rare).select("id", "text_hash", F.max("id").over(earlier).alias("other")).where("other is not null")
    links = shared.where("id > first").select("id", "text_hash", F.col("first").alias("other")).unionByName(before).distinct()
    pairs = links.join(lists.select(F.col("id").alias("other"), F.col("lines").alias("theirs")), "other").join(lists, ["id", "text_hash"])

    @F.pandas_udf("array<int>")
    def aligned(theirs: pd.Series, lines: pd.Series) -> pd.Series:
        tuples = lambda xs: [(x["place"], x["line"], x["hash"], x["words"]) for x in xs]
        return pd.Series([common_lines(tuples(a), tuples(b), least_words) for a, b in zip(theirs, lines)])

    # exploded at once: of a column of its own Spark asks first whether it is empty, which would align every pair twice, in two Python workers a task
    found = pairs.select("id", "text_hash", F.explode(aligned("theirs", "lines")).alias("line"))
    return found.groupBy("id", "text_hash").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, rare: int = RARE) -> DataFrame:
    """The columns of ``docs`` with shortened texts, beside ``lines_removed``."""
    with text_batches(docs.sparkSession):
        gone = stored(repeated_lines(docs, least_words, rare), "gone-lines")
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"), *_keys(docs))
    # one plan at every size: both sides are shuffled by document, whatever the size of the smaller
    joined = row.join(gone.hint("merge"), ["id", "text_hash"], "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    short = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.when(rest.rlike(WORD), rest).otherwise(""))
    out = joined.select("row", short.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("gone"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.when(F.col("gone") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
        changed["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns], F.col("gone").alias("lines_removed"))

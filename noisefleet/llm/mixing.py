"""Mixing of sources to target weights: a time-varying curriculum, by DataFrame functions only.

Each source has a target of words and a weight that changes over the training run (a piecewise linear
curve). The integral of the curve up to time t, scaled to the target, is what the source has to deliver
by t; a document that starts after ``offset`` words of its source's stream is therefore trained on at
the time where that integral reaches ``offset``. The stream of a source is its documents in the order of
a keyed hash, repeated until the target is met. The boundary document counts with the leading part that is
still needed, so a source meets its target to the word.

Offsets inside a source are prefix sums over ranges of the hash: sums per range come from one aggregate
with map-side partials, and only documents of one range meet in a task, so a hot source is spread evenly.

Defined cases: null or empty text counts 0 words and is never taken; null is a source of its own, ranked
last; repeated rows are documents of their own; an empty table gives an empty plan; columns of the input
keep any name, for they travel in the struct ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.llm.common import stored, word_count

Curve = Sequence[tuple[float, float]]

WEIGHTS = (3, 1, 2)
# Weight multipliers over the run: sources are front-loaded and back-loaded in turn.
CURVES: tuple[Curve, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))
ROWS_PER_RANGE = 512


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of (source, source_size): ``share`` of all words by weight, none above ``most`` times its size.

    Sources rank by code point, null last, and take the weights in turn. What a capped source leaves over
    is shared again by weight; the end of that process is a water level ``level`` with target =
    min(most * size, level * weight). Sources sorted by size per weight fill up in that order, so the level
    follows from prefix sums. Reads one row per source.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = ranked.select("*", weight.cast("bigint").alias("weight"), (F.col("source_size") * most).alias("cap"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the first source in filling order whose cap lies at or above the level ends the filling
    found = ranked.withColumn("own_level", level).withColumn(
        "level", F.min(F.when(F.col("own_level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "own_level")))
        .over(everything)["own_level"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return found.select("source", "source_size", "rank", target.alias("target"))


def curve_pieces(curve: Curve) -> list[tuple[float, float, float, float]]:
    """Pieces (start, weight at start, slope, integral before) of a curve scaled to an integral of 1 over the run."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    if area <= 0 or any(b[0] <= a[0] for a, b in zip(curve, curve[1:])) or any(w < 0 for _, w in curve):
        raise ValueError("a weight curve needs rising times, weights of 0 or more and a positive integral")
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(curve, curve[1:]):
        pieces.append((t0, w0 / area, (w1 - w0) / area / (t1 - t0), done))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return pieces


def training_time(share: Column, rank: Column, curves: Sequence[Curve] = CURVES) -> Column:
    """When a source has delivered ``share`` (0 to 1) of its words: the inverse of its integrated weight."""
    shapes = F.array(*[F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("t", "w", "slope", "done"), piece)])
                                 for piece in curve_pieces(c)]) for c in curves])
    piece = F.element_at(F.filter(F.element_at(shapes, rank % len(curves) + 1), lambda p: p["done"] <= share), -1)
    rest = share - piece["done"]
    speed = piece["w"] + F.sqrt(F.greatest(piece["w"] * piece["w"] + piece["slope"] * 2.0 * rest, F.lit(0.0)))
    return piece["t"] + F.when(speed > 0, rest * 2.0 / speed).otherwise(0.0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2,
        curves: Sequence[Curve] = CURVES, seed: int = 42, carried: Sequence[str] | None = None) -> DataFrame:
    """The plan of the mix, one row per document of ``docs`` (doc_id, text, source).

    Columns: ``row`` (struct of the ``carried`` columns, all by default), ``size``, ``source_size``,
    ``target``, ``rank`` (of the source), ``demand`` (target in whole words), ``start`` (words of the source's
    stream before the document), ``taken``.
    """
    rows = docs.count()
    digits = max(1, math.ceil(math.log(max(rows / ROWS_PER_RANGE, 1), 16)))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))))
    row = F.struct(*[docs[f"`{c}`"] for c in (carried or docs.columns)])
    base = docs.select(row.alias("row"), F.coalesce(docs["source"], F.lit("")).alias("name"), docs["source"].isNull().alias("unnamed"),
                       word_count(docs["text"]).alias("size"), order.alias("order"), docs["doc_id"].alias("id"),
                       F.substring(order, 1, digits).alias("range"))
    ranges = stored(base.groupBy("name", "unnamed", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    in_source = Window.partitionBy("name", "unnamed").orderBy("range")
    starts = ranges.withColumn("before", F.sum("words").over(in_source) - F.col("words")).drop("words")
    named = ranges.groupBy("name", "unnamed").agg(F.sum("words").alias("source_size"))
    targets = source_targets(named.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size"), weights, share, most)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"),
                             "source_size", "rank", "target", F.round("target").cast("bigint").alias("demand"))
    starts = starts.join(targets, ["name", "unnamed"])
    keys = ["name", "unnamed", "range"]
    in_range = Window.partitionBy(*keys).orderBy("order", "id", "size")
    placed = base.withColumn(
        "inside", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(starts, keys).withColumn("start", F.col("before") + F.col("inside"))
    taken = sum((_part(F.lit(k)) for k in range(1, most)), _part(F.lit(0)))
    return placed.select("row", "size", "source_size", "target", "rank", "demand", "start", taken.alias("taken"))


def _part(epoch: Column) -> Column:
    """Words that pass ``epoch`` (from 0) over the source takes from a document."""
    left = F.col("demand") - epoch * F.col("source_size") - F.col("start")
    return F.greatest(F.lit(0), F.least(F.col("size"), left))


def position(epoch: Column, curves: Sequence[Curve] = CURVES) -> Column:
    """Training time (0 to 1) at which pass ``epoch`` reaches a document of the plan."""
    offset = (epoch * F.col("source_size") + F.col("start")).cast("double")
    return training_time(F.when(F.col("demand") > 0, offset / F.col("demand")).otherwise(0.0), F.col("rank"), curves)


def curriculum(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2,
               curves: Sequence[Curve] = CURVES, seed: int = 42) -> DataFrame:
    """The mixed documents in training order: one row per pass over a document, the columns of ``docs``.

    Documents come whole. One of which only a part is needed comes if that is half of it or more: whichever is nearer to the
    target. An input column ``__at`` is kept like any other.
    """
    plan = mix(docs, weights, share, most, curves, seed)
    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.struct(position(k, curves).alias("at"), _part(k).alias("words"))),
                      lambda p: (p["words"] > 0) & (2 * p["words"] >= F.col("size")))
    copies = plan.select("row", F.explode(passes).alias("pass"))
    out = copies.repartitionByRange(F.col("pass.at"), F.xxhash64("row.doc_id")).sortWithinPartitions("pass.at", "row.doc_id")
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])

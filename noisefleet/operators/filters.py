"""Date bounds, exclusion windows and what they remove."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.operators.scans import SITE, islands, row_slice, scan


class FilterError(ValueError):
    """A filter that cannot be applied, or that leaves nothing."""


def parse_bound(raw: str, *, end: bool) -> dt.datetime:
    """A date or date-time bound; a date-only end means the last microsecond of that day."""
    text = str(raw).strip()
    try:
        bound = dt.datetime.fromisoformat(text)
    except ValueError as exc:
        raise FilterError(f"'{raw}' is not a valid date.") from exc
    if end and len(text) <= 10 and "T" not in text and ":" not in text:
        return bound + dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    return bound


def within(start: str | None = None, end: str | None = None) -> Column:
    """Inclusive bounds as a predicate that reaches the Parquet scan; unreadable times fail it."""
    keep = F.col("ts").isNotNull()
    if start:
        keep = keep & (F.col("ts") >= ck.ntz(parse_bound(start, end=False)))
    if end:
        keep = keep & (F.col("ts") <= ck.ntz(parse_bound(end, end=True)))
    return keep


def between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return df.where(within(start, end))


def mark_excluded(df: DataFrame, exclusions: DataFrame, keys: Sequence[str] = SITE, name: str = "excluded") -> DataFrame:
    """Flag readings inside an exclusion window, both ends included.

    Windows are listed by the dates they touch: one short array per site and date, matched by an
    equi-join instead of a range join.
    """
    dated = (exclusions.select(*keys, F.col("start").alias("a"), F.col("end").alias("b"))
             .withColumn("_d", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))))
             .groupBy(*keys, "_d").agg(F.collect_set(F.struct("a", "b")).alias("_w")))
    hit = F.exists("_w", lambda w: (F.col("ts") >= w["a"]) & (F.col("ts") <= w["b"]))
    return (df.withColumn("_d", F.to_date("ts")).join(dated, [*keys, "_d"], "left")
            .withColumn(name, F.coalesce(hit, F.lit(False))).drop("_d", "_w"))


def drop_excluded(df: DataFrame, exclusions: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    return mark_excluded(df, exclusions, keys, "_x").where(~F.col("_x")).drop("_x")


def mark_kept(df: DataFrame, start: str | None = None, end: str | None = None, exclusions: DataFrame | None = None,
              keys: Sequence[str] = SITE) -> DataFrame:
    """Add ``kept``: readable time, inside the bounds, outside every exclusion."""
    if exclusions is None:
        return df.withColumn("kept", within(start, end))
    return mark_excluded(df, exclusions, keys, "_x").withColumn("kept", within(start, end) & ~F.col("_x")).drop("_x")


def filter_report(marked: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Readings kept and dropped per site, and the span of the record."""
    n, kept = F.count(F.lit(1)), F.count_if("kept")
    return marked.groupBy(*keys).agg(
        n.alias("total_rows"), kept.alias("retained_rows"), (n - kept).alias("dropped_rows"),
        F.count_if(F.col("ts").isNull()).alias("unreadable_rows"), (100.0 * kept / n).alias("retained_pct"),
        F.min("ts").alias("record_start"), F.max("ts").alias("record_end"))


def refuse_empty(report: DataFrame) -> None:
    """Raise when a site keeps nothing, with the span its file covers. One small action."""
    empty = report.where(F.col("retained_rows") == 0).limit(1).collect()
    if empty:
        r = empty[0]
        span = f"; its record runs from {r['record_start']:%d %b %Y} to {r['record_end']:%d %b %Y}" if r["record_start"] else ""
        raise FilterError(f"the filters leave no reading of a site{span}")


def removed_windows(marked: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """First and last time of every run of removed readings, in recorded order."""
    gone = ~F.col("kept")
    s = scan(marked.select(*keys, "seq", "ts", "kept"), keys, row_slice("seq"), ["seq"], keep_slice=True,
             lags={"_prev": F.col("kept")})
    runs = islands(s, keys, None, ["seq"], gone & F.coalesce(F.col("_prev"), F.lit(True)), "_run").where(gone)
    g = runs.groupBy(*keys, "_run").agg(F.min_by("ts", "seq").alias("start"), F.max_by("ts", "seq").alias("end"),
                                        F.count(F.lit(1)).alias("n_removed"))
    return g.where(F.col("start").isNotNull() & F.col("end").isNotNull()).drop("_run")


def preview(df: DataFrame, n: int = 10, order: Sequence[str] = ("site_id", "seq")) -> DataFrame:
    """The first rows as a reader sees them: times as text, levels to one decimal."""
    def shown(c: str, t: str) -> Column:
        if t.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
        return (F.rint(F.col(c) * 10.0) / 10.0).alias(c) if t in ("double", "float") else F.col(c)
    return df.orderBy(*order).limit(n).select([shown(c, t) for c, t in df.dtypes if c != "fold"])

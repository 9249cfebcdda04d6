"""Repeated hours, ordering, zone conversion and what a record shows about its logger's clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.operators.scans import SITE, row_slice, scan
from noisefleet.session import cut_lineage

# Fixed values of the clock rules, in seconds.
FALL_BACK_TOLERANCE_S = 5.0
FAR_FUTURE = "9999-01-01"
HOUR_S = 3600.0


def mark_repeated_hour(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Set ``fold`` to 1 on the second pass of a repeated hour, found in recorded order.

    A step back of about one hour starts a second pass, which lasts while times stay at or below the
    last time before the step.
    """
    from noisefleet.operators.continuity import modal_step

    kept = [c for c in df.columns if c != "fold"]
    stepped = scan(df.select(kept), keys, row_slice("seq"), ["seq"], keep_slice=True, lags={"_prev": F.col("ts")})
    stepped = cut_lineage(stepped.withColumn("_step", ck.seconds_between("_prev", "ts")))
    tolerance = F.greatest(F.lit(FALL_BACK_TOLERANCE_S), 2.0 * F.coalesce("interval_s", F.lit(1.0)))
    jump = F.coalesce(F.abs(F.col("_step") + HOUR_S) <= tolerance, F.lit(False))
    # inside a slice: the last step back so far, and the latest time since it
    part = [*keys, "_slice"]
    run = Window.partitionBy(*part).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(*part, "_jumps").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    late = F.coalesce(F.col("ts"), F.lit(FAR_FUTURE).cast("timestamp_ntz"))
    local = (stepped.join(modal_step(stepped, keys, "_step"), list(keys), "left").withColumn("_jump", jump)
             .withColumn("_jumps", F.sum(F.when(F.col("_jump"), 1).otherwise(0)).over(run))
             .withColumn("_peak", F.last(F.when(F.col("_jump"), F.col("_prev")), ignorenulls=True).over(run))
             .withColumn("_latest", F.max(late).over(since)))
    # a slice hands on the pass that is open at its end; a slice without a step back only extends it
    ends = local.groupBy(*part).agg(F.max_by(F.struct("_jumps", "_peak", "_latest"), "seq").alias("e")).select(
        *part, F.when(F.col("e._jumps") > 0, F.col("e._peak")).alias("_p"), F.col("e._latest").alias("_m"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    numbered = ends.withColumn("_open", F.count("_p").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    opened = Window.partitionBy(*keys, "_open").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    state = numbered.withColumn("_p", F.max("_p").over(opened)).withColumn("_m", F.max("_m").over(opened))
    carry = state.select(*part, F.lag("_p").over(across).alias("_peak_in"), F.lag("_m").over(across).alias("_latest_in"))
    inherited = (F.col("_jumps") == 0) & (F.greatest("_latest", "_latest_in") <= F.col("_peak_in"))
    second = inherited | ((F.col("_jumps") > 0) & (F.col("_latest") <= F.col("_peak")))
    fold = F.when(F.coalesce(second, F.lit(False)), 1).otherwise(0).cast("tinyint")
    return local.join(carry, part, "left").select(*kept, fold.alias("fold"))


def ordering_key(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Add ``ord_ts``: wall time moved an hour later from every second pass on.

    Only the last folded reading per site and date is needed: at most one per date, kept as one short
    array per site.
    """
    folds = (df.where(F.col("fold") == 1).groupBy(*keys, F.to_date("ts").alias("_d"))
             .agg(F.max("ts").alias("_last")).groupBy(*keys).agg(F.collect_list("_last").alias("_folds")))
    moved = F.size(F.filter(F.coalesce("_folds", F.array().cast("array<timestamp_ntz>")), lambda x: (
        F.col("ts") > x) | ((F.col("fold") == 1) & (F.to_date("ts") == F.to_date(x)))))
    return df.join(folds, list(keys), "left").withColumn("ord_ts", ck.plus_hours("ts", moved)).drop("_folds")


def convert_clock(df: DataFrame, source: str, target: str) -> DataFrame:
    """Wall times moved to another zone through UTC; times that never happened are dropped.

    ``fold`` picks the pass of a repeated source hour and is set anew: 1 where the target wall time
    had been shown already.
    """
    ck.check_zone(source)
    ck.check_zone(target)
    if source == target:
        return df
    utc = ck.wall_to_utc("ts", source, fold=F.col("fold"))
    wall = ck.utc_to_wall("_utc", target)
    again = ck.shown_before("_utc", target)
    return (df.withColumn("_utc", utc).where(F.col("_utc").isNotNull() | F.col("ts").isNull())
            .withColumn("fold", F.when(again, 1).otherwise(0).cast("tinyint"))
            .withColumn("ts", wall).drop("_utc"))


def skipped_readings(df: DataFrame, source: str, keys: Sequence[str] = SITE) -> DataFrame:
    """Readings per site stamped with a time that never happened in the zone."""
    return df.groupBy(*keys).agg(F.count_if(ck.is_skipped("ts", source)).alias("nonexistent_source_readings"))


def clock_change_shift(zone: str) -> tuple[Column, Column]:
    """Real elapsed seconds from ``prev_ts`` to ``ts``, and how far the wall clock ran ahead of it."""
    def utc(c: str) -> Column:
        return ck.wall_to_utc(c, zone, on_repeated="later", on_skipped="forward")
    elapsed = ck.seconds_between(utc("prev_ts"), utc("ts"))
    return elapsed, ck.seconds_between("prev_ts", "ts") - elapsed


def describe_logger_clock(df: DataFrame, zone: str, keys: Sequence[str] = SITE) -> DataFrame:
    """Whether each logger follows daylight saving, with the evidence."""
    from noisefleet.operators.continuity import clock_changes

    day, time = "dd MMM yyyy", "HH:mm:ss"
    changes = F.expr("array(" + ", ".join(f"TIMESTAMP_NTZ '{t}'" for t, _ in ck.offset_changes(zone))
                     + ")") if ck.offset_changes(zone) else F.array().cast("array<timestamp_ntz>")
    # only steps over a change of the zone are evidence: at most two a year, however many gaps a record has
    at_change = F.exists(changes, lambda t: (t >= ck.hour_start("before")) & (t <= F.col("after")))
    jumps = clock_changes(df, zone, keys).where(at_change).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("before", "after"))).alias("jumps"))
    span = df.groupBy(*keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("ts").alias("n"),
        F.min(F.when(F.col("fold") == 1, F.col("ts"))).alias("first_fold"))
    spanned = F.filter(changes, lambda t: (t > ck.hour_start("start")) & (
        t <= ck.hour_start(ck.plus_seconds("end", 3599.999999))))
    said = F.transform(F.coalesce("jumps", F.array().cast("array<struct<before:timestamp_ntz,after:timestamp_ntz>>")),
                       lambda j: F.concat(F.date_format(j.after, day), F.lit(": "), F.date_format(j.before, time), F.lit(" is followed by "),
                                          F.date_format(j.after, time)))
    twice = F.when(F.col("first_fold").isNotNull(), F.array(F.concat(
        F.date_format("first_fold", day), F.lit(": an hour appears two times")))).otherwise(
        F.array().cast("array<string>"))
    parts = F.concat(said, twice)
    change = F.try_element_at("spanned", F.lit(1))
    follows = F.when(F.size("parts") > 0, True).when(F.size("spanned") > 0, False)
    evidence = (F.when(F.size("parts") > 0, F.concat(F.lit("Follows summer time. "), F.array_join("parts", "; ")))
                .when(F.size("spanned") > 0, F.concat(F.lit("Keeps one offset. The zone changed on "),
                      F.date_format(change, day), F.lit(" and the times run on.")))
                .otherwise("Open: the zone does not change within the record."))
    return (span.join(jumps, list(keys), "left").withColumn("parts", parts).withColumn("spanned", spanned)
            .select(*keys, F.when(F.col("n") > 1, follows).alias("follows_dst"),
                    F.when(F.col("n") > 1, evidence).otherwise("").alias("evidence")))


def check_clock_setting(df: DataFrame, zone: str, clock: str, keys: Sequence[str] = SITE) -> DataFrame:
    """First contradiction between a record and its clock mode, per site; no row when there is none.

    Only readings within a minute of a skipped hour are looked at.
    """
    skipped = [t for t, gone in ck.offset_changes(zone) if gone]
    if clock == "utc" or not skipped:
        return df.select(*keys, F.lit(None).cast("timestamp_ntz").alias("skipped_hour"), F.lit(0).cast("long").alias(
            "n_inside"), F.lit("").alias("contradiction")).where(F.lit(False))
    minute = 60.0
    hours = [ck.ntz(t) for t in skipped]
    inside = ck.hour_start("ts")
    ahead = ck.hour_start(ck.plus_seconds("ts", minute))
    behind = ck.hour_start(ck.plus_seconds("ts", -minute))
    gap = F.when(inside.isin(*hours), inside).when(ahead.isin(*hours), ahead).when(behind.isin(*hours), behind)
    near = df.where(F.col("ts").isNotNull()).withColumn("_gap", gap).where(F.col("_gap").isNotNull())
    end = ck.plus_hours("_gap", 1)
    g = near.groupBy(*keys, "_gap").agg(
        F.count_if((F.col("ts") >= F.col("_gap")) & (F.col("ts") < end)).alias("n_inside"),
        F.max(F.when(F.col("ts") < F.col("_gap"), F.col("ts"))).alias("_before"),
        F.min(F.when(F.col("ts") >= end, F.col("ts"))).alias("_after"))
    day = F.date_format("_gap", "dd MMM yyyy")
    if clock == "local_dst":
        wrong = F.col("n_inside") > 0
        text = F.concat(F.format_number("n_inside", 0), F.lit(" readings lie from "), F.date_format("_gap", "HH:mm"), F.lit(" to "),
                        F.date_format(ck.plus_hours("_gap", 1), "HH:mm"), F.lit(" on "), day,
                        F.lit(f", which {zone} left out; set the clock to standard time."))
    else:
        wrong = (F.col("n_inside") == 0) & F.col("_before").isNotNull() & F.col("_after").isNotNull()
        text = F.concat(F.lit("From "), F.date_format("_before", "HH:mm:ss"), F.lit(" the times go on at "), F.date_format("_after", "HH:mm:ss"),
                        F.lit(" on "), day, F.lit(f", where {zone} left an hour out; set the clock to summer time."))
    found = g.where(wrong).select(*keys, F.struct("_gap", "n_inside", text.alias("text")).alias("c"))
    return found.groupBy(*keys).agg(F.min("c").alias("c")).select(
        *keys, F.col("c._gap").alias("skipped_hour"), F.col("c.n_inside").alias("n_inside"),
        F.col("c.text").alias("contradiction"))


def time_basis(df: DataFrame, zone: str, keys: Sequence[str] = SITE) -> DataFrame:
    """Label of the clock each record is in, with the abbreviations in force."""
    span = df.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return span.select(*keys, ck.abbreviations(zone, F.col("_a"), F.col("_b")).alias("abbreviations"),
                       ck.time_basis(zone, F.col("_a"), F.col("_b")).alias("time_basis"))

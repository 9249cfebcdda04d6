"""Logging interval, gaps, completeness, file merging and noise events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.functions import text
from noisefleet.operators import clocks, ranks
from noisefleet.operators.scans import SITE, hour_slice, islands, pairs, scan, top_rows
from noisefleet.session import cut_lineage

# Fixed values of the gap rules.
MIN_GAP_S = 2.0
MINOR_GAP_MIN = 15.0
DEFAULT_ZONE = "America/New_York"
ORDER = ("ord_ts", "fold", "seq")


def modal_step(steps: DataFrame, keys: Sequence[str], step: str = "step_s") -> DataFrame:
    """Most frequent positive step per key, the smallest on ties, 1 s when there is none."""
    counted = (steps.groupBy(*keys, F.when(F.col(step) > 0, F.col(step)).alias("_s"))
               .agg(F.count(F.lit(1)).alias("_n")))
    return counted.groupBy(*keys).agg(_mode().alias("interval_s"))


def _mode() -> Column:
    return F.coalesce(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.struct(F.col("_n"), -F.col("_s")))), F.lit(1.0))


def modal_interval(df: DataFrame, keys: Sequence[str] = SITE, ts: str = "ts") -> DataFrame:
    """Logging interval of every site: the mode of its steps in time order."""
    timed = df.where(F.col(ts).isNotNull()).select(*keys, ts, "seq")
    p = pairs(timed, keys, hour_slice(ts), [ts, "seq"])
    return modal_step(p.select(*keys, ck.seconds_between(f"prev.{ts}", f"cur.{ts}").alias("step_s")), keys)


def elapsed_keyed(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Timed readings with the ordering key."""
    return clocks.ordering_key(df.where(F.col("ts").isNotNull()).select(*keys, "ts", "fold", "seq"), keys)


def edges(keyed: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Steps between neighbouring readings in elapsed order: both wall times and the elapsed step.

    One row per reading; the first of a site has no step.
    """
    p = pairs(keyed, keys, hour_slice("ord_ts"), ORDER)
    return p.select(*keys, F.col("prev.ts").alias("prev_ts"), F.col("cur.ts").alias("ts"), F.col("cur.ord_ts").alias("ord_ts"),
                    ck.seconds_between("prev.ord_ts", "cur.ord_ts").alias("step_s"))


def step_summary(steps: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Interval, number of readings and first and last elapsed time per site, in one aggregation."""
    counted = steps.groupBy(*keys, F.when(F.col("step_s") > 0, F.col("step_s")).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ord_ts").alias("_a"), F.max("ord_ts").alias("_b"))
    return counted.groupBy(*keys).agg(_mode().alias("interval_s"), F.sum("_n").alias("total_rows"),
                                      F.min("_a").alias("first_ord"), F.max("_b").alias("last_ord"))


def gap_threshold(interval_s: Column) -> Column:
    return F.greatest(2.0 * interval_s, F.lit(MIN_GAP_S))


def wide_steps(steps: DataFrame, zone: str, keys: Sequence[str] = SITE) -> DataFrame:
    """The few steps longer than the gap threshold, with the clock change in them taken out.

    Zone arithmetic runs only on these rows.
    """
    # a left join and a default keep the plan of ``steps`` equal to the summary's, so its shuffle is reused
    i = F.coalesce("interval_s", F.lit(1.0))
    elapsed, shift = clocks.clock_change_shift(zone)
    wall_wide = ck.seconds_between("prev_ts", "ts") > gap_threshold(i)
    return (steps.join(step_summary(steps, keys).select(*keys, "interval_s"), list(keys), "left")
            .where((F.col("step_s") > gap_threshold(i)) | wall_wide)
            .withColumn("shift_s", F.when(wall_wide & (shift >= 3600.0 - i), shift))
            .withColumn("step_s", F.when(F.col("shift_s").isNotNull(), elapsed).otherwise(F.col("step_s")))
            .withColumn("is_gap", F.col("step_s") > gap_threshold(i)))


def _explain_by_exclusions(wide: DataFrame, exclusions: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Mark the gaps that an exclusion window explains.

    Windows are matched on the dates they touch, so the range test runs inside an equi-join.
    """
    if exclusions is None:
        none = F.lit(None).cast("timestamp_ntz")
        return wide.withColumn("excl_start", none).withColumn("excl_end", none)
    dated = (exclusions.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b"))
             .withColumn("_d", F.explode(F.sequence(F.to_date("_a"), F.to_date("_b")))))
    tol = F.col("interval_s")
    hit = (F.col("is_gap") & (F.col("prev_ts") >= ck.plus_seconds("_a", -tol)) & (F.col("ts") <= ck.plus_seconds("_b", tol))
           & (F.col("prev_ts") < F.col("_b")) & (F.col("ts") > F.col("_a")))
    # the window's first date lies within one step of the gap, or the gap ends inside the window
    first_day, last_day = F.to_date("prev_ts"), F.to_date("ts")
    reach = F.least(last_day, F.date_add(first_day, F.ceil(tol / 86400.0).cast("int")))
    probes = wide.withColumn("_d", F.explode(F.array_union(F.sequence(first_day, reach), F.array(last_day))))
    found = (probes.join(dated, [*keys, "_d"], "left").groupBy(*wide.columns)
             .agg(F.min(F.when(hit, F.struct("_a", "_b"))).alias("_x")))
    return found.select(*wide.columns, F.col("_x._a").alias("excl_start"), F.col("_x._b").alias("excl_end"))


def _gaps_marked(df: DataFrame, zone: str, exclusions: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    return _explain_by_exclusions(wide_steps(edges(elapsed_keyed(df, keys), keys), zone, keys), exclusions, keys)


def gaps(df: DataFrame, zone: str = DEFAULT_ZONE, exclusions: DataFrame | None = None,
         keys: Sequence[str] = SITE) -> DataFrame:
    """Every step longer than twice the interval, with what is missing in it and why it is not a clock change."""
    found = _gaps_marked(df, zone, exclusions, keys).where(F.col("is_gap") & F.col("excl_start").isNull())
    missing = F.greatest(F.lit(0.0), F.col("step_s") - F.col("interval_s"))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return found.select(
        *keys, F.col("prev_ts").alias("gap_start"), F.col("ts").alias("gap_end"), F.col("step_s").alias("duration_seconds"),
        missing.alias("missing_seconds"), text.format_duration(missing).alias("duration_human"),
        F.when(missing / 60.0 < MINOR_GAP_MIN, "Minor").otherwise("Major").alias("category"),
        F.concat(text.format_duration(missing), F.lit(" missing after "), F.date_format("prev_ts", stamp), F.lit(", up to "),
                 F.date_format("ts", stamp)).alias("label"))


def clock_changes(df: DataFrame, zone: str = DEFAULT_ZONE, keys: Sequence[str] = SITE) -> DataFrame:
    """Spring-forward jumps: the wall step exceeds the real one by an hour, less one interval.

    At intervals of an hour or more that margin is used up and every wide step qualifies, most of them
    with a shift of zero.
    """
    wide = wide_steps(edges(elapsed_keyed(df, keys), keys), zone, keys)
    return wide.where(F.col("shift_s").isNotNull()).select(
        *keys, F.col("prev_ts").alias("before"), F.col("ts").alias("after"), F.col("shift_s").alias("shift_seconds"),
        F.col("step_s").alias("elapsed_seconds"))


def excluded_gaps(df: DataFrame, exclusions: DataFrame, zone: str = DEFAULT_ZONE, keys: Sequence[str] = SITE) -> DataFrame:
    """Gaps that an analyst's exclusion window explains."""
    return _gaps_marked(df, zone, exclusions, keys).where(F.col("excl_start").isNotNull()).select(
        *keys, F.col("excl_start").alias("start"), F.col("excl_end").alias("end"), F.col("step_s").alias("step_seconds"))


def gap_summary(df: DataFrame, zone: str = DEFAULT_ZONE, exclusions: DataFrame | None = None,
                keys: Sequence[str] = SITE) -> DataFrame:
    """Expected readings, completeness and gap counts per site; clock changes and exclusions are not data loss."""
    steps = edges(elapsed_keyed(df, keys), keys)
    marked = _explain_by_exclusions(wide_steps(steps, zone, keys), exclusions, keys)
    out, gap = F.col("excl_start").isNotNull(), F.col("is_gap")
    missing = F.greatest(F.lit(0.0), F.col("step_s") - F.col("interval_s"))
    minor = (F.col("step_s") - F.col("interval_s")) / 60.0 < MINOR_GAP_MIN
    g = marked.groupBy(*keys).agg(
        F.count_if(gap & ~out).alias("_gaps"), F.count_if(gap & ~out & minor).alias("_minor"),
        F.sum(F.when(gap & ~out, missing)).alias("_missing"), F.sum(F.when(out, missing)).alias("_excluded"),
        F.sum("shift_s").alias("_shift"), F.count("shift_s").alias("_changes"))

    def zero(c: str, v=0) -> Column:
        return F.coalesce(c, F.lit(v))

    i = F.col("interval_s")
    span = ck.seconds_between("first_ord", "last_ord")
    measured = span - zero("_shift", 0.0) - zero("_excluded", 0.0)
    rows = F.col("total_rows")
    expected = F.when(rows >= 2, F.greatest(F.bround(measured / i, 0).cast("long") + 1, rows)).otherwise(0)
    exact = F.when(rows >= 2, F.least(F.lit(100.0), rows / expected * 100.0)).otherwise(100.0)
    return step_summary(steps, keys).join(g, list(keys), "left").select(
        *keys, "total_rows", i.alias("logging_interval_seconds"), span.alias("actual_span_seconds"),
        expected.alias("expected_rows"), exact.alias("completeness_exact"), text.floor_pct(exact, 2).alias("uptime_pct"),
        zero("_gaps").alias("gap_count"), zero("_minor").alias("minor_gap_count"),
        (zero("_gaps") - zero("_minor")).alias("major_gap_count"), zero("_missing", 0.0).alias("missing_seconds"),
        zero("_changes").alias("n_clock_changes"), (zero("_gaps") == 0).alias("continuous"))


def completeness(df: DataFrame, zone: str = DEFAULT_ZONE, keys: Sequence[str] = SITE) -> DataFrame:
    """Data completeness (%) against the unrounded number of expected readings."""
    steps = edges(elapsed_keyed(df, keys), keys)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    shift = wide_steps(steps, zone, keys).groupBy(*keys).agg(F.sum("shift_s").alias("_shift"))
    span = ck.seconds_between("first_ord", "last_ord")
    expected = F.greatest(F.lit(1.0), (span - F.coalesce("_shift", F.lit(0.0))) / F.col("interval_s") + 1.0)
    return (rows.join(step_summary(steps, keys), list(keys), "left").join(shift, list(keys), "left")
            .select(*keys, "n_rows", F.when(span > 0, F.least(F.lit(100.0), 100.0 * F.col("n_rows") / expected)).alias("completeness_pct")))


def merge_files(df: DataFrame, keys: Sequence[str] = SITE) -> tuple[DataFrame, DataFrame]:
    """One record per site from overlapping files, and notes on what was left out.

    Of readings with one (time, fold) the earliest file wins. It is a minimum by file and position
    with a map-side partial, so any number of copies of a reading collapses before the shuffle.
    """
    rest = [c for c in df.columns if c not in (*keys, "ts", "fold")]
    # file and position in one number: with fixed-width columns the minimum stays a hash aggregate
    place = F.shiftleft(F.coalesce("file_seq", F.lit(0)).cast("bigint"), 40) + F.col("seq")
    merged = (df.where(F.col("ts").isNotNull()).groupBy(*keys, "ts", "fold")
              .agg(*[F.min_by(c, place).alias(c) for c in rest]))
    return merged.select(*df.columns), merge_notes(df, keys)


def in_time_order(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """``seq`` anew: the position of each reading of a merged record in elapsed time.

    Files count their own positions, so those repeat within a site. Hours are numbered by themselves and take
    over the count of the hours before.
    """
    keyed = clocks.ordering_key(df, keys)
    at = scan(keyed, keys, hour_slice("ord_ts"), ["ord_ts", "fold", "ts"], sums={"_at": F.lit(1)})
    return at.withColumn("seq", F.col("_at") - 1).select(*df.columns)


def merge_notes(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Counts of unreadable and repeated readings per site, with their text."""
    times = df.groupBy(*keys, "ts", "fold").agg(F.count(F.lit(1)).alias("_n"))
    dead = F.col("ts").isNull()
    g = times.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(dead, F.col("_n"))), F.lit(0)).alias("unreadable"),
        F.coalesce(F.sum(F.when(~dead, F.col("_n") - 1)), F.lit(0)).alias("duplicates"))
    unread = F.struct(F.lit("unreadable_time").alias("code"), F.col("unreadable").alias("n"), F.concat(
        F.lit("left out for an unreadable time: "), F.format_number("unreadable", 0), F.lit(" of "), F.format_number("n_rows", 0)).alias("text"))
    twice = F.struct(F.lit("duplicate_time").alias("code"), F.col("duplicates").alias("n"), F.concat(
        F.lit("left out for a time that an earlier file or row has: "), F.format_number("duplicates", 0)).alias("text"))
    return (g.select(*keys, F.explode(F.array(unread, twice)).alias("note")).select(*keys, "note.*").where(F.col("n") > 0))


def file_details(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    return df.groupBy(*keys, "file_seq").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"))


# Fixed values of the event rules.
EVENT_PERCENTILE, EVENT_BRIDGE_STEPS, EVENT_BRIDGE_MIN_S = 0.90, 3.0, 3.0
TOP_EVENTS, EVENT_SEPARATION_S = 10, 300


def noise_events(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Runs of readings at or above the 90th percentile, joined over short steps.

    Only the loud tenth of the readings takes part in the runs, so it is written out once before they
    are numbered.
    """
    timed = df.where(F.col("ts").isNotNull() & F.col("leq").isNotNull())
    keyed = clocks.ordering_key(timed.select(*keys, "ts", "fold", "seq", "leq"), keys)
    threshold = ranks.percentiles(timed, keys, "leq", {"threshold": EVENT_PERCENTILE})
    p = pairs(keyed.drop("leq", "ts"), keys, hour_slice("ord_ts"), ORDER)
    # the typical step is taken in whole seconds
    whole = p.select(*keys, F.floor(ck.seconds_between("prev.ord_ts", "cur.ord_ts")).cast("double").alias("_w"))
    typical = ranks.percentiles(whole, keys, "_w", {"typical_s": 0.5})
    s = scan(keyed, keys, hour_slice("ord_ts"), ORDER, keep_slice=True,
             lags={"prev_ord": F.col("ord_ts"), "prev_leq": F.col("leq")})
    bridge = F.greatest(EVENT_BRIDGE_STEPS * F.col("typical_s"), F.lit(EVENT_BRIDGE_MIN_S))
    joined = (F.col("prev_leq") >= F.col("threshold")) & (ck.seconds_between("prev_ord", "ord_ts") <= bridge)
    loud = cut_lineage(s.join(threshold, list(keys)).where(F.col("leq") >= F.col("threshold")).join(typical, list(keys))
                       .withColumn("_begins", ~F.coalesce(joined, F.lit(False)))
                       .drop("prev_ord", "prev_leq", "threshold"))
    runs = islands(loud, keys, None, ORDER, F.col("_begins"), "event_id")
    loudest = F.struct(F.col("leq").alias("peak"), (-F.unix_micros(F.col("ord_ts").cast("timestamp"))).alias("_k"),
                       (-F.col("seq")).alias("_s"))
    g = runs.groupBy(*keys, "event_id").agg(
        F.min_by("ts", F.struct(*ORDER)).alias("start"), F.max_by("ts", F.struct(*ORDER)).alias("end"),
        F.min("ord_ts").alias("_a"), F.max("ord_ts").alias("_b"), F.max_by(F.struct("ts", "ord_ts"), loudest).alias("_p"),
        F.max("leq").alias("peak"), F.max("typical_s").alias("_i"), F.count(F.lit(1)).alias("n_readings"))
    return g.select(*keys, "event_id", "start", "end", F.col("_p.ts").alias("peak_time"), F.col("_p.ord_ts").alias("peak_key"),
                    "peak", (ck.seconds_between("_a", "_b") + F.col("_i")).alias("duration_s"), "n_readings")


def top_events(events: DataFrame, keys: Sequence[str] = SITE, top_n: int = TOP_EVENTS,
               separation_s: int = EVENT_SEPARATION_S) -> DataFrame:
    """The ``top_n`` loudest events whose peaks lie more than ``separation_s`` apart, loudest first.

    Picking is greedy, so only a bounded set of events can matter: cut time into cells as wide as the
    separation. One pick rules out events in at most three cells, so among the 3·(top_n-1)+1 cells with
    the best peaks one is always free before the last pick. Events worse than the best of that last
    cell are never picked; the rest (a fixed number of cells per site) is folded in order.
    """
    cells = 3 * (top_n - 1) + 1
    events = cut_lineage(events)
    micros = F.unix_micros(F.col("peak_key").cast("timestamp"))
    # ascending order of `at` is: loudest first, then earliest
    e = events.withColumn("_at", F.struct((-F.col("peak")).alias("p"), micros.alias("t"), F.col("event_id").alias("i")))
    e = e.withColumn("_cell", F.floor(micros / (separation_s * 1_000_000)))
    best = e.groupBy(*keys, "_cell").agg(F.min("_at").alias("_best"))
    ranked = top_rows(best, keys, F.floor(F.col("_cell") / 4096), [F.asc("_best")], cells)
    last = ranked.groupBy(*keys).agg(F.max("_best").alias("_last"))
    some = (e.join(ranked.select(*keys, "_cell"), [*keys, "_cell"], "left_semi").join(last, list(keys))
            .where(F.col("_at") <= F.col("_last")))
    listed = some.groupBy(*keys).agg(F.array_sort(F.collect_list("_at")).alias("_all"))
    none = F.array().cast("array<struct<p:double,t:bigint,i:bigint>>")

    def pick(got: Column, x: Column) -> Column:
        clear = ~F.exists(got, lambda g: F.abs(g["t"] - x["t"]) <= F.lit(separation_s * 1_000_000))
        return F.when((F.size(got) < top_n) & clear, F.concat(got, F.array(x))).otherwise(got)

    chosen = listed.select(*keys, F.posexplode(F.aggregate("_all", none, pick)).alias("_i", "_at"))
    return (events.join(chosen.select(*keys, (F.col("_i") + 1).alias("rank"), F.col("_at.i").alias("event_id")), [*keys, "event_id"])
            .drop("peak_key"))

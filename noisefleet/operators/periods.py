"""Daily, nightly and hourly summaries, grids and resampled series.

Every rating window starts and ends on a clock hour, so the readings are reduced once to one row per
site and clock hour (sums that merge exactly) and all calendars are built from that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.functions import levels as lv
from noisefleet.operators import ranks
from noisefleet.operators.scans import SITE

# Fixed values.
COMPLETE_COVERAGE_PCT = 99.5
MIN_PERIOD_COVERAGE_PCT = 50.0
LDEN_DAY_START = 7
ROAD_LDEN_DB, ROAD_LNIGHT_DB = 53.0, 45.0
QUARTER_S = 900
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def period_key(ts: Column | str, start_hour: int) -> Column:
    """Date on which the period containing a reading began."""
    return F.to_date(ck.plus_hours(ts, -start_hour))


def period_length_s(day: Column | str, window: tuple[int, int], zone: str | None) -> Column:
    """Real length of the period that starts on ``day``: 23 and 25 hour days included."""
    start, end = window
    midnight = ck.col(day).cast("timestamp_ntz")
    a = ck.plus_hours(midnight, start)
    b = ck.plus_hours(midnight, end + (24 if end <= start else 0))
    if not zone:
        return ck.seconds_between(a, b)
    # both ends are named by their first occurrence
    return ck.seconds_between(ck.first_instant(a, zone), ck.first_instant(b, zone))


def coverage_pct(n: Column, interval_s: Column, length_s: Column) -> Column:
    return F.when(length_s > 0, F.least(F.lit(100.0), 100.0 * n * interval_s / length_s))


def hour_rollup(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq") -> DataFrame:
    """One row per site and clock hour with mergeable sums; the base of every calendar below."""
    x = F.col(level)
    return (df.where(F.col("ts").isNotNull() & x.isNotNull())
            .groupBy(*keys, ck.hour_start("ts").alias("hour_ts"))
            .agg(F.sum(lv.energy(x)).alias("e"), F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"),
                 F.max(x).alias("hi"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")))


def rolled_laeq(where: Column | None = None) -> Column:
    """Energy average over rolled-up hours."""
    e, n = F.col("e"), F.col("n")
    if where is not None:
        e, n = F.when(where, e), F.when(where, n)
    return lv.to_db(F.sum(e) / F.sum(n))


def rolled_sd() -> Column:
    """Sample standard deviation over rolled-up hours."""
    n, s, ss = F.sum("n"), F.sum("s"), F.sum("ss")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), ss - s * s / n) / (n - 1)))


def window_levels(roll: DataFrame, interval: DataFrame, window: tuple[int, int], zone: str | None,
                  keys: Sequence[str] = SITE) -> DataFrame:
    """LAeq and coverage of one window per period, keyed by the date it began."""
    start, end = window
    hour = F.hour("hour_ts")
    day = period_key("hour_ts", start) if end <= start else F.to_date("hour_ts")
    g = (roll.where(lv.in_hours(hour, window)).groupBy(*keys, day.alias("date"))
         .agg(rolled_laeq().alias("laeq"), F.sum("n").alias("n")))
    return g.join(interval, list(keys)).select(
        *keys, "date", "laeq", "n",
        coverage_pct(F.col("n"), F.col("interval_s"), period_length_s("date", window, zone)).alias("coverage_pct"))


def nightly(df: DataFrame, interval: DataFrame, window: tuple[int, int] = lv.NIGHT_LDEN,
            zone: str | None = ck.DEFAULT_ZONE, keys: Sequence[str] = SITE) -> DataFrame:
    return window_levels(hour_rollup(df, keys), interval, window, zone, keys)


def _rolled_rating(hour: Column) -> tuple[Column, Column, Column]:
    return tuple(rolled_laeq(lv.in_hours(hour, w)) for w in (lv.DAY_LDEN, lv.EVENING_LDEN, lv.NIGHT_LDEN))


def lden_by_day(df: DataFrame, interval: DataFrame, zone: str | None = ck.DEFAULT_ZONE,
                keys: Sequence[str] = SITE) -> DataFrame:
    """Lden of every 07:00-07:00 period, with coverage."""
    d, e, n = _rolled_rating(F.hour("hour_ts"))
    g = (hour_rollup(df, keys).groupBy(*keys, period_key("hour_ts", LDEN_DAY_START).alias("date"))
         .agg(d.alias("_d"), e.alias("_e"), n.alias("_n"), F.sum("n").alias("n")))
    whole = (LDEN_DAY_START, LDEN_DAY_START)
    return g.join(interval, list(keys)).select(
        *keys, "date", lv.lden(F.col("_d"), F.col("_e"), F.col("_n")).alias("lden"), "n",
        coverage_pct(F.col("n"), F.col("interval_s"), period_length_s("date", whole, zone)).alias("coverage_pct"))


def daily_summary(df: DataFrame, interval: DataFrame, zone: str | None = ck.DEFAULT_ZONE,
                  keys: Sequence[str] = SITE) -> DataFrame:
    """One row per calendar date that has readings, with the periods that begin on it.

    A rolled-up hour belongs to a calendar date, a daytime, a night and an Lden period; it is tagged
    with each and all four are reduced in one aggregation.
    """
    hour = F.hour("hour_ts")
    tags = F.array(
        F.struct(F.lit("date").alias("kind"), F.to_date("hour_ts").alias("date")),
        F.when(lv.in_hours(hour, lv.DAY_LDN), F.struct(F.lit("day").alias("kind"), F.to_date("hour_ts").alias("date"))),
        F.when(lv.in_hours(hour, lv.NIGHT_LDN), F.struct(
            F.lit("night").alias("kind"), period_key("hour_ts", lv.NIGHT_LDN[0]).alias("date"))),
        F.struct(F.lit("lden").alias("kind"), period_key("hour_ts", LDEN_DAY_START).alias("date")))
    tagged = (hour_rollup(df, keys).withColumn("_h", hour).withColumn("_t", F.explode(F.array_compact(tags)))
              .select("*", F.col("_t.kind").alias("kind"), F.col("_t.date").alias("date")))
    kind = F.col("kind")
    cal = kind == "date"

    def total(c: str) -> Column:
        return F.sum(F.when(cal, F.col(c)))

    part = [rolled_laeq((kind == "lden") & lv.in_hours(F.col("_h"), w)).alias(a) for w, a in
            ((lv.DAY_LDEN, "_d"), (lv.EVENING_LDEN, "_e"), (lv.NIGHT_LDEN, "_n"))]
    g = tagged.groupBy(*keys, "date").agg(
        total("n").alias("n"), lv.to_db(total("e") / total("n")).alias("laeq"),
        F.min(F.when(cal, F.col("lo"))).alias("min_leq"), F.max(F.when(cal, F.col("hi"))).alias("max_leq"),
        total("s").alias("_s"), total("ss").alias("_ss"),
        rolled_laeq(kind == "day").alias("day_laeq"), F.sum(F.when(kind == "day", F.col("n"))).alias("_n_day"),
        rolled_laeq(kind == "night").alias("night_laeq"), F.sum(F.when(kind == "night", F.col("n"))).alias("_n_night"),
        *part, F.sum(F.when(kind == "lden", F.col("n"))).alias("_n_lden")).where(F.col("n") > 0)
    i, n = F.col("interval_s"), F.col("n")

    def covered(count: str, window: tuple[int, int]) -> Column:
        return coverage_pct(F.col(count), i, period_length_s("date", window, zone))

    whole = (LDEN_DAY_START, LDEN_DAY_START)
    return g.join(interval, list(keys)).select(
        *keys, "date", "laeq", "min_leq", "max_leq",
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("_ss") - F.col("_s") * F.col("_s") / n) / (n - 1))).alias("std_dev"),
        (n * i / 3600.0).alias("hours_measured"), covered("n", (0, 0)).alias("day_coverage_pct"),
        "day_laeq", covered("_n_day", lv.DAY_LDN).alias("daytime_coverage_pct"),
        "night_laeq", covered("_n_night", lv.NIGHT_LDN).alias("night_coverage_pct"),
        lv.lden(F.col("_d"), F.col("_e"), F.col("_n")).alias("lden"), covered("_n_lden", whole).alias("lden_coverage_pct"))


def hourly_summary(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Clock hours pooled over all dates."""
    return hour_rollup(df, keys).groupBy(*keys, F.hour("hour_ts").alias("hour")).agg(
        rolled_laeq().alias("laeq"), F.min("lo").alias("min_leq"), F.max("hi").alias("max_leq"), rolled_sd().alias("std_dev"))


def diurnal_profile(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """LAeq of the 24 clock hours as one array; NULL where an hour has no data."""
    hours = hourly_summary(df, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("hour", "laeq"))).alias("_m"))
    return hours.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.try_element_at("_m", h)).alias("diurnal"))


def hour_date_grid(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """LAeq per hour and date over every calendar date of the record, empty cells NULL."""
    cells = hour_rollup(df, keys).select(*keys, F.to_date("hour_ts").alias("date"), F.hour("hour_ts").alias("hour"),
                                         lv.to_db(F.col("e") / F.col("n")).alias("laeq"))
    span = cells.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    spine = (span.select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
             .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))))
    return spine.join(cells, [*keys, "date", "hour"], "left")


def date_week_grid(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    return hour_rollup(df, keys).groupBy(
        *keys, F.to_date("hour_ts").alias("date"), F.weekofyear("hour_ts").alias("week")).agg(rolled_laeq().alias("laeq"))


def weekly_profile(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """LAeq by weekday, day (07-22) and night, with how many dates and weekdays the site has in all."""
    roll = hour_rollup(df, keys).withColumn("weekday", F.weekday("hour_ts")).withColumn("_d", F.to_date("hour_ts"))
    held = (roll.groupBy(*keys, "_d", "weekday").agg(F.lit(1).alias("x")).groupBy(*keys)
            .agg(F.count("_d").alias("n_dates"), F.count_distinct("weekday").alias("n_weekdays")))
    day = lv.in_hours(F.hour("hour_ts"), lv.DAY_LDN)
    g = roll.groupBy(*keys, "weekday").agg(rolled_laeq(day).alias("day_laeq"), rolled_laeq(~day).alias("night_laeq"))
    return g.join(held, list(keys)).withColumn("day_name", F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday") + 1))


def _hour_ranks(df: DataFrame, keys: Sequence[str], level: str) -> tuple[DataFrame, list[str]]:
    by = [*keys, "hour"]
    timed = df.where(F.col("ts").isNotNull()).withColumn("hour", F.hour("ts"))
    return ranks.ranked(ranks.kept_counts(timed, by, level), by), by


def _quartiles(r: DataFrame, by: list[str]) -> DataFrame:
    return r.groupBy(*by).agg(
        *[ranks.percentile_of_ranked(p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
        F.min("v").alias("_min"), F.max("v").alias("_max"),
        lv.to_db(F.sum(lv.energy("v") * F.col("n")) / F.sum("n")).alias("laeq"))


def hourly_box(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq") -> DataFrame:
    """Box per clock hour; whiskers are the most extreme readings within 1.5 IQR, the mean is LAeq."""
    r, by = _hour_ranks(df, keys, level)
    q = _quartiles(r, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    w = r.join(q, by).groupBy(*by).agg(F.min(F.when(inside, F.col("v"))).alias("lo"), F.max(F.when(inside, F.col("v"))).alias("hi"))
    return q.join(w, by).select(*by, "q1", "median", "q3", F.coalesce("lo", "_min").alias("lower_fence"),
                                F.coalesce("hi", "_max").alias("upper_fence"), "laeq")


def hourly_outliers(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq", shown: int | None = None) -> DataFrame:
    """The levels beyond 1.5 IQR of each hour's box, how many readings have them, and how far they lie from the median.

    With ``shown``, only that many readings furthest from the median (ties to the lower level): a top-k on
    counted levels, first within a level bin, then across the bins' survivors.
    """
    r, by = _hour_ranks(df, keys, level)
    j = r.join(_quartiles(r, by), by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    far = (j.where((F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach))
           .withColumn("_far", F.abs(F.col("v") - F.col("median"))))
    n = F.col("n")
    if shown is not None:
        order = [F.desc("_far"), F.asc("v")]
        first = Window.partitionBy(*by, "_bin").orderBy(*order)
        across = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        far = (far.withColumn("_bin", F.floor("v")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= shown)
               .withColumn("_before", F.sum("n").over(across) - n).where(F.col("_before") < shown))
        n = F.least(n, shown - F.col("_before"))
    return far.select(*by, F.col("v").alias("level"), n.alias("n"), F.col("_far").alias("from_median"))


def hourly_box_clipped(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq") -> DataFrame:
    """Box per clock hour with fences clipped to the data, and how many readings lie beyond them."""
    r, by = _hour_ranks(df, keys, level)
    q = _quartiles(r, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    box = q.select(*by, "q1", "median", "q3", F.greatest(F.col("_min"), F.col("q1") - reach).alias("lower_fence"),
                   F.least(F.col("_max"), F.col("q3") + reach).alias("upper_fence"))
    beyond = (F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence"))
    n = r.join(box, by).groupBy(*by).agg(F.coalesce(F.sum(F.when(beyond, F.col("n"))), F.lit(0)).alias("n_outliers"))
    return box.join(n, by)


def thinned_outliers(df: DataFrame, keys: Sequence[str] = SITE, level: str = "leq", *, shown: int) -> DataFrame:
    """Outliers of :func:`hourly_box_clipped` at ``shown`` evenly spaced ranks, both ends kept."""
    r, by = _hour_ranks(df, keys, level)
    q = _quartiles(r, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    lo, hi = F.greatest(F.col("_min"), F.col("q1") - reach), F.least(F.col("_max"), F.col("q3") + reach)
    out = r.join(q, by).where((F.col("v") < lo) | (F.col("v") > hi)).select(*by, "v", "n")
    o = ranks.ranked(out, by)
    m = F.col("n_total")
    step = (m - 1).cast("double") / F.lit(shown - 1)
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(shown - 1)), lambda k: F.when(
        k == shown - 1, m - 1).otherwise(F.floor(k * step))))
    every = F.sequence(F.col("rank0"), F.col("rank1") - 1)
    picked = F.when(m <= shown, every).otherwise(
        F.filter(spaced, lambda x: (x >= F.col("rank0")) & (x < F.col("rank1"))))
    return o.withColumn("rank", F.explode(picked)).select(*by, "rank", F.col("v").alias("level"))


def chart_width_s(span_s: float, most_bins: int) -> int:
    """The narrowest of 15 minutes, an hour and a day that cuts a span into ``most_bins`` or fewer."""
    return next((w for w in (QUARTER_S, 4 * QUARTER_S) if span_s <= w * most_bins), 96 * QUARTER_S)


def resample(df: DataFrame, keys: Sequence[str] = SITE, bin_s: int = 4 * QUARTER_S) -> DataFrame:
    """LAeq, highest L-Max and lowest L-Min per bin of ``bin_s`` seconds (multiples of 15 minutes); empty bins are kept."""
    if bin_s <= 0 or bin_s % QUARTER_S:
        raise ValueError("a bin is a multiple of 900 seconds")
    at = F.floor(ck.epoch_seconds("ts") / bin_s)
    bins = (df.where(F.col("ts").isNotNull() & F.col("leq").isNotNull()).groupBy(*keys, at.alias("_bin"))
            .agg(lv.laeq("leq").alias("laeq"), F.max("lmax").alias("lmax"), F.min("lmin").alias("lmin")))
    spine = bins.groupBy(*keys).agg(F.min("_bin").alias("_a"), F.max("_bin").alias("_b")).select(
        *keys, F.explode(F.sequence("_a", "_b")).alias("_bin"))
    return spine.join(bins, [*keys, "_bin"], "left").select(
        *keys, F.timestamp_seconds(F.col("_bin") * bin_s).cast("timestamp_ntz").alias("bin_start"), "laeq", "lmax", "lmin")


def rolling_median(bins: DataFrame, keys: Sequence[str] = SITE, window: int = 24) -> DataFrame:
    """Centred rolling median of resampled LAeq over ``window`` bins, blank where the bin is empty.

    A value needs half a window of bins with a level. Each row gathers the bins of its window, no more.
    """
    at = Window.partitionBy(*keys).orderBy("bin_start").rowsBetween(-(window // 2), (window - 1) // 2)
    vals = F.array_sort(F.collect_list("laeq").over(at))
    k = F.size("_vals")
    med = (F.element_at("_vals", F.floor((k + 1) / 2).cast("int")) + F.element_at("_vals", F.floor(k / 2).cast("int") + 1)) / 2
    return bins.withColumn("_vals", vals).select(
        *keys, "bin_start", "laeq", F.when(F.col("laeq").isNotNull() & (k >= max(1, window // 2)), med).alias("rolling_median"))


def envelope_runs(bins: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Runs of at least two consecutive bins with both L-Max and L-Min."""
    at = Window.partitionBy(*keys).orderBy("bin_start")
    measured = F.col("lmax").isNotNull() & F.col("lmin").isNotNull()
    b = bins.withColumn("_m", measured).withColumn("_new", F.when(
        F.col("_m") & ~F.coalesce(F.lag("_m").over(at), F.lit(False)), 1).otherwise(0))
    b = b.withColumn("_run", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return (b.where("_m").groupBy(*keys, "_run").agg(
        F.min("bin_start").alias("start"), F.max("bin_start").alias("end"), F.count(F.lit(1)).alias("bins"))
        .where(F.col("bins") >= 2).drop("_run"))


def minute_levels(keyed: DataFrame, keys: Sequence[str] = SITE, level: str = "leq") -> DataFrame:
    """1-minute LAeq on the ordering key, so a repeated hour keeps its own minutes."""
    minute = F.date_trunc("MINUTE", "ord_ts").cast("timestamp_ntz")
    wall = F.date_trunc("MINUTE", "ts").cast("timestamp_ntz")
    return (keyed.where(F.col("ts").isNotNull() & F.col(level).isNotNull()).groupBy(*keys, minute.alias("_k"))
            .agg(F.min(wall).alias("minute_start"), F.max("fold").alias("_f"), lv.laeq(level).alias("laeq"),
                 F.count(F.lit(1)).alias("readings"))
            .select(*keys, "minute_start", F.when(F.col("_f") == 1, "yes").otherwise("").alias("second_pass"), "laeq", "readings"))


def periods_over_limit(df: DataFrame, interval: DataFrame, zone: str | None = ck.DEFAULT_ZONE,
                       keys: Sequence[str] = SITE) -> DataFrame:
    """Nights over Lnight 45 and days over Lden 53 among those at least half measured, with their range."""
    half = F.col("coverage_pct") >= MIN_PERIOD_COVERAGE_PCT
    nights = (nightly(df, interval, lv.NIGHT_LDEN, zone, keys).where(half & F.col("laeq").isNotNull())
              .select(*keys, F.lit("night").alias("period"), F.col("laeq").alias("level"), F.lit(ROAD_LNIGHT_DB).alias("limit_db")))
    days = (daily_summary(df, interval, zone, keys)
            .where((F.col("lden_coverage_pct") >= MIN_PERIOD_COVERAGE_PCT) & F.col("lden").isNotNull())
            .select(*keys, F.lit("day").alias("period"), F.col("lden").alias("level"), F.lit(ROAD_LDEN_DB).alias("limit_db")))
    return nights.unionByName(days).groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("n_periods"), F.count_if(F.col("level") > F.col("limit_db")).alias("n_over"),
        F.min("level").alias("lowest"), F.max("level").alias("highest"))


def calendar_features(df: DataFrame) -> DataFrame:
    """Hour, weekday (0 is Monday), day name, date and ISO week of every reading."""
    return df.withColumns({
        "hour": F.hour("ts"), "weekday": F.weekday("ts"),
        "day_name": F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday("ts") + 1),
        "date": F.to_date("ts"), "week": F.weekofyear("ts")})


def period_levels(rating: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """The eight period levels of a record in long form."""
    # Order, name and hours of the rows.
    rows = [("LAeq, whole record", "All readings", "laeq_24h"), ("LAeq, day", "07:00-19:00", "laeq_day_lden"),
            ("LAeq, evening", "19:00-23:00", "laeq_evening_lden"), ("Lnight", "23:00-07:00", "lnight"),
            ("Lden", "Day + evening (+5 dB) + night (+10 dB)", "lden"),
            ("LAeq, COMAR day", "07:00-22:00", "laeq_day_ldn"), ("LAeq, COMAR night", "22:00-07:00", "laeq_night_ldn"),
            ("Ldn", "Day + night (+10 dB, 22:00-07:00)", "ldn")]
    entries = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(m).alias("metric"), F.lit(p).alias("averaging_period"),
                                 F.col(c).alias("level_db")) for i, (m, p, c) in enumerate(rows, 1)])
    return rating.select(*keys, F.explode(entries).alias("r")).select(*keys, "r.*")

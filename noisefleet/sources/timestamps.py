"""Times from text: which format a record uses, how far it can be trusted, and rebuilding lost dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.operators.scans import SITE, row_slice, scan
from noisefleet.session import cut_lineage

# Fixed values of the decision.
YEAR_FIRST = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"
# what is left of a clock time without its digits
CLOCK_MARKS = (":", "::", ":.", "::.")
YEAR_SHARE, TIME_ONLY_SHARE = 0.5, 0.8
WEAK, GOOD_ENOUGH, USABLE, OK_PCT = 0.95, 0.99, 0.60, 99.5
EPOCH_MS_OVER = 1e11
CLOCK = "[ H:m[:s[.SSSSSSSSS]]]"
# Name, shape and reading order of the explicit formats, in the order they are tried.
EXPLICIT = [
    ("%Y-%m-%d %H:%M:%S", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "year"),
    ("%Y-%m-%d %H:%M:%S.%f", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d+$", "year"),
    ("%Y/%m/%d %H:%M:%S", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "year"),
    ("%Y/%m/%d %H:%M:%S.%f", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d+$", "year"),
    ("%d/%m/%Y %H:%M:%S", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "day"),
    ("%m/%d/%Y %H:%M:%S", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "month"),
    ("%d-%m-%Y %H:%M:%S", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "day"),
    ("%d.%m.%Y %H:%M:%S", r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "day"),
]
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _read(text: Column, pattern: str, guard: str) -> Column:
    """Parse where the text has the right shape; the guard spares the parser its failures."""
    return F.when(text.rlike(guard), F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"))


def _spelled(t: Column) -> Column:
    """Dates with a month's name, or without separators, as yyyy-M-d; NULL for other texts."""
    day_first = r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?[ ,-]+(\d{4})(.*)$"
    month_first = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})(.*)$"
    compact = r"^((?:19|20)\d{2})(\d{2})(\d{2})(?:[ _]?(\d{2})(\d{2})(\d{2})?)?$"
    numbers = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m[:3]), F.lit(i))])

    def dated(pattern: str, year: int, month: int, day: int) -> Column:
        part = [F.regexp_extract(t, pattern, i) for i in range(5)]
        return F.concat_ws("-", part[year], F.try_element_at(numbers, F.lower(part[month])).cast("string"), F.concat(part[day], part[4]))

    clock = [F.regexp_extract(t, compact, i) for i in (4, 5, 6)]
    digits = F.concat_ws("-", *[F.regexp_extract(t, compact, i) for i in (1, 2, 3)])
    timed = F.concat(digits, F.lit(" "), F.concat_ws(":", *[F.nullif(c, F.lit("")) for c in clock]))
    return F.when(t.rlike(day_first), dated(day_first, 3, 2, 1)).when(t.rlike(month_first), dated(month_first, 3, 1, 2)).when(
        t.rlike(compact), F.when(clock[0] == "", digits).otherwise(timed))


def normal_text(raw: Column) -> Column:
    """A text time with one spelling of its date: yyyy-M-d where the year leads or the month is named, else with slashes
    and a year of four digits. An offset from UTC is left aside: the time is the one the clock showed.
    """
    t = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?<=\d)T(?=\d)", " "), r"(?<=:\d\d(?:\.\d{1,9})?)(Z| ?[+-]\d{2}:?\d{2})$|Z$", "")
    short = r"^(\d{1,2}/\d{1,2}/)({}\d)(?= |$)"
    for shape, plain in ((r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"), (r"^(\d{1,2})[-.](\d{1,2})[-.](\d{4}|\d{2}(?= |$))", "$1/$2/$3"),
                         (short.replace("{}", "[0-6]"), "$120$2"), (short.replace("{}", "[7-9]"), "$119$2"), (r" ?([APap][Mm])$", " $1")):
        t = F.regexp_replace(t, shape, plain)
    # most times are digits with separators and need no more
    return F.when(t.rlike(r"[A-Za-z]{3}|^\d{8}"), F.coalesce(_spelled(t), t)).otherwise(t)


def readings_of(text: Column) -> dict[str, Column]:
    """A normal text time read year first, day first and month first. Everything else is chosen from these."""
    late = r"^\d{1,2}/\d{1,2}/\d{4}"
    half = r" \d{1,2}:\d{2}(:\d{2})? [APap][Mm]$"

    def both(order: str, guard: str) -> Column:
        return F.coalesce(_read(text, order + CLOCK, guard + r"($| [0-9:.]+$)"), _read(F.upper(text), order + " h:m[:s] a", guard + half))

    return {"year": both("yyyy-M-d", YEAR_FIRST), "day": both("d/M/yyyy", late), "month": both("M/d/yyyy", late)}


def candidates(raw: Column, read: dict[str, Column] | None = None) -> dict[str, Column]:
    """What every strategy makes of a text time; the explicit formats are shapes of the three readings."""
    r = read or readings_of(normal_text(raw))
    out = {"inferred-yearfirst": r["year"], "inferred-dayfirst": F.coalesce(r["day"], r["year"]),
           "inferred-monthfirst": F.coalesce(r["month"], r["year"])}
    return out | {f"format:{name}": F.when(F.trim(raw).rlike(shape), r[order]) for name, shape, order in EXPLICIT}


def _epoch(raw: Column, unit: str) -> Column:
    n = raw.try_cast("double")
    seconds = n / 1000.0 if unit == "ms" else n
    return F.when(F.abs(seconds) < 1e11, F.timestamp_seconds(seconds).cast("timestamp_ntz"))


def bare_clock(value: Column) -> Column:
    """The text is a clock time without a date."""
    t = F.trim(value)
    return F.translate(t, "0123456789", "").isin(*CLOCK_MARKS) & t.rlike("^[0-9].*[0-9]$")


def choose_method(df: DataFrame, keys: Sequence[str] = SITE, raw: str = "raw", more: dict[str, Column] | None = None) -> DataFrame:
    """How each record is read, decided by all its values in one aggregate.

    ``method`` is the strategy and ``share`` what it reads; ``time_only`` says that the values are clock times
    without a date, ``has_year`` that they hold a year. Year-first wins where most values look so; otherwise
    day-first, month-first only if it reads more; explicit formats only when that is weak. ``more`` are aggregates
    to be counted along.
    """
    k, text = list(keys), F.col(raw)
    # read once, then counted under every strategy
    df = df.withColumn("_t", normal_text(text))
    df = df.withColumns({f"_{o}": c for o, c in readings_of(F.col("_t")).items()})
    named = candidates(text, {o: F.col(f"_{o}") for o in ("year", "day", "month")})
    n = F.count(F.lit(1))
    num, big = text.try_cast("double"), text.try_cast("double") > EPOCH_MS_OVER

    def looks(like: Column, share: float) -> Column:
        return F.coalesce(F.avg(like.cast("double")) >= share, F.lit(False))

    def shaped(pattern: str) -> Column:
        return F.trim(text).rlike(pattern)

    counts = df.groupBy(*k).agg(
        n.alias("n"), *[(F.count(c) / n).alias(f"c{i}") for i, c in enumerate(named.values())], F.count(num).alias("_num"),
        F.count_if(big).alias("_big"), F.max(F.when(~big, num)).alias("_below"), F.min(F.when(big, num)).alias("_above"),
        looks(shaped(YEAR_FIRST), YEAR_SHARE).alias("_yf"), looks(bare_clock(text), TIME_ONLY_SHARE).alias("time_only"),
        looks(shaped(r"\d{4}"), YEAR_SHARE).alias("has_year"), *[c.alias(name) for name, c in (more or {}).items()])
    # the median passes the limit if most values do; at exactly half it lies between the two nearest ones
    half = 2 * F.col("_big") - F.col("_num")
    in_ms = F.when(half == 0, (F.col("_below") + F.col("_above")) / 2 > EPOCH_MS_OVER).otherwise(half > 0)
    names = list(named)

    def entry(method: Column | str, share: Column) -> Column:
        return F.struct((F.lit(method) if isinstance(method, str) else method).alias("m"), share.alias("f"))

    inferred = F.when(F.col("_yf"), entry(names[0], F.col("c0"))).when(
        F.col("c2") > F.col("c1"), entry(names[2], F.col("c2"))).otherwise(entry(names[1], F.col("c1")))
    explicit = F.array(*[entry(m, F.col(f"c{i}")) for i, m in enumerate(names) if m.startswith("format:")])

    def better(best: Column, x: Column) -> Column:
        settled = best["m"].startswith("format:") & (best["f"] >= GOOD_ENOUGH)
        return F.when(~settled & (x["f"] > best["f"]), x).otherwise(best)

    j = counts.withColumn("_i", inferred).withColumn("c_num", F.col("_num") / F.col("n"))
    j = j.withColumn("_b", F.when(F.col("_i.f") < WEAK, F.aggregate(explicit, F.col("_i"), better)).otherwise(F.col("_i")))
    by_number = (F.col("_b.f") < USABLE) & (F.col("c_num") >= USABLE) & (F.col("c_num") > F.col("_b.f"))
    unit = F.when(in_ms, "epoch:ms").otherwise("epoch:s")
    return j.select(*k, "n", F.when(by_number, unit).otherwise(F.col("_b.m")).alias("method"),
                    F.when(by_number, F.col("c_num")).otherwise(F.col("_b.f")).alias("share"), "time_only", "has_year", *(more or {}))


def parse_with(raw: Column, method: Column, normal: Column | None = None) -> Column:
    """Read a text time with its record's strategy. Each reading appears once, behind the methods that use it."""
    r = readings_of(normal_text(raw) if normal is None else normal)
    by_order = {o: [f"format:{name}" for name, _, order in EXPLICIT if order == o] for o in r}
    inferred = ["inferred-yearfirst", "inferred-dayfirst", "inferred-monthfirst"]
    value = F.coalesce(
        F.when(method.isin("inferred-dayfirst", *by_order["day"]), r["day"]),
        F.when(method.isin("inferred-monthfirst", *by_order["month"]), r["month"]),
        F.when(method.isin(*inferred, *by_order["year"]), r["year"]),
        F.when(method == "epoch:s", _epoch(raw, "s")), F.when(method == "epoch:ms", _epoch(raw, "ms")))
    shaped = F.coalesce(*[F.when(method == f"format:{name}", F.trim(raw).rlike(pattern)) for name, pattern, _ in EXPLICIT], F.lit(True))
    return F.when(shaped, value)


def parse_times(df: DataFrame, keys: Sequence[str] = SITE, raw: str = "raw", chosen: DataFrame | None = None) -> DataFrame:
    """Add ``ts`` and the ``method`` it was read with."""
    chosen = (choose_method(df, keys, raw) if chosen is None else chosen).select(*keys, "method")
    return (df.join(chosen, list(keys)).withColumn("_t", normal_text(F.col(raw)))
            .withColumn("ts", parse_with(F.col(raw), F.col("method"), F.col("_t"))).drop("_t"))


def time_only(df: DataFrame, keys: Sequence[str] = SITE, raw: str = "raw") -> DataFrame:
    """Records whose values are clock times without a date."""
    return choose_method(df, keys, raw).select(*keys, "time_only")


def assess_integrity(df: DataFrame, now: dt.date, keys: Sequence[str] = SITE, raw: str = "raw") -> DataFrame:
    """Verdict on each record's times: ok, recovered or unusable.

    Unusable: bare clock times, under 60 % readable, or every row on ``now``'s date with no year in the text.
    """
    k = list(keys)
    # one small row per record, read twice below
    heads = cut_lineage(choose_method(df, k, raw))
    parsed = parse_times(df, k, raw, heads)
    per_date = parsed.groupBy(*k, F.to_date("ts").alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.max("method").alias("_m"))
    g = per_date.groupBy(*k).agg(
        F.sum("_n").alias("n_total"), F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_parsed"),
        F.count("_d").alias("unique_dates"), F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.max("_m").alias("method"))
    j = g.join(heads.select(*k, "time_only", "has_year"), k, "left")
    pct = 100.0 * F.col("n_parsed") / F.col("n_total")
    lost = F.coalesce(F.col("time_only"), F.lit(False))
    made_up = ((F.col("unique_dates") == 1) & (F.to_date("_a") == F.lit(now)) & ~F.coalesce(F.col("has_year"), F.lit(False)))
    bad = lost | (pct < USABLE * 100) | made_up

    def unless_lost(c: Column, v) -> Column:
        return F.when(lost, v).otherwise(c)

    return j.select(
        *k, F.when(bad, "unusable").when(pct >= OK_PCT, "ok").otherwise("recovered").alias("status"), "n_total",
        unless_lost(F.col("n_parsed"), 0).alias("n_parsed"), unless_lost(pct, 0.0).alias("parsed_pct"),
        unless_lost(F.col("unique_dates"), 0).alias("unique_dates"),
        unless_lost(F.coalesce(ck.seconds_between("_a", "_b") / 86400.0, F.lit(0.0)), 0.0).alias("span_days"),
        unless_lost(F.col("method"), "time-only").alias("method"), (~bad).alias("time_metrics_valid"))


def combine_date_time(date: Column, time: Column) -> Column:
    """One time from separate date and clock columns; the clock may be a bare hour number."""
    day = F.date_format(F.coalesce(*readings_of(normal_text(date)).values()), "yyyy-MM-dd")
    hour = time.try_cast("double")
    clock = F.when(time.rlike(r"^\s*\d{1,2}:\d{2}(:\d{2})?\s*$"), F.trim(time)).when(
        hour.between(0, 23.49), F.format_string("%02d:00:00", F.rint(hour).cast("int")))
    return F.try_to_timestamp(F.concat(day, F.lit(" "), F.coalesce(clock, F.lit("00:00:00"))),
                              F.lit("yyyy-MM-dd H:mm[:ss]")).cast("timestamp_ntz")


def expand_ties(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Spread readings that share one time over the logging interval, in recorded order.

    A run of equal times is a block. The interval is the modal block width over the modal block size;
    blocks that touch the next one end at it, over-full ones are squeezed, real gaps stay.
    """
    k = list(keys)
    s = cut_lineage(scan(df, k, row_slice("seq"), ["seq"], keep_slice=True, lags={"_prev": F.col("ts"), "_pseq": F.col("seq")}))
    # a missing time is never equal to its neighbour
    starts = F.col("_pseq").isNull() | ~F.coalesce(F.col("ts") == F.col("_prev"), F.lit(False))
    rows = cut_lineage(scan(s, k, None, ["seq"], sums={"_pos": F.lit(1)}, lasts={"_block": F.when(starts, F.col("seq"))})
                       .drop("_prev", "_pseq"))
    blocks = rows.groupBy(*k, "_block").agg(F.min("ts").alias("_start"), F.count(F.lit(1)).cast("double").alias("_size"),
                                            F.min("_pos").alias("_pos0"))
    following = {"_next": F.col("_start"), "_more": F.lit(1)}
    b = cut_lineage(scan(blocks, k, row_slice("_block"), ["_block"], leads=following)
                    .withColumn("_width", ck.seconds_between("_start", "_next")))

    def smallest_mode(c: Column, name: str) -> DataFrame:
        counted = b.where(c.isNotNull()).groupBy(*k, c.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        return counted.groupBy(*k).agg(F.max_by("_v", F.struct(F.col("_n"), -F.col("_v"))).alias(name))

    typical = smallest_mode(F.col("_size"), "_msize").join(
        smallest_mode(F.when(F.col("_width") > 0, F.col("_width")), "_mwidth"), k, "left")
    mw = F.coalesce("_mwidth", F.lit(1.0))
    step = mw / F.col("_msize")
    width, size = F.coalesce(F.col("_width"), mw), F.col("_size")
    touching = (width <= mw * 1.5) & F.col("_more").isNotNull() & (size > 1)
    fits = size * step <= width
    sized = b.join(typical, k).select(
        *k, "_block", "_start", "_pos0", F.when(touching & fits, width - size * step).otherwise(0.0).alias("_base"),
        F.when(touching & ~fits, width / size).otherwise(step).alias("_space"))
    offset = F.col("_base") + (F.col("_pos") - F.col("_pos0")) * F.col("_space")
    spread = F.when(F.col("ts").isNotNull(), ck.plus_seconds("_start", offset))
    return rows.join(sized, [*k, "_block"]).withColumn("ts", spread).select(*df.columns)


def minute_second(raw: Column) -> Column:
    """Seconds of an 'MM:SS' token."""
    m = F.regexp_extract(F.trim(raw), r"^(\d+):(\d+(?:\.\d+)?)$", 1).try_cast("double")
    s = F.regexp_extract(F.trim(raw), r"^(\d+):(\d+(?:\.\d+)?)$", 2).try_cast("double")
    return m * 60.0 + s


def elapsed_seconds(raw: Column) -> Column:
    """Seconds of an 'MM:SS' (minutes may pass 59) or 'HH:MM:SS' token."""
    parts = [F.regexp_extract(F.trim(raw), r"^(\d+):(\d{1,2}):(\d+(?:\.\d+)?)$", i).try_cast("double") for i in (1, 2, 3)]
    return F.coalesce(parts[0] * 3600.0 + parts[1] * 60.0 + parts[2], minute_second(raw))


def from_elapsed(raw: Column, start: Column) -> Column:
    return ck.plus_seconds(start, elapsed_seconds(raw))


def unwrap_minutes(df: DataFrame, base: DataFrame, keys: Sequence[str] = SITE, raw: str = "raw") -> DataFrame:
    """Absolute times from 'MM:SS' tokens: every step back is a new hour, counted from ``base.base_ts``.

    Unreadable tokens repeat the one before. ``base`` has one row per record.
    """
    k = list(keys)
    w = minute_second(F.col(raw))
    filled = cut_lineage(scan(df, k, row_slice("seq"), ["seq"], keep_slice=True, lasts={"_w": w}, befores={"_p": w}))
    counted = scan(filled, k, None, ["seq"], sums={"_wraps": F.when(F.col("_w") < F.col("_p"), 1).otherwise(0)})
    first = filled.groupBy(*k).agg(F.min_by("_w", F.when(F.col("_w").isNotNull(), F.col("seq"))).alias("_w0"))
    since = F.col("_wraps") * 3600.0 + F.col("_w") - F.col("_w0")
    return (counted.join(first, k).join(base, k).withColumn("ts", ck.plus_seconds("base_ts", since)).select(*df.columns, "ts"))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trial_start(line: Column) -> Column:
    """Start from a preamble line such as '2024_03_05__9h04m07s': the first word that reads so."""
    words = F.split(line, "[^0-9_hms]+")
    read = F.transform(words, lambda w: F.try_to_timestamp(w, F.lit("yyyy_MM_dd__H'h'mm'm'ss's'")))
    return F.try_element_at(F.filter(read, lambda t: t.isNotNull()), F.lit(1)).cast("timestamp_ntz")


def dates_from_name(stem: Column, modified: Column) -> tuple[Column, Column]:
    """First and last date named in a file: two days each with its month's name, or two of the form month.day.

    A name is cut into its numbers and words. Of a month any beginning of three letters or more will do. The year is the
    one in the name, else the year of ``modified``, or the one before if the start lies ahead of it.
    """
    # each is cut and read once: the places compared below only look up what was read
    parts = F.regexp_extract_all(F.lower(stem), F.lit("([0-9]+|[a-z]+)"), F.lit(1))
    dotted = F.filter(F.split(stem, "[^0-9.]+"), lambda w: F.length(w) > 0)

    def at(array: Column, i: Column) -> Column:
        return F.try_element_at(array, i.cast("int"))

    def number(w: Column) -> Column:
        return F.when(F.length(w) <= 2, w.try_cast("int"))

    def month(w: Column) -> Column:
        return F.when(F.length(w) >= 3, F.coalesce(*[F.when(F.lit(m).startswith(w), i) for i, m in enumerate(MONTHS, 1)]))

    def word(w: Column) -> Column:
        return F.struct(number(w).alias("d"), month(w).alias("m"))

    def month_and_day(w: Column) -> Column:
        two = F.split(w, "[.]")
        return let(two, lambda t: F.when(F.size(t) == 2, F.struct(number(F.get(t, F.lit(0))).alias("m"), number(F.get(t, F.lit(1))).alias("d"))))

    def pairs(array: Column, step: int, first, second) -> Column:
        """What ``first`` and ``second`` read at the earliest place where both read something."""
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1))), lambda i: F.struct(
            first(i).alias("a"), second(i + step).alias("b")))
        whole = lambda x: x["m"].isNotNull() & x["d"].isNotNull()
        return at(F.filter(found, lambda x: whole(x["a"]) & whole(x["b"])), F.lit(1))

    def named(words: Column) -> Column:
        def spelled(i: Column) -> Column:
            return F.struct(at(words, i + 1)["m"].alias("m"), at(words, i)["d"].alias("d"))
        return pairs(words, 2, spelled, spelled)

    def plain(marked: Column) -> Column:
        return pairs(marked, 1, lambda i: at(marked, i), lambda i: at(marked, i))

    def years(words: Column) -> Column:
        return F.filter(words, lambda w: (F.length(w) == 4) & (w.startswith("19") | w.startswith("20")) & w.try_cast("int").isNotNull())

    def date(y: Column, md: Column) -> Column:
        return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, md["m"], md["d"]), F.lit("yyyy-MM-dd")).cast("date")

    def dated(x: Column) -> Column:
        ahead = date(F.year(x["now"]), x["p"]["a"]) > x["now"]
        year = F.coalesce(x["y"], F.year(x["now"]) - F.when(ahead, 1).otherwise(0))
        return let(year, lambda y: F.struct(date(y, x["p"]["a"]).alias("a"), date(y, x["p"]["b"]).alias("b")))

    def dates(x: Column) -> Column:
        return F.when(x["p"].isNotNull() & F.coalesce(x["y"], F.year(x["now"])).isNotNull(), dated(x))

    def said(words: Column) -> Column:
        found = F.coalesce(let(F.transform(words, word), named), let(F.transform(dotted, month_and_day), plain))
        return F.struct(found.alias("p"), at(years(words), F.lit(1)).cast("int").alias("y"), F.to_date(modified).alias("now"))

    found = let(let(parts, said), dates)
    known = let(found, lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), x))
    return known["a"], known["b"]


def start_time_from_name(stem: Column) -> Column:
    """'HH:MM' of the first window in a file name that runs forwards within a day, such as '9.00-17.30'.

    A window is two clock times on the two sides of a dash; a clock time is an hour, a dot and two digits.
    """
    def minutes(word: Column) -> Column:
        def read(two: Column) -> Column:
            hour, minute = F.get(two, F.lit(0)), F.get(two, F.lit(1))
            h, m = hour.try_cast("int"), minute.try_cast("int")
            fits = (F.size(two) == 2) & (F.length(hour) <= 2) & (F.length(minute) == 2)
            return F.when(fits & h.between(0, 23) & m.between(0, 59), h * 60 + m)
        return let(F.split(word, "[.]"), read)

    def ends(side: Column) -> Column:
        """The first and the last word of a side, as minutes."""
        return let(F.split(side, "[^0-9.]+"), lambda words: F.struct(
            minutes(F.try_element_at(words, F.lit(1))).alias("first"), minutes(F.try_element_at(words, F.lit(-1))).alias("last")))

    def windows(sides: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(sides)), lambda i: F.struct(
            F.try_element_at(sides, i)["last"].alias("a"), F.try_element_at(sides, i + 1)["first"].alias("b")))

    found = let(F.transform(F.split(stem, " *[-–] *"), ends), windows)
    start = F.try_element_at(F.filter(found, lambda w: w["b"] > w["a"]), F.lit(1))["a"]
    return let(start, lambda s: F.when(s.isNotNull(), F.format_string("%02d:%02d", F.floor(s / 60), s % 60)))

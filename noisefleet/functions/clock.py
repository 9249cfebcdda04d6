"""Wall-clock arithmetic on TIMESTAMP_NTZ columns, and driver-side facts about time zones."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "America/New_York"
FIRST_YEAR, LAST_YEAR = 1970, 2100
# Hours within which a change of offset is felt by the wall times around it.
NEARBY_H = 3

# Labels of the zones a user is offered.
ZONE_LABELS = {
    "America/New_York": "US Eastern, with daylight saving (EST/EDT)",
    "Etc/GMT+5": "US Eastern standard time all year (UTC−5)",
    "America/Chicago": "US Central, with daylight saving (CST/CDT)",
    "America/Denver": "US Mountain, with daylight saving (MST/MDT)",
    "America/Phoenix": "US Mountain, no daylight saving (Arizona, UTC−7)",
    "America/Los_Angeles": "US Pacific, with daylight saving (PST/PDT)",
    "UTC": "Coordinated Universal Time (UTC)",
    "Europe/London": "UK (GMT/BST)",
    "Europe/Berlin": "Central Europe (CET/CEST)",
    "Asia/Kolkata": "India (IST, UTC+5:30)",
}


class ClockError(ValueError):
    """A time zone or clock setting that cannot be used."""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_zone(name: str) -> str:
    if name not in available_timezones():
        raise ClockError(f"'{name}' is not a recognised time zone.")
    return name


def zone_label(name: str) -> str:
    return ZONE_LABELS.get(name, name)


def ntz(value: str | dt.datetime | dt.date) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(1e6)


def plus_seconds(ts: Column | str, seconds: Column | float) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_add("MICROSECOND", F.round(s * 1e6).cast("long"), col(ts))


def plus_hours(ts: Column | str, hours: Column | int) -> Column:
    return F.timestamp_add("HOUR", hours if isinstance(hours, Column) else F.lit(hours), col(ts))


def hour_start(ts: Column | str) -> Column:
    return F.date_trunc("HOUR", col(ts)).cast("timestamp_ntz")


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a UTC wall time (the session zone is UTC)."""
    return F.unix_seconds(col(ts).cast("timestamp"))


def utc_to_wall(utc: Column | str, zone: str) -> Column:
    # with a literal zone this is several times cheaper per row than convert_timezone
    return F.from_utc_timestamp(col(utc).cast("timestamp"), zone).cast("timestamp_ntz")


def first_instant(ts: Column | str, zone: str) -> Column:
    """UTC of a wall time: a repeated one is its earlier instant, a skipped one moves forward."""
    return F.to_utc_timestamp(col(ts).cast("timestamp"), zone).cast("timestamp_ntz")


def is_skipped(ts: Column | str, zone: str) -> Column:
    """The wall time never happened: clocks jumped over it."""
    return utc_to_wall(first_instant(col(ts), zone), zone) != col(ts)


def _offset_s(utc: Column, zone: str) -> Column:
    return seconds_between(utc, utc_to_wall(utc, zone))


def second_instant(ts: Column | str, zone: str) -> Column:
    """UTC of the second time a repeated wall time was shown, NULL for other times.

    The offset a few hours on is the one behind a change close by, whatever the size of the change.
    """
    first = first_instant(col(ts), zone)
    second = plus_seconds(col(ts), -_offset_s(plus_hours(first, NEARBY_H), zone))
    return F.when((second > first) & (utc_to_wall(second, zone) == col(ts)), second)


def is_repeated(ts: Column | str, zone: str) -> Column:
    """The wall time happened twice."""
    return second_instant(ts, zone).isNotNull()


def shown_before(utc: Column | str, zone: str) -> Column:
    """The wall time of an instant had been shown already: it lies in the second pass of a repeated time."""
    wall = utc_to_wall(utc, zone)
    return first_instant(wall, zone) < col(utc)


def change_before(utc: Column, zone: str) -> Column:
    """The last instant up to ``utc``, within a few hours, at which the zone's offset changed; whole quarters of an hour."""
    quarter = F.timestamp_seconds(F.floor(epoch_seconds(utc) / 900) * 900).cast("timestamp_ntz")
    tried = F.transform(F.sequence(F.lit(0), F.lit(4 * NEARBY_H)), lambda k: F.timestamp_add("MINUTE", k * -15, quarter))
    changed = F.filter(tried, lambda t: _offset_s(t, zone) != _offset_s(F.timestamp_add("SECOND", F.lit(-1), t), zone))
    return F.try_element_at(changed, F.lit(1))


def wall_to_utc(ts: Column | str, zone: str, *, fold: Column | None = None, on_repeated: str = "fold",
                on_skipped: str = "null") -> Column:
    """UTC of a wall time.

    ``on_repeated``: ``fold`` takes the later instant where fold is 1, ``later`` always, ``null`` never
    decides. ``on_skipped``: ``null``, or ``forward`` to the moment the clocks jumped.
    """
    ts = col(ts)
    first = first_instant(ts, zone)
    later = F.coalesce(second_instant(ts, zone), first)
    if on_repeated == "null":
        utc = F.when(~is_repeated(ts, zone), first)
    elif on_repeated == "later":
        utc = later
    else:
        utc = F.when(F.coalesce(fold, F.lit(0)) == 1, later).otherwise(first) if fold is not None else first
    missing = change_before(first, zone) if on_skipped == "forward" else F.lit(None).cast("timestamp_ntz")
    return F.when(is_skipped(ts, zone), missing).otherwise(utc)


@lru_cache(maxsize=64)
def standard_offset_seconds(zone: str) -> int:
    """Standard-time offset: the smaller of the January and July offsets."""
    z = ZoneInfo(check_zone(zone))
    return int(min(dt.datetime(2021, m, 15, 12, tzinfo=z).utcoffset().total_seconds() for m in (1, 7)))


def logger_to_utc(ts: Column | str, zone: str, clock: str) -> Column:
    """UTC of a logger time under its clock mode; times that cannot be placed become NULL."""
    if clock == "utc":
        return col(ts)
    if clock == "local_standard":
        return plus_seconds(ts, float(-standard_offset_seconds(zone)))
    if clock == "local_dst":
        return wall_to_utc(ts, zone, on_repeated="null")
    raise ClockError(f"Unknown clock mode '{clock}'.")


def utc_to_logger(utc: Column | str, zone: str, clock: str) -> Column:
    if clock == "utc":
        return col(utc)
    if clock == "local_standard":
        return plus_seconds(utc, float(standard_offset_seconds(zone)))
    return utc_to_wall(utc, zone)


@lru_cache(maxsize=64)
def offset_changes(zone: str) -> tuple[tuple[dt.datetime, bool], ...]:
    """Wall hours at which the zone's offset changes, with whether that hour is skipped."""
    z, hour = ZoneInfo(check_zone(zone)), dt.timedelta(hours=1)

    def offset(t: dt.datetime) -> dt.timedelta:
        return t.replace(tzinfo=z, fold=1).utcoffset()

    def exists(t: dt.datetime) -> bool:
        aware = t.replace(tzinfo=z)
        return aware.astimezone(dt.timezone.utc).astimezone(z).replace(tzinfo=None) == t

    out, day = [], dt.datetime(FIRST_YEAR, 1, 1)
    while day.year < LAST_YEAR:
        after = day + dt.timedelta(days=1)
        if offset(day) != offset(after):
            probes = [day + i * hour for i in range(25)]
            offsets = [offset(p) if exists(p) else offset(p + hour) for p in probes]
            out += [(p, not exists(p)) for i, p in enumerate(probes) if i and offsets[i] != offsets[i - 1]]
        day = after
    return tuple(out)


@lru_cache(maxsize=64)
def abbreviation_spans(zone: str) -> tuple[tuple[dt.date, dt.date, str], ...]:
    """First and last date of every run of one zone abbreviation, judged at noon."""
    z, runs, day = ZoneInfo(check_zone(zone)), [], dt.date(FIRST_YEAR, 1, 1)
    while day.year < LAST_YEAR:
        name = dt.datetime(day.year, day.month, day.day, 12, tzinfo=z).tzname()
        if runs and runs[-1][2] == name:
            runs[-1][1] = day
        else:
            runs.append([day, day, name])
        day += dt.timedelta(days=1)
    return tuple((a, b, n) for a, b, n in runs)


def abbreviations(zone: str, start: Column, end: Column) -> Column:
    """Zone abbreviations in force from ``start`` to the day after ``end``, in order, joined by '/'."""
    spans = F.expr("array(" + ", ".join(
        f"named_struct('a', DATE '{a}', 'b', DATE '{b}', 'n', '{n}')" for a, b, n in abbreviation_spans(zone)) + ")")
    hit = F.filter(spans, lambda s: (s.b >= F.to_date(start)) & (s.a <= F.date_add(F.to_date(end), 1)))
    return F.array_join(F.array_distinct(F.transform(hit, lambda s: s.n)), "/")


def time_basis(zone: str, start: Column, end: Column) -> Column:
    """Label of the zone plus the abbreviations in force in the record."""
    label, abbr = F.lit(zone_label(zone)), abbreviations(zone, start, end)
    return F.when(start.isNull() | (abbr == "") | F.contains(label, abbr), label).otherwise(
        F.concat(label, F.lit("; "), abbr, F.lit(" in this record")))

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from helpers import steps
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.operators import clocks, continuity

NY = "America/New_York"
T = dt.datetime.fromisoformat


UTC = dt.timezone.utc
# Zones whose changes differ in size, sign of the offset and time of day.
ZONES = ("Europe/Lisbon", "Australia/Lord_Howe", "Australia/Adelaide", "America/St_Johns", "America/Havana", "Asia/Kathmandu", "Africa/Cairo")


def around_changes(zone, year=2023):
    """Instants around each change of a zone in a year, and some far from any."""
    z, out = ZoneInfo(zone), []
    t = dt.datetime(year, 1, 1, tzinfo=UTC)
    while t.year == year:
        after = t + dt.timedelta(minutes=15)
        if t.astimezone(z).utcoffset() != after.astimezone(z).utcoffset():
            out += [after + dt.timedelta(minutes=m) for m in (-121, -61, -59, -31, -29, -1, 0, 1, 29, 31, 59, 61, 121)]
        t = after
    return out + [dt.datetime(year, m, 10, 12, 34, 56, tzinfo=UTC) for m in (2, 8)]


@pytest.mark.parametrize("zone", ZONES)
def test_instants_survive_the_wall_clock(readings, zone):
    instants = around_changes(zone)
    df = readings([t.replace(tzinfo=None) for t in instants], [1] * len(instants))
    wall = clocks.convert_clock(df, "UTC", zone)
    shown = [t.astimezone(ZoneInfo(zone)) for t in instants]
    assert [(r["ts"], r["fold"]) for r in wall.orderBy("seq").collect()] == [(t.replace(tzinfo=None), t.fold) for t in shown]
    back = clocks.convert_clock(wall, zone, "UTC").orderBy("seq").collect()
    assert [r["ts"] for r in back] == [t.replace(tzinfo=None) for t in instants]


@pytest.mark.parametrize("zone, wall, change", [
    ("Australia/Adelaide", "2024-10-06 02:20", "2024-10-05 16:30"), ("Australia/Lord_Howe", "2024-10-06 02:10", "2024-10-05 15:30"),
    ("Europe/Lisbon", "2023-03-26 01:59:59", "2023-03-26 01:00"), ("America/Havana", "2023-03-12 00:00", "2023-03-12 05:00")])
def test_times_that_never_were(spark, readings, zone, wall, change):
    df = readings([wall], [1])
    assert clocks.convert_clock(df, zone, "UTC").count() == 0
    assert clocks.skipped_readings(df, zone).first()["nonexistent_source_readings"] == 1
    assert df.select(ck.wall_to_utc("ts", zone, on_skipped="forward").alias("u")).first()["u"] == T(change)


def test_same_zone_is_left_as_it_is(readings):
    df = readings(["2023-03-26 01:30"], [1])
    assert clocks.convert_clock(df, "Europe/Lisbon", "Europe/Lisbon") is df


def test_many_gaps_do_not_grow_the_evidence(readings):
    times = [t for t in steps("2025-01-01", 4000, 3600) if t.hour % 2 or t.day % 2]
    d = clocks.describe_logger_clock(readings(times, [1] * len(times)), NY).first()
    assert len(d["evidence"]) < 400


def test_second_pass_from_recorded_order(readings):
    df = readings(["2026-11-01 00:30", "2026-11-01 01:00", "2026-11-01 01:30", "2026-11-01 01:00", "2026-11-01 01:30", "2026-11-01 02:00"], [50] * 6)
    marked = clocks.mark_repeated_hour(df)
    assert [r["fold"] for r in marked.orderBy("seq").collect()] == [0, 0, 0, 1, 1, 0]
    key = [r["ord_ts"] for r in clocks.ordering_key(marked).orderBy("seq").collect()]
    assert key == steps("2026-11-01 00:30", 6, 1800)


@pytest.mark.parametrize("rows", [50, 997, 1 << 18])
def test_second_pass_across_slices(readings, monkeypatch, rows):
    utc = steps("2026-11-01 04:00", 3 * 360, 10)
    wall = [t - dt.timedelta(hours=4 if t < T("2026-11-01 06:00") else 5) for t in utc]
    monkeypatch.setattr(clocks, "row_slice", lambda c: F.floor(F.col(c) / rows))
    got = [r["fold"] for r in clocks.mark_repeated_hour(readings(wall, [50] * len(wall))).orderBy("seq").collect()]
    assert got == [1 if T("2026-11-01 06:00") <= t < T("2026-11-01 07:00") else 0 for t in utc]


def test_no_step_back_no_fold(readings):
    df = readings(steps("2026-06-01", 100, 60), [50] * 100)
    assert clocks.mark_repeated_hour(df).where("fold = 1").count() == 0


def test_logger_clock_modes(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2026-03-08 01:59:59', TIMESTAMP_NTZ '2026-03-08 02:30:00', TIMESTAMP_NTZ '2026-03-08 03:00:00',"
                   "TIMESTAMP_NTZ '2026-07-01 12:00:00', TIMESTAMP_NTZ '2026-11-01 01:30:00')) AS ts")
    rows = df.select(*[ck.logger_to_utc("ts", NY, m).alias(m) for m in ("local_dst", "local_standard", "utc")]).collect()
    assert [r["local_dst"] for r in rows] == [T("2026-03-08 06:59:59"), None, T("2026-03-08 07:00"), T("2026-07-01 16:00"), None]
    assert rows[3]["local_standard"] == T("2026-07-01 17:00") and rows[3]["utc"] == T("2026-07-01 12:00")


def test_spring_jump_is_a_clock_change_not_a_gap(readings):
    utc = steps("2026-03-08 06:30", 60, 60)
    wall = [t - dt.timedelta(hours=5 if t < T("2026-03-08 07:00") else 4) for t in utc]
    df = readings(wall, [50] * 60)
    assert continuity.gaps(df, NY).count() == 0
    c = continuity.clock_changes(df, NY).collect()
    assert [(r["before"], r["after"], r["shift_seconds"], r["elapsed_seconds"]) for r in c] == [
        (T("2026-03-08 01:59"), T("2026-03-08 03:00"), 3600.0, 60.0)]
    s = continuity.gap_summary(df, NY).first()
    assert s["expected_rows"] == 60 and s["uptime_pct"] == 100.0 and s["n_clock_changes"] == 1 and s["continuous"]
    assert continuity.completeness(df, NY).first()["completeness_pct"] == pytest.approx(100.0)
    d = clocks.describe_logger_clock(df, NY).first()
    assert d["follows_dst"] is True and "08 Mar 2026: 01:59:00 is followed by 03:00:00" in d["evidence"]


def test_clock_that_ignores_the_change(readings):
    df = readings(steps("2026-03-08 00:30", 240, 60), [50] * 240)
    d = clocks.describe_logger_clock(df, NY).first()
    assert d["follows_dst"] is False and "08 Mar 2026" in d["evidence"]
    c = clocks.check_clock_setting(df, NY, "local_dst").first()
    assert c["n_inside"] == 60 and "60 readings lie from 02:00 to 03:00" in c["contradiction"]
    assert clocks.check_clock_setting(df, NY, "local_standard").count() == 0
    summer = readings(steps("2026-06-01", 10, 60), [50] * 10)
    assert clocks.describe_logger_clock(summer, NY).first()["follows_dst"] is None


def test_standard_time_setting_contradicted(readings):
    wall = steps("2026-03-08 01:00", 60, 60) + steps("2026-03-08 03:00", 60, 60)
    assert "01:59:00 the times go on at 03:00:00" in clocks.check_clock_setting(readings(wall, [50] * 120), NY, "local_standard").first()["contradiction"]


def test_zone_names(readings):
    r = clocks.time_basis(readings(["2026-03-01", "2026-03-20"], [1, 1]), NY).first()
    assert r["abbreviations"] == "EST/EDT" and r["time_basis"] == "US Eastern, with daylight saving (EST/EDT)"
    r = clocks.time_basis(readings(["2026-07-01", "2026-07-02"], [1, 1]), NY).first()
    assert r["abbreviations"] == "EDT"
    assert ck.standard_offset_seconds(NY) == -5 * 3600
    with pytest.raises(ck.ClockError):
        ck.check_zone("Mars/Olympus_Mons")

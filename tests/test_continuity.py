from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from helpers import steps

from noisefleet.operators import continuity as con
from noisefleet.operators import filters as flt
from noisefleet.operators import periods as per
from noisefleet.operators import aggregates as agg

T = dt.datetime.fromisoformat


def test_overlapping_files(spark):
    a = [("A", 0, i, t, 0, 50.0) for i, t in enumerate(steps("2026-04-06 09:00", 1000, 1))]
    b = [("A", 1, i, t, 0, 60.0) for i, t in enumerate(steps("2026-04-06 09:15", 1000, 1))]
    df = spark.createDataFrame(a + b + [("A", 1, 1000, None, 0, 1.0)], "site_id string, file_seq int, seq bigint, ts timestamp_ntz, fold tinyint, leq double")
    merged, notes = con.merge_files(df)
    assert merged.count() == 1900
    assert merged.where("leq = 50").count() == 1000          # the earlier file wins
    text = {r["code"]: r["text"] for r in notes.collect()}
    assert text["duplicate_time"].endswith(": 100") and text["unreadable_time"].endswith(": 1 of 2,001")
    assert {(r["file_seq"], r["rows"]) for r in con.file_details(df).collect()} == {(0, 1000), (1, 1001)}


def test_gap_numbers(readings):
    times = steps("2026-06-01", 100, 1) + steps("2026-06-01 00:10:00", 100, 1) + steps("2026-06-01 01:00:00", 10, 1)
    df = readings(times, [50] * len(times))
    g = con.gaps(df).orderBy("gap_start").collect()
    assert [(r["duration_seconds"], r["missing_seconds"], r["category"]) for r in g] == [(501.0, 500.0, "Minor"), (2901.0, 2900.0, "Major")]
    assert g[0]["duration_human"] == "8 min 20 s" and g[0]["label"] == "8 min 20 s missing after 2026-06-01 00:01:39, up to 2026-06-01 00:10:00"
    s = con.gap_summary(df).first()
    assert s["total_rows"] == 210 and s["expected_rows"] == 3610 and s["gap_count"] == 2 and s["uptime_pct"] == 5.81


def test_exclusions_are_not_data_loss(readings, spark):
    times = steps("2026-06-01", 100, 60) + steps("2026-06-01 05:00", 100, 60)
    x = spark.createDataFrame([("A", T("2026-06-01 01:40"), T("2026-06-01 04:59"))], "site_id string, start timestamp_ntz, end timestamp_ntz")
    df = readings(times, [50] * 200)
    s = con.gap_summary(df, exclusions=x).first()
    assert s["continuous"] and s["uptime_pct"] == 100.0
    assert con.excluded_gaps(df, x).count() == 1 and con.gaps(df, exclusions=x).count() == 0


def test_single_reading_and_intervals(readings):
    assert con.modal_interval(readings(["2026-01-01"], [50])).first()["interval_s"] == 1.0
    s = con.gap_summary(readings(["2026-01-01"], [50])).first()
    assert s["uptime_pct"] == 100.0 and s["total_rows"] == 1 and s["expected_rows"] == 0
    tie = ["2026-01-01 00:00:00", "2026-01-01 00:00:05", "2026-01-01 00:00:07"]
    assert con.modal_interval(readings(tie, [1, 1, 1])).first()["interval_s"] == 2.0


def greedy(events, n, sep):
    out = []
    for e in sorted(events, key=lambda e: (-e[1], e[0])):
        if len(out) < n and all(abs((e[0] - s[0]).total_seconds()) > sep for s in out):
            out.append(e)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_top_events_equal_the_greedy_choice(readings, seed):
    rng = np.random.default_rng(seed)
    n = 4000
    levels = np.where(rng.random(n) < 0.12, np.minimum(90, np.round(75 + rng.exponential(4, n))), 50.0)   # many tied peaks
    events = con.noise_events(readings(steps("2026-06-01", n, 2), levels))
    all_events = [(r["peak_time"], r["peak"]) for r in events.collect()]
    got = [(r["peak_time"], r["peak"]) for r in con.top_events(events).orderBy("rank").collect()]
    assert got == greedy(all_events, 10, 300)


def test_event_edges(readings):
    levels = [50.0] * 100
    for i in (10, 11, 12, 40, 42, 70, 71, 72, 73, 74):
        levels[i] = 80.0 + i / 100
    e = con.noise_events(readings(steps("2026-06-01", 100, 1), levels)).orderBy("start").collect()
    assert [r["n_readings"] for r in e] == [3, 1, 1, 5]
    assert e[0]["duration_s"] == 3.0 and e[0]["peak"] == 80.12 and e[0]["peak_time"] == T("2026-06-01 00:00:12")


def test_date_only_end_is_that_whole_day(readings):
    df = readings(steps("2026-09-01", 48, 3600), [40.1] * 24 + [80.1] * 24)
    day = flt.between(df, None, "2026-09-01")
    assert day.count() == 24
    assert agg.rating_levels(day).first()["lden"] == pytest.approx(agg.rating_levels(readings(steps("2026-09-01", 24, 3600), [40.1] * 24)).first()["lden"])


def test_empty_result_is_refused(readings):
    df = readings(steps("2026-09-01", 48, 3600), [40.1] * 48)
    with pytest.raises(flt.FilterError, match="01 Sep 2026"):
        flt.refuse_empty(flt.filter_report(flt.mark_kept(df, "2027-01-01", None)))
    with pytest.raises(flt.FilterError):
        flt.parse_bound("soon", end=False)


def test_kept_and_removed_add_up(readings, spark):
    df = readings(steps("2026-09-01", 96, 1800), [40.1] * 96)
    x = spark.createDataFrame([("A", T("2026-09-01 06:00"), T("2026-09-01 08:00"))], "site_id string, start timestamp_ntz, end timestamp_ntz")
    m = flt.mark_kept(df, "2026-09-01 01:00", "2026-09-02 10:00", x)
    r = flt.filter_report(m).first()
    assert r["retained_rows"] + r["dropped_rows"] == 96
    w = [(a["start"], a["end"]) for a in flt.removed_windows(m).orderBy("start").collect()]
    assert w == [(T("2026-09-01"), T("2026-09-01 00:30")), (T("2026-09-01 06:00"), T("2026-09-01 08:00")), (T("2026-09-02 10:30"), T("2026-09-02 23:30"))]


def test_minutes_of_a_repeated_hour_stay_apart(readings):
    from noisefleet.operators import clocks
    df = readings(["2026-11-01 01:10:00", "2026-11-01 01:10:30", "2026-11-01 01:10:30"], [50, 50, 70], fold=[0, 0, 1])
    m = per.minute_levels(clocks.ordering_key(df)).orderBy("laeq").collect()
    assert [(r["readings"], r["second_pass"]) for r in m] == [(2, ""), (1, "yes")]

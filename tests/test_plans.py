from __future__ import annotations

import numpy as np
import pytest
from helpers import steps

from noisefleet.operators import compare
from noisefleet.plans import analyse
from noisefleet.sources import sinks


def test_tables_agree_under_one_filter(readings, spark, tmp_path):
    rng = np.random.default_rng(1)
    leq = rng.normal(55, 6, 2 * 288)
    df = readings(steps("2026-06-01", 2 * 288, 300), leq, leq + 5, leq - 5)
    day = analyse.filter_record(df, start="2026-06-01", end="2026-06-01")
    tables = analyse.result_tables(day, environment="indoor")
    got = {n: t.collect() for n, t in tables.items()}
    level = {r["metric"]: r["level_db"] for r in got["period_levels"]}
    assert got["daily"][0]["laeq"] == pytest.approx(level["LAeq, whole record"]) == pytest.approx(got["key_findings"][0]["avg_laeq"])
    rows = {r["row"]: r for r in got["guideline_comparison"]}
    assert rows[1]["measured_db"] == pytest.approx(level["Lden"], abs=0.0501) and len(rows) == 10
    assert rows[8]["kind"] == "indicative" and rows[1]["status"] == ("ABOVE" if level["Lden"] > 53 else "AT OR BELOW")
    assert {r["item"]: r["value"] for r in got["about"]}["Readings analysed"] == "288"
    assert got["gap_summary"][0]["uptime_pct"] == 100.0 and len(got["minute_levels"]) == 288
    sinks.write_tables({"daily": tables["daily"]}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "daily")).count() == 1


def test_missing_levels_leave_no_row(readings):
    night = readings(steps("2026-06-01 23:00", 60, 60), [50.0] * 60)
    rows = [r["row"] for r in compare.compliance_matrix(compare.limit_inputs(night)).collect()]
    assert sorted(rows) == [2, 4, 6, 10]


def test_ranking_falls_back_for_all_sites(spark):
    cols = "site_id string, lden double, lnight double, laeq double, completeness_pct double"
    full = spark.createDataFrame([("A", 60.0, 50.0, 58.0, 99.0), ("B", 50.0, 40.0, 59.0, 80.0), ("C", 50.0, 44.0, 57.0, 99.0)], cols)
    got = {r["site_id"]: (r["rank"], r["ranked_by"]) for r in compare.rank_sites(full).collect()}
    assert got == {"A": (3, "Lden"), "B": (1, "Lden"), "C": (1, "Lden")}
    part = full.union(spark.createDataFrame([("D", None, None, 40.0, None)], cols))
    got = {r["site_id"]: (r["rank"], r["ranked_by"]) for r in compare.rank_sites(part).collect()}
    assert got == {"D": (1, "LAeq"), "C": (2, "LAeq"), "A": (3, "LAeq"), "B": (4, "LAeq")}
    s = compare.comparison_summary(part).first()
    assert (s["quietest"], s["loudest"], s["gap_db"], s["n_exceed_day"], s["n_exceed_night"], s["n_incomplete"]) == ("D", "B", 19.0, 1, 1, 1)

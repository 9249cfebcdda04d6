from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from noisefleet.operators import peaks, ranks, scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"site_id": rng.choice(["A", "B", "C"], 400, p=[0.8, 0.15, 0.05]), "seq": rng.permutation(2000)[:400],
                        "v": rng.integers(0, 20, 400).astype(float)})
    pdf.loc[rng.random(400) < 0.3, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df, pdf.sort_values(["site_id", "seq"]).reset_index(drop=True)


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_scan_equals_an_unsliced_window(rows, width):
    df, pdf = rows
    got = scans.scan(df, ["site_id"], scans.row_slice("seq", width), ["seq"], lags={"lag": F.col("v")}, leads={"lead": F.col("v")},
                     sums={"run": F.coalesce("v", F.lit(0.0))}, lasts={"last": F.col("v")}, befores={"before": F.col("v")})
    got = got.toPandas().sort_values(["site_id", "seq"]).reset_index(drop=True)
    g = pdf.groupby("site_id")["v"]
    want = {"lag": g.shift(1), "lead": g.shift(-1), "run": pdf["v"].fillna(0).groupby(pdf["site_id"]).cumsum(), "last": g.ffill(),
            "before": g.ffill().groupby(pdf["site_id"]).shift(1)}
    for name, w in want.items():
        np.testing.assert_allclose(got[name].astype(float), w.astype(float), err_msg=name)


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_pairs_are_all_neighbours(rows, width):
    df, pdf = rows
    p = scans.pairs(df, ["site_id"], scans.row_slice("seq", width), ["seq"]).select("site_id", "prev.seq", F.col("cur.seq").alias("c")).toPandas()
    got = {(r.site_id, r.c): r.seq for r in p.itertuples()}
    prev = pdf.groupby("site_id")["seq"].shift(1)
    assert len(got) == len(p) == 400
    for s, c, b in zip(pdf["site_id"], pdf["seq"], prev):
        assert (np.isnan(b) and np.isnan(got[s, c])) or got[s, c] == b


def test_top_rows(rows):
    df, pdf = rows
    top = scans.top_rows(df, ["site_id"], F.col("seq") % 5, [F.desc("seq")], 4).toPandas()
    want = pdf.sort_values("seq", ascending=False).groupby("site_id").head(4)
    assert set(zip(top.site_id, top.seq)) == set(zip(want.site_id, want.seq))


def test_percentiles_with_one_level_holding_most_rows(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([np.full(3000, 50.0), rng.normal(50, 30, 999), [-5000.0, 9000.0]])
    df = spark.createDataFrame(pd.DataFrame({"site_id": "A", "leq": v}))
    r = ranks.percentiles(df, ["site_id"], "leq", {"a": 0.05, "b": 0.5, "c": 0.987, "lo": 0.0, "hi": 1.0}).collect()[0]
    for name, p in (("a", 5), ("b", 50), ("c", 98.7), ("lo", 0), ("hi", 100)):
        assert r[name] == pytest.approx(np.percentile(v, p), abs=1e-9)


def brute_peaks(x, sd):
    """Local maxima (flat tops once) whose prominence, by its definition, reaches sd."""
    out, n, i = [], len(x), 1
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                a = i
                while a > 0 and x[a - 1] <= x[i]:
                    a -= 1
                b = j
                while b < n - 1 and x[b + 1] <= x[i]:
                    b += 1
                if x[i] - max(min(x[a:i + 1]), min(x[i:b + 1])) >= sd:
                    out.append((i, x[i]))
            i = j + 1
        else:
            i += 1
    return out


@pytest.mark.parametrize("seed, width", [(0, 5), (1, 16), (2, 33), (3, 1000)])
def test_peaks_equal_the_definition(spark, seed, width):
    rng = np.random.default_rng(seed)
    # whole levels, so flat tops and ties cross slices
    x = np.round(50 + np.cumsum(rng.normal(0, 1.2, 300))).astype(float)
    x[100:140] = x[100]
    sd = float(np.std(x, ddof=1))
    df = spark.createDataFrame(pd.DataFrame({"site_id": "A", "seq": np.arange(300), "leq": x}))
    got = sorted((r["seq"], r["level"]) for r in peaks.prominent_peaks(df, rows_per_slice=width).collect())
    assert got == brute_peaks(x, sd)
    s = peaks.peak_summary(df, rows_per_slice=width).collect()[0]
    want = [v for _, v in brute_peaks(x, sd)]
    assert s["number_of_peaks"] == len(want) and s["top5_by_level"] == sorted(want, reverse=True)[:5]
    assert s["last5_in_time"] == want[-5:]


def test_ranks_of_levels_that_are_not_rounded(spark):
    """One site in a quarter of a decibel, levels below zero and beyond the bins, ties: every rank as in a plain sort."""
    rng = np.random.default_rng(6)
    v = np.concatenate([50 + rng.random(4000) / 4, -rng.random(300), rng.choice([49.999999, 50.0, 50.25], 300), rng.normal(0, 4000, 200)])
    sites = np.where(rng.random(len(v)) < 0.9, "A", "B")
    df = spark.createDataFrame(pd.DataFrame({"site_id": sites, "leq": v}))
    got = ranks.ranked(ranks.value_counts(df, ["site_id"]), ["site_id"]).toPandas()
    for site, g in got.groupby("site_id"):
        held = np.sort(v[sites == site])
        assert (g["n_total"] == len(held)).all() and len(g) == len(np.unique(held))
        np.testing.assert_array_equal(g["rank0"], np.searchsorted(held, g["v"], "left"))
        np.testing.assert_array_equal(g["rank1"], np.searchsorted(held, g["v"], "right"))


def test_hot_quarter_decibel_spreads_over_cells(spark):
    """No window partition holds the readings of a level bin: the rows of a bin stand in hundreds of cells."""
    df = spark.range(20000).select(F.lit("A").alias("site_id"), (50 + F.rand(3) / 4).alias("leq"))
    at = F.col("leq") / ranks.BIN_WIDTH
    cells = df.groupBy(F.floor(at).alias("b"), F.floor((at - F.floor(at)) * ranks.FINE_BINS).alias("f")).count()
    assert cells.agg(F.max("count")).first()[0] < 60 and cells.count() == ranks.FINE_BINS
    r = ranks.percentiles(df, ["site_id"], "leq", {"a": 0.5}).first()
    assert r["a"] == pytest.approx(np.percentile(df.toPandas()["leq"], 50), abs=1e-12)

"""From files to the reading table: parse times, spread ties, mark the repeated hour, merge a site's files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefleet.operators import clocks, continuity
from noisefleet.operators.scans import SITE
from noisefleet.session import cut_lineage
from noisefleet.sources import files, timestamps

READING = ("site_id", "file_seq", "seq", "ts", "fold", "leq", "lmax", "lmin")
FILE = ("path",)


def to_readings(raw: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Readings from what a file reader returns, each file on its own: ``raw`` text or ``ts`` times.

    ``sites`` names the site and place in line of every path; without it a file is its own site.
    """
    df = raw
    for c in ("leq", "lmax", "lmin"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    if "ts" not in df.columns:
        # the text is parsed once; ties and folds go over the result several times
        df = cut_lineage(timestamps.parse_times(df, FILE).drop("raw", "method"))
    df = timestamps.expand_ties(df.drop("fold") if "fold" in df.columns else df, FILE)
    df = clocks.mark_repeated_hour(df, FILE)
    if sites is None:
        df = df.withColumn("site_id", files.site_of(F.col("path"))).withColumn("file_seq", F.lit(0))
    else:
        df = df.join(sites.select("path", "site_id", F.col("file_seq").cast("int").alias("file_seq")), "path")
    return df.select(*READING)


def merge_sites(readings: DataFrame, keys: Sequence[str] = SITE) -> tuple[DataFrame, DataFrame]:
    """One record per site from the readings of its files, numbered in time, and the notes on what was left out."""
    merged, notes = continuity.merge_files(readings, keys)
    return continuity.in_time_order(merged, keys), notes

"""A weather screen from landed observations to screened readings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.operators import weather as wx
from noisefleet.session import cut_lineage


@dataclass(frozen=True)
class Screen:
    """Tables of one weather screen. ``readings`` carry ``reason``: NULL keeps a reading."""
    minutes: DataFrame
    blocks: DataFrame
    record_blocks: DataFrame
    readings: DataFrame
    quality: DataFrame
    cfg: wx.ScreenConfig
    keys: tuple[str, ...]

    def summary(self) -> DataFrame:
        return wx.screen_summary(self.readings, self.record_blocks, self.minutes, self.cfg, self.keys)

    def kept(self) -> DataFrame:
        return self.readings.where(F.col("reason").isNull()).drop("reason", "block")


def build_screen(readings: DataFrame, onemin: DataFrame, metar: DataFrame, snow_daily: DataFrame, cfg: wx.ScreenConfig,
                 zone: str, clock: str, keys: Sequence[str] = wx.STATION) -> Screen:
    """Minutes, snow cover and blocks around each record, then the reason per reading.

    Every table carries ``keys``: the station, or the site when each site has its own station copy.
    Blocks are classified from one more than the buffer before the record to as far after it. Minutes
    and blocks are far smaller than readings and read several times, so they are written once.
    """
    k = list(keys)
    minutes = cut_lineage(wx.minute_states(onemin, metar, k))
    block = wx.block_key(ck.logger_to_utc("ts", zone, clock), cfg.block_minutes)
    pad = max(cfg.buffer_before_blocks, cfg.buffer_after_blocks) + 1
    span = cut_lineage(readings.groupBy(*k).agg(F.min(block).alias("_a"), F.max(block).alias("_b")).where(F.col("_a").isNotNull()))

    def start(b: str, by: int):
        return F.timestamp_seconds((F.col(b) + by) * cfg.block_minutes * 60).cast("timestamp_ntz")

    padded = span.select(*k, start("_a", -pad).alias("start_utc"), start("_b", pad).alias("end_utc"))
    dates = padded.select(*k, F.explode(F.sequence(F.to_date(ck.utc_to_wall("start_utc", zone)),
                                                   F.to_date(ck.utc_to_wall("end_utc", zone)))).alias("date"))
    snow = wx.snow_cover_status(snow_daily, dates, cfg, k)
    blocks = cut_lineage(wx.classify_blocks(minutes, padded, cfg, zone, snow, k))
    inside = blocks.join(span, k).where(F.col("block").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return Screen(minutes, blocks, inside, wx.apply_screen(readings, inside, cfg, zone, clock, k),
                  wx.assess_identifier(onemin, metar, k), cfg, tuple(k))

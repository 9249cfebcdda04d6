"""Weather screening: station minutes, blocks, snow cover and the readings they remove."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.functions import weather as wx
from noisefleet.operators.scans import SITE

STATION = ("station",)
# Reasons in the order in which they win.
REASONS = ("precipitation", "thunder", "wind", "snow_cover", "precip_buffer", "snow_cover_unverified",
           "weather_unverified", "clock_ambiguous")
IDENTIFIER_DISAGREEMENT_LIMIT = 0.20


class ScreenError(ValueError):
    """A weather screen that cannot be built or applied."""


def _limited(default, low: float, high: float, above: bool = False):
    """A setting with its range; ``above`` shuts the lower end out."""
    return field(default=default, metadata={"low": low, "high": high, "above": above})


@dataclass(frozen=True)
class ScreenConfig:
    """Screening rules and their limits."""
    block_minutes: int = _limited(15, 5, 15)
    wind_limit_ms: float = _limited(5.0, 0, 30, above=True)
    mic_height_m: float = _limited(1.5, 0, 30, above=True)
    anemometer_height_m: float = _limited(10.0, 0, 100, above=True)
    roughness_length_m: float = _limited(0.05, 0, 100, above=True)
    buffer_before_blocks: int = _limited(1, 0, 8)
    buffer_after_blocks: int = _limited(1, 0, 8)
    snow_depth_limit_mm: float = _limited(25.4, 0, 1000, above=True)
    slot_minutes: int = _limited(5, 1, 15)
    screen_station_wind: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            value, low, high = getattr(self, f.name), f.metadata.get("low"), f.metadata.get("high")
            if f.type == "int" and type(value) is not int:
                raise ScreenError(f"{f.name} is a whole number")
            if low is not None and not (low <= value <= high and (value > low or not f.metadata["above"])):
                raise ScreenError(f"{f.name} lies {'above' if f.metadata['above'] else 'between'} {low} and {high} at most")
        if 60 % self.block_minutes or self.block_minutes % 5:
            raise ScreenError("blocks of 5, 10 or 15 minutes fill an hour")
        if self.block_minutes % self.slot_minutes:
            raise ScreenError("slots fill a block")
        if min(self.mic_height_m, self.anemometer_height_m) <= self.roughness_length_m:
            raise ScreenError("instruments stand above the roughness length")

    @property
    def wind_factor(self) -> float:
        return wx.wind_factor(self.mic_height_m, self.anemometer_height_m, self.roughness_length_m)


def block_key(utc: Column | str, minutes: int) -> Column:
    """Whole number of blocks since 1970, NULL for a time that is not placed in UTC."""
    return F.floor(ck.epoch_seconds(utc) / F.lit(minutes * 60))


def _minute(c: str = "valid_utc") -> Column:
    return F.date_trunc("MINUTE", c).cast("timestamp_ntz")


def minute_states(onemin: DataFrame, metar: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    """One row per station and observed UTC minute, from both sources.

    Wet wins over dry and dry over unknown; a tipping-bucket amount is wet whatever the code says.
    """
    tipped = F.coalesce(F.col("precip"), F.lit(0.0)) > 0
    kind = F.coalesce(wx.ptype_kind("ptype"), F.when(tipped, "other"))
    no = F.lit(False)

    def peak(gust: str) -> Column:
        return F.greatest(wx.usable_wind("sknt"), wx.usable_wind(gust))

    def is_kind(k: str) -> Column:
        return F.coalesce(kind == k, no).alias(k)

    one = onemin.select(
        *keys, _minute().alias("minute"), F.when(tipped, 1.0).otherwise(wx.ptype_state("ptype")).alias("state"),
        is_kind("rain"), is_kind("snow"), is_kind("other"), no.alias("thunder"), F.lit(True).alias("src_1min"),
        wx.usable_wind("sknt").alias("wind_kt"), peak("gust_sknt").alias("wind_peak_kt"))
    flags = wx.metar_flags("wxcodes", "metar")
    met = metar.select(
        *keys, _minute().alias("minute"), *[flags[n].alias(n) for n in ("state", "rain", "snow", "other", "thunder")],
        F.lit(False).alias("src_1min"), wx.usable_wind("sknt").alias("wind_kt"), peak("gust").alias("wind_peak_kt"))
    return one.unionByName(met).groupBy(*keys, "minute").agg(
        F.max("state").alias("state"), *[F.bool_or(c).alias(c) for c in ("rain", "snow", "other", "thunder")],
        F.bool_or("src_1min").alias("src_1min"), F.bool_or(~F.col("src_1min")).alias("src_metar"),
        F.max("wind_kt").alias("wind_kt"), F.max("wind_peak_kt").alias("wind_peak_kt"))


def _shared_minutes(onemin: DataFrame, metar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minutes seen by both sources, the last report of each minute."""
    def last(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        return (df.groupBy(*keys, _minute().alias("minute"))
                .agg(F.max_by(F.struct(*cols), F.struct("valid_utc", "seq")).alias(name)))
    return last(onemin, ["ptype", "tmpf", "precip"], "o").join(last(metar, ["wxcodes", "metar"], "m"), [*keys, "minute"])


def _states_of_both(shared: DataFrame, warm_snow_is_unknown: bool) -> DataFrame:
    code = F.col("o.ptype")
    warm = F.coalesce(wx.fahrenheit_to_c(F.col("o.tmpf")) > wx.IMPOSSIBLE_SNOW_TEMP_C, F.lit(False))
    odd = warm & F.coalesce(wx.ptype_kind(code) == "snow", F.lit(False))
    s1 = F.when(odd, None).otherwise(wx.ptype_state(code)) if warm_snow_is_unknown else wx.ptype_state(code)
    s1 = F.when(F.coalesce(F.col("o.precip"), F.lit(0.0)) > 0, 1.0).otherwise(s1)
    s2 = wx.metar_flags(F.col("m.wxcodes"), F.col("m.metar"))["state"]
    return shared.withColumn("odd", odd).withColumn("s1", s1).withColumn("s2", s2)


def assess_identifier(onemin: DataFrame, metar: DataFrame, keys: Sequence[str] = STATION, least_minutes: int = 200) -> DataFrame:
    """Whether the 1-minute precipitation sensor agrees with the station's own reports; NULL under ``least_minutes``
    shared minutes, so that the caller decides what too short a comparison means."""
    b = _states_of_both(_shared_minutes(onemin, metar, keys), True)
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    g = b.groupBy(*keys).agg(
        F.count_if(both).alias("minutes_compared"), F.count_if(both & (F.col("s1") == 1) & (F.col("s2") == 0)).alias("_o"),
        F.count_if(both & (F.col("s1") == F.col("s2"))).alias("_a"), F.count_if("odd").alias("impossible_snow_minutes"))
    n = F.col("minutes_compared")
    enough = n >= least_minutes
    return g.select(*keys, F.when(enough, F.col("_o") / n <= IDENTIFIER_DISAGREEMENT_LIMIT).alias("reliable"),
                    "minutes_compared", F.when(enough, 100.0 * F.col("_o") / n).alias("only_1min_pct"),
                    F.when(enough, 100.0 * F.col("_a") / n).alias("agree_pct"), "impossible_snow_minutes")


def source_agreement(onemin: DataFrame, metar: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    """Wet and dry minutes of the two sources against each other."""
    b = _states_of_both(_shared_minutes(onemin, metar, keys), False)
    s1, s2 = F.col("s1"), F.col("s2")
    b = b.where(s1.isNotNull() & s2.isNotNull())
    n = F.count(F.lit(1))
    return b.groupBy(*keys).agg(
        n.alias("minutes_compared"), (100.0 * F.count_if(s1 == s2) / n).alias("agree_pct"),
        F.count_if((s1 == 1) & (s2 == 1)).alias("both_precip"), F.count_if((s1 == 1) & (s2 == 0)).alias("only_1min_precip"),
        F.count_if((s1 == 0) & (s2 == 1)).alias("only_metar_precip"))


def block_observations(minutes: DataFrame, cfg: ScreenConfig, keys: Sequence[str] = STATION) -> DataFrame:
    """Minutes reduced to slots and slots to blocks; a block is verified when every slot of it is."""
    m = minutes.withColumn("block", block_key("minute", cfg.block_minutes)).withColumn(
        "slot", block_key("minute", cfg.slot_minutes))
    flags = ("rain", "snow", "other", "thunder")
    slots = m.groupBy(*keys, "block", "slot").agg(
        F.max("state").alias("state"), (F.count("state") > 0).alias("_p"), (F.count("wind_kt") > 0).alias("_w"),
        F.sum("wind_kt").alias("_ws"), F.count("wind_kt").alias("_wn"), F.max("wind_peak_kt").alias("_peak"),
        *[F.bool_or(c).alias(c) for c in flags], F.count(F.lit(1)).alias("n_minutes"),
        F.count_if("src_1min").alias("n_1min"), F.count_if("src_metar").alias("n_metar"))
    return slots.groupBy(*keys, "block").agg(
        F.coalesce(F.max("state") == 1.0, F.lit(False)).alias("precip"), *[F.bool_or(c).alias(c) for c in flags],
        (F.count_if(F.col("_p") & F.col("_w")) >= cfg.block_minutes // cfg.slot_minutes).alias("verified"),
        (F.try_divide(F.sum("_ws"), F.sum("_wn")) * _knots_at_mic(cfg)).alias("wind_mic_ms"),
        (F.max("_peak") * wx.KNOT_MS).alias("wind_station_max_ms"),
        F.sum("n_minutes").alias("n_minutes"), F.sum("n_1min").alias("n_1min"), F.sum("n_metar").alias("n_metar"))


def _knots_at_mic(cfg: ScreenConfig) -> float:
    """Knots at the anemometer to m/s at the microphone."""
    return wx.KNOT_MS * cfg.wind_factor


def classify_blocks(minutes: DataFrame, span: DataFrame, cfg: ScreenConfig, zone: str, snow: DataFrame | None = None,
                    keys: Sequence[str] = STATION) -> DataFrame:
    """Every block from ``start_utc`` to ``end_utc`` of ``span``, with the first reason to leave it out.

    The spine has one row per block (35,040 a year for 15 minutes), so the buffer windows run over
    the calendar, not over observations.
    """
    part = list(keys)
    spine = span.select(*part, F.explode(F.sequence(
        block_key("start_utc", cfg.block_minutes), block_key("end_utc", cfg.block_minutes))).alias("block"))
    b = spine.join(block_observations(minutes, cfg, keys), [*part, "block"], "left")
    b = b.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("precip", "thunder", "rain", "snow", "other", "verified")})
    b = b.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_minutes", "n_1min", "n_metar")})
    b = b.withColumn("block_start_utc", F.timestamp_seconds(F.col("block") * cfg.block_minutes * 60).cast("timestamp_ntz"))
    b = b.withColumn("local_date", F.to_date(ck.utc_to_wall("block_start_utc", zone)))
    if snow is None:
        b = b.withColumn("snow_status", F.lit(None).cast("string"))
    else:
        b = b.join(snow.select(*part, F.col("date").alias("local_date"), F.col("status").alias("snow_status")),
                   [*part, "local_date"], "left")
    at = Window.partitionBy(*part).orderBy("block")

    def beside(flag: Column) -> Column:
        """A block within reach before or after carries the flag."""
        near = F.lit(False)
        one = F.when(flag, 1).otherwise(0)
        if cfg.buffer_before_blocks:
            near = near | F.coalesce(F.max(one).over(at.rowsBetween(1, cfg.buffer_before_blocks)) == 1, F.lit(False))
        if cfg.buffer_after_blocks:
            near = near | F.coalesce(F.max(one).over(at.rowsBetween(-cfg.buffer_after_blocks, -1)) == 1, F.lit(False))
        return near

    b = (b.withColumn("_buffer", beside(F.col("precip") | F.col("thunder")))
         .withColumn("_unverified", ~F.col("verified") | beside(~F.col("verified"))))
    windy = F.coalesce(F.col("wind_mic_ms") > cfg.wind_limit_ms, F.lit(False))
    if cfg.screen_station_wind:
        windy = windy | F.coalesce(F.col("wind_station_max_ms") > cfg.wind_limit_ms, F.lit(False))
    tests = (F.col("precip"), F.col("thunder"), windy, F.coalesce(F.col("snow_status") == "snow_cover", F.lit(False)),
             F.col("_buffer"), F.coalesce(F.col("snow_status") == "snow_cover_unverified", F.lit(False)), F.col("_unverified"))
    reason = F.coalesce(*[F.when(t, name) for t, name in zip(tests, REASONS)])
    return b.withColumn("reason", reason).drop("_buffer", "_unverified", "local_date")


def snow_cover_status(daily: DataFrame, dates: DataFrame, cfg: ScreenConfig, keys: Sequence[str] = ("ghcnd_id",)) -> DataFrame:
    """Snow cover of each requested date, where it is not known to be clear.

    A missing depth counts as clear only if the last known depth was under the limit and no snow fell
    on any day since; the days before and after must be clear too. Runs over a spine of days.
    """
    part = list(keys)
    d = daily.groupBy(*part, "date").agg(F.max("snwd_mm").alias("depth"), F.max("snow_mm").alias("fall"))
    wanted = dates.select(*part, "date").distinct()
    span = (d.select(*part, "date").unionByName(wanted.select(*part, F.date_sub("date", 1).alias("date")))
            .unionByName(wanted.select(*part, F.date_add("date", 1).alias("date")))
            .groupBy(*part).agg(F.min("date").alias("a"), F.max("date").alias("b")))
    spine = span.select(*part, F.explode(F.sequence("a", "b")).alias("date")).join(d, [*part, "date"], "left")
    at = Window.partitionBy(*part).orderBy("date")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    snowed = F.when(F.coalesce(F.col("fall") != 0, F.lit(True)), 1).otherwise(0)
    s = spine.withColumn("_bad", F.sum(snowed).over(upto))
    known = F.last(F.when(F.col("depth").isNotNull(), F.struct(F.col("depth").alias("v"), F.col("_bad").alias("bad"))), ignorenulls=True)
    s = s.withColumn("_k", known.over(upto))
    own = (F.when(F.col("depth").isNotNull(), F.when(F.col("depth") >= cfg.snow_depth_limit_mm, "cover").otherwise("clear"))
           .when((F.col("_k.v") < cfg.snow_depth_limit_mm) & (F.col("_bad") == F.col("_k.bad")), "clear").otherwise("unknown"))
    s = s.withColumn("_s", own)
    three = F.array(F.coalesce(F.lag("_s").over(at), F.lit("unknown")), F.col("_s"), F.coalesce(F.lead("_s").over(at), F.lit("unknown")))
    status = F.when(F.array_contains(three, "cover"), "snow_cover").when(F.array_contains(three, "unknown"), "snow_cover_unverified")
    return s.withColumn("status", status).join(wanted, [*part, "date"], "left_semi").where(
        F.col("status").isNotNull()).select(*part, "date", "status")


def apply_screen(readings: DataFrame, blocks: DataFrame, cfg: ScreenConfig, zone: str, clock: str,
                 keys: Sequence[str] = STATION) -> DataFrame:
    """Add ``reason`` to readings: NULL keeps them. ``blocks`` are those of the record's range.

    The block number makes this an equi-join that spreads a hot site over its blocks.
    """
    named = blocks.select(*keys, "block", F.col("reason").alias("_reason"), F.lit(True).alias("_in"))
    keyed = readings.withColumn("block", block_key(ck.logger_to_utc("ts", zone, clock), cfg.block_minutes))
    reason = (F.when(F.col("block").isNull(), "clock_ambiguous").when(F.col("_in").isNull(), "weather_unverified")
              .otherwise(F.col("_reason")))
    return keyed.join(named, [*keys, "block"], "left").withColumn("reason", reason).drop("_reason", "_in")


def screen_summary(screened: DataFrame, blocks: DataFrame, minutes: DataFrame, cfg: ScreenConfig,
                   keys: Sequence[str] = STATION) -> DataFrame:
    """Readings and blocks kept and removed, how well the blocks are verified, and wet minutes."""
    k = list(keys)
    n, kept = F.count(F.lit(1)), F.count_if(F.col("reason").isNull())
    a = screened.groupBy(*k).agg(n.alias("samples_total"), F.count_if(F.col("ts").isNull()).alias("samples_unreadable_time"),
                                 kept.alias("samples_kept"), (n - kept).alias("samples_excluded"),
                                 (100.0 * kept / n).alias("pct_kept"), F.min("ts").alias("record_start_local"),
                                 F.max("ts").alias("record_end_local"))
    b = blocks.groupBy(*k).agg(
        n.alias("blocks_total"), F.count_if(F.col("reason").isNull()).alias("blocks_clean"),
        (100.0 * F.count_if(F.col("n_1min") > 0) / n).alias("blocks_with_1min_pct"),
        (100.0 * F.count_if("verified") / n).alias("blocks_verified_pct"), F.max("wind_mic_ms").alias("max_block_wind_mic_ms"),
        F.min("block").alias("_a"), F.max("block").alias("_b"))
    m = (minutes.withColumn("block", block_key("minute", cfg.block_minutes)).join(b.select(*k, "_a", "_b"), k)
         .where(F.col("block").between(F.col("_a"), F.col("_b"))).groupBy(*k)
         .agg(*[F.count_if(c).alias(f"{c}_minutes") for c in ("rain", "snow", "other")]))
    return a.join(b.drop("_a", "_b"), k, "left").join(m, k, "left")


def removed_by_reason(screened: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    """Readings per reason among those given; pass the rows that the other filters kept."""
    return (screened.where(F.col("reason").isNotNull()).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n")))


def blocks_by_reason(blocks: DataFrame, keys: Sequence[str] = STATION) -> DataFrame:
    return blocks.groupBy(*keys, F.coalesce("reason", F.lit("clean")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def fingerprint(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Identity of the ordered times of a record, missing ones included; ``seq`` makes it order-sensitive."""
    # 60 bits of a digest that other engines have too
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-1))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "seq", micros)), 1, 15), 16, 10)
    return df.groupBy(*keys).agg(
        F.sum(h.cast("decimal(28,0)")).cast("string").alias("timestamp_hash"), F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("start"), F.max("ts").alias("end"))


def refuse_other_record(df: DataFrame, saved: DataFrame, keys: Sequence[str] = SITE) -> None:
    """Raise when a saved screen was made for another record. Compares one row per site."""
    now = fingerprint(df, keys)
    same = now.join(saved, [*keys, "timestamp_hash", "rows"], "left_anti")
    if same.limit(1).count():
        raise ScreenError("the saved weather screen belongs to other readings; build it again for these")

"""Landed weather files in table form: 1-minute and METAR reports, daily snow, station lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MM_PER_INCH = 25.4


def _number(c: str) -> Column:
    """A landed value; 'M' and blanks are missing."""
    return F.trim(F.col(c)).try_cast("double")


def _time(c: str) -> Column:
    return F.try_to_timestamp(F.trim(F.col(c)), F.lit("yyyy-MM-dd H:m[:s]")).cast("timestamp_ntz")


def _inside(df: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    df = df.where(F.col("valid_utc").isNotNull())
    if start is not None:
        df = df.where(F.col("valid_utc") >= start)
    return df if end is None else df.where(F.col("valid_utc") < end)


def onemin(landed: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """1-minute observations in [start, end); of repeated minutes the last landed row stays.

    The last row is a maximum by position with a map-side partial, not a window.
    """
    code = F.trim("ptype")
    rows = _inside(landed.select(
        "station", _time("valid(UTC)").alias("valid_utc"), "seq", _number("tmpf").alias("tmpf"), _number("sknt").alias("sknt"),
        _number("gust_sknt").alias("gust_sknt"), F.when(code.isin("M", "--"), "").otherwise(code).alias("ptype"),
        _number("precip").alias("precip")), start, end)
    payload = ["seq", "tmpf", "sknt", "gust_sknt", "ptype", "precip"]
    last = rows.groupBy("station", "valid_utc").agg(F.max_by(F.struct(*payload), "seq").alias("r"))
    return last.select("station", "valid_utc", "r.*")


def metar(landed: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    return _inside(landed.select(
        "station", _time("valid").alias("valid_utc"), "seq", _number("tmpf").alias("tmpf"), _number("sknt").alias("sknt"),
        _number("gust").alias("gust"), F.trim("wxcodes").alias("wxcodes"), F.trim("metar").alias("metar")), start, end)


def snow_daily(landed: DataFrame, keys: Sequence[str] = ("ghcnd_id",)) -> DataFrame:
    """Daily depth and fall in mm from inches; flagged, negative and trace values are unknown, not zero."""
    def mm(c: str) -> Column:
        if c not in landed.columns:
            return F.lit(None).cast("double")
        flags = F.split(F.coalesce(F.col(f"{c}_ATTRIBUTES"), F.lit("")), ",") if f"{c}_ATTRIBUTES" in landed.columns else F.array(F.lit(""))
        clean = F.coalesce(F.get(flags, F.lit(1)), F.lit("missing")) == ""
        v = _number(c)
        ok = (v >= 0) & clean
        if c == "SNOW":
            ok = ok & (F.get(flags, F.lit(0)) != "T")
        return F.when(ok, v * MM_PER_INCH)
    return landed.select(*keys, F.to_date(F.col("DATE")).alias("date"), mm("SNWD").alias("snwd_mm"), mm("SNOW").alias("snow_mm"))


def station_history(landed: DataFrame) -> DataFrame:
    """US stations with a call sign and a position, from the station history list."""
    return (landed.where((F.col("CTRY") == "US") & (F.length("ICAO") >= 3))
            .select(F.col("ICAO").alias("icao"), F.col("WBAN").alias("wban"), _number("LAT").alias("lat"), _number("LON").alias("lon"),
                    F.col("END").alias("end"), F.col("STATE").alias("state"))
            .where(F.col("lat").isNotNull() & F.col("lon").isNotNull()))


def snow_inventory(lines: DataFrame, value: str = "value") -> DataFrame:
    """Stations reporting snow depth, from fixed-width inventory lines."""
    def field(start: int, length: int) -> Column:
        return F.trim(F.substring(value, start, length))
    return lines.where(F.substring(value, 32, 4) == "SNWD").select(
        field(1, 11).alias("ghcnd_id"), field(13, 8).try_cast("double").alias("lat"), field(22, 9).try_cast("double").alias("lon"),
        field(37, 4).try_cast("int").alias("first_year"), field(42, 4).try_cast("int").alias("last_year"))


def zip_centroids(landed: DataFrame) -> DataFrame:
    """ZIP areas from the gazetteer; its header names carry trailing blanks."""
    named = landed.toDF(*[c.strip() for c in landed.columns])
    return named.select(F.trim("GEOID").alias("zip"), _number("INTPTLAT").alias("lat"), _number("INTPTLONG").alias("lon"))


STATION_FEATURES = ("features array<struct<properties: struct<sid: string, sname: string, tzname: string, network: string, "
                    "attributes: struct<IS_AWOS: string, HAS1MIN: string, GHCNH_ID: string>>, geometry: struct<coordinates: array<double>>>>")


def network_stations(collections: DataFrame) -> DataFrame:
    """Stations of landed GeoJSON collections, without AWOS and without those that lack a zone or position."""
    f = collections.select(F.explode("features").alias("f")).select(
        "f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))
    return f.where((F.coalesce("attributes.IS_AWOS", F.lit("0")) != "1") & F.col("lon").isNotNull()
                   & (F.coalesce("sid", F.lit("")) != "") & (F.coalesce("tzname", F.lit("")) != "")).select(
        F.col("sid").alias("station_id"), F.coalesce("sname", "sid").alias("name"), "lat", "lon", F.col("tzname").alias("tz"),
        (F.coalesce("attributes.HAS1MIN", F.lit("0")) == "1").alias("has_1min"), F.col("attributes.GHCNH_ID").alias("ghcnd_id"))

"""Labels built from numbers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: study codes, home letters and device serials that may be shown.
SAFE_LABEL = (r"(?i)^(?:(?:home|house)\s*[A-Z]|(?:conv|pair|site|loc|dev|unit)\s*[-_]?\d{1,4}"
              r"|[A-Z]{1,6}[-_]?\d{1,6}|\d{1,6})$")
UPLOAD_PREFIX = r"^\d{8}_\d{6}_"


def floor_pct(value: Column, decimals: int = 1) -> Column:
    """Percentage cut, never rounded, so missing data cannot show as 100 %."""
    scale = F.lit(float(10 ** decimals))
    return F.floor(value * scale) / scale


def format_duration(seconds: Column) -> Column:
    """'2 h 5 min', '5 min 3 s', '3 s'."""
    s = F.bround(seconds, 0).cast("long")
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (F.when(h > 0, F.when(m > 0, F.concat(h, F.lit(" h "), m, F.lit(" min"))).otherwise(F.concat(h, F.lit(" h"))))
            .when(m > 0, F.when(sec > 0, F.concat(m, F.lit(" min "), sec, F.lit(" s"))).otherwise(F.concat(m, F.lit(" min"))))
            .otherwise(F.concat(sec, F.lit(" s"))))


def _plural(n: Column, word: str) -> Column:
    return F.concat(n, F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def days_text(days: Column) -> Column:
    whole = F.bround(days, 0)
    return F.when(F.abs(days - whole) < 0.05, _plural(whole.cast("long"), "day")).otherwise(
        F.concat(F.format_string("%.1f", days), F.lit(" days")))


def span_label(seconds: Column) -> Column:
    """Record length in days or weeks: '< 1 day', '3 days', '2 weeks', '2.4 weeks'."""
    days = seconds / 86400.0
    weeks = days / 7.0
    return (F.when(days < 1, "< 1 day")
            .when(days < 7, _plural(F.bround(days, 0).cast("long"), "day"))
            .when(F.abs(weeks - F.bround(weeks, 0)) <= 0.15, _plural(F.bround(weeks, 0).cast("long"), "week"))
            .otherwise(F.concat(F.format_string("%.1f", weeks), F.lit(" weeks"))))


def duration_label(seconds: Column) -> Column:
    """'3 days, 2 hrs, 5 min'; minutes are left out from 30 days on."""
    s = F.bround(seconds, 0).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    label = F.concat_ws(", ", F.when(d > 0, _plural(d, "day")), F.when(h > 0, _plural(h, "hr")),
                        F.when((m > 0) & (d < 30), F.concat(m, F.lit(" min"))))
    return F.when(label == "", "< 1 min").otherwise(label)


def is_safe_label(value: Column) -> Column:
    """The text is a study code rather than something that may name a person."""
    return F.coalesce(F.trim(value).rlike(SAFE_LABEL), F.lit(False))


def safe_label(value: Column, fallback: Column) -> Column:
    return F.when(is_safe_label(value), F.trim(value)).otherwise(fallback)


def file_stem(path: Column) -> Column:
    """File name without folder, extension and upload prefix."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), UPLOAD_PREFIX, ""))

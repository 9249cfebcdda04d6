"""Sound level arithmetic as Column expressions.

Levels are decibels; averages are taken on energy, ``10^(L/10)``. All builders stay inside
whole-stage codegen and use aggregates with a map-side partial, so no site is too large for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours of each rating period, and the penalty in dB added to it.
DAY_LDEN, EVENING_LDEN, NIGHT_LDEN = (7, 19), (19, 23), (23, 7)
DAY_LDN, NIGHT_LDN = (7, 22), (22, 7)
EVENING_PENALTY_DB, NIGHT_PENALTY_DB = 5.0, 10.0
LDEN_HOURS = (12.0, 4.0, 8.0)
LDN_HOURS = (15.0, 9.0)

EXCEEDANCE = {"l5": 0.95, "l10": 0.90, "l50": 0.50, "l90": 0.10, "l95": 0.05}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def energy(level: Column | str) -> Column:
    return F.pow(F.lit(10.0), col(level) / 10.0)


def to_db(mean_energy: Column) -> Column:
    return F.lit(10.0) * F.log10(mean_energy)


def laeq(level: Column | str, where: Column | None = None) -> Column:
    """Energy-average aggregate, over the rows that satisfy ``where`` if given."""
    e = energy(level)
    return to_db(F.avg(e if where is None else F.when(where, e)))


def in_hours(hour: Column, window: tuple[int, int]) -> Column:
    """Hour-of-day test for ``[start, end)``; may wrap midnight, equal ends mean the whole day."""
    start, end = window
    if start == end:
        return F.lit(True)
    if start < end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def weighted_db(parts: list[tuple[float, Column]]) -> Column:
    """Levels combined by hours; NULL when any of them is NULL."""
    total = sum(h for h, _ in parts)
    return to_db(reduce(lambda a, b: a + b, [F.lit(h) * energy(lv) for h, lv in parts]) / F.lit(total))


def ldn(day: Column, night: Column) -> Column:
    return weighted_db([(LDN_HOURS[0], day), (LDN_HOURS[1], night + NIGHT_PENALTY_DB)])


def lden(day: Column, evening: Column, night: Column) -> Column:
    return weighted_db([(LDEN_HOURS[0], day), (LDEN_HOURS[1], evening + EVENING_PENALTY_DB),
                        (LDEN_HOURS[2], night + NIGHT_PENALTY_DB)])


def pct_at_or_above(level: Column | str, threshold: float, where: Column | None = None) -> Column:
    """Share (%) of measured readings at or above a threshold; NULL when there are none."""
    level = col(level)
    hit = F.when(level.isNotNull(), F.when(level >= F.lit(float(threshold)), 1.0).otherwise(0.0))
    return F.avg(hit if where is None else F.when(where, hit)) * 100.0


def pct_above(level: Column | str, threshold: float, where: Column | None = None) -> Column:
    """As :func:`pct_at_or_above` with a strict comparison."""
    level = col(level)
    hit = F.when(level.isNotNull(), F.when(level > F.lit(float(threshold)), 1.0).otherwise(0.0))
    return F.avg(hit if where is None else F.when(where, hit)) * 100.0

"""Helpers of the tests that are not fixtures."""

from __future__ import annotations

import datetime as dt


def steps(start: str, n: int, seconds: float):
    a = dt.datetime.fromisoformat(start)
    return [a + dt.timedelta(seconds=seconds * i) for i in range(n)]

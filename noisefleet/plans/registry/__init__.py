"""Every registered query, by name, with the DuckDB statement it is checked against where SQL can say it."""

from __future__ import annotations

import importlib

from noisefleet.plans.registry.common import Query

FAMILIES = ("levels", "periods", "continuity", "clocks", "filters", "weather", "stations", "compare", "ingest")


def _merged(attr: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out |= getattr(importlib.import_module(f"noisefleet.plans.registry.{family}"), attr)
    return out


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")

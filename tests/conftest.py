from __future__ import annotations

import datetime as dt
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from noisefleet.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4, app="noisefleet-tests")


@pytest.fixture(scope="session")
def readings(spark):
    """Readings of one site from times and levels in recorded order."""
    def make(times, leq, lmax=None, lmin=None, fold=None, site="A"):
        rows = []
        for i, (t, v) in enumerate(zip(times, leq)):
            ts = dt.datetime.fromisoformat(t) if isinstance(t, str) else t
            rows.append((site, 0, i, ts, int(fold[i]) if fold is not None else 0, None if v is None else float(v),
                         None if lmax is None else float(lmax[i]), None if lmin is None else float(lmin[i])))
        return spark.createDataFrame(rows, "site_id string, file_seq int, seq bigint, ts timestamp_ntz, fold tinyint, "
                                           "leq double, lmax double, lmin double")
    return make

"""Run registered queries against their DuckDB statements and report differences.

usage: python tools/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import importlib
import pathlib
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
from noisefleet.session import local_session  # noqa: E402


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        out = []
        for v in r:
            v = v.item() if isinstance(v, np.generic) else v
            v = float(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 53 else v
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                out.append(None)
            elif hasattr(v, "tolist") and not isinstance(v, pd.Timestamp):
                out.append(str(v.tolist()))
            elif isinstance(v, float) and v == int(v):
                out.append(float(v) + 0.0)
            else:
                out.append(str(v) if isinstance(v, (pd.Timestamp,)) else v)
        rows.append(tuple(out))
    return sorted(rows, key=str)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def check(spark, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    t = time.time()
    got = query(spark, sf_dir).toPandas()
    took = time.time() - t
    if sql is None:
        return len(got) > 0, f"{name}: {len(got)} rows (no SQL) {took:.1f}s"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{name}: columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    types = [f"{c}:{got[c].dtype}/{want[c].dtype}" for c in sorted(got.columns) if str(got[c].dtype) != str(want[c].dtype)]
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{name}: {len(a)} vs {len(b)} rows; columns {sorted(got.columns)}; first differences {bad}"
    return True, f"{name}: {len(a)} rows equal {took:.1f}s {' '.join(types)}"


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    families, wanted = importlib.import_module("noisefleet.plans.registry"), set()
    picked: dict = {}
    for f in families.FAMILIES:
        if f in names:
            m = importlib.import_module(f"noisefleet.plans.registry.{f}")
            picked |= {q: (fn, m.ORACLES.get(q)) for q, fn in m.QUERIES.items()}
            wanted.add(f)
    rest = [n for n in names if n not in wanted]
    if rest or not names:
        qs, orc = families.queries(), families.oracles()
        picked |= {q: (qs[q], orc.get(q)) for q in (rest or qs)}
    spark, con, failed = local_session(), connect(sf_dir), []
    for name, (fn, sql) in picked.items():
        try:
            ok, line = check(spark, con, sf_dir, name, fn, sql)
        except Exception as exc:  # report and go on to the next query
            ok, line = False, f"{name}: {type(exc).__name__} {str(exc)[:600]}"
        print(("ok   " if ok else "FAIL ") + line, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(picked) - len(failed)}/{len(picked)} ok; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())

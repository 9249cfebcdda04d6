"""Instrument formats: the Larson Davis time history sheet and the .cil binary log."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.functions import levels as lv
from noisefleet.functions import roles
from noisefleet.session import stored
from noisefleet.sources.files import open_store

# Flag texts that mean "not flagged", flag columns, and the .cil layout.
NOT_FLAGGED = ("", "nan", "no", "false", "0")
FLAG_COLUMNS = ("Overload", "Invalid")
CIL_EPOCH_OFFSET_S = 2082844800          # 1904-01-01 to 1970-01-01
CIL_TEXTS, CIL_BLOCKS, CIL_HEADER = 4, ("lmax", "leq", "lmin"), ">ddi"
CIL_LOWEST_DB, CIL_HIGHEST_DB = -10.0, 200.0
CIL_RANGE = 1 << 20


def larson_davis(sheet: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A landed Time History sheet as readings; levels of flagged readings become missing.

    ``flagged`` stays on the rows so that the caller can count them.
    """
    names = {c.strip(): c for c in sheet.columns}
    if "Date/Time" not in names:
        raise roles.IngestError("the sheet has no Date/Time column")
    chosen, _ = roles.plan_levels([n for n in names if n != "Date/Time" and n not in keep])
    if "leq" not in chosen:
        raise roles.IngestError("the sheet has no LAeq column")

    def col(n: str) -> Column:
        return F.col(f"`{names[n]}`")

    flagged = F.lit(False)
    for n in FLAG_COLUMNS:
        if n in names:
            flagged = flagged | ~F.lower(F.trim(F.coalesce(col(n).cast("string"), F.lit("")))).isin(*NOT_FLAGGED)
    stamp = F.regexp_replace(F.trim(col("Date/Time").cast("string")), r"\s+", " ")
    ts = F.coalesce(*[F.try_to_timestamp(stamp, F.lit(p)) for p in ("yyyy-M-d H:m:s[.SSSSSSSSS]", "M/d/yyyy H:m:s[.SSSSSSSSS]", "M/d/yyyy h:m:s a")])
    levels = {r: F.when(~flagged, lv.finite(col(c).cast("string").try_cast("double"))) for r, c in chosen.items()}
    return sheet.select(*keep, ts.cast("timestamp_ntz").alias("ts"), flagged.alias("flagged"),
                        *[levels.get(r, F.lit(None).cast("double")).alias(r) for r in ("leq", "lmax", "lmin")]).where(F.col("ts").isNotNull())


def flagged_note(readings: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """How many readings the instrument flagged, per record that has any."""
    g = readings.groupBy(*keys).agg(F.count_if("flagged").alias("n")).where(F.col("n") > 0)
    return g.select(*keys, F.lit("flagged").alias("code"), "n", F.concat(
        F.format_number("n", 0), F.lit(" readings flagged by the instrument were treated as missing.")).alias("text"))


def cil_layout(file: BinaryIO, length: int) -> tuple[int, float, float, int]:
    """Where the first block of a .cil log begins, and the start (seconds since 1970), step and length of its three blocks."""
    def read(form: str, at: int) -> tuple:
        file.seek(at)
        return struct.unpack(form, file.read(struct.calcsize(form)))
    try:
        at = 0
        for _ in range(CIL_TEXTS):
            at += 4 + read(">i", at)[0]
        at += 4
        first = start, step, count = read(CIL_HEADER, at)
        if count <= 0 or step <= 0 or not math.isfinite(start) or at + len(CIL_BLOCKS) * cil_block(count) > length:
            raise roles.IngestError("block header out of range")
        others = [read(CIL_HEADER, at + i * cil_block(count)) for i in range(1, len(CIL_BLOCKS))]
    except (struct.error, ValueError, OSError, roles.IngestError) as exc:
        raise roles.IngestError(f"not a readable .cil log: {exc}") from exc
    if any(o != first for o in others):
        raise roles.IngestError("the level blocks of this .cil log differ in start, step or length")
    return at, start - CIL_EPOCH_OFFSET_S, step, count


def cil_block(count: int) -> int:
    """Bytes of a block: its header and its values."""
    return struct.calcsize(CIL_HEADER) + 8 * count


def cil_values(file: BinaryIO, at: int, count: int, block: str, first: int, n: int) -> np.ndarray:
    """``n`` values of a block, from ``first`` on."""
    file.seek(at + CIL_BLOCKS.index(block) * cil_block(count) + cil_block(first))
    return np.round(np.frombuffer(file.read(8 * n), ">f8").astype(float), 6)


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, length in zip(batch["path"], batch["length"]):
            store, name = open_store(path)
            with store.open_input_file(name) as file:
                at, start, step, count = cil_layout(file, length)
                # as far as the first level: a log without any is refused
                if not any(np.isfinite(cil_values(file, at, count, "leq", i, min(CIL_RANGE, count - i))).any() for i in range(0, count, CIL_RANGE)):
                    raise roles.IngestError("the levels of this .cil log are not plausible")
            rows.append((path, at, start, step, count))
        yield pd.DataFrame(rows, columns=["path", "at", "start", "step", "count"])


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples():
            store, name = open_store(r.path)
            n = r.stop - r.first
            with store.open_input_file(name) as file:
                values = {block: cil_values(file, r.at, r.count_, block, r.first, n) for block in CIL_BLOCKS}
            leq = values["leq"][np.isfinite(values["leq"])]
            if len(leq) and (leq.min() <= CIL_LOWEST_DB or leq.max() >= CIL_HIGHEST_DB):
                raise roles.IngestError("the levels of this .cil log are not plausible")
            seq = np.arange(r.first, r.first + n)
            yield pd.DataFrame({"path": r.path, "seq": seq, "epoch_s": r.start + r.step * seq, "leq": values["leq"], "lmax": values["lmax"],
                                "lmin": values["lmin"]})


def read_cil(spark: SparkSession, paths: str | list[str], zone: str = ck.DEFAULT_ZONE, size: int = CIL_RANGE) -> DataFrame:
    """Readings of .cil logs in the wall clock of ``zone``.

    A log is read in ranges of ``size`` readings, each by a task that seeks to its part of the three blocks.
    Times are stored in UTC, so ``fold`` is exact: the wall time had been shown already.
    """
    ck.check_zone(zone)
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    found = stored(files.mapInPandas(_layouts, "path string, at bigint, start double, step double, count bigint"), "cil-layouts")
    n = found.agg(F.sum(F.ceil(F.col("count") / size))).first()[0] or 1
    cut = found.select("path", "at", "start", "step", F.col("count").alias("count_"), F.explode(F.sequence(F.lit(0), F.col("count") - 1, F.lit(size))).alias("first"))
    cut = cut.withColumn("stop", F.least(F.col("first") + size, "count_"))
    rows = cut.repartition(min(int(n), 100_000), "path", "first").mapInPandas(
        _ranges, "path string, seq bigint, epoch_s double, leq double, lmax double, lmin double")
    utc = F.timestamp_micros(F.rint(F.col("epoch_s") * 1e6).cast("long")).cast("timestamp_ntz")
    t = rows.withColumn("ts_utc", utc).withColumn("ts", ck.utc_to_wall("ts_utc", zone))
    again = ck.shown_before("ts_utc", zone)
    return t.select("path", "seq", "ts", F.when(again, 1).otherwise(0).cast("tinyint").alias("fold"), "ts_utc",
                    *[lv.finite(c).alias(c) for c in ("leq", "lmax", "lmin")])

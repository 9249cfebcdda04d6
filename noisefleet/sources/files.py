"""What a file is, whether it is whole, and the reader of Parquet exports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefleet.functions import levels as lv
from noisefleet.functions import roles, text
from noisefleet.operators.scans import SITE

# Leading bytes of the formats, in hex, and their names.
MAGIC = [("50415231", "parquet"), ("D0CF11E0A1B11AE1", "xls"), ("504B0304", "xlsx")]
CIL_MARK, CIL_MARK_AT = "4E535254", 5
SEPARATORS = ("\t", ";", ",", "|")
HEAD_BYTES = 64 * 1024
HEADS_AT_ONCE = 64
# Schemes of Hadoop's connectors and what the same stores are called elsewhere.
STORES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasbs": "abfs", "wasb": "abfs", "abfss": "abfs"}
ROW_LIMITS = {"xlsx": 1_048_576, "xls": 65_536}
ROW_LIMIT_SLACK = 6
COMMA_SHARE = 0.95


def store_path(path: str) -> str:
    """A path as Spark lists it, as Arrow opens it."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    if colon and scheme == "file":
        return "file:///" + rest.lstrip("/")
    return STORES.get(scheme, scheme) + colon + rest


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark lists it, and the path in it."""
    found = store_path(path)
    if found.startswith("file:///"):
        return fs.LocalFileSystem(), found.removeprefix("file://")
    scheme, mark, rest = found.partition("://")
    place, slash, name = rest.partition("/")
    return fs.FileSystem.from_uri(scheme + mark + place + slash + quote(name) if mark else found)


def head_of(path: str) -> bytes:
    """The first bytes of a file."""
    store, at = open_store(path)
    with store.open_input_stream(at, compression=None) as stream:
        return stream.read(HEAD_BYTES)


def _read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # some files at a time: a batch may list thousands
        for start in range(0, len(batch), HEADS_AT_ONCE):
            part = batch.iloc[start:start + HEADS_AT_ONCE]
            yield part.assign(head=[head_of(p) for p in part["path"]])


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path, length and time of change of every file: the listing comes from Spark."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").alias("modified"))


def heads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path, length, time of change and the first 64 KB of every file, none of which is read whole."""
    return listed(spark, paths).mapInPandas(_read_heads, "path string, length bigint, modified timestamp, head binary")


def formats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path, length and format by leading bytes, one row per file. Unknown binary files, .wlg too, are ``refused``."""
    f = heads(spark, paths)
    first = F.hex(F.substring("head", 1, 512))
    known = [F.when(first.startswith(m), name) for m, name in MAGIC]
    cil = F.when(F.hex(F.substring("head", CIL_MARK_AT, 4)) == CIL_MARK, "cil")
    is_text = F.when((F.length("head") > 0) & ~first.rlike("^(..)*00"), "text")
    return f.select("path", "length", F.coalesce(*known, cil, is_text, F.lit("refused")).alias("format"))


def provenance(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SHA-256 of every source file, read in parallel."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def refuse(found: DataFrame) -> None:
    """Raise for files that cannot be read. Looks at file names only."""
    bad = found.where(F.col("format").isin("refused", "xls", "xlsx")).select("path", "format").limit(5).collect()
    if bad:
        raise roles.IngestError("These files can't be read; export them as .csv, .parquet or .cil: "
                                + ", ".join(r["path"] for r in bad))


def fix_decimal_commas(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("path",)) -> DataFrame:
    """Text columns with a decimal comma as numbers, where at least 95 % of a record's values are written so."""
    def written(c: str) -> Column:
        return F.trim(F.col(c)).rlike(r"^-?\d+,\d+$")
    share = df.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(F.col(c).isNotNull(), F.when(written(c), 1.0).otherwise(0.0))), F.lit(0.0))
                                    .alias(f"_comma_{i}") for i, c in enumerate(columns)])
    j = df.join(share, list(keys))
    return j.withColumns({c: F.when(F.col(f"_comma_{i}") >= COMMA_SHARE, F.replace(F.trim(F.col(c)), F.lit(","), F.lit(".")).try_cast("double").cast("string"))
                          .otherwise(F.col(c)) for i, c in enumerate(columns)}).drop(*[f"_comma_{i}" for i in range(len(columns))])


def numeric_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows of each text column that read as a number. One aggregate, one row per column."""
    g = df.agg(*[F.avg(F.when(F.trim(F.col(c).cast("string")).try_cast("double").isNotNull(), 1.0).otherwise(0.0)).alias(c) for c in columns])
    return g.unpivot([], list(columns), "column", "share")


def read_parquet(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Readings of Parquet exports that share a schema; the row index of each file is the recorded order."""
    paths = [paths] if isinstance(paths, str) else paths
    nanos = False
    try:
        df = spark.read.parquet(*paths)
    except AnalysisException as exc:
        if "TIMESTAMP(NANOS" not in str(exc):
            raise
        # times in nanoseconds, as data frame libraries write them, come as whole numbers; the option is the
        # relation's own session's, so the caller's stays as it is
        own = spark.newSession()
        own.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        df, nanos = own.read.parquet(*paths), True
    chosen, said = roles.plan_levels(df.columns)
    time = roles.time_column(df.dtypes)
    if time is None:
        raise roles.IngestError("This file has no recognisable time column.")
    kind, at = dict(df.dtypes)[time], F.col(f"`{time}`")
    if nanos and kind == "bigint":
        named = {"ts": F.timestamp_micros(F.floor(at / 1000))}
    else:
        named = {"ts": at} if kind.startswith("timestamp") else {"raw": at.cast("string")}
    named |= {r: lv.finite(F.col(f"`{c}`").cast("string").try_cast("double")) for r, c in chosen.items()}
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("seq"),
                     *[(c.cast("timestamp_ntz") if n == "ts" else c).alias(n) for n, c in named.items()]), said


def row_limit_flags(df: DataFrame, keys: Sequence[str] = ("path",), limits: dict[str, int] | None = None) -> DataFrame:
    """Files whose row count sits just under a worksheet ceiling, and so were probably cut there."""
    n = F.col("n_rows")
    hit = F.coalesce(*[F.when(n.between(top - ROW_LIMIT_SLACK, top), kind) for kind, top in (limits or ROW_LIMITS).items()])
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("worksheet", hit)
    return g.withColumn("truncated_at_row_limit", F.col("worksheet").isNotNull())


def valid_levels(df: DataFrame, channels: Sequence[str] = ("leq", "lmax", "lmin")) -> DataFrame:
    """Readings with at least one usable level."""
    return df.withColumns({c: lv.finite(c) for c in channels}).dropna("all", subset=list(channels))


def validation_report(df: DataFrame, keys: Sequence[str] = SITE, channels: Sequence[str] = ("leq", "lmax", "lmin")) -> DataFrame:
    """Rows dropped for lack of any level, and missing values per channel among the rest."""
    clean = df.withColumns({c: lv.finite(c) for c in channels})
    some = F.coalesce(*[F.col(c) for c in channels]).isNotNull()
    return clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~some).alias("rows_dropped"),
        *[F.count_if(some & F.col(c).isNull()).alias(f"{c}_missing") for c in channels])


def site_of(path: Column) -> Column:
    """Site name of a file: its stem when that is a study code, else a code made from its hash."""
    stem = text.file_stem(path)
    return text.safe_label(stem, F.concat(F.lit("SITE-"), F.substring(F.sha2(path, 256), 1, 12)))

"""Delimited exports, read in ranges of bytes, with the times of each file rebuilt the way it needs.

Every file is cut into ranges of ``RANGE_BYTES``; a range is a row, and the rows are dealt over the tasks, so one
plan reads any number of files and layouts and no list of files reaches the driver. A range owns the records that
begin in it. Quoted fields may hold line breaks: each range first tells what it makes of a quote that is open,
or not, where it starts; composed along a file, these say which ranges start inside a field.

What a file's times are is decided by all its values, in one aggregate: ``absolute`` (read by the best format),
``combined`` (a date and a clock column), ``elapsed`` (counted from the start) or ``wrapping`` (minutes and seconds
of an hour that is not written). The start is the preamble's, else the file name's. A file whose times cannot be
placed keeps its levels, without times, and a note.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noisefleet.functions import clock as ck
from noisefleet.functions import levels as lv
from noisefleet.functions import roles, text
from noisefleet.session import cut_lineage, stored
from noisefleet.sources import timestamps
from noisefleet.sources.files import COMMA_SHARE, HEAD_BYTES, SEPARATORS, head_of, listed, open_store

RANGE_BYTES = 32 << 20
# what a task holds of its range at a time
PIECE_BYTES = 1 << 20
STEP_BYTES = 64 << 10
# Fixed value: share of values that must be of a kind for a file to be of that kind.
CLOCK_SHARE = 0.8
QUOTE = b'"'
CHANNELS = ("leq", "lmax", "lmin")
LAYOUT = ("path string, length bigint, modified timestamp, body_at bigint, sep string, eol string, width int, raw int, day int, leq int, lmax int, lmin int, "
          "start timestamp_ntz, notes array<struct<code string, text string>>")
ROWS = "path string, seq bigint, raw string, day string, leq string, lmax string, lmin string"


def preamble_start(head: str) -> dt.datetime | None:
    """The first time written like '2024_03_05__9h04m07s'."""
    for token in re.split(r"[^0-9_hms]+", head):
        day, mark, clock = token.partition("__")
        if mark:
            try:
                return dt.datetime.strptime("_".join(day.split("_")[-3:]) + " " + clock[:clock.find("s") + 1], "%Y_%m_%d %Hh%Mm%Ss")
            except ValueError:
                continue
    return None


def lines_of(head: bytes) -> Iterator[tuple[int, str]]:
    """Lines of a file head, each with the offset of the byte after it."""
    at = 0
    for line in re.findall(rb"[^\r\n]*(?:\r\n|\n|\r|$)", head):
        at += len(line)
        yield at, line.decode("utf-8-sig" if at == len(line) else "utf-8", "replace").rstrip("\r\n")


def find_header(head: bytes) -> tuple[int, list[str], str] | None:
    """End, cells and separator of the first line whose cells name a time and, in another cell, a level; or two levels."""
    for end, line in lines_of(head):
        sep = max(SEPARATORS, key=line.count)
        cells = [c.strip().strip('"') for c in next(csv.reader([line], delimiter=sep), [])]
        times = [c for c in cells if c and roles.time_column([(c, "string")])]
        levels = [c for c in cells if c not in times[:1] and (roles.level_role(c) or roles.names_a_level(c))]
        if len(levels) > (not times):
            return end, cells, sep
    return None


def date_and_clock(names: Sequence[str]) -> tuple[str, str] | None:
    """The columns of a date and of a clock time, where no column holds both."""
    kinds = [("date" in n.lower(), "time" in n.lower() or "clock" in n.lower(), n) for n in names]
    if any(d and c or re.sub(r"[\W_]", "", n.lower()) in ("timestamp", "datetime") for d, c, n in kinds):
        return None
    dates, clocks = [n for d, _, n in kinds if d], [n for _, c, n in kinds if c]
    return (dates[0], min(clocks, key=lambda n: n.lower() not in ("time", "clock"))) if dates and clocks else None


def layout_of(head: bytes) -> dict:
    """What a file's head says of its columns; only notes where it cannot be read."""
    found = find_header(head)
    if found is None:
        return {"notes": [("no_header", f"not read: no line of the first {HEAD_BYTES} bytes names a time and a level, or two levels")]}
    end, names, sep = found
    try:
        chosen, said = roles.plan_levels([c for c in names if c])
    except roles.IngestError as exc:
        return {"notes": [("ambiguous_levels", f"not read: {exc}")]}
    both = date_and_clock([c for c in names if c])
    day, raw = both or (None, roles.time_column([(c, "string") for c in names if c]) or names[0])
    if both:
        said = [*said, ("times_combined", f"times are {day} with {raw}")]
    at = {"raw": names.index(raw), "day": names.index(day) if day else None} | {r: names.index(c) for r, c in chosen.items()}
    return at | {"body_at": end, "sep": sep, "eol": "\n" if b"\n" in head else "\r", "width": len(names), "notes": said,
                 "start": preamble_start(head[:end].decode("utf-8", "replace"))}


def layouts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The layout of every file, one row each; ``body_at`` is NULL where it is not read."""
    names = [c.split()[0] for c in LAYOUT.split(", ")[:13]] + ["notes"]
    types = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("body_at", pa.int64()), ("sep", pa.string()),
                       ("eol", pa.string()), *[(c, pa.int32()) for c in ("width", "raw", "day", *CHANNELS)], ("start", pa.timestamp("us")),
                       ("notes", pa.list_(pa.struct([("code", pa.string()), ("text", pa.string())])))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                one = layout_of(head_of(r["path"]))
                one["notes"] = [{"code": c, "text": t} for c, t in one["notes"]]
                rows.append(dict.fromkeys(names) | one | {n: r[n] for n in ("path", "length", "modified")})
            yield pa.RecordBatch.from_pylist(rows, types)
    return listed(spark, paths).mapInArrow(found, LAYOUT)


def ranges(found: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows of bytes from ``first`` to before ``stop``, and over how many tasks they are to be dealt."""
    cut = found.where("body_at < length").withColumn("first", F.explode(F.sequence("body_at", F.col("length") - 1, F.lit(size))))
    cut = cut.withColumn("stop", F.least(F.col("first") + size, "length")).drop("notes", "modified", "start")
    n = found.agg(F.sum(F.ceil((F.col("length") - F.col("body_at")) / size))).first()[0] or 1
    return cut, max(1, min(int(n), 100_000))


def open_after(line: bytes, sep: bytes, opened: bool) -> bool:
    """Whether a quoted field is open after a line, given whether one is before it."""
    at = 0
    while True:
        if not opened:
            if line[at:at + 1] != QUOTE:
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at += 1
        end = line.find(QUOTE, at)
        if end < 0:
            return True
        opened = line[end + 1:end + 2] == QUOTE  # two quotes are one that belongs to the field
        at = end + 2 if opened else line.find(sep, end) + 1
        if not opened and not at:
            return False


def open_after_all(data: bytes, sep: bytes, eol: bytes, opened: bool) -> bool:
    return closed_until(data, sep, eol, opened)[0]


def closed_until(data: bytes, sep: bytes, eol: bytes, opened: bool) -> tuple[bool, int]:
    """Whether a quoted field is open after whole lines, and the end of the last line after which none is."""
    if QUOTE not in data:
        return opened, 0 if opened else len(data)
    at = end = 0
    for line in data.split(eol):
        at += len(line) + 1
        if QUOTE in line:
            opened = open_after(line, sep, opened)
        if not opened:
            end = at
    return opened, min(end, len(data))


class Range:
    """The whole lines that begin in a range of a file, read a piece at a time."""

    def __init__(self, r: dict) -> None:
        store, at = open_store(r["path"])
        self.file, self.length, self.eol, self.sep = store.open_input_file(at), r["length"], r["eol"].encode(), r["sep"].encode()
        self.first, self.stop, self.inside = r["first"], r["stop"], r["first"] > r["body_at"]

    def pieces(self) -> Iterator[bytes]:
        """The lines, about ``PIECE_BYTES`` of them at a time."""
        # the line before ends at the first line end from one byte before the range
        before, left = self.inside, b""
        self.file.seek(self.first - before)
        while self.file.tell() < self.stop:
            data = self.file.read(min(PIECE_BYTES, self.stop - self.file.tell()))
            if not data:
                break
            if before:
                start = data.find(self.eol) + 1
                if not start:
                    continue
                before, data = False, data[start:]
            end = data.rfind(self.eol) + 1
            if end:
                yield left + data[:end]
            left = data[end:] if end else left + data
        if left:
            yield left + self.line()

    def line(self) -> bytes:
        """What follows, to the end of the line."""
        out = b""
        while self.file.tell() < self.length and self.eol not in out:
            out += self.file.read(STEP_BYTES)
        end = out.find(self.eol) + 1
        if end:
            self.file.seek(self.file.tell() - len(out) + end)
        return out[:end] if end else out

    def records(self, opened: bool, quoted: bool) -> Iterator[bytes]:
        """The records that begin here, whole, some at a time."""
        if not quoted:
            yield from self.pieces()
            return
        before, held = opened, b""
        for data in self.pieces():
            start = 0
            while before and start < len(data):
                end = data.find(self.eol, start) + 1 or len(data)
                before = opened = open_after(data[start:end], self.sep, True)
                start = end
            if start == len(data):
                continue
            data = data[start:]
            opened, end = closed_until(data, self.sep, self.eol, opened)
            if end:
                yield held + data[:end]
            held = data[end:] if end else held + data
        while held and opened:
            line = self.line()
            if not line:
                break
            opened, held = open_after(line, self.sep, True), held + line
        if held:
            yield held


def even_cells(data: bytes, r: dict, quoted: bool) -> list[pa.Array] | None:
    """The columns of ``ROWS`` from ``raw`` on; None where a record is short or long."""
    names = [f"c{i}" for i in range(r["width"])]
    wanted = [r[c] for c in ("raw", "day", *CHANNELS)]
    uneven = []
    parsed = pacsv.read_csv(
        io.BytesIO(data), pacsv.ReadOptions(use_threads=False, column_names=names, block_size=len(data) + 1),
        pacsv.ParseOptions(delimiter=r["sep"], quote_char='"' if quoted else False, newlines_in_values=quoted,
                           invalid_row_handler=lambda row: uneven.append(row.number) or "skip"),
        pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), include_columns=[names[i] for i in set(wanted) - {None}],
                             null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True))
    n = parsed.num_rows
    return None if uneven else [pa.nulls(n, pa.string()) if i is None else parsed.column(names[i]).combine_chunks() for i in wanted]


def uneven_cells(data: bytes, r: dict, quoted: bool) -> list[pa.Array]:
    """The same where records are uneven: short ones have empty cells, long ones lose what no column names, empty ones are left out."""
    csv.field_size_limit(sys.maxsize)
    rows = [x for x in csv.reader(io.StringIO(data.decode(), newline=""), delimiter=r["sep"], quoting=csv.QUOTE_MINIMAL if quoted else csv.QUOTE_NONE)
            if any(c.strip() for c in x)]
    return [pa.array([(x[i] or None) if i is not None and i < len(x) else None for x in rows], pa.string())
            for i in (r[c] for c in ("raw", "day", *CHANNELS))]


def quote_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.to_dict("records"):
            x, after = Range(r), [False, True]
            for data in x.pieces():
                after = [open_after_all(data, x.sep, x.eol, before) for before in after]
            out.append((r["path"], r["first"], *map(int, after)))
        yield pd.DataFrame(out, columns=["path", "first", "closed", "opened"])


def text_pieces(r: dict) -> Iterator[bytes]:
    """The records of a range as UTF-8, some at a time, without what holds line ends only."""
    for data in Range(r).records(r["opened"] == 1, r["quoted"]):
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode()
        if data.strip(b"\r\n"):
            yield data


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ROWS.split(", ")]
    for batch in batches:
        for r in batch.to_pylist():
            # one record that is short or long settles how the range is read, so it is looked for first
            blank, even = True, True
            for data in text_pieces(r):
                blank = blank and not data.strip()
                even = even and even_cells(data, r, r["quoted"]) is not None
                if not (blank or even):
                    break
            at = r["first"]
            for data in () if blank else text_pieces(r):
                columns = (even_cells if even else uneven_cells)(data, r, r["quoted"])
                n = len(columns[0])
                seq = pa.array(np.arange(at, at + n, dtype=np.int64))
                yield from pa.table([pa.repeat(pa.scalar(r["path"], pa.string()), n), seq, *columns], names).to_batches(max_chunksize=1 << 16)
                at += n


def rows_of(found: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Text cells of every record, with a position ``seq`` that rises along its file.

    A quote that a file never closes is no quote: such a file is read without any.
    """
    cut, tasks = ranges(found, size)
    states = stored(cut.repartition(tasks).mapInPandas(quote_states, "path string, first bigint, closed int, opened int"), "quote-states")
    # a range keeps, turns or sets the state; before a range stands the last state set, turned as often as ranges since have
    sets, turns = F.when(F.col("closed") == F.col("opened"), F.col("closed")), ((F.col("closed") == 1) & (F.col("opened") == 0)).cast("int")
    along = Window.partitionBy("path").orderBy("first")
    before, upto, whole = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("path")
    told = states.withColumns({"_sets": sets, "_turns": turns}).withColumn("_sum", F.sum("_turns").over(upto))
    told = told.withColumn("_then", F.when(F.col("_sets").isNotNull(), F.col("_sum")))

    def state(w, last: Column) -> Column:
        turned = last - F.coalesce(F.last("_then", True).over(w), F.lit(0))
        return (F.coalesce(F.last("_sets", True).over(w), F.lit(0)) + turned) % 2

    told = told.select("path", "first", state(before, F.coalesce(F.lag("_sum").over(along), F.lit(0))).alias("opened"), state(upto, F.col("_sum")).alias("_after"))
    told = told.select("path", "first", "opened", (F.max_by("_after", "first").over(whole) == 0).alias("quoted"))
    return cut.join(told, ["path", "first"]).repartition(tasks).mapInArrow(read_ranges, ROWS)


def clock_of(value: Column) -> Column:
    """The clock time in a cell; a bare number is the hour."""
    hour = value.try_cast("double")
    written = F.regexp_extract(value, r"(\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[APap][Mm])?)\s*$", 1)
    return F.when(hour.between(0, 23.49), F.format_string("%02d:00:00", F.rint(hour).cast("int"))).when(written != "", written)


def decisions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row per file: how its ``whole`` texts are times, from where they count, and what is to be said of it."""
    within, since = timestamps.minute_second(F.col("whole")), timestamps.elapsed_seconds(F.col("whole"))

    def share(c: Column) -> Column:
        return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))

    counted = timestamps.choose_method(rows, ("path",), "whole", {
        "_mmss": share(within.isNotNull()), "_hms": share(since.isNotNull() & within.isNull()), "_most": F.max(within),
        "_first": F.min_by(within, F.when(within.isNotNull(), F.col("seq"))), "_dated": F.max(F.col("day").isNotNull()),
        "_digits": F.max(F.length(F.regexp_replace("whole", r"\D", ""))),
        **{f"_comma_{c}": share(F.when(F.col(c).isNotNull(), F.trim(c).rlike(r"^-?\d+,\d+$"))) for c in CHANNELS}})
    f = counted.join(found.select("path", "modified", "start", "sep"), "path")
    stem = text.file_stem(F.col("path"))
    day, _ = timestamps.dates_from_name(stem, F.col("modified").cast("date"))
    clock = timestamps.start_time_from_name(stem)
    first = F.col("_first")
    clock_seconds = F.coalesce(F.substring(clock, 1, 2).cast("int") * 3600 + F.substring(clock, 4, 2).cast("int") * 60 + first % 60, first % 3600)
    named = ck.plus_seconds(day.cast("timestamp_ntz"), clock_seconds)
    kind = (F.when(F.col("_dated"), "combined").when((F.col("_mmss") >= CLOCK_SHARE) & (F.col("_most") < 3600), "wrapping")
            .when((F.col("_mmss") >= CLOCK_SHARE) | (F.col("_hms") >= CLOCK_SHARE), "elapsed").otherwise("absolute"))
    base = F.coalesce("start", F.when(F.col("kind") == "wrapping", named))
    f = f.withColumns({"kind": kind, "_clock": clock}).withColumn("base_ts", F.when(F.col("kind").isin("elapsed", "wrapping"), base))
    bare, placed = F.col("kind").isin("elapsed", "wrapping"), F.col("base_ts").isNotNull()
    said = (F.when(bare & ~placed, F.struct(F.lit("no_start").alias("code"), F.lit(
        "times are not placed: the file holds clock times only, and neither its preamble nor its name says when it starts").alias("text")))
        .when(bare & F.col("start").isNotNull(), F.struct(F.lit("times_counted").alias("code"), F.lit("times count from the start in the preamble").alias("text")))
        .when(bare & F.col("_clock").isNull(), F.struct(F.lit("time_of_day_unknown").alias("code"), F.lit(
            "the date is the file name's, the hour is not known and taken as midnight: results by hour are not reliable").alias("text")))
        .when(bare, F.struct(F.lit("times_counted").alias("code"), F.lit("times count from the start in the file name").alias("text")))
        .when((F.col("kind") == "absolute") & (F.col("share") >= timestamps.USABLE) & ~F.col("method").startswith("epoch") & (F.col("_digits") <= 8),
              F.struct(F.lit("date_only").alias("code"), F.lit("readings carry a date but no clock time: they are spread over it in recorded order").alias("text"))))
    comma = {f"_comma_{c}": (F.col("sep") != ",") & (F.col(f"_comma_{c}") >= COMMA_SHARE) for c in CHANNELS}
    return f.withColumns(comma | {"said": said}).select("path", "kind", "method", "base_ts", "said", *comma)


def read_delimited(spark: SparkSession, paths: str | list[str], size: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Readings of delimited exports (path, seq, raw time text, ts, levels) and notes (path, code, text).

    Cells are stored once as text; the decisions and the times are made from there.
    """
    found = cut_lineage(layouts(spark, paths))
    rows = rows_of(found, size).withColumn("raw", F.trim("raw"))
    rows = stored(rows.withColumn("whole", F.when(F.col("day").isNotNull(), F.concat_ws(" ", F.trim("day"), clock_of(F.col("raw")))).otherwise(F.col("raw"))),
                  "delimited-rows")
    # of a date without its clock no time is made
    rows = rows.withColumn("whole", F.when(F.col("day").isNull() | clock_of(F.col("raw")).isNotNull(), F.col("whole")))
    decided = cut_lineage(decisions(rows, found))

    def level(c: str) -> Column:
        plain = F.when(F.col(f"_comma_{c}"), F.replace(F.trim(c), F.lit(","), F.lit("."))).otherwise(F.trim(c))
        return lv.finite(plain.try_cast("double")).alias(c)

    held = rows.join(decided.drop("said"), "path").select("path", "seq", "raw", "whole", "kind", "method", "base_ts", *[level(c) for c in CHANNELS])
    out = ["path", "seq", "raw", "ts", *CHANNELS]

    def placed(kind: str) -> DataFrame:
        of = held.where(F.col("kind") == kind)
        if kind == "elapsed":
            return of.withColumn("ts", timestamps.from_elapsed(F.col("whole"), F.col("base_ts")))
        if kind == "wrapping":
            return timestamps.unwrap_minutes(of.drop("base_ts"), decided.where("kind = 'wrapping'").select("path", "base_ts"), ("path",), "whole")
        normal = of.withColumn("_t", timestamps.normal_text(F.col("whole")))
        return normal.withColumn("ts", timestamps.parse_with(F.col("whole"), F.col("method"), F.col("_t")))

    # the kinds that occur, four at most
    kinds = [r["kind"] for r in decided.select("kind").distinct().orderBy("kind").collect()]
    readings = reduce(DataFrame.unionByName, [placed(k).select(out) for k in kinds or ["absolute"]])
    notes = found.select("path", F.inline("notes")).unionByName(decided.where("said is not null").select("path", "said.*"))
    return readings, notes

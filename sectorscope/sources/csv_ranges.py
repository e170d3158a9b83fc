"""CSV files read in many tasks, also where quoted cells hold line breaks.

A byte range of a file cannot tell by itself whether it starts inside a quoted
cell. So the lines of all files are read twice, each time in ranges that Spark
cuts:

1. Each range tells how it ends if it starts outside a quoted cell, and how if
   it starts inside one, and the range at a file's begin gives the header. Per
   file a running composition of these two-way answers, in order of the ranges,
   says how each range really starts. Only the ranges that start inside a cell
   and the distinct headers come to the driver.
2. Each range puts its lines together to records, cut at line ends outside
   quoted cells. A record that crosses ranges comes in pieces, which are joined
   by a grouping on the range where it starts.

Records are then parsed by ``from_csv``. Two jobs read the files, however many
they are. Most lines hold no quote and pass both steps as Arrow columns.

Defined results: a cell is quoted if a quote is its first character, a doubled
quote inside one is a quote; empty lines between records are skipped; ``\\r``
before a line end that ends a record is not part of it; a file's first record
is its header, and empty files have none; columns go by name, so that files may
order them differently or lack some (null there).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectorscope.session import materialize


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell, given whether it starts inside one."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line.startswith('"', quote + 1):
                at = quote + 2
                continue
            inside, at = False, quote + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        # outside a quoted cell: on to the next cell
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def column_names(values: Sequence[str | None]) -> list[str]:
    """Column names of a header: an unnamed one is ``Unnamed: <position>``, a repeated one gets ``.1``, ``.2`` and so on."""
    given = [v or f"Unnamed: {i}" for i, v in enumerate(values)]
    names: list[str] = []
    for name in given:
        k, unique = 0, name
        while unique in names or (k and unique in given):
            k += 1
            unique = f"{name}.{k}"
        names.append(unique)
    return names


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``, ``file``, ``start`` (of the range), in order within a range."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The lines of a batch by range."""
    files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    at = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or starts[i] != starts[at] or files[i] != files[at]:
            yield files[at], starts[at], batch.column(0).slice(at, i - at)
            at = i


def _quoted(lines: pa.Array) -> list[bool]:
    return pc.match_substring(lines, '"').to_pylist()


def _survey(multi_line: bool):
    """Per range: how it ends from either start, and the header if it is a file's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []  # [file, start, ends if outside, ends if inside, header lines, header done]
        for batch in batches:
            for file, start, lines in _runs(batch):
                if not out or out[-1][:2] != [file, start]:
                    out.append([file, start, False, True, [], start != 0])
                state = out[-1]
                if multi_line and not state[5]:
                    for line in lines.to_pylist():
                        if not state[4] and line.strip("\r﻿") == "":
                            continue
                        state[4].append(line)
                        state[5] = not ends_inside("\n".join(state[4]), False)
                        if state[5]:
                            break
                elif not state[5]:
                    state[4] = [x for x in lines.to_pylist() if x.strip("\r﻿")][:1]
                    state[5] = bool(state[4])
                if multi_line:
                    for line in lines.filter(pa.array(_quoted(lines))).to_pylist():
                        state[2], state[3] = ends_inside(line, state[2]), ends_inside(line, state[3])
        if any(s[4] and not s[5] for s in out):
            raise ValueError("a header crosses two ranges of its file")
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s in out], pa.string()), pa.array([s[1] for s in out], pa.int64()),
             pa.array([s[2] for s in out], pa.bool_()), pa.array([s[3] for s in out], pa.bool_()),
             pa.array(["\n".join(s[4]).removesuffix("\r").removeprefix("﻿") if s[4] else None for s in out], pa.string())],
            names=["file", "start", "if_outside", "if_inside", "header"])

    return run


_FIELDS = ["file", "start", "kind", "first", "nth", "record"]


def _records(inside: frozenset[tuple[str, int]], multi_line: bool):
    """Per range: whole records, and pieces of records that cross ranges.

    ``kind`` is "whole", or "head", "middle" or "tail" for a piece; ``first`` marks a file's first record; ``nth`` counts
    the other records that start in the range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[str, int] | None = None
        held: list[str] = []       # lines of the record that is open
        opened = False             # whether it started in this range
        first = False              # whether the next record is the file's first
        count = 0                  # records that started in this range, the file's first left out

        def rows(values: pa.Array, kinds: list[str], marks: list[bool], places: list[int]) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(kinds, pa.string()),
                 pa.array(marks, pa.bool_()), pa.array(places, pa.int64()), values], names=_FIELDS)

        def close() -> Iterator[pa.RecordBatch]:
            """The range ends with an open record."""
            if held:
                yield rows(pa.array(["\n".join(held)], pa.string()), ["head" if opened else "middle"], [first and opened], [count])

        for batch in batches:
            for file, start, lines in _runs(batch):
                if key != (file, start):
                    yield from close()
                    key, held, first, count = (file, start), [], start == 0, 0
                    open_now = (file, start) in inside
                    opened = not open_now
                else:
                    open_now = bool(held) or (not opened and (file, start) in inside)
                quoted = _quoted(lines) if multi_line else [False] * len(lines)
                if not open_now and not first and not any(quoted):
                    opened = True
                    kept = lines.filter(pc.not_equal(pc.utf8_trim(lines, "\r"), ""))
                    n = len(kept)
                    yield rows(pc.utf8_rtrim(kept, "\r"), ["whole"] * n, [False] * n, list(range(count, count + n)))
                    count += n
                    continue
                values, kinds, marks, places = [], [], [], []
                for line, has_quote in zip(lines.to_pylist(), quoted):
                    if not open_now:
                        if not line.strip("\r"):
                            continue
                        opened = True
                    held.append(line)
                    if has_quote:
                        open_now = ends_inside(line, open_now)
                    if not open_now:
                        values.append("\n".join(held).removesuffix("\r"))
                        kinds.append("whole" if opened else "tail")
                        marks.append(first and opened)
                        places.append(count)
                        count += opened and not first
                        first = first and not opened
                        held, opened = [], True
                if values:
                    yield rows(pa.array(values, pa.string()), kinds, marks, places)
        if key is not None:
            yield from close()

    return run


def csv_records(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, list[tuple[int, str]]]:
    """The records of all files under ``path`` (``hid``, ``file``, ``start``, ``nth``, ``record``), headers left out, and the distinct headers with
    their numbers ``hid``, in order of the first files that have them."""
    lines = _lines(spark, path)
    ranges = materialize(lines.mapInArrow(_survey(multi_line), "file string, start bigint, if_outside boolean, "
                                                               "if_inside boolean, header string"), "csv-ranges")
    # how a range starts: the running composition of the answers of the ranges before it
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    answers = F.collect_list(F.struct("if_outside", "if_inside")).over(before)
    starts = F.aggregate(answers, F.lit(False), lambda s, a: F.when(s, a["if_inside"]).otherwise(a["if_outside"]))
    some = ranges.where("if_outside OR NOT if_inside").select("file").distinct()  # only files in which a quote is open at some end
    inside = frozenset((r["file"], r["start"]) for r in ranges.join(some, "file", "left_semi")
                       .select("file", "start", starts.alias("inside")).where("inside").collect())
    of_file = ranges.where("header is not null").select("file", "header", F.xxhash64("header").alias("hid"))
    headers = of_file.groupBy("header", "hid").agg(F.min("file").alias("first")).orderBy("first").collect()
    parts = lines.mapInArrow(_records(inside, multi_line), "file string, start bigint, kind string, first boolean, nth bigint, record string")
    if inside:
        parts = materialize(parts, "csv-parts")
        whole = parts.where("kind = 'whole'").unionByName(_joined(parts.where("kind != 'whole'")))
    else:
        whole = parts
    return (whole.where(~F.col("first")).join(of_file.select("file", "hid"), "file").select("hid", "file", "start", "nth", "record"),
            [(r["hid"], r["header"]) for r in headers])


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that cross ranges: the pieces from one head up to the next."""
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == "head").rowsBetween(Window.unboundedPreceding, 0)
    number = F.count_if(F.col("kind") == "head").over(order)
    piece = F.struct("start", (F.col("kind") == "head").alias("head"), "nth", "record")
    return (pieces.withColumn("number", number).groupBy("file", "number")
            .agg(F.sort_array(F.collect_list(piece)).alias("p"), F.bool_or("first").alias("first"))
            .select("file", F.col("p")[0]["start"].alias("start"), F.lit("whole").alias("kind"), "first",
                    F.col("p")[0]["nth"].alias("nth"), F.rtrim(F.array_join("p.record", "\n"), F.lit("\r")).alias("record")))


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = True,
             places: bool = False) -> DataFrame:
    """All CSV files under ``path`` with every column as a string; ``columns`` names them by position instead of by header.

    With ``places`` three columns tell where a record starts: ``_file``, ``_start`` (of the range), ``_nth`` (in it, from 0).
    """
    records, headers = csv_records(spark, path, multi_line)
    if not headers:
        raise ValueError(f"no columns in {path!r}")
    names = {hid: list(columns) if columns else column_names(next(csv.reader(io.StringIO(header), strict=False), []))
             for hid, header in headers}
    options = {"escape": '"', "emptyValue": "", "mode": "PERMISSIVE"}

    def parsed(hid: int) -> Column:
        ddl = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names[hid])
        return F.from_csv(F.col("record"), ddl, options)

    # one struct a header, each record parsed once
    place = [F.col(c).alias(f"_{c}") for c in ("file", "start", "nth")] if places else []
    rows = records.select(*place, *[F.when(F.col("hid") == hid, parsed(hid)).alias(f"h{i}") for i, hid in enumerate(names)])
    every = list(dict.fromkeys(n for own in names.values() for n in own))
    return rows.select(*[c for c in rows.columns if c[0] == "_"], *[F.coalesce(*[F.col(f"h{i}").getField(n) for i, own in enumerate(names.values()) if n in own]).alias(n)
                         for n in every])

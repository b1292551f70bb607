"""CSV files with quoted line ends, read by many tasks (survey S2).

A line end inside quotes does not end a record, so a byte range alone cannot tell where records begin, and Spark's multi-line
reader gives a file to one task. Here a file's lines are read by ranges (Spark's text scan, one range a split). A first pass
says for every range in what state (outside or inside quotes) it ends, for each state it may begin in: one row a range. The
ranges of a file are then chained, which gives the state each begins in. A second pass cuts the ranges into records; only the
pieces of records that cross a border of ranges are shuffled and joined. Records become columns by ``from_csv``.

Quotes open only where a field begins and close before a delimiter or the end of a line; a doubled quote inside is one
quote. So a stray quote inside a bare field does not swallow the rows behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges that begin inside quotes travel to every task; beyond so many the file is not read like this.
MOST_OPEN_RANGES = 1_000_000
# what a record is made of, from the place where a field begins: a closed quoted field, or a bare one
_FIELD = re.compile(r'"[^"]*(?:""[^"]*)*"(?!")[^,]*(?:,|\Z)|(?!")[^,]*(?:,|\Z)')
_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside quotes, or where a field begins, ends inside quotes."""
    at = 0
    if inside:
        close = _CLOSE.match(line)
        if close is None:
            return True
        at = line.find(",", close.end()) + 1
        if not at:
            return False
    elif '"' not in line:
        return False
    while at < len(line):
        field = _FIELD.match(line, at)
        if field is None:  # an opened quote without its end
            return True
        at = field.end()
    return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[str]]]:
    """(file, range, lines) in the order of the scan; a range may come in several pieces."""
    for b in batches:
        files, starts, lines = (b.column(c).to_pylist() for c in ("file", "at", "value"))
        first = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (files[i], starts[i]) != (files[first], starts[first]):
                yield files[first], starts[first], lines[first:i]
                first = i


def open_ranges(lines: DataFrame) -> DataFrame:
    """(file, at) of the ranges that begin inside quotes."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], list[bool]] = {}
        for file, at, some in _runs(batches):
            now = state.setdefault((file, at), [False, True])
            for line in some:
                if '"' in line:
                    now[:] = [ends_inside(line, s) for s in now]
        rows = [(f, a, *s) for (f, a), s in state.items()]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()),
                                          pa.array(cols[3], pa.bool_())], names=["file", "at", "bare", "quoted"])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        inside, found = False, []
        for r in rows.sort_values("at").itertuples():  # one row a range of the file
            if inside:
                found.append((r.file, r.at))
            inside = r.quoted if inside else r.bare
        return pd.DataFrame(found, columns=["file", "at"]).astype("int64")

    made = lines.mapInArrow(ends, "file long, at long, bare boolean, quoted boolean")
    return made.groupBy("file").applyInPandas(chain, "file long, at long")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, first, record): the records of CSV files at ``path`` as text, the quoted line ends inside; ``first`` marks
    the first record of a file."""
    lines = _lines(spark, path)
    inside = {(r["file"], r["at"]) for r in open_ranges(lines).limit(MOST_OPEN_RANGES + 1).collect()}
    if len(inside) > MOST_OPEN_RANGES:
        raise ValueError(f"more than {MOST_OPEN_RANGES} ranges begin inside quotes: {path}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["file", "at", "first", "part", "record"]

        def given(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema)

        where, held, quoted, begun, fresh, rows = None, [], False, True, False, []
        # begun: the record at hand began in this range; fresh: no record of the file has been seen
        for file, at, some in _runs(batches):
            if (file, at) != where:
                if held:
                    rows.append((*where, fresh, "head" if begun else "middle", "\n".join(held)))
                where, held = (file, at), []
                quoted = where in inside
                begun, fresh = not quoted, at == 0
            for line in some:
                held.append(line)
                if '"' in line or quoted:
                    quoted = ends_inside(line, quoted)
                if not quoted:
                    rows.append((*where, fresh, "whole" if begun else "tail", "\n".join(held)))
                    held, begun, fresh = [], True, False
                    if len(rows) >= 8192:
                        yield given(rows)
                        rows = []
        if held:
            rows.append((*where, fresh, "head" if begun else "middle", "\n".join(held)))
        yield given(rows)

    pieces = lines.mapInArrow(cut, "file long, at long, first boolean, part string, record string")
    whole = pieces.where("part = 'whole'").select("file", "at", "first", "record")
    # at most two pieces a range: the head of a record joins what follows up to its tail
    broken = pieces.where("part <> 'whole'")
    order = [F.col("at"), F.when(F.col("part") == "head", 1).otherwise(0)]
    number = F.sum((F.col("part") == "head").cast("int")).over(Window.partitionBy("file").orderBy(*order))
    joined = broken.withColumn("n", number).groupBy("file", "n").agg(
        F.min("at").alias("at"), F.bool_or("first").alias("first"),
        F.sort_array(F.collect_list(F.struct("at", F.when(F.col("part") == "head", 1).otherwise(0).alias("k"), "record"))).alias("r"))
    return whole.unionByName(joined.select("file", "at", "first", F.array_join(F.transform("r", lambda x: x["record"]), "\n").alias("record")))


def read_split(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The rows of CSV files with a header as text columns ``names`` (of the header, in order); malformed rows fill with nulls."""
    text = F.regexp_replace("record", "\r\\z", "")
    body = records(spark, path).where(~F.col("first")).select(text.alias("record")).where("record <> ''")
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = body.select(F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    return parsed.select(*(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)))

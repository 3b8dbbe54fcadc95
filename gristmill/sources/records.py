"""Records of csv files whose quoted fields hold line breaks, without a task per file.

Spark cuts a text file into ranges and reads physical lines. Whether a line break ends a record
depends on everything before it, but only through one bit: is a quoted field open. So every line
is a function from that bit to that bit, and so is a range, as the composition of its lines:

1. Tasks follow both cases, closed and open, along the lines of their range. A line without a
   quote changes nothing, so only lines with quotes are looked at.
2. One row per range goes through a window that composes the ranges of a file in order. It says
   how each range begins, and which record is open there.
3. Lines that begin and end closed are records as they stand. Only the others are shuffled, by the
   record they belong to, and put together.

A quote opens a field only at its start; elsewhere in a bare field it is a character. Inside a
quoted field two quotes are one. A field that is never closed is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gristmill.plans.session import checkpoint, sized

# What follows the start of a field up to its end, and the rest of a quoted field up to its closing quote.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"(?!")[^,]*+|(?!")[^,]*+),)*+'
#: A line that begins closed and ends open, and one that begins open and ends open.
CLOSED_TO_OPEN = rf'(?s)^{_FIELDS}"{_INSIDE}$'
OPEN_TO_OPEN = rf'(?s)^{_INSIDE}(?:$|"(?!")[^,]*+,{_FIELDS}"{_INSIDE}$)'

FILE, RANGE, SEQ, LINE = "file", "range_start", "seq", "line"
LINE_SCHEMA = "file string, range_start long, seq long, line string, before0 boolean, after0 boolean, start0 long, before1 boolean, after1 boolean, start1 long"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, range_start, line``: physical lines, in order within each range of a file."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(RANGE), F.col("value").alias(LINE))


def opens_a_field(line: Column) -> Column:
    """Whether a line that begins a record leaves a quoted field open."""
    return line.contains('"') & line.rlike(CLOSED_TO_OPEN)


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any record goes over a line end. If no line opens a field, none does."""
    return not spark.read.option("lineSep", "\n").text(path).where(opens_a_field(F.col("value"))).isEmpty()


def followed(lines: DataFrame) -> DataFrame:
    """Add to each line its number and, for ranges that begin closed (0) and open (1), whether a field is
    open before and after it and the number of the line that begins its record, null if that lies in an
    earlier range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_open = [re.compile(CLOSED_TO_OPEN), re.compile(OPEN_TO_OPEN)]
        place = None
        for batch in batches:
            files, ranges, lines = (batch.column(c) for c in (FILE, RANGE, LINE))
            quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
            n = batch.num_rows
            numbers, opened, starts = np.zeros(n, np.int64), np.zeros((2, 2, n), bool), np.zeros((2, n), np.int64)
            new = pc.or_(pc.not_equal(files.slice(1), files.slice(0, n - 1)), pc.not_equal(ranges.slice(1), ranges.slice(0, n - 1)))
            cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
            for low, high in zip(cuts, cuts[1:]):
                if place != (files[low].as_py(), ranges[low].as_py()):
                    place, seq, state, start = (files[low].as_py(), ranges[low].as_py()), 0, [False, True], [-1, -1]
                numbers[low:high] = np.arange(seq, seq + high - low)
                seq += high - low
                marked = np.flatnonzero(quoted[low:high])  # only these can change anything
                for case in (0, 1):
                    states = [state[case]]
                    for i in marked.tolist():
                        states.append(to_open[states[-1]].search(lines[low + i].as_py()) is not None)
                    state[case] = states[-1]
                    at = np.arange(high - low)
                    opened[case, 0, low:high] = np.array(states)[np.searchsorted(marked, at, side="left")]
                    opened[case, 1, low:high] = np.array(states)[np.searchsorted(marked, at, side="right")]
                    begun = np.where(opened[case, 0, low:high], -1, numbers[low:high])
                    starts[case, low:high] = np.maximum(np.maximum.accumulate(begun), start[case])
                    start[case] = int(starts[case, high - 1])
            cases = [x for c in (0, 1) for x in (pa.array(opened[c, 0]), pa.array(opened[c, 1]), pa.array(starts[c], mask=starts[c] < 0))]
            columns = [files, ranges, pa.array(numbers), lines, *cases]
            yield pa.RecordBatch.from_arrays(columns, ["file", "range_start", "seq", "line", "before0", "after0", "start0", "before1", "after1", "start1"])

    return lines.mapInArrow(run, LINE_SCHEMA)


def range_states(followed_lines: DataFrame) -> DataFrame:
    """``file, range_start, open, open_range, open_seq``: is a field open where the range begins, and in which record.

    Ranges of a file are composed in order by folding their functions; a range is one row.
    """
    last = F.max_by(F.struct("after0", "start0", "after1", "start1"), SEQ).alias("end")
    ranges = followed_lines.groupBy(FILE, RANGE).agg(last)
    # A range that ends the same way in both cases decides the state whatever came before; between such
    # ranges, each either keeps the state or turns it round, so turns are counted.
    along = Window.partitionBy(FILE).orderBy(RANGE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    decides = F.col("end.after0") == F.col("end.after1")
    turns = F.when(F.col("end.after0") & ~F.col("end.after1"), 1).otherwise(0)
    counted = ranges.withColumn("turns", F.sum(turns).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    anchor = F.last(F.when(decides, F.struct(F.col("end.after0").alias("state"), "turns")), ignorenulls=True).over(earlier)
    so_far = F.coalesce(F.lag("turns").over(along), F.lit(0)) - F.coalesce(F.col("anchor.turns"), F.lit(0))
    state = F.coalesce(F.col("anchor.state"), F.lit(False)) != (so_far % 2 == 1)
    begun = counted.withColumn("anchor", anchor).withColumn("open", state)
    case = lambda name: F.when(F.col("open"), F.col(f"end.{name}1")).otherwise(F.col(f"end.{name}0"))
    ended = begun.withColumn("ends_open", case("after")).withColumn("own_start", case("start"))
    # The open record began in the last earlier range in which any record began.
    begins = F.last(F.when(F.col("own_start").isNotNull(), F.struct(F.col(RANGE).alias("r"), F.col("own_start").alias("s"))), ignorenulls=True).over(earlier)
    return ended.withColumn("begins", begins).select(
        FILE, RANGE, "open", F.col("begins.r").alias("open_range"), F.col("begins.s").alias("open_seq"), "ends_open"
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, position, record``: logical records; ``position`` grows along a file, no two are equal there."""
    lines = followed(lines_of(spark, path))
    ranges = checkpoint(range_states(lines))
    at_end = ranges.groupBy(FILE).agg(F.max_by("ends_open", RANGE).alias("ends_open")).where("ends_open").select(FILE).first()
    if at_end:
        raise ValueError(f"a quoted field is not closed at the end of {at_end[0]}")
    states = sized(ranges.drop("ends_open"))
    told = lines.join(states, [FILE, RANGE])
    case = lambda name: F.when(F.col("open"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    told = told.select(FILE, RANGE, SEQ, LINE, case("before").alias("before"), case("after").alias("after"), case("start").alias("start"), "open_range", "open_seq")
    whole = told.where("NOT before AND NOT after").select(FILE, (F.col(RANGE) + F.col(SEQ)).alias("position"), F.col(LINE).alias("record"))
    first_range = F.when(F.col("start").isNotNull(), F.col(RANGE)).otherwise(F.col("open_range"))
    begins = first_range + F.coalesce("start", "open_seq")
    parts = told.where("before OR after").select(FILE, begins.alias("position"), F.struct((F.col(RANGE) + F.col(SEQ)).alias("at"), LINE).alias("part"))
    joined = parts.groupBy(FILE, "position").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p[LINE]), "\n").alias("record")
    )
    # A line takes one byte at least, so the start of a range and the number of a line add up in order.
    both = whole.unionByName(joined)
    return both.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.trim("record") != "")

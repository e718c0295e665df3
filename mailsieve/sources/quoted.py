"""Delimited text with quoted line breaks, read by many tasks a file.

`multiLine` reads a file in one task, because whether a line break ends a record
depends on the quotes before it.  Here files are split as plain text is:

1. each block of a file is summed up by what it makes of both cases at its
   start: inside a quoted field or not.  Such a summary keeps the case, swaps
   it, or sets it;
2. a prefix over the summaries of a file's blocks tells which blocks begin
   inside a quoted field;
3. each block is cut into records at its true ends.  What belongs to a record
   that began in an earlier block, or goes on in a later one, becomes a
   fragment; fragments are put together by record, and every record goes
   through `from_csv`.

A quote opens a field only where the field begins, and a doubled quote inside
is a quote, so stray quotes within a field do no harm.  Lines end with "\\n";
one "\\r" before the end of a record goes.  Empty lines between records are no
records.  A field that is still open where its file ends takes the rest along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

OPEN_BLOCKS = 200_000  # blocks that begin inside a field and travel with the tasks, 16 bytes each
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3  # a record, the end of one, a block inside one, the beginning of one
_COLUMNS = "file long, start long, kind int, first boolean, text string"


def _closing(line: str, at: int, quote: str) -> int:
    """The place after the quote that closes a field, or -1."""
    while (k := line.find(quote, at)) >= 0:
        if not line.startswith(quote, k + 1):
            return k + 1
        at = k + 2
    return -1


def ends_open(line: str, is_open: bool, sep: str, quote: str = '"') -> bool:
    """Whether a line ends inside a quoted field, given whether it begins inside one."""
    if quote not in line:
        return is_open
    at = 0
    while True:
        if is_open or line.startswith(quote, at):
            at = _closing(line, at if is_open else at + 1, quote)
            if at < 0:
                return True
            is_open = False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, pos): lines with the block they begin in, in order within their task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("pos"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(file, start, first row, end) of the consecutive rows of one block."""
    file, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start"))
    firsts = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (start[1:] != start[:-1]))).tolist() if len(file) else []
    for first, end in zip(firsts, [*firsts[1:], len(file)]):
        yield int(file[first]), int(start[first]), first, end


def _summaries(lines: DataFrame, sep: str) -> DataFrame:
    """(file, start, from_closed, from_open): whether each block ends inside a field, for both cases at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[bool]] = {}
        for batch in batches:
            quoted = pc.match_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)
            for file, start, first, end in _runs(batch):
                state = held.setdefault((file, start), [False, True])
                for k in (first + np.flatnonzero(quoted[first:end])).tolist():
                    line = batch.column("value")[k].as_py()
                    state[:] = (ends_open(line, is_open, sep) for is_open in state)
        rows = [(*key, *state) for key, state in held.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))],
            ["file", "start", "from_closed", "from_open"])

    return lines.select("value", "file", "start").mapInArrow(run, "file long, start long, from_closed boolean, from_open boolean")


def open_blocks(summaries: DataFrame) -> DataFrame:
    """(file, start) of the blocks that begin inside a quoted field."""
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("from_closed") & ~F.col("from_open")).cast("int")
    fixed = F.when(F.col("from_closed") == F.col("from_open"), F.col("from_closed").cast("int"))
    rows = summaries.select("file", "start", swap.alias("swap"), fixed.alias("fixed"))
    rows = rows.withColumn("swaps", F.sum("swap").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    # the last block that sets the case decides, together with the swaps after it
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swaps")), ignorenulls=True).over(earlier)
    rows = rows.withColumns({"last": last, "before": F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("start")), F.lit(0))})
    case = F.coalesce(F.col("last.fixed"), F.lit(0)) + F.col("before") - F.coalesce(F.col("last.swaps"), F.lit(0))
    return rows.filter(case % 2 == 1).select("file", "start")


def _cut(lines: DataFrame, sep: str, known: set[tuple[int, int]] | None) -> DataFrame:
    """(file, start, kind, first, text): records and fragments.  Blocks that begin open are in `known`, or marked in a column of the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, is_open, held, kind, first_line = None, False, [], WHOLE, False
        out: list[tuple] = []

        def end_block():
            if held:  # the rest of the block is inside a field
                out.append((*block, MIDDLE if kind == HEAD else TAIL, first_line, "\n".join(held)))

        for batch in batches:
            values = batch.column("value").to_pylist()
            for file, start, at, end in _runs(batch):
                if (file, start) != block:
                    end_block()
                    block = file, start
                    is_open = block in known if known is not None else bool(batch.column("open")[at].as_py())
                    held, kind, first_line = [], HEAD if is_open else WHOLE, start == 0
                for line in values[at:end]:
                    is_open = ends_open(line, is_open, sep)
                    held.append(line)
                    if not is_open:
                        out.append((*block, kind, first_line, "\n".join(held)))
                        held, kind, first_line = [], WHOLE, False
            yield rows(out)
            out.clear()
        end_block()
        yield rows(out)

    def rows(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["file", "start", "kind", "first", "text"])

    return lines.mapInArrow(run, _COLUMNS)


def _stitched(fragments: DataFrame) -> DataFrame:
    """(first, text) of the records that lie in more than one block."""
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = fragments.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("start", "kind", "text")))
    whole = numbered.groupBy("file", "record").agg(F.max("first").alias("first"), parts.alias("parts"))
    return whole.select("first", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def quoted_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(first, text): the records of all files, `first` being the first one of its file."""
    lines = _lines(spark, path)
    opened = materialize(open_blocks(materialize(_summaries(lines, sep), "block-summaries")), "open-blocks")
    if opened.limit(OPEN_BLOCKS + 1).count() <= OPEN_BLOCKS:
        known = {(r["file"], r["start"]) for r in opened.collect()}
        cut = _cut(lines.select("value", "file", "start"), sep, known)
    else:  # a join, after which each block's lines are put in order again
        marked = lines.join(opened.withColumn("open", F.lit(True)), ["file", "start"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
        cut = _cut(marked.repartition("file", "start").sortWithinPartitions("file", "start", "pos").select("value", "file", "start", "open"), sep, None)
    cut = materialize(cut, "cut-records")
    records = cut.filter(F.col("kind") == WHOLE).select("first", "text").unionByName(_stitched(cut.filter(F.col("kind") != WHOLE)))
    return records.withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_quoted(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """The rows of delimited files with quoted line breaks, columns taken by position."""
    records = quoted_records(spark, path, sep).filter("text <> ''")
    records = records.filter(~F.col("first")) if header else records
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return records.select(F.from_csv("text", F.lit(schema), options).alias("r")).select("r.*")

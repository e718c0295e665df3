"""Packing by concatenating all documents and cutting at fixed windows.

1. A narrow pass encodes every document and notes where its ids begin within its
   task's stream; the ids are written once.
2. Prefix sums over the tasks' totals (one row a task, in blocks of tasks) give
   each task's place in the one stream of all ids.
3. A second narrow pass cuts the written ids at multiples of the window and
   reports one record for each part of a document between two boundaries.
   No row is shuffled but the totals.

The ids after the last whole window go into windows of falling powers of two,
which need no padding, so all padding is nought.

Null text is empty; every document has at least its end id.  A null or repeated
doc_id is a document like any other.  An empty table gives no rows.  A long
document spans as many windows as it needs.  Documents follow each other in the
order of the input's partitions; ties do not arise.  Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_ids import encoder
from .common import byte_slices, keep_only, materialize, table

WINDOW = 2048
_TOGETHER = 1024  # tasks whose totals are summed in one window
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_stream(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, place, doc_id, n, ids): each document's ids with the end id, and how many ids of its task precede them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        end, size = np.array([end_id], ids_of.dtype).tobytes(), ids_of.dtype.itemsize
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, texts in byte_slices(batch.column("text")):
                ids = [x + end for x in ids_of.encode(texts)]
                n = np.array([len(x) // size for x in ids], np.int64)
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(places), doc_ids.slice(at, len(ids)).cast(pa.int64()),
                     pa.array(n), pa.array(ids, pa.binary())],
                    ["part", "place", "doc_id", "n", "ids"])

    return keep_only(docs, "doc_id", "text").mapInArrow(run, "part int, place long, doc_id long, n long, ids binary")


def task_offsets(stream: DataFrame) -> DataFrame:
    """(part, base): ids of all tasks before each one.  Totals are summed within blocks of tasks, then over the blocks."""
    totals = stream.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.expr(f"part div {_TOGETHER}"))
    earlier = (Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(*earlier)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("block").orderBy("part").rowsBetween(*earlier)
    return (totals.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
            .join(blocks, "block").select("part", (F.col("before") + F.col("inner")).alias("base")))


class Windows:
    """Boundaries of a stream of `total` ids: whole windows, then the rest in falling powers of two."""

    def __init__(self, total: int, size: int = WINDOW):
        self.size, self.whole = size, total // size
        rest, tail = total % size, [total // size * size]
        for bit in range(size.bit_length(), -1, -1):
            if rest >> bit & 1:
                tail.append(tail[-1] + (1 << bit))
        self.tail = np.array(tail, np.int64)

    def number(self, at: np.ndarray) -> np.ndarray:
        """The window in which each place lies."""
        return np.where(at < self.tail[0], at // self.size, self.whole + np.searchsorted(self.tail, at, "right") - 1)

    def begin(self, number: np.ndarray) -> np.ndarray:
        return np.where(number < self.whole, number * self.size, self.tail[np.clip(number - self.whole, 0, len(self.tail) - 1)])


def cut(stream: DataFrame, windows: Windows, dtype: str) -> DataFrame:
    """The pieces of documents (place, n, ids, base) between the boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, n, base = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "n", "base"))
            first = place + base
            lowest = windows.number(first)
            many = windows.number(first + n - 1) - lowest + 1
            row = np.repeat(np.arange(len(n)), many)
            number = lowest[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            left = np.maximum(windows.begin(number), first[row])
            right = np.minimum(windows.begin(number + 1), (first + n)[row])
            right = np.where(np.append(row[1:] != row[:-1], True), (first + n)[row], right)  # the last piece ends with its document
            start, sums, column = left - first[row], [], batch.column("ids")
            at = -1
            for k, begin, end in zip(row.tolist(), start.tolist(), (right - first[row]).tolist()):
                if k != at:
                    at, ids = k, np.frombuffer(column[k].as_buffer(), dtype).astype("<u4")
                sums.append(zlib.crc32(ids[begin:end]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(right - left), pa.array(sums, pa.int64()),
                 pa.array(n[row]), pa.array(number), pa.array(left - windows.begin(number))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return stream.select("doc_id", "place", "n", "ids", "base").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Every piece of every document with its window and place there."""
    stream = materialize(encode_stream(docs, tokenizer, end_id), "id-stream")
    offsets = materialize(task_offsets(stream), "id-offsets")  # one row a task: written, so that its true size is known to the join
    total = stream.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return cut(stream.join(offsets, "part"), Windows(total, window), encoder(tokenizer).dtype.str)


def op11_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 11: the pieces of all documents in windows of 2048."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

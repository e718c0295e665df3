"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the sequence length, so the counts per length
(at most `capacity` numbers, whatever the corpus) are the packing instance.  The
solver works on runs of equal things: a run of sequences with the same content
is one entry.

1. Large lengths (over `small`) are cut into groups of equal cardinality; a
   group's size is its largest length.
2. A cutting-stock linear programme over the few group sizes (column generation
   with a knapsack as pricing) gives configurations and how often to use each.
3. Documents take the slots of their group, longest first; what the rounding
   left free, and large documents beyond the rounded-down programme, go on.
4. The rest, longest first, goes where it fits best.

Documents are numbered within their length by a per-task counter at encoding
plus offsets from counts per task, so no window or sort runs over documents;
the plan, a bounded table, is looked up by (length, number).

Edge cases: a null or empty text is the end id alone; a null doc_id is kept;
repeated rows are packed as often as they occur; a document over the capacity
is cut into full pieces and a rest; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, keep_only, materialize, release, small_batches, table
from .word_ids import encoder

REMEMBERED = 250_000  # chunks that a worker keeps the ids of
SLICE_BYTES = 3_000_000  # text encoded at once
ROWS = 1500  # documents that go to Python at once
CAPACITY = 4096
SMALL = CAPACITY // 3  # lengths up to here are left to the best-fit step
GROUPS = 64  # groups of large lengths


# ---- the plan, on counts per length -------------------------------------------------------

def _price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of a sequence filled with any number of each size, and how many of each."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k, (s, v) in enumerate(zip(sizes.tolist(), values.tolist())):
        if v <= 1e-12:
            continue
        for _ in range(capacity // s):  # each pass allows one copy more
            gain = best[:-s] + v
            better = gain > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = gain[better]
            last[s:][better] = k
    counts, at = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    value = float(best[at])
    while at > 0 and last[at] >= 0:
        counts[last[at]] += 1
        at -= int(sizes[last[at]])
    return value, counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(copies of each size, uses) by the cutting-stock programme, uses rounded down."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    for _ in range(8 * k):
        inverse = np.linalg.inv(columns)
        value, fresh = _price(sizes, np.ones(k) @ inverse, capacity)
        if value <= 1 + 1e-9:
            break
        uses, step = inverse @ demand, inverse @ fresh
        ratio = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(np.argmin(ratio))] = fresh
    uses = np.linalg.solve(columns, demand.astype(float))
    return [(columns[:, j].round().astype(np.int64), int(u + 1e-9)) for j, u in enumerate(uses) if u >= 1 - 1e-9]


class Plan:
    """Runs of sequences: each run has a first sequence, a number of them and the place taken so far."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first number, first sequence, per sequence, offset
        self.free: dict[int, list[tuple[int, int]]] = {}  # free place -> (first sequence, number of them)
        self.taken: dict[int, int] = {}  # length -> documents placed

    def put(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        """`count` documents, `each` in one sequence, from `sequence` on."""
        self.rows.append((length, self.taken.get(length, 0), sequence, each, offset))
        self.taken[length] = self.taken.get(length, 0) + count

    def leave(self, free: int, sequence: int, number: int) -> None:
        if number > 0 and free > 0:
            self.free.setdefault(free, []).append((sequence, number))


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> Plan:
    """Place every document that the counts per length stand for."""
    plan, left = Plan(capacity), {k: n for k, n in counts.items() if n > 0}
    for length in [k for k in left if k == capacity]:
        n = left.pop(length)
        plan.put(length, n, plan.sequences, 1, 0)
        plan.sequences += n
    large = sorted((k for k in left if k > small), reverse=True)
    if large:
        total = sum(left[k] for k in large)
        cut = np.minimum(np.cumsum([left[k] for k in large]) - 1, total - 1) * groups // total
        members: dict[int, list[int]] = {}  # the group's largest length -> its lengths, longest first
        names: dict[int, int] = {}
        for length, g in zip(large, cut.tolist()):
            members.setdefault(names.setdefault(g, length), []).append(length)
        sizes = np.array(list(members))
        queue = {s: [[k, left[k]] for k in members[s]] for s in members}
        demand = np.array([sum(n for _, n in queue[s]) for s in queue])
        for copies, uses in sorted(configurations(sizes, demand, capacity), key=lambda c: -c[1]):
            _fill(plan, queue, sizes, copies, uses)
        left.update({length: 0 for length in large})
        left.update({length: n for s in queue for length, n in queue[s]})
    for length in sorted(left, reverse=True):
        _best_fit(plan, length, left[length])
    return plan


def _fill(plan: Plan, queue: dict, sizes: np.ndarray, copies: np.ndarray, uses: int) -> None:
    """Documents take the slots of `uses` sequences of one configuration; equal sequences stay one run."""
    slots = [int(s) for s, c in zip(sizes, copies) for _ in range(c)]
    uses = min([uses] + [sum(n for _, n in queue[s]) // slots.count(s) for s in set(slots)])
    runs = [(plan.sequences, uses, 0)]  # first, number, place taken
    plan.sequences += uses
    for slot in slots:
        out = []
        for first, number, taken in runs:
            while number:
                length, n = queue[slot][0]
                now = min(n, number)
                plan.put(length, now, first, 1, taken)
                out.append((first, now, taken + length))
                first, number = first + now, number - now
                queue[slot][0][1] -= now
                if not queue[slot][0][1]:
                    queue[slot].pop(0)
        runs = out
    for first, number, taken in runs:
        plan.leave(plan.capacity - taken, first, number)


def _best_fit(plan: Plan, length: int, count: int) -> None:
    """Put `count` documents of one length, each where the least place stays free."""
    while count:
        fits = [f for f in plan.free if f >= length]
        if not fits:
            each = plan.capacity // length
            number = -(-count // each)
            plan.leave(plan.capacity, plan.sequences, number)
            plan.sequences += number
            fits = [plan.capacity]
        free = min(fits)
        first, number = plan.free[free].pop()
        if not plan.free[free]:
            del plan.free[free]
        each, offset = free // length, plan.capacity - free
        whole = min(number, count // each)
        plan.put(length, whole * each, first, each, offset) if whole else None
        plan.leave(free - each * length, first, whole)
        count -= whole * each
        rest = number - whole
        if rest and count:  # the last sequence takes fewer
            plan.put(length, count, first + whole, count, offset)
            plan.leave(free - count * length, first + whole, 1)
            count, whole, rest = 0, whole + 1, rest - 1
        plan.leave(free, first + whole, rest)


# ---- Spark ----------------------------------------------------------------------------------

def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: place, length, check sum, the task and the piece's number in its task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, REMEMBERED).encode, np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in byte_slices(batch.column("text"), SLICE_BYTES):
                out: list[list] = [[] for _ in range(6)]
                for doc_id, ids in zip(doc_ids[at:at + len(texts)], encode(texts)):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        raw = ids[start:start + 4 * capacity]
                        length = len(raw) // 4
                        number = seen[length] = seen.get(length, -1) + 1
                        for column, value in zip(out, (doc_id, piece, start // 4, length, zlib.crc32(raw), number)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]],
                     pa.array([part] * len(out[0]), pa.int32())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "number", "part"])
        release()

    return keep_only(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, number long, part int")


def place(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Look up each piece (length, number) in the plan."""
    rows = np.array(plan.rows, np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shift = np.int64(48)  # length and number in one key; fewer than 2^48 pieces of a length
    keys = rows[:, 0] << shift | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = rows[np.searchsorted(keys, length << shift | number, "right") - 1] if len(rows) else rows
            beyond = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(row[:, 2] + beyond // row[:, 3], pa.int64()),
                 pa.array(row[:, 4] + beyond % row[:, 3] * length, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` ids."""
    with small_batches(docs.sparkSession, ROWS):
        pieces = materialize(encode_pieces(docs, tokenizer, end_id, capacity), "pieces")
    by_task = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["length", "part"]).withColumn("number", F.col("number") + F.col("before"))
    return place(numbered, make_plan(counts, capacity))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 1: every piece with its sequence and place."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

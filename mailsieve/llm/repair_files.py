"""Token-id files: each block of ids is a Re-Pair grammar.

Documents are range-partitioned by id and encoded in ascending order.  A task
cuts its documents into blocks; in a block, frequent pairs of neighbouring
symbols are replaced by new symbols, round after round, until a round saves
little.  A block stores the rules, the length each rule expands to and marks
into the symbol string, so one document is decoded without the rest.

Blocks are rows of a Parquet table (any file system, committed by Spark), in
ascending order: `shard` and `block` give the order, `first` the ids before the
block in its shard, `payload` the grammar.

Edge cases: a null or empty text has only the end id; a null doc_id sorts
first; rows with one doc_id stay apart, ordered by text; an empty table gives
an empty file; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, keep_only, materialize, table
from .word_ids import encoder

MAGIC = b"RPG1"
BLOCK_IDS = 1 << 19  # ids that end a block (a block holds whole documents)
SLICE_BYTES = 6_000_000  # text encoded at once
LEAST_SAVED = 0.02  # share of the symbols that a round must save to be followed by another
LEAST_USES = 24  # occurrences that make a pair worth a rule
MARK_EVERY = 256  # symbols from one mark to the next
_HASH_BITS = 20

BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, doc_ids array<bigint>, counts array<int>, payload binary"


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    return values[at], np.diff(np.append(at, len(values)))


def _hashed(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


def _frequent_pairs(symbols: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (left << 32 | right) of the most frequent pairs, best first; where they occur, and which one each time."""
    pairs = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:].astype(np.uint64)
    hashed = _hashed(pairs)
    often = np.bincount(hashed, minlength=1 << _HASH_BITS) >= LEAST_USES  # no frequent pair is outside
    keys, uses = _runs(np.sort(pairs[often[hashed]]))
    keep = uses >= LEAST_USES
    keys, uses = keys[keep], uses[keep]
    best = keys[np.lexsort((keys, -uses))[:most]]
    if not len(best):
        return best, np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = np.zeros(1 << _HASH_BITS, bool)
    chosen[_hashed(best)] = True
    at = np.flatnonzero(chosen[hashed])
    order = np.argsort(best)
    found = np.minimum(np.searchsorted(best[order], pairs[at]), len(best) - 1)
    hit = best[order][found] == pairs[at]
    return best, at[hit], order[found[hit]]


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Grammar of an id array: (first nonterminal, rules n x 2, expansion length of each rule, symbols)."""
    base = int(ids.max()) + 1 if len(ids) else 0
    symbols, rules, lengths = ids.astype(np.uint32), np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    while len(symbols) > 1:
        best, at, rank = _frequent_pairs(symbols, max(64, len(symbols) // 512))
        if not len(best):
            break
        # overlapping occurrences: the more frequent pair wins, the earlier one of equals; the rest wait for the next round
        clash = np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~clash | (rank[1:] < rank[:-1])
        wins[:-1] &= ~clash | (rank[:-1] <= rank[1:])
        equal = np.flatnonzero(clash & (rank[1:] == rank[:-1]))
        if len(equal):  # runs of one symbol: every other occurrence
            begins = np.concatenate(([True], np.diff(equal) != 1))
            within = np.arange(len(equal)) - np.maximum.accumulate(np.where(begins, np.arange(len(equal)), 0))
            run_start = equal - within
            inside = np.unique(np.concatenate((equal, equal + 1)))
            wins[inside] = False
            wins[equal[within % 2 == 0]] = True
            tail = (equal + 1)[np.append(np.diff(run_start) != 0, True) & (within % 2 == 1)]
            wins[tail] = True
            wins &= ~np.concatenate(([False], (np.diff(at) == 1) & wins[:-1]))
        at, rank = at[wins], rank[wins]
        used, rank = np.unique(rank, return_inverse=True)
        if len(at) < LEAST_SAVED * len(symbols):
            break
        chosen = best[used]
        new = np.stack((chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)), 1).astype(np.uint32)
        expanded = np.concatenate((np.ones(base, np.int64), lengths))
        first = base + len(rules)
        rules = np.concatenate((rules, new))
        lengths = np.concatenate((lengths, expanded[new[:, 0]] + expanded[new[:, 1]]))
        symbols = symbols.copy()
        symbols[at] = first + rank
        symbols = np.delete(symbols, at + 1)
    return base, rules, lengths, symbols


def pack_block(ids: np.ndarray) -> bytes:
    """A block's bytes: header, rules, expansion lengths, marks, symbols."""
    base, rules, lengths, symbols = compress(ids)
    expanded = np.concatenate((np.ones(base, np.int64), lengths))
    before = np.concatenate(([0], np.cumsum(expanded[symbols])))[:-1] if len(symbols) else np.zeros(0, np.int64)
    wide = base + len(rules) > 65536
    kind = "<u4" if wide else "<u2"
    head = struct.pack("<4sBQQQQ", MAGIC, wide, base, len(rules), len(symbols), len(ids))
    return b"".join((head, rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(),
                     before[::MARK_EVERY].astype("<u8").tobytes(), symbols.astype(kind).tobytes()))


class Block:
    """Reader of one block's bytes."""

    def __init__(self, payload: bytes):
        magic, wide, base, n_rules, n_symbols, self.n_ids = struct.unpack_from("<4sBQQQQ", payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        kind, at = np.dtype("<u4" if wide else "<u2"), struct.calcsize("<4sBQQQQ")
        rules = np.frombuffer(payload, kind, 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        at += 2 * n_rules * kind.itemsize
        lengths = np.frombuffer(payload, "<u4", n_rules, at).astype(np.int64)
        at += 4 * n_rules
        self.marks = np.frombuffer(payload, "<u8", -(-n_symbols // MARK_EVERY), at)
        at += 8 * len(self.marks)
        self.symbols = np.frombuffer(payload, kind, n_symbols, at)
        self.lengths = np.concatenate((np.ones(base, np.int64), lengths))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.texts = np.empty(base + int(lengths.sum()), "<u4")  # what each symbol stands for
        self.texts[:base] = np.arange(base)
        for k, (a, b) in enumerate(rules.tolist()):
            at = self.starts[base + k]
            n = self.lengths[a]
            self.texts[at:at + n] = self.texts[self.starts[a]:self.starts[a] + n]
            self.texts[at + n:at + self.lengths[base + k]] = self.texts[self.starts[b]:self.starts[b] + self.lengths[b]]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[symbols] - (ends - n), n)
        at += np.arange(len(at))
        return self.texts[at]

    def all(self) -> np.ndarray:
        """Every id of the block."""
        return self._expand(self.symbols) if len(self.symbols) else np.zeros(0, "<u4")

    def ids(self, start: int, count: int) -> np.ndarray:
        """`count` ids from `start` on, decoding only the symbols between two marks."""
        if not count:
            return np.zeros(0, "<u4")
        a = int(np.searchsorted(self.marks, start, "right")) - 1
        b = int(np.searchsorted(self.marks, start + count, "left"))
        out = self._expand(self.symbols[a * MARK_EVERY:b * MARK_EVERY])
        skip = start - int(self.marks[a])
        return out[skip:skip + count]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text and write the blocks below the session's shared folder; the table, read back."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                            ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("payload", pa.binary())])
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        parts: list[bytes] = []
        held, held_ids, counts = 0, [], []

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": number, "first": first, "n_ids": len(ids), "doc_ids": held_ids,
                "counts": counts, "payload": pack_block(ids)}], schema)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in byte_slices(batch.column("text"), SLICE_BYTES):
                for doc_id, ids in zip(doc_ids[at:at + len(texts)], encode(texts)):
                    parts += (ids, end)
                    n = len(ids) // 4 + 1
                    held += n
                    held_ids.append(doc_id)
                    counts.append(n)
                    if held >= block_ids:
                        yield row()
                        number, first = number + 1, first + held
                        parts, held, held_ids, counts = [], 0, [], []
        if parts:
            yield row()

    ordered = keep_only(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(blocks, BLOCK_SCHEMA), "token-ids")


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document of a written table; ids are 4 bytes each, little-endian."""
    return _with_starts(blocks).mapInArrow(_documents(lambda ids: ids.tobytes(), pa.binary()),
                                           "doc_id long, start long, n_tokens long, ids binary")


def _with_starts(blocks: DataFrame) -> DataFrame:
    # one row per range partition of the writing job: broadcast, and ordered in one task
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return (blocks.join(F.broadcast(before), "shard")
            .select((F.col("before") + F.col("first")).alias("start"), "doc_ids", "counts", "payload"))


def _documents(value, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch.column("payload")[row].as_py())
                counts = np.array(batch.column("counts")[row].as_py(), np.int64)
                ends = np.cumsum(counts)
                ids = block.all()
                yield pa.RecordBatch.from_arrays([
                    pa.array(batch.column("doc_ids")[row].as_py(), pa.int64()),
                    pa.array(batch.column("start")[row].as_py() + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([value(ids[b - n:b]) for b, n in zip(ends.tolist(), counts.tolist())], kind),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return run


def op4_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 4: every document's place, length and check sum, from the files written."""
    import public_tokenizers

    blocks = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return (_with_starts(blocks)
            .mapInArrow(_documents(zlib.crc32, pa.int64()), "doc_id long, start long, n_tokens long, ids long")
            .withColumnRenamed("ids", "ids_crc32"))

"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations for balanced binary codes are learnt on a bounded sample (SAMPLE
vectors of least id hash).  A code is cut into substrings, each the key of a
table: two codes that differ in fewer bits than there are substrings share at
least one.  All vectors are indexed and all are queries.  Vectors that share a
table cell are compared by the cosine of the original vectors in double
precision; a pair that shares several cells counts in the first.

Equal vectors are collapsed beforehand and count with their number.  A cell of
very many vectors is cut into blocks, compared block against block, so no task
holds more than two blocks; blocks return counts and a spanning forest of their
links, not pairs.

Edge cases: a vector that is null, zero, or holds null, NaN or infinite
components, or whose label is null, is linked with nothing; vectors of
different lengths are never compared; every row is one vector, also where an id
repeats; a null id has no component and is kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, materialize, table
from .components import components

SAMPLE = 20_000  # vectors that the rotations are learnt on, at most
TABLES = 15  # tables at least; as many rotations, from different starts, as give them
SUBSTRING = 12  # bits of a table's key
ROUNDS = 30  # rounds of iterative quantisation
BLOCK = 1024  # vectors of a block of a split cell


class Codes:
    """Rotations for one vector length, and the tables' keys of vectors."""

    def __init__(self, sample: np.ndarray, tables: int = TABLES, substring: int = SUBSTRING, seed: int = 7):
        unit = _unit(sample)
        bits = min(64, unit.shape[1])  # longer vectors keep their 64 strongest directions
        self.substring = min(substring, bits)
        random = np.random.default_rng(seed)
        self.planes = []  # (mean, plane); where near copies dominate a sample, codes around their mean part them: every third code has none
        for k in range(-(-tables // (bits // self.substring))):
            mean = unit.mean(0) if k % 3 != 1 else np.zeros(unit.shape[1])
            _, _, axes = np.linalg.svd((unit - mean).T @ (unit - mean))
            projected = (unit - mean) @ axes[:bits].T
            rotation, _ = np.linalg.qr(random.standard_normal((bits, bits)))
            for _ in range(ROUNDS):  # codes for the rotation, then the rotation for the codes
                code = np.where(projected @ rotation >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(code.T @ projected)
                rotation = (left @ right).T
            self.planes.append((mean, axes[:bits].T @ rotation))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Key of each unit vector in each table."""
        weights, out = 1 << np.arange(self.substring), []
        for mean, plane in self.planes:
            bit = (unit - mean) @ plane >= 0
            for at in range(0, bit.shape[1] - self.substring + 1, self.substring):
                out.append(bit[:, at:at + self.substring] @ weights)
        return np.stack(out, 1).astype(np.int32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with a flag for usable ones, and the distinct usable vectors (label, embedding, rep, copies)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some, F.lit(False))
    rows = keep_only(vectors, "vec_id", "embedding", "label").withColumn("usable", usable)
    distinct = (rows.filter("usable").groupBy("label", "embedding")
                .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    return rows, distinct


def _learn(distinct: DataFrame) -> dict[int, Codes]:
    """Codes by vector length, from a bounded sample of each length."""
    lengths = [r["n"] for r in distinct.groupBy(F.size("embedding").alias("n")).count().collect()]
    out = {}
    for n in lengths:
        rows = (distinct.filter(F.size("embedding") == n).select("embedding", "rep")
                .orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow())
        out[n] = Codes(np.array(rows.column(0).combine_chunks().flatten().to_numpy()).reshape(-1, n))
    return out


def _cells(distinct: DataFrame, codes) -> DataFrame:
    """A row for each vector and table: label, size, tab, value, rep, copies and the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("embedding")
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            label, rep, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "rep", "copies"))
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                vectors = np.stack([flat[starts[i]:starts[i] + n] for i in at]).astype("<f8")
                keys = codes.value[n].keys(_unit(vectors))
                raw = [v.tobytes() for v in vectors]
                for t in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(label[at], pa.int64()), pa.array(np.full(len(at), n), pa.int32()), pa.array(np.full(len(at), t), pa.int32()),
                         pa.array(keys[:, t]), pa.array(rep[at], pa.int64()), pa.array(copies[at], pa.int64()), pa.array(raw, pa.binary())],
                        ["label", "size", "tab", "value", "rep", "copies", "vector"])

    return distinct.withColumn("label", F.col("label").cast("long")).mapInArrow(
        run, "label long, size int, tab int, value int, rep long, copies long, vector binary")


def _compare(rows: pa.Table, codes: dict[int, Codes], least: float):
    """Links of one block: (rep, partners counted, a node that it reaches)."""
    size, tab = rows.column("size")[0].as_py(), rows.column("tab")[0].as_py()
    rep, copies, part = (rows.column(c).to_numpy() for c in ("rep", "copies", "part"))
    unit = _unit(np.frombuffer(b"".join(rows.column("vector").to_pylist()), "<f8").reshape(-1, size))
    close = unit @ unit.T >= least
    np.fill_diagonal(close, False)
    if rows.column("mixed")[0].as_py():  # block against block
        close &= part[:, None] != part[None, :]
    x, y = np.nonzero(close)
    if not len(x):
        return None
    if tab:  # pairs that share an earlier table's cell were counted there
        keys = codes[size].keys(unit)[:, :tab]
        fresh = ~(keys[x] == keys[y]).any(1)
        x, y = x[fresh], y[fresh]
        if not len(x):
            return None
    partners = np.bincount(x, weights=copies[y], minlength=len(rep)).astype(np.int64)
    root = rep.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, x, root[y])
        if (root == before).all():
            break
    some = np.flatnonzero(partners)
    return rep[some], partners[some], root[some]


def link(vectors: DataFrame, least: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows, distinct = classes(vectors)
    distinct = materialize(distinct, "distinct-vectors")
    codes = distinct.sparkSession.sparkContext.broadcast(_learn(distinct))  # a few 64 x 64 matrices a length
    cells = materialize(_cells(distinct, codes), "cells")
    key = ["label", "size", "tab", "value"]
    large = (cells.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 2 * BLOCK)
             .select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    placed = (cells.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
              .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
              .withColumn("mixed", F.col("low") != F.col("high"))
              .select(*key, "low", "high", "mixed", "part", "rep", "copies", "vector"))
    group = [*key, "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("n", pa.int64()), ("b", pa.int64())])
        held: pa.Table | None = None

        def groups(table_: pa.Table, last: bool):
            nonlocal held
            names = np.stack([table_.column(c).to_numpy() for c in group], 1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            edges = [0, *cuts.tolist(), len(names)]
            spans = list(zip(edges, edges[1:]))
            held = None if last else table_.slice(spans[-1][0])
            out = [r for a, b in (spans if last else spans[:-1]) if b - a > 1
                   and (r := _compare(table_.slice(a, b - a).combine_chunks(), codes.value, least)) is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                yield from groups(pa.concat_tables([held, now]) if held is not None else now, False)
        if held is not None and held.num_rows:
            yield from groups(held, True)

    # the sort brings a group's rows together; a group holds at most two blocks
    found = materialize(placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, n long, b long"), "links")
    partners = found.groupBy("a").agg(F.sum("n").alias("partners"))
    named = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    by_class = (distinct.join(partners.withColumnRenamed("a", "rep"), "rep", "left").join(named, "rep", "left")
                .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    usable = rows.filter("usable").join(by_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_quantised_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 9: cosine of at least 0.93 among vectors of one label."""
    return link(table(spark, sf_dir, "embeddings"), 0.93)

"""Ranked lexical search: the documents of highest score for each item of a stated query set.

A score is an inner product: of sqrt(weight) over an item's terms with
sqrt(weight) * saturated term frequency over a document's terms.  Coordinates
are the terms of the items; no other one meets a query.

1. One narrow pass cuts the texts into terms and writes a sparse vector per
   document, with each task's counts; these are added up to N, L and df.
2. The vectors are range-partitioned and sorted by length, longest first, and
   written: files and row groups then hold ranges of lengths.
3. Rounds over falling ranges of length.  A task takes its rows as buckets of
   similar length.  By Cauchy-Schwarz a bucket is skipped for an item if the
   item's length times the bucket's greatest is below the item's tenth score so
   far; the same bound over all items is a filter on the scan.  Inside a bucket
   the heaviest coordinates are multiplied out, the rest of the product is
   bounded by the lengths of what is left, and survivors get their exact score
   in 64-bit integers.  Tenth scores pass from round to round.

Bounds are in doubles with a margin, so nothing that could tie is lost.  Items
are taken in blocks of about ITEM_BYTES of text, so what a task holds of them is
bounded however many there are.

Null text has no terms.  A document without doc_id counts in N, L and df, but is
never ranked.  Rows that repeat a doc_id are documents of their own and may
stand side by side in a list.  Equal scores rank by doc_id.  A null or empty
item, and any item if no document has a term of it, gives no rows; repeated
item rows are ranked each.  Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, keep_only, materialize, table

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # over UTF-8: bytes from 0x80 belong to terms
ITEM_BYTES = 4_000_000  # text of the items that are searched at once
BUCKET = 4096  # documents of a bucket at most
SHORTEST = 0.9  # of the longest vector in a bucket
ROUNDS = (0.99, 0.9)  # shares of the vectors that are shorter than those of a round; the last round takes the rest


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # bytes.lower changes A-Z only


@dataclass
class Items:
    """A block of items: their ids, and the numbers of their distinct terms in `vocabulary`."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        terms = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of((text or "").encode())}), np.int32)
                 for _, text in rows]
        return cls([i for i, _ in rows], terms, vocabulary)


@dataclass
class Statistics:
    """Counts over all documents: N, all terms L, and each coordinate's weight."""

    documents: int
    terms: int
    weight: np.ndarray

    def saturated(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The integer impact of term counts in documents of n terms, before the weight."""
        m = 10 + 90 * n * self.documents // self.terms
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


# ---- 1. vectors and counts --------------------------------------------------------------------

VECTORS = "doc_id long, n long, salt long, terms binary, counts binary"
COUNTS = "numbers array<int>, df array<long>, n_docs long, n_terms long"


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per document that has a term of the vocabulary, and a row of counts per task (n_docs is set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, n_docs, n_terms, salt = vocabulary.keys(), Counter(), 0, 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for at, texts in byte_slices(batch.column("text")):
                out = []
                for k, text in enumerate(texts.cast(pa.binary())):
                    terms = terms_of(text.as_py() or b"")
                    n_docs += bool(terms)
                    n_terms += len(terms)
                    counts = Counter(terms)
                    found = sorted((vocabulary[t], counts[t]) for t in counts.keys() & known)
                    if found:
                        numbers, tf = np.array(found, np.int32).T
                        df.update(numbers.tolist())
                        out.append((at + k, len(terms), numbers.tobytes(), tf.tobytes()))
                if out:
                    rows, n, numbers, tf = zip(*out)
                    salts, salt = salt + np.arange(len(out)), salt + len(out)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(salts), pa.array(numbers, pa.binary()), pa.array(tf, pa.binary()),
                         *[pa.nulls(len(out), t) for t in (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64())]],
                        ["doc_id", "n", "salt", "terms", "counts", "numbers", "df", "n_docs", "n_terms"])
        yield pa.RecordBatch.from_pylist(
            [{"numbers": list(df), "df": list(df.values()), "n_docs": n_docs, "n_terms": n_terms}],
            pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("salt", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()),
                       ("numbers", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())]))

    return keep_only(docs, "doc_id", "text").mapInArrow(run, f"{VECTORS}, {COUNTS}")


def statistics(counted: DataFrame, coordinates: int) -> Statistics:
    tasks = counted.filter("n_docs is not null")
    row = tasks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    documents, terms = row[0] or 0, row[1] or 0
    df = np.zeros(coordinates, np.int64)
    pairs = tasks.select(F.explode(F.arrays_zip("numbers", "df")).alias("p")).groupBy("p.numbers").agg(F.sum("p.df").alias("df"))
    for r in pairs.collect():  # a row a coordinate
        df[r["numbers"]] = r["df"]
    return Statistics(documents, terms, np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64))


# ---- 2. vectors by length ---------------------------------------------------------------------

def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, term, count, n of the row) of all entries of a batch of vectors."""
    raw = [b"".join(batch.column(c).to_pylist()) for c in ("terms", "counts")]
    size = pc.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False) // 4
    row = np.repeat(np.arange(len(size)), size)
    n = batch.column("n").to_numpy(zero_copy_only=False)
    return row, np.frombuffer(raw[0], np.int32), np.frombuffer(raw[1], np.int32).astype(np.int64), n[row]


def by_length(counted: DataFrame, stats: Statistics) -> DataFrame:
    """The vectors with their length, longest first.  Equal lengths are spread by a salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, tf, n = _flat(batch)
            square = stats.weight[term] * stats.saturated(tf, n).astype(float) ** 2
            length = np.sqrt(np.bincount(row, square, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], [*batch.schema.names, "length"])

    vectors = counted.filter("n_docs is null and doc_id is not null").select("doc_id", "n", "salt", "terms", "counts")
    return (vectors.mapInArrow(run, f"{VECTORS}, length double").filter("length > 0")
            .repartitionByRange(F.desc("length"), "salt").sortWithinPartitions(F.desc("length")))


# ---- 3. buckets -------------------------------------------------------------------------------

def buckets(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows (sorted, longest first) of similar length."""
    at = 0
    while at < len(length):
        end = min(at + BUCKET, at + int(np.searchsorted(-length[at:], -SHORTEST * length[at], "right")))
        yield at, max(end, at + 1)
        at = max(end, at + 1)


class Bucket:
    """Documents of similar length, with an index from coordinate to documents."""

    def __init__(self, doc_ids, length, row, term, impact, weight):
        self.doc_ids, self.square, self.longest, self.weight = doc_ids, length ** 2, length[0], weight
        order = np.argsort(term, kind="stable")
        self.row, self.impact, term = row[order], impact[order], term[order]
        present = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.array([], int)
        self.place = dict(zip(term[present].tolist(), zip(present.tolist(), [*present[1:].tolist(), len(term)])))

    def candidates(self, terms: np.ndarray, rest: np.ndarray, floor: float) -> np.ndarray:
        """Rows that can reach `floor`.  `terms` are heaviest first; rest[k] is the length of the query without the first k."""
        partial, used = np.zeros(len(self.square)), np.zeros(len(self.square))
        k = 0
        while k < len(terms) and rest[k] * self.longest >= floor:  # a document without the first k terms could still reach it
            if (span := self.place.get(int(terms[k]))) is not None:
                row, impact, weight = self.row[slice(*span)], self.impact[slice(*span)], self.weight[terms[k]]
                partial[row] += weight * impact
                used[row] += weight * impact.astype(float) ** 2
            k += 1
        bound = partial + rest[k] * np.sqrt(np.maximum(self.square - used, 0))
        return bound >= floor

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Exact scores of all rows."""
        out = np.zeros(len(self.square), np.int64)
        for t in terms.tolist():
            if (span := self.place.get(t)) is not None:
                out[self.row[slice(*span)]] += self.weight[t] * self.impact[slice(*span)]
        return out


class Best:
    """The `k` best (score, doc_id) of each item so far, and the score that a document must reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.held = [(np.array([], np.int64), np.array([], np.int64)) for _ in floors]

    def add(self, item: int, scores: np.ndarray, doc_ids: np.ndarray) -> None:
        scores, doc_ids = np.append(self.held[item][0], scores), np.append(self.held[item][1], doc_ids)
        order = np.lexsort((doc_ids, -scores))[:self.k]
        self.held[item] = scores[order], doc_ids[order]
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], scores[order[-1]])


def search(vectors: DataFrame, items: Items, stats: Statistics, floors: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k of every item that reach the item's floor."""
    queries = []
    for terms in items.terms:
        weight = stats.weight[terms]
        order = np.argsort(-weight, kind="stable")
        rest = np.sqrt(np.append(np.cumsum(weight[order][::-1])[::-1], 0))
        queries.append((terms[order], rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(floors, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by([("length", "descending")])
            length = batch.column("length").to_numpy(zero_copy_only=False)
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            row, term, tf, n = _flat(batch)
            impact = stats.saturated(tf, n)
            for at, end in buckets(length):
                first, last = np.searchsorted(row, (at, end))
                bucket = Bucket(doc_ids[at:end], length[at:end], row[first:last] - at, term[first:last], impact[first:last], stats.weight)
                for item, (terms, rest) in enumerate(queries):
                    floor = max(best.floors[item], 1) * (1 - 1e-9)
                    if rest[0] * bucket.longest < floor:
                        continue
                    able = bucket.candidates(terms, rest, floor)
                    if able.any():
                        score = bucket.scores(terms)
                        able &= score >= max(best.floors[item], 1)
                        best.add(item, score[able], bucket.doc_ids[able])
        many = [len(s) for s, _ in best.held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(many)), many), pa.int32()),
             *[pa.array(np.concatenate([np.array([], np.int64), *(h[c] for h in best.held)])) for c in (1, 0)]],
            ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, rank, doc_id, score) for one block of items."""
    counted = materialize(count_terms(docs, items.vocabulary), "term-vectors")
    stats = statistics(counted, len(items.vocabulary))
    vectors = materialize(by_length(counted, stats), "vectors-by-length")
    cuts = vectors.approxQuantile("length", list(ROUNDS), 0.001) or [0.0]
    own = np.array([np.sqrt(stats.weight[t].sum()) for t in items.terms])  # the items' lengths
    floors, found = np.zeros(len(items.ids)), []
    for low, high in zip([*cuts, 0.0], [None, *cuts]):
        reach = np.divide(floors, own, out=np.full(len(own), np.inf), where=own > 0).min() * (1 - 1e-9)  # shorter vectors reach no item's floor
        part = vectors.filter(F.col("length") >= float(max(low, reach)))
        part = part if high is None else part.filter(F.col("length") < high)
        found.append(materialize(_first(search(part, items, stats, floors, k), k).drop("rank"), "ranked"))
        for r in _first(reduce(DataFrame.unionByName, found), k).filter(F.col("rank") == k).collect():  # a row an item of the block
            floors[r["item"]] = r["score"]
    return _first(reduce(DataFrame.unionByName, found), k)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents."""
    spark = docs.sparkSession
    items = items.select(items["item_id"].cast("long").alias("item_id"), items["text"])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = -(-size // ITEM_BYTES), []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        ranked = rank_block(docs, Items.of([tuple(r) for r in rows]), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        out.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 12: the ten best documents of each benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, big_n),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
           FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

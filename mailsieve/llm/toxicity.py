"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled rows: at most EXAMPLES per class,
those with the least hash of the id, whatever the corpus size.  Terms are the
words whose presence differs between the classes of the sample (chi-square);
document frequencies come from all documents.  Every document's vector over
these terms is written once; an inverted index over the examples, in blocks
with the largest weight of each term per block, finds a document's K nearest
examples exactly: blocks of the highest upper bounds are searched first, then
the others that can still reach the K-th best.  Their votes, weighted by
cosine and by how many labelled rows an example stands for, give the score.

Edge cases: a null or empty text, or one without any of the terms, gets the
share of toxic rows among examples without terms; documents without labelled
rows at all get 0; repeated rows are scored as often as they occur; a label
that is null is no example, several labels of one id count as the largest; ties
at the K-th place go to the example that comes first by hash; an empty table
gives no rows; other columns are ignored by `score_documents` and kept by
`filter_documents`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, materialize, release, table, text_slices

EXAMPLES = 4000  # labelled rows of each class that are examples, at most
LEAST_CHI2 = 15.0  # chi-square that makes a word a term
LEAST_DOCS = 3  # examples that a term occurs in
K = 15  # nearest examples that vote
HOT = 256  # terms with a dense row, at most
HOT_SHARE = 64  # which at least one of so many examples holds
MARGIN = 1e-4  # more than single precision loses over HOT terms
TOGETHER = 64  # texts that are searched at once, at most
POSTINGS = 400_000  # postings of all their terms, unless one text has more
DOUBT = 0.5  # weight of the base rate against the cosines of the voters
EVIDENCE = 3  # voters named in the result

_WORDS = re.compile(r"\w+")


def _words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Index:
    """The vectors of the examples, by term: dense rows of the terms that many hold, postings of the others."""

    def __init__(self, vectors: list[dict[int, int]], labels: list[int], ids: list, weights: dict[int, float], idf: np.ndarray):
        self.idf, self.weights = idf, weights
        order = [e for e in range(len(vectors)) if vectors[e]]
        self.labels = np.array([labels[e] for e in order], np.int64)
        self.first = np.array(order, np.int64)  # the place by hash, for ties
        self.ids = [ids[e] for e in order]
        # entries of all examples, one after the other, each in the order of its terms
        held = [(p, t, (1 + math.log(vectors[e][t])) * idf[t]) for p, e in enumerate(order) for t in sorted(vectors[e])]
        at, self.term, part = (np.array([h[c] for h in held], kind) for c, kind in enumerate((np.int64, np.int64, float)))
        norms = np.sqrt(np.bincount(at, part * part, len(order)))
        at, self.term, part = (c[norms[at] > 0] for c in (at, self.term, part))
        self.part = part / norms[at]
        self.entries = np.searchsorted(at, np.arange(len(order) + 1))
        uses = np.bincount(self.term, minlength=len(idf))
        hot = np.argsort(-uses, kind="stable")[:HOT]
        hot = hot[uses[hot] * HOT_SHARE >= max(len(order), 1)]
        self.row_of = np.full(len(idf), -1, np.int64)  # a term's row in `dense`, if it has one
        self.row_of[hot] = np.arange(len(hot))
        self.dense = np.zeros((len(hot), len(order)), np.float32)
        row = self.row_of[self.term]
        self.dense[row[row >= 0], at[row >= 0]] = self.part[row >= 0]
        rare = np.flatnonzero(row < 0)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        self.posted, self.posted_part = at[rare], self.part[rare]
        self.postings = np.searchsorted(self.term[rare], np.arange(len(idf) + 1))
        empty = Counter(labels[e] for e in range(len(vectors)) if not vectors[e])
        toxic, clean = (empty[k] * weights.get(k, 0.0) for k in (1, 0))
        self.none = toxic / (toxic + clean + 1.0) if vectors else 0.0
        every = Counter(labels)
        total = sum(every[k] * weights.get(k, 0.0) for k in (0, 1))
        self.base = every[1] * weights.get(1, 0.0) / total if total else 0.0

    @staticmethod
    def _spread(number: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the spans `number`, begins[n] to begins[n + 1], and which of the given spans each is in."""
        many = begins[number + 1] - begins[number]
        which = np.repeat(np.arange(len(number)), many)
        return which, np.arange(len(which)) + np.repeat(begins[number] - (np.cumsum(many) - many), many)

    def nearest(self, row: np.ndarray, term: np.ndarray, uses: np.ndarray, rows: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, cosine) of the k nearest examples of each of some texts with a cosine over 0, best first.

        The texts' vectors come as entries (row, term, uses).  All of them are searched
        together: cosines in single precision, less than MARGIN off, leave out what
        cannot be among the k nearest; those of the others are computed in double."""
        q = (1 + np.log(uses)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, q * q, rows))
        row, term, q = (c[q > 0] for c in (row, term, q))
        q = q / norm[row]
        exact = np.zeros((rows, len(self.idf)))
        exact[row, term] = q
        n, line = len(self.ids), self.row_of[term]
        often = line >= 0
        front = np.zeros((rows, len(self.dense)), np.float32)
        front[row[often], line[often]] = q[often]
        near = front @ self.dense
        which, place = self._spread(term[~often], self.postings)
        if len(which):
            cell = row[~often][which] * n + self.posted[place]
            near += np.bincount(cell, q[~often][which] * self.posted_part[place], rows * n).reshape(rows, -1)
        kth = np.partition(near, n - k, axis=1)[:, n - k] if n >= k else np.zeros(rows, np.float32)
        found, at = np.nonzero((near >= kth[:, None] - np.float32(MARGIN)) & (near > 0))
        which, place = self._spread(at, self.entries)
        value = np.bincount(which, exact[found[which], self.term[place]] * self.part[place], len(found))
        order = np.lexsort((self.first[at], -np.round(value, 12), found))
        found, at, value = found[order], at[order], value[order]
        keep = np.arange(len(found)) - np.searchsorted(found, found) < k
        return found[keep], at[keep], value[keep]

    def scores(self, terms: list, uses: list, k: int = K) -> list[tuple[float, list[tuple]]]:
        """For each text: the probability of label 1, and the nearest examples as (id, label, cosine)."""
        out: list[tuple[float, list[tuple]]] = [(self.none, [])] * len(terms)
        size = np.diff(self.postings)  # of each term
        work = np.cumsum([int(size[t].sum()) if t else 0 for t in terms])
        first = 0
        while first < len(terms):
            done = work[first - 1] if first else 0
            last = min(first + TOGETHER, max(first + 1, int(np.searchsorted(work, done + POSTINGS, "right"))))
            begin_at, first = first, last
            part = terms[begin_at:last]
            row = np.repeat(np.arange(len(part)), [len(t or ()) for t in part])
            if not len(row) or not self.ids:
                continue
            term = np.concatenate([np.asarray(t, np.int64) for t in part if t])
            used = np.concatenate([np.asarray(u, np.int64) for u in uses[begin_at:last] if u])
            found, at, cosine = self.nearest(row, term, used, len(part), k)
            weight = cosine * np.array([self.weights.get(0, 0.0), self.weights.get(1, 0.0)])[self.labels[at]]
            begins = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else []
            for begin, end in zip(begins, [*begins[1:], len(found)]):
                w, c, y = weight[begin:end], cosine[begin:end], self.labels[at[begin:end]]
                scale = w.sum() / c.sum()
                score = (w[y == 1].sum() + DOUBT * scale * self.base) / (w.sum() + DOUBT * scale)
                evidence = [(self.ids[a], int(self.labels[a]), float(x)) for a, x in zip(at[begin:end][:EVIDENCE], c[:EVIDENCE])]
                out[begin_at + int(found[begin])] = float(min(1.0, max(0.0, score))), evidence
        return out

    def score(self, vector: dict[int, int], k: int = K) -> tuple[float, list[tuple]]:
        """The same for one text's vector."""
        return self.scores([list(vector)], [list(vector.values())], k)[0]


def fold(doc_id: Column, parts: int) -> Column:
    """Check sum of an id as text, by the number of parts; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y, h): at most `most` labelled rows of each class, those of least hash."""
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("y")).withColumn("h", F.xxhash64("doc_id")))
    parts = [known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(most) for y in (0, 1)]
    return materialize(parts[0].unionByName(parts[1]), "examples")


def _terms(texts: DataFrame, sizes: dict[int, int]) -> list[str]:
    """Words whose presence differs between the classes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: list[Counter] = [Counter(), Counter()]
            labels = batch.column("y").to_pylist()
            for at, part in text_slices(batch, "text"):
                for text, y in zip(part, labels[at:at + len(part)]):
                    seen[y].update(set(_words(text)))
            words = sorted(set(seen[0]) | set(seen[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *[pa.array([s[w] for w in words], pa.int64()) for s in seen]], ["word", "n0", "n1"])

    counted = texts.mapInArrow(run, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total0, total1 = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    if not total0 or not total1:
        return []
    n, a, b = total0 + total1, F.col("n1"), F.col("n0")
    rest = F.lit(n) - a - b
    chi2 = n * F.pow(a * (total0 - b) - b * (total1 - a), 2) / (F.lit(total0 * total1) * (a + b) * F.greatest(rest, F.lit(0.5)))
    chosen = counted.filter((a + b >= LEAST_DOCS) & (chi2 >= LEAST_CHI2)).select("word").collect()  # bounded: words of the sample
    return sorted(r["word"] for r in chosen)


def _named(frame: DataFrame, columns: list[str]) -> str:
    """The schema of the named columns."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name in columns)


def _vectors(terms: list[str], columns: list[str]) -> Callable:
    """mapInArrow function to the named columns, and `terms` and `uses`: places in the term list and how often each occurs."""
    number = {w: i for i, w in enumerate(terms)}
    known = frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                out: list[list] = [[], []]
                for text in texts:
                    words = _words(text)
                    counted = Counter(w for w in words if w in known) if not known.isdisjoint(words) else {}
                    places = sorted((number[w], n) for w, n in counted.items())
                    out[0].append([p for p, _ in places])
                    out[1].append([n for _, n in places])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(at, len(texts)) for c in columns], *[pa.array(c, pa.list_(pa.int32())) for c in out]],
                    [*columns, "terms", "uses"])

    return run


def _documents_of(vectors: DataFrame, n_terms: int) -> DataFrame:
    """(t, n): how many vectors hold each term; a task sends one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["t", "n"])

    return vectors.select("terms").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))


def build_index(spark: SparkSession, docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> tuple[list[str], Index, DataFrame]:
    """Terms, the index, and every document's vector (doc_id, terms, uses), written."""
    sample = _sample(labels, examples)
    classes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    every = {r["y"]: r["n"] for r in labels.filter("doc_id is not null and toxic is not null")
             .groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count_distinct("doc_id").alias("n")).collect()}
    texts = keep_only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")  # 2 x EXAMPLES rows at most
    terms = _terms(texts, classes)
    texts = keep_only(docs, "doc_id", "text")
    vectors = materialize(texts.mapInArrow(_vectors(terms, ["doc_id"]), f"{_named(texts, ['doc_id'])}, terms array<int>, uses array<int>"), "vectors")
    total = vectors.count()
    seen = {r["t"]: r["n"] for r in _documents_of(vectors, len(terms)).collect()}  # a row a term
    idf = np.array([math.log((total + 1) / (seen.get(t, 0) + 1)) for t in range(len(terms))])
    rows = (vectors.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("h", "doc_id")
            .select("doc_id", "y", "terms", "uses").collect())
    index = Index([dict(zip(r["terms"], r["uses"])) for r in rows], [r["y"] for r in rows], [r["doc_id"] for r in rows],
                  {y: every[y] / classes[y] for y in classes}, idf)
    return terms, index, vectors


def _scores(frame: DataFrame, index: Index, columns: list[str], vectors: Callable = iter) -> DataFrame:
    """Add score and evidence to a frame of vectors, or to one of which `vectors` makes them in the same task."""
    shared = frame.sparkSession.sparkContext.broadcast(index)  # EXAMPLES bounds it
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in vectors(batches):
            out = found.scores(batch.column("terms").to_pylist(), batch.column("uses").to_pylist())
            evidence = [[dict(zip(("doc_id", "label", "cosine"), e)) for e in ev] for _, ev in out]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array([s for s, _ in out], pa.float64()), pa.array(evidence, kind)],
                [*columns, "score", "evidence"])
        release()

    return frame.mapInArrow(run, f"{_named(frame, columns)}, score double, evidence array<struct<doc_id: bigint, label: int, cosine: double>>")


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, score and evidence of every document."""
    _, index, vectors = build_index(spark, docs, labels, examples)
    # vectors take little room but much time each: spread them over more tasks than their bytes would make
    return _scores(vectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), index, ["doc_id"])


def filter_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns."""
    terms, index, _ = build_index(spark, docs, labels)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = inner.columns
    with_text = inner.withColumn("text", F.col(names[docs.columns.index("text")]))
    scored = _scores(with_text, index, names, _vectors(terms, names))
    return scored.filter(F.col("score") < threshold).select(*[F.col(n).alias(o) for n, o in zip(names, docs.columns)])


def op8_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 8: every document's score, learnt outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    scored = score_documents(spark, table(spark, sf_dir, "documents"), labels.filter(fold(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")

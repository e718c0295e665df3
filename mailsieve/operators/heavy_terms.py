"""The most frequent terms of a corpus without shuffling its vocabulary.

1. Every task keeps a Misra-Gries summary of `capacity` terms: when it holds
   more, the count of the first one beyond is taken from all.  What was taken is
   the task's error; a summary is a lower bound, and it is short by no more.
2. Summaries add up.  With E the sum of the errors and L the k-th largest sum, a
   term whose sum is below L - E is not among the k most frequent, and neither
   is one in no summary as long as E < L.  Otherwise the capacity doubles.
3. The remaining candidates are counted exactly in a second pass.

So the exchanges carry at most `capacity` rows a task, then a row per candidate
and task; the result is that of the full count.  Ties at rank k stay among the
candidates and are decided by the term.  Null text has no terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize

CAPACITY = 20_000
PACKED = 2_000_000  # candidates that travel with the tasks; more are joined


def shrink(counts: Counter, capacity: int) -> int:
    """Cut a summary down to its capacity; what every kept count lost."""
    if len(counts) <= capacity:
        return 0
    kept = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(kept, len(kept) - capacity - 1)[len(kept) - capacity - 1])
    for term in [t for t, n in counts.items() if n <= cut]:
        del counts[term]
    for term in counts:
        counts[term] -= cut
    return cut


def summaries(docs: DataFrame, tokens: Column, capacity: int) -> DataFrame:
    """(term, n, error) by task: the summary's counts, and one row with a null term for the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, error = Counter(), 0
        for batch in batches:
            for pair in pc.value_counts(batch.column("tokens").flatten()):
                counts[pair["values"].as_py()] += pair["counts"].as_py()
            error += shrink(counts, capacity)
        rows = [*counts.items(), (None, error)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["term", "n"])

    return docs.select(tokens.alias("tokens")).mapInArrow(run, "term string, n long")


def exact_counts(docs: DataFrame, tokens: Column, candidates: DataFrame) -> DataFrame:
    """(term, cf, df) of the candidate terms."""
    if candidates.limit(PACKED + 1).count() > PACKED:
        numbered = docs.select(F.monotonically_increasing_id().alias("_doc"), tokens.alias("tokens"))
        rows = numbered.select("_doc", F.explode("tokens").alias("term")).join(candidates, "term", "left_semi")
        per = rows.groupBy("_doc", "term").agg(F.count("*").alias("tf"))
        return per.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    wanted = pa.array(sorted(r["term"] for r in candidates.collect()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cf, df = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        for batch in batches:
            lists = batch.column("tokens")
            at = pc.index_in(lists.flatten(), value_set=wanted)
            held = pc.is_valid(at).to_numpy(zero_copy_only=False)
            number = at.drop_null().to_numpy().astype(np.int64)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[held].astype(np.int64)
            cf += np.bincount(number, minlength=len(wanted))
            df += np.bincount(np.unique(row * len(wanted) + number) % max(len(wanted), 1), minlength=len(wanted))
        some = np.flatnonzero(cf)
        yield pa.RecordBatch.from_arrays([wanted.take(pa.array(some)), pa.array(cf[some]), pa.array(df[some])], ["term", "cf", "df"])

    counts = docs.select(tokens.alias("tokens")).mapInArrow(run, "term string, cf long, df long")
    return counts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def top_terms(docs: DataFrame, text_col: str, k: int, capacity: int = CAPACITY) -> DataFrame:
    """(term, cf, df, term_index): the k terms of highest collection frequency, then by term."""
    from .corpus_models import vocabulary
    tokens = T.tokenize(F.col(text_col))
    while True:
        found = materialize(summaries(docs, tokens, max(capacity, k)), "term-summaries")
        error = found.filter("term is null").agg(F.sum("n")).first()[0] or 0
        sums = found.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
        largest = [r["n"] for r in sums.orderBy(F.desc("n")).limit(k).collect()]
        least = largest[-1] if len(largest) == k else 0
        if not error or error < least:
            break
        capacity *= 2
    candidates = sums.filter(F.col("n") >= least - error).select("term")
    return vocabulary(exact_counts(docs, tokens, candidates), k)

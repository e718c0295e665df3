"""Words of scripts written without spaces, learnt from the corpus.

Word discovery needs the counts of character n-grams only.  A string is a word
if its characters hold together (cohesion: the least pointwise mutual
information over all ways to cut it in two) and it is free on both sides
(freedom: the lesser entropy of its left and right neighbours, which follow from
the counts of the strings one character longer; the edge of a run is a
neighbour of its own each time).  Runs are counted before they are cut into
n-grams and each task adds up its own, so the exchanges carry one row per
distinct n-gram and task.

Texts are then cut by the most probable segmentation under the learnt words
(Viterbi), other scripts as `functions.text.tokenize` does.  Null text has no
runs; characters that no word covers are tokens by themselves; equally probable
segmentations go to the one whose last words are longer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from .token_counts import count_by_text

LONGEST = 4  # characters of a word at most
LEAST = 5  # occurrences
COHESION = 2.0
FREEDOM = 0.5
WORDS = 1_000_000  # size of the learnt vocabulary: the most frequent words


def ngram_counts(docs: DataFrame, text_col: str, longest: int = LONGEST) -> DataFrame:
    """(gram, n): occurrences of every string of up to `longest` + 1 characters in the runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text, times in zip(batch.column("run").to_pylist(), batch.column("times").to_pylist()):
                for size in range(1, longest + 2):
                    for at in range(len(text) - size + 1):
                        counts[text[at:at + size]] += times
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(T.UNSPACED_RUN), F.lit(1))).alias("run"))
    times = runs.groupBy("run").agg(F.count("*").alias("times"))
    return times.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def learn_words(docs: DataFrame, text_col: str, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION,
                freedom: float = FREEDOM) -> DataFrame:
    """(word, n, cohesion, freedom) of the words of two characters or more."""
    counts = materialize(ngram_counts(docs, text_col, longest), "ngrams").withColumn("size", F.length("gram"))
    total = counts.filter("size = 1").agg(F.sum("n")).first()[0] or 0
    words = counts.filter((F.col("size") > 1) & (F.col("size") <= longest) & (F.col("n") >= least))
    cuts = words.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("gram", "n", F.expr("substring(gram, 1, cut)").alias("left"), F.expr("substring(gram, cut + 1)").alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(counts.select(F.col("gram").alias(side), F.col("n").alias(f"n_{side}")), side)
    pmi = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_left") * F.col("n_right")))
    held = cuts.groupBy("gram").agg(F.min(pmi).alias("cohesion"))

    def neighbours(of: str, name: str) -> DataFrame:
        longer = counts.filter("size > 1").select(F.expr(of).alias("gram"), (F.col("n") * F.log("n")).alias("t"))
        return longer.groupBy("gram").agg(F.sum("t").alias(name))

    out = words.join(held, "gram")
    for of, name in (("substring(gram, 1, size - 1)", "after"), ("substring(gram, 2)", "before")):
        out = out.join(neighbours(of, name), "gram", "left")
        out = out.withColumn(name, F.log("n") - F.coalesce(name, F.lit(0.0)) / F.col("n"))
    out = out.select(F.col("gram").alias("word"), "n", F.round("cohesion", 6).alias("cohesion"), F.round(F.least("after", "before"), 6).alias("freedom"))
    return out.filter((F.col("cohesion") >= cohesion) & (F.col("freedom") >= freedom))


def segment(run: str, weight: dict[str, float], longest: int, single: float) -> list[str]:
    """The segmentation of highest total weight; a single character that is no word weighs `single`."""
    best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - longest), end):  # longer words first, so they win ties
            w = weight.get(run[start:end], single if end - start == 1 else -math.inf)
            if best[start] + w > best[end] + 1e-12:
                best[end], back[end] = best[start] + w, start
    out, end = [], len(run)
    while end:
        out.append(run[back[end]:end])
        end = back[end]
    return out[::-1]


def tokenize_learnt(docs: DataFrame, text_col: str, words: DataFrame, out_col: str = "tokens", limit: int = WORDS) -> DataFrame:
    """`docs` with the tokens of each text; runs without spaces are cut into learnt words."""
    table = words.orderBy(F.desc("n"), "word").limit(limit).select("word", "n").collect()
    total = sum(r["n"] for r in table) + 1
    weight = {r["word"]: math.log(r["n"] / total) for r in table}
    longest, single = max(map(len, weight), default=1), math.log(0.5 / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(out_col)
            yield batch.set_column(at, out_col, cut(batch.column(at)))

    def cut(lists: pa.ListArray) -> pa.ListArray:
        """The lists with their runs cut; each distinct token of the batch is looked at once."""
        coded = lists.flatten().dictionary_encode()
        parts = [segment(t, weight, longest, single) if unspaced(t) else None for t in coded.dictionary.to_pylist()]
        if not any(p and len(p) > 1 for p in parts):
            return lists.cast(pa.list_(pa.string()))
        parts = pa.array([[t] if p is None else p for t, p in zip(coded.dictionary.to_pylist(), parts)], pa.list_(pa.string()))
        taken = parts.take(coded.indices)
        sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False))))
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        return pa.ListArray.from_arrays(pa.array(sizes[ends].astype(np.int32)), taken.flatten())

    def unspaced(token: str) -> bool:
        return any(a <= token[0] <= b for a, b in ranges)

    ranges = [(chr(a), chr(b)) for a, b in T.UNSPACED_RANGES]
    spaced = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), T.UNSPACED_RUN, " $1 ")
    rows = docs.withColumn(out_col, F.regexp_extract_all(spaced, F.lit(T.TOKEN_PATTERN), 0))
    return rows.mapInArrow(run, rows.schema)


def count_learnt(docs: DataFrame, id_col: str, text_col: str, words: DataFrame) -> DataFrame:
    """(id, token, n): how often each text's tokens come, counted where the text is; texts of one id are added up, which takes a shuffle."""
    twice = docs.groupBy(id_col).count().filter("count > 1").limit(1).count() > 0
    rows = tokenize_learnt(docs.select(id_col, text_col), text_col, words, "_tokens").select(id_col, "_tokens")
    counts = rows.mapInArrow(count_by_text, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, term string, tf long")
    counts = counts.select(id_col, F.col("term").alias("token"), F.col("tf").alias("n"))
    return counts.groupBy(id_col, "token").agg(F.sum("n").alias("n")) if twice else counts

"""Naive-Bayes scorers whose fitted form is a few numbers.

Fitting is one aggregation; scoring is a row expression over literals, so a
batch or a stream is scored without a join or a shuffle.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

VARIANCE_FLOOR = 1e-6
TERMS = 200  # terms of the word scorer


def text_shape(text: Column) -> dict[str, Column]:
    """Numeric features of a text: log length and shares of digits, capitals, marks and spaces."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)

    def share(rest: Column) -> Column:
        return (n - F.length(rest)) / F.greatest(n, F.lit(1))

    def without(*characters: str) -> Column:  # literal replaces: cheaper than a pattern
        return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), characters, text)

    return {"log_length": F.log1p(n.cast("double")), "digits": share(F.regexp_replace(text, "[0-9]+", "")),
            "capitals": share(F.regexp_replace(text, "[A-Z]+", "")), "marks": share(without("!", "?")), "spaces": share(without(" ", "\n"))}


SHAPE = ("log_length", "digits", "capitals", "marks", "spaces")


class GaussianScorer(NamedTuple):
    """Class counts, and mean and variance of each feature by class."""

    counts: dict[int, int]
    stats: dict[int, dict[str, tuple[float, float]]]

    @staticmethod
    def fit(train: DataFrame, features: tuple[str, ...] = SHAPE, label_col: str = "label") -> GaussianScorer:
        rows = train.groupBy(label_col).agg(
            F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features]).collect()
        return GaussianScorer({r[label_col]: r["n"] for r in rows},
                              {r[label_col]: {f: (r[f"m_{f}"], r[f"v_{f}"] + VARIANCE_FLOOR) for f in features} for r in rows})

    def probability(self) -> Column:
        """Probability of class 1 from the feature columns, six places."""
        if set(self.counts) != {0, 1}:
            return F.lit(float(1 in self.counts))
        total = sum(self.counts.values())

        def log_likelihood(c: int) -> Column:
            out = F.lit(math.log(self.counts[c] / total) - sum(0.5 * math.log(2 * math.pi * v) for _, v in self.stats[c].values()))
            for f, (m, v) in self.stats[c].items():
                out = out - (F.col(f) - F.lit(m)) * (F.col(f) - F.lit(m)) / F.lit(2 * v)
            return out

        return _logistic(log_likelihood(1) - log_likelihood(0))


class WordScorer(NamedTuple):
    """Prior log odds and the log odds of the most telling words."""

    prior: float
    weights: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, text_col: str, label_col: str = "label", terms: int = TERMS) -> WordScorer:
        """The `terms` words of the largest |log odds| x documents, from the documents that hold each word."""
        sizes = {r[label_col]: r["n"] for r in train.groupBy(label_col).agg(F.count("*").alias("n")).collect()}
        if set(sizes) != {0, 1}:
            return WordScorer(500.0 if 1 in sizes else -500.0, {})
        words = train.select(F.col(label_col).alias("y"), F.explode(F.array_distinct(T.tokenize(F.col(text_col)))).alias("term"))
        held = words.groupBy("term").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("n1"),
                                         F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("n0"))
        odds = F.log((F.col("n1") + 1) / F.lit(sizes[1] + 2.0)) - F.log((F.col("n0") + 1) / F.lit(sizes[0] + 2.0))
        told = held.withColumn("w", odds).withColumn("rank", F.round(F.abs("w") * (F.col("n1") + F.col("n0")), 6))
        rows = told.orderBy(F.desc("rank"), "term").limit(terms).collect()
        return WordScorer(math.log(sizes[1] / sizes[0]), {r["term"]: r["w"] for r in rows})

    def probability(self, text: Column) -> Column:
        """Probability of class 1 from the words that a text holds, six places."""
        if not self.weights:
            return _logistic(F.lit(self.prior))
        known = F.array(*[F.lit(t) for t in self.weights])
        weight = F.create_map(*[F.lit(x) for pair in self.weights.items() for x in pair])
        found = F.array_intersect(T.tokenize(text), known)
        return _logistic(F.aggregate(found, F.lit(self.prior), lambda acc, t: acc + F.element_at(weight, t)))


def _logistic(odds: Column) -> Column:
    return F.round(1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-500.0)), F.lit(500.0)))), 6)


class MailScorers(NamedTuple):
    """The two scorers of a mailbox: by the shape of the body and by its words."""

    shape: GaussianScorer
    words: WordScorer

    @staticmethod
    def fit(train: DataFrame, text_col: str = "raw_body", label_col: str = "label") -> MailScorers:
        shaped = train.withColumns(text_shape(F.col(text_col)))
        return MailScorers(GaussianScorer.fit(shaped, SHAPE, label_col), WordScorer.fit(train, text_col, label_col))

    def score(self, mails: DataFrame, text_col: str = "raw_body") -> DataFrame:
        """Add p_rf (shape) and p_second (words), in the row."""
        return (mails.withColumns(text_shape(F.col(text_col))).withColumn("p_rf", self.shape.probability())
                .withColumn("p_second", self.words.probability(F.col(text_col))).drop(*SHAPE))

"""Corpus statistics and the count-based text models, as aggregations.

* term statistics, top-k vocabulary, TF-IDF with smoothed IDF
  ln((1+n)/(1+df)) + 1 and L2 normalisation per document;
* sentiment: multinomial naive Bayes with add-one smoothing, scored by a join
  and a per-mail sum of log-odds (`feature_models`);
* perplexity: character-bigram model with add-one smoothing over the whole
  text (`prefix=n` restricts it to the first n characters, as the original
  neural scorer's input window did), exp(-mean ln p) per mail, then log1p
  (`char_model`).

Sentiment and perplexity replace pretrained neural scorers: their numbers
differ from those models, their direction (formulaic text scores lower
perplexity) is what is kept.

Term tables are bounded by the vocabulary, not by the number of mails; whether
they are broadcast is left to the optimizer's byte statistics, and AQE splits
skewed terms otherwise.
Token streams are counted to (doc, term, tf) where the text is, before any shuffle or join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..session import materialize
from .char_model import CharModel, bigram_counts
from .feature_models import FeatureCounts, class_log_odds, perplexity_from_mean, probability_from_odds
from .token_counts import count_by_text


def doc_terms(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, term, tf) from the corpus tokenizer; `df` is read twice.

    Each text is counted in its row.  Only where an id comes more than once are
    the counts of its texts added up, by a shuffle; where none does, the columns
    named in `keep` stay, and what needs them needs no join by id."""
    twice = df.groupBy(id_col).count().filter("count > 1").limit(1).count() > 0
    carried = [] if twice else [c for c in keep if c in df.columns and c != id_col]
    rows = df.select(id_col, *carried, T.tokenize(F.col(text_col)).alias("_tokens"))
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *carried)]
    counts = rows.mapInArrow(count_by_text, ", ".join([*fields, "term string, tf long"]))
    return counts.groupBy(id_col, "term").agg(F.sum("tf").alias("tf")) if twice else counts


def term_stats(terms: DataFrame, id_col: str) -> DataFrame:
    """(term, df, cf): document frequency and collection frequency."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("cf"))


def vocabulary(stats: DataFrame, size: int = K.VOCAB_SIZE) -> DataFrame:
    """The `size` most frequent terms (cf desc, term asc) with a 0-based index.
    Global top-k: partial top-k per partition, then one small merge."""
    top = stats.orderBy(F.desc("cf"), F.asc("term")).limit(size)
    return top.withColumn("term_index", (F.row_number().over(Window.orderBy(F.desc("cf"), F.asc("term"))) - 1)
                          .cast("int"))


def tfidf(terms: DataFrame, vocab: DataFrame, id_col: str, n_docs: int) -> DataFrame:
    """(id, term, tf, weight): tf * (ln((1+n)/(1+df)) + 1), L2-normalised per doc."""
    v = vocab.select("term", "term_index",
                     (F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1)) + 1).alias("idf"))
    x = terms.join(v, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return x.select(id_col, "term", "term_index", "tf", F.round(F.col("w") / norm, 6).alias("weight"))


def _prefixed(text_col: str, prefix: int | None) -> Column:
    """The scored text: the whole text, or its first `prefix` characters
    when a prefix is given."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return t if prefix is None else F.substring(t, 1, prefix)


def bigram_perplexity(df: DataFrame, id_col: str, text_col: str, prefix: int | None = None) -> DataFrame:
    """(id, perplexity) = log1p(exp(-mean ln P(b|a))) for every doc under the
    model of all docs; 0.0 for texts under 2 characters."""
    docs = df.select(id_col, _prefixed(text_col, prefix).alias("_t"))
    model = CharModel.of(materialize(bigram_counts(docs, F.col("_t")), "bigram-counts"))  # the model's tables each start from the counts
    return model.add_means(docs, "_t", id_col).select(id_col, perplexity_from_mean(F.col("_m")[0]).alias("perplexity"))


def sentiment(docs: DataFrame, terms: DataFrame, class_col: str, id_col: str = "mail_id") -> DataFrame:
    """(id, sentiment) of every doc: naive-Bayes probability of class 1, trained on the docs that have a class."""
    counts = FeatureCounts.fit(docs, terms, class_col, id_col=id_col, pairs=False)
    llr, priors = counts.naive_bayes((None,))
    odds = class_log_odds(docs.select(id_col), terms, llr, priors, id_col)
    return odds.select(id_col, probability_from_odds(F.col("_odds")[0]).alias("sentiment"))

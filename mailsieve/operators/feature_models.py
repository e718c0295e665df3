"""The count-based feature models: term statistics, naive-Bayes sentiment, character perplexity.

All of them come from `FeatureCounts`, three additive tables:

* terms   (fold, term, df, cf, n1, n0): mails and occurrences of each term, and
          its occurrences in mails of either class;
* classes (fold, mails, n1, n0): mails, and mails of either class;
* bigrams (fold, code, n): character pairs (`char_model`).

Being additive they merge: counts of a new day's mail are written as a further
version of the store, and the counts of A and B together are those of A plus
those of B.  And they subtract: with a fold column, the model of the training
part that leaves out fold k is the total less fold k, so one aggregation serves
all folds of a cross-validation and nothing of a held-out mail is in the model
that scores it.

One smoothing rule (add one) for training and scoring.  Null text is empty; a
mail without a class counts for terms and pairs only; a term unknown to a
training part adds nothing; an empty corpus gives a prior of 0.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import features as FT
from ..session import materialize
from .char_model import CharModel, _without, bigram_counts

SENT_TERMS = 200_000  # terms of a model that are sent to the tasks: of a larger one the most frequent, the rest are joined by a shuffle
TERM_SUMS, CLASS_SUMS = ("df", "cf", "n1", "n0"), ("mails", "n1", "n0")


class FeatureCounts:
    """The three count tables; `fold` is -1 where there are no folds."""

    def __init__(self, terms: DataFrame, classes: DataFrame, bigrams: DataFrame):
        self.terms, self.classes, self.bigrams = terms, classes, bigrams

    @classmethod
    def fit(cls, corpus: DataFrame, terms: DataFrame, class_col: str, fold_col: str | None = None, id_col: str = "mail_id",
            text_col: str = "body", pairs: bool = True) -> FeatureCounts:
        """Counts of a corpus and its (id, term, tf) table; without `pairs` those of terms and classes only.

        Terms that carry the fold and class columns (`doc_terms` with `keep`) are not joined to the corpus."""
        fold = F.coalesce(F.col(fold_col), F.lit(-1)).cast("int") if fold_col else F.lit(-1)
        marks = corpus.select(id_col, fold.alias("fold"), F.col(class_col).cast("int").alias("c"))

        def of_class(c: int, value: Column) -> Column:
            return F.sum(F.when(F.col("c") == c, value).otherwise(0)).cast("long").alias(f"n{c}")

        carried = {class_col, *([fold_col] if fold_col else [])} <= set(terms.columns)
        marked = terms.select("term", "tf", fold.alias("fold"), F.col(class_col).cast("int").alias("c")) if carried else terms.join(marks, id_col)
        per = marked.groupBy("fold", "term").agg(
            F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"), of_class(1, F.col("tf")), of_class(0, F.col("tf")))
        classes = marks.groupBy("fold").agg(F.count("*").alias("mails"), of_class(1, F.lit(1)), of_class(0, F.lit(1)))
        bigrams = bigram_counts(corpus.filter(F.lit(True) if pairs else F.lit(False)), F.col(text_col) if pairs else F.lit(""),
                                F.col(fold_col) if fold_col else None)
        return cls(per, classes, bigrams).written()

    def written(self) -> FeatureCounts:
        """The same counts as tables in the shared folder, read by all models that follow."""
        return FeatureCounts(materialize(self.terms, "count-terms"), materialize(self.classes, "count-classes"), materialize(self.bigrams, "count-bigrams"))

    @staticmethod
    def _summed(terms: DataFrame, classes: DataFrame, bigrams: DataFrame) -> FeatureCounts:
        return FeatureCounts(
            terms.groupBy("fold", "term").agg(*[F.sum(c).alias(c) for c in TERM_SUMS]),
            classes.groupBy("fold").agg(*[F.sum(c).alias(c) for c in CLASS_SUMS]),
            bigrams.groupBy("fold", "code").agg(F.sum("n").alias("n")))

    def merge(self, other: FeatureCounts) -> FeatureCounts:
        """The counts of both corpora together."""
        return self._summed(self.terms.unionByName(other.terms), self.classes.unionByName(other.classes), self.bigrams.unionByName(other.bigrams))

    # ---- store: a folder per table and version --------------------------------------------
    def save(self, path: str, version: int) -> None:
        """Write these counts as one version of the store; writing a version again replaces it."""
        for name in ("terms", "classes", "bigrams"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}/version={version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, up_to: int | None = None) -> FeatureCounts:
        """The sum of all versions of the store, or of those up to one."""
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("terms", "classes", "bigrams")]
        return cls._summed(*[t if up_to is None else t.filter(F.col("version") <= up_to) for t in tables])

    # ---- term models ------------------------------------------------------------------------
    def vocabulary(self, variants: Sequence[int | None], size: int = K.VOCAB_SIZE) -> DataFrame:
        """(variant, term, cf, df, term_index, n_mails): each training part's most frequent terms (cf, then term)."""
        names = list(range(len(variants)))
        per = self.terms.groupBy("term").agg(F.array(*[
            F.struct(F.lit(i).alias("variant"), _without("cf", v).alias("cf"), _without("df", v).alias("df")) for i, v in zip(names, variants)]).alias("x"))
        rows = per.select("term", F.inline("x")).filter("cf > 0")
        order = Window.partitionBy("variant").orderBy(F.desc("cf"), "term")
        # the plain rank in the filter lets every task drop all but its own first ones before the shuffle
        top = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size)
        mails = self.classes.agg(*[_without("mails", v).alias(f"m{i}") for i, v in zip(names, variants)])
        mails = mails.select(F.inline(F.array(*[F.struct(F.lit(i).alias("variant"), F.col(f"m{i}").alias("n_mails")) for i in names])))
        top = top.withColumn("term_index", (F.col("_rank") - 1).cast("int"))
        return top.join(mails, "variant").select("variant", "term", "cf", "df", "term_index", "n_mails")

    def naive_bayes(self, variants: Sequence[int | None]) -> tuple[DataFrame, list[float]]:
        """((term, llr) with a value per variant, prior log odds per variant): add-one smoothing over the training part's terms."""
        names = range(len(variants))
        per = self.terms.filter("n1 + n0 > 0").groupBy("term").agg(
            *[_without(f"n{c}", v).alias(f"n{c}_{i}") for i, v in zip(names, variants) for c in (0, 1)])
        sums = per.agg(*[F.sum(F.col(f"n{c}_{i}")).alias(f"t{c}_{i}") for i in names for c in (0, 1)],
                       *[F.sum((F.col(f"n0_{i}") + F.col(f"n1_{i}") > 0).cast("int")).alias(f"v_{i}") for i in names]).first()
        total = {k: float(x or 0) for k, x in sums.asDict().items()}

        def part(c: int, i: int) -> Column:
            return F.log((F.col(f"n{c}_{i}") + 1) / F.lit(max(total[f"t{c}_{i}"] + total[f"v_{i}"], 1.0)))

        llr = F.array(*[F.when(F.col(f"n0_{i}") + F.col(f"n1_{i}") > 0, part(1, i) - part(0, i)).otherwise(0.0) for i in names])
        mails = self.classes.agg(*[_without(f"n{c}", v).alias(f"n{c}_{i}") for i, v in zip(names, variants) for c in (0, 1)]).first()
        return per.select("term", llr.alias("llr")), [_log_odds(mails[f"n1_{i}"] or 0, mails[f"n0_{i}"] or 0) for i in names]


def _log_odds(n1: int, n0: int) -> float:
    if not n1 and not n0:
        return 0.0
    return math.inf if not n0 else -math.inf if not n1 else math.log(n1 / (n1 + n0)) - math.log(n0 / (n1 + n0))


def class_log_odds(docs: DataFrame, terms: DataFrame, model: DataFrame, priors: Sequence[float], id_col: str = "mail_id") -> DataFrame:
    """The rows of `docs` with `_odds`: the prior plus the sum of tf * llr, one value a variant."""
    rows = terms.select(id_col, "term", "tf")
    if model.limit(SENT_TERMS + 1).count() <= SENT_TERMS:
        known = rows.join(F.broadcast(model), "term")
    else:  # most rows are of frequent terms: they stay where they are, and no task gets all rows of one
        model = materialize(model, "term-model")
        frequent = terms.groupBy("term").count().orderBy(F.desc("count"), "term").limit(SENT_TERMS).select("term")
        frequent = materialize(model.join(frequent, "term"), "frequent-terms")
        rare = rows.join(F.broadcast(frequent.select("term")), "term", "left_anti")
        known = rows.join(F.broadcast(frequent), "term").unionByName(rare.join(model, "term"))
    sums = known.groupBy(id_col).agg(F.array(*[F.sum(F.col("tf") * F.col("llr")[i]) for i in range(len(priors))]).alias("_s"))
    odds = F.array(*[F.lit(float(p)) + F.coalesce(F.col("_s")[i], F.lit(0.0)) for i, p in enumerate(priors)])
    return docs.join(sums, id_col, "left").withColumn("_odds", odds).drop("_s")


def probability_from_odds(odds: Column) -> Column:
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)), 6)


def perplexity_from_mean(mean: Column) -> Column:
    return F.round(F.coalesce(F.log1p(F.exp(-mean)), F.lit(0.0)), 6)


class FeatureModels:
    """Sentiment and perplexity models of one or more training parts ("variants") of a corpus."""

    def __init__(self, llr: DataFrame, priors: Sequence[float], chars: CharModel, lexicon: Sequence[str] = tuple(K.LEXICON_FULL35)):
        self.llr, self.priors, self.chars, self.lexicon = llr, list(priors), chars, list(lexicon)

    @classmethod
    def of(cls, counts: FeatureCounts, variants: Sequence[int | None] = (None,)) -> FeatureModels:
        llr, priors = counts.naive_bayes(variants)
        return cls(llr, priors, CharModel.of(counts.bigrams, variants))

    def save(self, path: str) -> None:
        spark = self.llr.sparkSession
        for name, table in (("llr", self.llr), ("pairs", self.chars.pairs), ("unseen", self.chars.unseen)):
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        meta = {"priors": self.priors, "unknown": self.chars.unknown, "lexicon": self.lexicon}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModels:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        llr, pairs, unseen = (spark.read.parquet(f"{path}/{n}") for n in ("llr", "pairs", "unseen"))
        return cls(llr, meta["priors"], CharModel(pairs, unseen, meta["unknown"]), meta["lexicon"])

    def features(self, mails: DataFrame, terms: DataFrame, id_col: str = "mail_id", text_col: str = "body", urls_col: str = "urls",
                 derived: Sequence[Column] = ()) -> DataFrame:
        """The mails with the nine features.  With several variants `sentiment` and `perplexity` are arrays, one value each.

        Perplexity, the fixed features and the `derived` columns are computed in the
        row; the term sums are the one join, to which a text goes only if it is read later."""
        mails = mails.drop(*[c for c in K.FEATURES if c in mails.columns])
        rows = self.chars.add_means(mails, text_col, id_col)
        rows = rows.select("*", FT.keyword_density(F.col(text_col), self.lexicon).alias("subjectivity"), *FT.url_features(F.col(urls_col)), *derived)
        rows = class_log_odds(rows, terms, self.llr, self.priors, id_col)
        values = [(probability_from_odds(F.col("_odds")[i]), perplexity_from_mean(F.col("_m")[i])) for i in range(len(self.priors))]
        sentiment, perplexity = values[0] if len(values) == 1 else (F.array(*[v[k] for v in values]) for k in (0, 1))
        return rows.withColumns({"sentiment": sentiment, "perplexity": perplexity}).drop("_odds", "_m")


def held_out(features: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(training part, held-out part) of a fold, both with the features of the models that leave it out."""
    rows = features.withColumns({c: F.col(c)[fold] for c in ("sentiment", "perplexity")})
    return rows.filter(F.col(fold_col) != fold), rows.filter(F.col(fold_col) == fold)

"""Texts are cleaned, cut and counted once where several steps read them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.functions import text as T
from mailsieve.operators import corpus_models as CM
from mailsieve.operators import feature_models as FM
from mailsieve.operators import ml as ML
from mailsieve.plans import catalog


def mailbox(spark, tmp_path, repeat=False):
    """Tables of 40 documents; with `repeat` one id has two texts, and one none."""
    docs = [(i, f"offer {'prize cash' if i % 4 == 0 else 'meeting notes'} number {i % 7} 安全验证", "en", f"src{i % 3}", 30) for i in range(1, 41)]
    docs += [(1, "offer again", "en", "src0", 11), (41, None, "en", "src1", 0)] if repeat else []
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(1, 39)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_second_scores_cuts_texts_into_tokens_before_the_fit(spark, tmp_path, monkeypatch):
    folder = mailbox(spark, tmp_path)
    data = catalog.split_features(spark, folder)
    model = ML.fit_text_classifier(data.filter("is_test = 0"), kind="logreg")
    want = ML.positive_probability(model, data.filter("is_test = 1"), "p").select("mail_id", F.round("p", 6), "pred").collect()

    def never(*_, **__):
        raise AssertionError("texts are cut into tokens again")

    monkeypatch.setattr(ML, "tokenizer_stage", never)
    monkeypatch.setattr(ML.Vocabulary, "fit", staticmethod(never))
    got = catalog.QUERIES["second_scores"](spark, folder).select("mail_id", "p_second", "pred").collect()
    assert sorted(got) == sorted(want) and len(got) >= 8


def test_second_scores_with_ids_of_several_texts(spark, tmp_path):
    folder = mailbox(spark, tmp_path, repeat=True)
    data, vocabulary = catalog.split_tokens(spark, folder)
    train = catalog.split_features(spark, folder).filter("is_test = 0")
    assert data.count() == 42 and "body" not in data.columns
    assert vocabulary == ML.Vocabulary.fit(train, "mail_id", "body", 500)


def test_perplexity_reads_the_texts_for_the_counts_and_the_means(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, t string").mapInArrow(seen, "id long, t string")
    assert len(CM.bigram_perplexity(docs, "id", "t").collect()) == 20
    assert read.value == 40


def test_every_task_drops_the_rarer_terms_of_a_vocabulary(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}", i % 2) for i in range(12)], "id long, t string, fold int")
    counts = FM.FeatureCounts.fit(docs, CM.doc_terms(docs, "id", "t", ("fold",)), "fold", "fold", "id", "t", pairs=False)
    top = counts.vocabulary([0, None], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["variant"], r["term_index"], r["term"], r["cf"]) for r in top.collect())
    assert got == [(0, 0, "a", 6), (0, 1, "b", 6), (1, 0, "a", 12), (1, 1, "b", 12)]


@pytest.mark.parametrize("seed", [1, 2])
def test_tokens_equal_those_of_separated_scripts(spark, seed):
    random_, alphabet = np.random.default_rng(seed), list("abzAZ09 .-_'éßİσΣก๐฿中文字ひカ가٠ªſK々\n\U0001f600\U00020000\U0001d7céั")
    rows = [(i, "".join(random_.choice(alphabet, random_.integers(0, 14)))) for i in range(800)] + [(-1, None), (-2, "")]
    docs = spark.createDataFrame(rows, "id long, body string")
    plain = rf"[{T.UNSPACED}]+|[\p{{L}}\p{{M}}]+|\p{{Nd}}+"
    apart = F.regexp_replace(F.lower(F.coalesce("body", F.lit(""))), T.UNSPACED_RUN, " $1 ")
    want = F.flatten(F.transform(F.regexp_extract_all(apart, F.lit(plain), 0), lambda t: F.when(
        t.rlike("^" + T.UNSPACED_RUN) & (F.length(t) > 1), T.char_bigrams(t)).otherwise(F.array(t))))
    both = ML.tokenizer_stage().transform(docs.select("*", want.alias("want"), T.tokenize(F.col("body")).alias("got")))
    assert both.filter("NOT (want <=> got) OR NOT (want <=> tokens)").count() == 0

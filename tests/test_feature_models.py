"""Additive counts: merging, subtraction, the packed character model; large lexicons; thresholds."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsieve import constants as K
from mailsieve.functions import features as FT
from mailsieve.functions import text as T
from mailsieve.operators import char_model as CH
from mailsieve.operators import corpus_models as CM
from mailsieve.operators import feature_models as FM
from mailsieve.operators import lexicon as LX
from mailsieve.operators import ranking as RK
from mailsieve.session import scratch_path

TEXTS = ["free money now 😀", "", None, "a", "meeting at noon", "free lunch at noon", "money money", "日本語 text", "b", "noon 😀😀", "zz", "at"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, [1, 0, None][i % 3], i % 4, i % 2) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "mail_id int, body string, quality int, fold int, label int")


def counts_of(df, fold=None):
    return FM.FeatureCounts.fit(df, CM.doc_terms(df, "mail_id", "body"), "quality", fold)


def rows(table):
    return sorted((tuple(r) for r in table.select(*sorted(table.columns)).collect()), key=repr)


def same(a, b):
    return all(rows(getattr(a, n)) == rows(getattr(b, n)) for n in ("terms", "classes", "bigrams"))


def test_counts_of_two_corpora_are_the_sum(spark, corpus):
    whole, a, b = counts_of(corpus), counts_of(corpus.filter("mail_id < 17")), counts_of(corpus.filter("mail_id >= 17"))
    assert same(a.merge(b), whole)
    path = scratch_path(spark, "counts")
    a.save(path, 1)
    b.save(path, 2)
    b.save(path, 2)  # a version written again counts once
    assert same(FM.FeatureCounts.load(spark, path), whole) and same(FM.FeatureCounts.load(spark, path, up_to=1), a)


def test_leaving_a_fold_out_equals_counting_without_it(spark, corpus):
    folds = range(4)
    counts = counts_of(corpus, "fold")
    llr, priors = counts.naive_bayes(folds)
    chars = CH.CharModel.of(counts.bigrams, folds)
    got = {r["term"]: r["llr"] for r in llr.collect()}
    means = {r["mail_id"]: r["_m"] for r in chars.add_means(corpus, "body", "mail_id").collect()}
    vocabulary = counts.vocabulary(folds, 5).collect()
    for k in folds:
        part = corpus.filter(f"fold <> {k}")
        alone = counts_of(part)
        expected, prior = alone.naive_bayes((None,))
        expected = {r["term"]: r["llr"][0] for r in expected.collect()}
        assert priors[k] == pytest.approx(prior[0])
        assert all(got[t][k] == pytest.approx(expected.get(t, 0.0)) for t in got) and set(expected) <= set(got)
        single = CH.CharModel.of(alone.bigrams)
        for r in single.add_means(corpus, "body", "mail_id").collect():
            assert (means[r["mail_id"]] is None) == (r["_m"] is None)
            assert r["_m"] is None or means[r["mail_id"]][k] == pytest.approx(r["_m"][0])
        top = CM.vocabulary(CM.term_stats(CM.doc_terms(part, "mail_id", "body"), "mail_id"), 5).collect()
        assert sorted((r["term"], r["cf"], r["df"], r["term_index"]) for r in vocabulary if r["variant"] == k) == sorted(
            (r["term"], r["cf"], r["df"], r["term_index"]) for r in top)


def brute_perplexity(texts, scored):
    pairs, first, alphabet = Counter(), Counter(), set()
    for t in texts:
        alphabet.update(t or "")
        for a, b in zip(t or "", (t or "")[1:]):
            pairs[a, b] += 1
            first[a] += 1
    out = []
    for t in scored:
        ps = [math.log((pairs[p] + 1) / max(first[p[0]] + len(alphabet), 1)) for p in zip(t or "", (t or "")[1:])]
        out.append(sum(ps) / len(ps) if ps else None)
    return out


@pytest.mark.parametrize("packed", [CH.PACKED, 0])
def test_character_model_equals_brute_force(spark, corpus, monkeypatch, packed):
    monkeypatch.setattr(CH, "PACKED", packed)  # 0: joined to histograms
    model = CH.CharModel.of(CH.bigram_counts(corpus, F.col("body")))
    unseen = ["free xylophone", "Ω!", "日本 free", None, "a", "😀q"]
    new = spark.createDataFrame([(i, t) for i, t in enumerate(unseen)], "mail_id int, body string")
    got = {r["mail_id"]: r["_m"] for r in model.add_means(new, "body", "mail_id").collect()}
    for i, m in enumerate(brute_perplexity(TEXTS * 3, unseen)):
        assert (got[i] is None) == (m is None) and (m is None or got[i][0] == pytest.approx(m))


def test_character_model_moves_no_positions(spark, corpus):
    df = CM.bigram_perplexity(corpus, "mail_id", "body")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    codes, row = CH.text_codes(pa.array(["ab", "", "c", "abc"]))
    assert Counter(zip(codes.tolist(), row.tolist())) == Counter(
        {((97 << 21) | 98, 0): 1, ((97 << 21) | 98, 3): 1, ((98 << 21) | 99, 3): 1, ((99 << 21) | CH.ALONE, 2): 1}.keys())


def test_empty_corpus(spark, corpus):
    nothing = corpus.filter("false")
    counts = counts_of(nothing)
    llr, priors = counts.naive_bayes((None,))
    assert llr.collect() == [] and priors == [0.0]
    model = CH.CharModel.of(counts.bigrams)
    assert [r["_m"] for r in model.add_means(corpus.filter("mail_id = 4"), "body", "mail_id").collect()][0][0] == 0.0


def test_lexicon_equals_the_literal_list(spark):
    words = K.LEXICON_FULL35
    texts = [None, "", "".join(words), "请点击链接验证账号", "no hit", words[3] * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lexicon = spark.createDataFrame([(w,) for w in words + words[:3]] + [(None,)], "term string")
    got = LX.lexicon_density(df, "t", lexicon).withColumn("plain", FT.keyword_hits(F.col("t"))).withColumn("share", FT.keyword_density(F.col("t"))).collect()
    assert all(r["hits"] == r["plain"] and r["density"] == pytest.approx(r["share"]) for r in got) and got[2]["hits"] == 35


def test_fifty_thousand_terms_in_blocks(spark):
    rng = random.Random(7)
    terms = ["".join(rng.choices("abcd", k=rng.randint(2, 9))) for _ in range(50_000)] + [""]
    texts = ["".join(rng.choices("abcd ", k=rng.randint(0, 300))) for _ in range(60)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    distinct = set(terms)
    for size in (LX.BLOCK_CHARS, 100_000):
        got = {r["id"]: r["hits"] for r in LX.lexicon_hits(df, "t", lexicon, block_chars=size).collect()}
        assert got == {i: sum(w in (t or "") for w in distinct) for i, t in enumerate(texts)}
    assert [r["hits"] for r in LX.lexicon_hits(df, "t", lexicon.filter("false")).collect()] == [0] * len(texts)


def test_samples_by_threshold_sort_no_table(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("gn"))
    plan = RK.sample_exact_n(df, "id", 100, 42, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


@pytest.mark.parametrize("literal", [RK.LITERAL_GROUPS, 0])
def test_thresholds_equal_ranks(spark, monkeypatch, literal):
    monkeypatch.setattr(RK, "LITERAL_GROUPS", literal)  # 0: thresholds are joined
    monkeypatch.setattr(RK, "HASH_BUCKET_HEX", 1)
    df = spark.range(3000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g")).unionByName(
        spark.range(50).select("id", F.lit(9).alias("g")))
    for n in (0, 1, 60, 10_000):
        want = RK.hash_ranked(df, "id", 42, ["g"]).filter(F.col("rank") <= n).select("id", "g")
        got = RK.sample_exact_n(df, "id", n, 42, ["g"]).select("id", "g")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    flags = RK.split_flag(df, "id", 0.2, 42).groupBy("is_test").count().collect()
    assert {r["is_test"]: r["count"] for r in flags} == {0: 2440, 1: 610}


def test_ids_with_an_outlier_keep_their_buckets_small(spark):
    df = spark.range(4000).select(F.when(F.col("id") == 7, F.lit(10**17)).otherwise(F.col("id")).alias("id"), F.lit(1).alias("g"))
    got = RK.id_ranked(df, "id", ["g"], n_buckets=64)
    assert all(r["rank"] == i for i, r in enumerate(got.orderBy("id").collect(), 1))


def test_tokens_with_and_without_unspaced_scripts(spark):
    df = spark.createDataFrame([(t,) for t in ("Free 日本語 x9", "plain Text 12", "日", "", None)], "t string")
    assert [r[0] for r in df.select(T.tokenize(F.col("t"))).collect()] == [["free", "日本", "本語", "x", "9"], ["plain", "text", "12"], ["日"], [], []]

"""Counts of tokens in the row, and the model join that keeps frequent terms in place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.operators import char_model as CH
from mailsieve.operators import corpus_models as CM
from mailsieve.operators import feature_models as FM
from mailsieve.operators import token_counts as TC

ROWS = [(1, "a b a 中文字", 1), (2, "", 0), (3, None, 0), (4, "b b c", 1), (None, "d", 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, t string, y int")


def test_texts_are_counted_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(TC, "_TOKENS", 2)  # a slice a text
    terms = CM.doc_terms(frame(spark, ROWS), "id", "t", ("y",))
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    found = {(r["id"], r["y"], r["term"]): r["tf"] for r in terms.collect()}
    assert found == {(1, 1, "a"): 2, (1, 1, "b"): 1, (1, 1, "中文"): 1, (1, 1, "文字"): 1, (4, 1, "b"): 2, (4, 1, "c"): 1, (None, 0, "d"): 1}


def test_texts_of_one_id_are_added_up(spark):
    terms = CM.doc_terms(frame(spark, [(1, "a b", 1), (1, "a", 0), (None, "z", 1), (None, "z", 1)]), "id", "t", ("y",))
    assert terms.columns == ["id", "term", "tf"]
    assert {(r["id"], r["term"]): r["tf"] for r in terms.collect()} == {(1, "a"): 2, (1, "b"): 1, (None, "z"): 2}


def test_counts_by_group(spark):
    rows = TC.group_counts(frame(spark, ROWS), "t", F.col("y")).groupBy("y", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    found = {(r["y"], r["term"]): (r["df"], r["cf"]) for r in rows.collect()}
    assert found[1, "b"] == (2, 3) and found[1, "a"] == (1, 2) and found[0, "d"] == (1, 1) and len(found) == 6


@pytest.mark.parametrize("sent", [100, 1, 0])
def test_odds_do_not_depend_on_how_many_terms_are_sent(spark, monkeypatch, sent):
    monkeypatch.setattr(FM, "SENT_TERMS", sent)
    docs = frame(spark, [(i, f"a b{i} {'a' * (i % 2)} c", i % 2) for i in range(6)])
    model = spark.createDataFrame([("a", [1.0]), ("c", [0.5]), ("1", [-3.0])], "term string, llr array<double>")
    odds = FM.class_log_odds(docs, CM.doc_terms(docs, "id", "t"), model, [0.25], "id")
    assert {r["id"]: r["_odds"][0] for r in odds.collect()} == {i: 1.75 + (i % 2) - 3.0 * (i == 1) for i in range(6)}


def test_counts_carry_what_a_join_would_add(spark):
    docs = frame(spark, [(i, f"a b{i % 3}", i % 2) for i in range(9)]).withColumn("fold", (F.col("id") % 2).cast("int"))
    joined = FM.FeatureCounts.fit(docs, CM.doc_terms(docs, "id", "t"), "y", "fold", "id", "t", pairs=False)
    carried = FM.FeatureCounts.fit(docs, CM.doc_terms(docs, "id", "t", ("fold", "y")), "y", "fold", "id", "t", pairs=False)
    assert sorted(map(tuple, joined.terms.collect())) == sorted(map(tuple, carried.terms.collect()))


@pytest.mark.parametrize("dense", [CH.DENSE, 0])
def test_pairs_are_the_same_by_table_and_by_sorting(spark, monkeypatch, dense):
    monkeypatch.setattr(CH, "DENSE", dense)
    texts = ["abab", "é", "a\U0001f600b", "", "x"] * 40
    codes, _ = CH.text_codes(__import__("pyarrow").array(texts))
    code, n = CH.code_counts(codes)
    want, times = np.unique(codes, return_counts=True)
    assert code.tolist() == want.tolist() and n.tolist() == times.tolist()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:5], "zz", "az"])], "id long, t string")
    model = CH.CharModel.of(CH.bigram_counts(docs.filter("id < 5"), F.col("t")))
    means = {r["id"]: r["_m"] for r in model._packed(docs, "t", "_m").collect()}
    assert means[1] is None and means[3] is None
    v, pairs = 5, {"ab": 2, "ba": 1}  # a, b, é, the emoji and x
    lp = lambda a, b: np.log((pairs.get(a + b, 0) + 1) / ({"a": 3, "b": 1}.get(a, 0) + v))
    assert np.isclose(means[0][0], (2 * lp("a", "b") + lp("b", "a")) / 3) and np.isclose(means[5][0], -np.log(v)) and np.isclose(means[6][0], lp("a", "z"))

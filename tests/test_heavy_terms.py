"""Heavy terms by summaries, and the leak report."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import corpus_models as CM
from mailsieve.operators import heavy_terms as HT
from mailsieve.operators import leaks as LK


@pytest.mark.parametrize("capacity,packed", [(20_000, HT.PACKED), (40, HT.PACKED), (40, 0)])
def test_top_terms_equal_the_full_count(spark, monkeypatch, capacity, packed):
    monkeypatch.setattr(HT, "PACKED", packed)
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 5000}x"
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(900, None), (901, ""), (902, "tie tie2 tie3")]
    docs = spark.createDataFrame(rows, "id int, t string").repartition(6)
    full = CM.vocabulary(CM.term_stats(CM.doc_terms(docs, "id", "t"), "id"), 25)
    got = HT.top_terms(docs, "t", 25, capacity)
    columns = ["term", "cf", "df", "term_index"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, full.select(*columns).collect()))


def test_fewer_terms_than_asked_for_and_none(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, t string")
    assert sorted((r["term"], r["cf"], r["df"]) for r in HT.top_terms(docs, "t", 10, 1).collect()) == [("a", 2, 1), ("b", 1, 1)]
    assert HT.top_terms(docs.filter("id = 2"), "t", 10).collect() == []


def test_a_summary_is_short_by_its_error_at_most():
    rng = random.Random(1)
    true, held, error = Counter(), Counter(), 0
    for _ in range(50):
        batch = Counter(int(rng.paretovariate(0.6)) % 500 for _ in range(200))
        true += batch
        held.update(batch)
        error += HT.shrink(held, 30)
    assert len(held) <= 30 and all(true[t] - error <= held[t] <= true[t] for t in true)


def test_planted_leak_ranks_first_and_vanishes_given_its_source(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
        F.when(F.col("id") % 20 < 18, F.col("id") % 2).otherwise(1 - F.col("id") % 2).cast("int").alias("label"),
        (F.col("id") % 2 * 3).alias("url_count"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("noise"),
        F.when(F.col("id") % 7 > 0, F.lit(5)).alias("partly_null"))
    got = {r["feature"]: r for r in LK.leak_report(rows, ["noise", "url_count", "partly_null"]).collect()}
    assert got["url_count"]["rank"] == 1 and got["url_count"]["bits"] > 0.5 and got["url_count"]["bits_given_source"] == 0
    assert got["noise"]["bits"] < 0.02 and got["partly_null"]["bits"] < 0.01
    assert LK.leak_report(rows.filter("false"), ["noise"]).collect() == []

import pytest
from pyspark.sql import functions as F

from mailsieve.functions import urls as U
from mailsieve.operators import scoring as SC


def test_boost_band_verdict_edges(spark):
    rows = [(0.5, 0), (0.5, 4), (0.74, 0), (0.75, 0), (0.95, 6), (0.2, 5)]
    df = spark.createDataFrame(rows, "p double, risk int")
    res, lvl = SC.band(F.col("prob"))
    out = (df.withColumn("boost", U.url_boost(F.col("risk")))
           .withColumn("prob", SC.boosted(F.col("p"), F.col("boost")))
           .select("prob", SC.is_phishing(F.col("prob")).alias("ph"), lvl.alias("lvl")).collect())
    assert [(r.prob, r.ph, r.lvl) for r in out] == [
        (0.5, 0, "中危"), (0.58, 1, "中危"), (0.74, 1, "中危"), (0.75, 1, "高危"), (1.0, 1, "高危"), (0.28, 0, "无风险")]


def test_fuse_weights_and_range(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (0.5, 0.5)], "a double, b double")
    got = [r[0] for r in df.select(SC.fuse(F.col("a"), F.col("b"))).collect()]
    assert got == [0.6, 1.0, 0.5]


def test_mode_names_and_invalid_mode():
    assert SC.resolve_mode("加权集成检测") == "ENSEMBLE"
    assert SC.resolve_mode("机器学习引擎") == "RF"
    with pytest.raises(ValueError):
        SC.resolve_mode("SVM")


def test_flagship_counts(spark):
    import __spark_entry__ as E
    df = E.queries()["score_mailbox"](spark, "/root/testdata/sf0.01")
    maxrisk = {r[0]: r[1] for r in df.groupBy("url_max_risk").count().collect()}
    assert maxrisk == {0: 350, 1: 100, 2: 50, 3: 300, 4: 100, 7: 50, 10: 50}
    assert df.filter("keyword_hits > 0").count() == 973


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 200
    assert "prob" in df.columns and "verdict" in df.columns

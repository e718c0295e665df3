from pyspark.sql import Window
from pyspark.sql import functions as F

from mailsieve.operators import ranking as RK
from mailsieve.sources import fixtures as FX

SF = "/root/testdata/sf0.01"


def test_bucketed_rank_equals_row_number(spark):
    m = FX.mail_table(spark, SF).select("mail_id", "label")
    ours = RK.hash_ranked(m, "mail_id", 42, ["label"]).select("mail_id", "rank")
    w = Window.partitionBy("label").orderBy(RK.hash_key("mail_id", 42), "mail_id")
    plain = m.select("mail_id", F.row_number().over(w).alias("rank"))
    assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0


def test_folds_partition_and_stratify(spark):
    m = FX.mail_table(spark, SF)
    f = RK.stratified_folds(m, "mail_id", "label").groupBy("label", "fold").count().collect()
    by_label = {}
    for r in f:
        by_label.setdefault(r.label, []).append(r["count"])
    for counts in by_label.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert sum(sum(v) for v in by_label.values()) == m.count()


def test_contiguous_folds_sizes(spark):
    m = FX.mail_table(spark, SF)
    sizes = sorted(r["count"] for r in RK.contiguous_folds(m, "mail_id", "label")
                   .filter("label = 0").groupBy("fold").count().collect())
    n0 = m.filter("label = 0").count()
    assert sum(sizes) == n0 and max(sizes) - min(sizes) <= 1


def test_split_and_sample_sizes(spark):
    import math
    m = FX.mail_table(spark, SF)
    n = m.count()
    assert RK.split_flag(m, "mail_id", 0.2, 42).filter("is_test = 1").count() == math.ceil(0.2 * n)
    s = RK.sample_exact_n(m, "mail_id", 200, 42, ["label"]).groupBy("label").count().collect()
    n1 = m.filter("label = 1").count()
    assert {r.label: r["count"] for r in s} == {0: 200, 1: min(200, n1)}
    seeds = RK.sample_fraction_seeds(m.select("mail_id"), "mail_id").groupBy("seed").count().collect()
    assert all(r["count"] == round(0.2 * n) for r in seeds) and len(seeds) == 5


def test_rows_of_a_null_group_stay(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, None)], "id long, label int")
    assert {r.id for r in RK.split_flag(df, "id", 0.2, 42, "label").collect()} == {1, 2, 3, 4}
    folds = {r.id: r.fold for r in RK.contiguous_folds(df, "id", "label", 2).collect()}
    assert folds == {1: 0, 2: 0, 3: 0, 4: 1}
    assert RK.sample_exact_n(df, "id", 1, 42, ["label"]).count() == 3

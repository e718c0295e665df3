"""Exact, skew-free ranking: samples, splits and folds.

Samples and splits take the first rows of a group in hash order.  They need not
rank the rows: `thresholds` finds the last row to take, by a histogram of the
hashes (one scan, 65,536 counts a group at most) and the order of the rows in
the one bucket where the sought rank falls (a second scan).  The sample is then
a filter on the rows, so nothing but counts and one bucket a group is shuffled
or sorted.

Folds need every rank.  A row's rank inside a group is `offset(bucket) +
row_number within bucket`:

* every row gets an order-preserving bucket (the first 16 bits of its md5
  order key, or one between quantiles of the ids);
* bucket sizes come from one partial-aggregated `groupBy` whose output is
  bounded by groups x buckets; running offsets are a window over that small
  table and it is joined back (null-safe: a null group value is a group);
* `row_number` then runs per (group, bucket), so a class holding most of the
  rows is still spread over up to 65,536 tasks instead of one.

Hash order is `md5(id || '|' || seed)`, ties broken by id; Spark and DuckDB
produce the same digest, so the oracle can use a plain `row_number`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_HEX = 4  # 16 bits -> 65,536 buckets per group


def hash_key(id_col: str, seed) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def ranked(df: DataFrame, group_cols: list[str], order_cols: list[Column], bucket: Column,
           rank_col: str = "rank", size_col: str = "group_n") -> DataFrame:
    """Add `rank` (1-based, exact) and `group_n` (rows in the group)."""
    b = df.withColumn("_bucket", bucket)
    keys = list(group_cols) + ["_bucket"]
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    running = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("_cnt").over(running), F.lit(0)).alias("_offset"),
        F.sum("_cnt").over(whole).alias(size_col),
    )
    # null is a group of its own, so the join is null-safe
    joined = b.join(offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys}),
                    reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])).drop(*[f"_of_{k}" for k in keys])
    inner = Window.partitionBy(*keys).orderBy(*order_cols)
    return joined.withColumn(rank_col, F.col("_offset") + F.row_number().over(inner)).drop("_bucket", "_offset")


def hash_ranked(df: DataFrame, id_col: str, seed, group_cols: list[str] | None = None,
                rank_col: str = "rank", size_col: str = "group_n") -> DataFrame:
    """Rank rows by md5(id|seed), id within each group."""
    d = df.withColumn("_hkey", hash_key(id_col, seed))
    bucket = F.conv(F.substring("_hkey", 1, HASH_BUCKET_HEX), 16, 10).cast("int")
    out = ranked(d, list(group_cols or []), [F.col("_hkey"), F.col(id_col)], bucket, rank_col, size_col)
    return out.drop("_hkey")


def id_ranked(df: DataFrame, id_col: str, group_cols: list[str] | None = None, n_buckets: int = 1024,
              rank_col: str = "rank", size_col: str = "group_n") -> DataFrame:
    """Rank rows by an id within each group.  Buckets lie between approximate quantiles of the ids, so ids may be spread in any way."""
    from pyspark.ml.feature import Bucketizer
    shares = [i / n_buckets for i in range(1, n_buckets)]
    valued = df.withColumn("_value", F.col(id_col).cast("double"))  # order-preserving, though neighbours above 2^53 may coincide
    cuts = sorted(set(valued.approxQuantile("_value", shares, 1 / (4 * n_buckets))))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_value", outputCol="_at", handleInvalid="keep").transform(valued)
    out = ranked(bucketed, list(group_cols or []), [F.col(id_col)], F.coalesce(F.col("_at").cast("int"), F.lit(-1)), rank_col, size_col)
    return out.drop("_value", "_at")


LITERAL_GROUPS = 200  # thresholds that are written into the filter; more are joined


def thresholds(df: DataFrame, group_cols: list[str], order_cols: list[str], bucket: Column, wanted: Column) -> DataFrame:
    """(group columns, order columns): the row of each group whose rank by `order_cols` is `wanted` of the group's size `group_n`.

    A group of which nothing is wanted has no row; one that is too small for it has its last."""
    b = df.select(*group_cols, *order_cols, bucket.alias("_bucket"))
    counts = b.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    whole = Window.partitionBy(*group_cols)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_upto": F.sum("_cnt").over(upto), "group_n": F.sum("_cnt").over(whole)})
    counts = counts.withColumn("_want", F.least(wanted.cast("long"), F.col("group_n")))
    sought = counts.filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_cnt") < F.col("_want")))
    sought = sought.select(*[F.col(c).alias(f"_of_{c}") for c in (*group_cols, "_bucket")], (F.col("_want") - F.col("_upto") + F.col("_cnt")).alias("_rank"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group_cols, "_bucket")])
    order = Window.partitionBy(*group_cols).orderBy(*order_cols)
    rows = b.join(sought, same).withColumn("_n", F.row_number().over(order))
    return rows.filter(F.col("_n") == F.col("_rank")).select(*group_cols, *order_cols)


def _upto_threshold(df: DataFrame, found: DataFrame, group_cols: list[str], order_cols: list[str], flag: str) -> DataFrame:
    """`df` with a flag: whether the row is at or before its group's threshold."""
    def at_most(limits: list[Column]) -> Column:
        out = F.col(order_cols[-1]) <= limits[-1]
        for c, v in reversed(list(zip(order_cols[:-1], limits[:-1]))):
            out = (F.col(c) < v) | ((F.col(c) == v) & out)
        return out

    rows = found.limit(LITERAL_GROUPS + 1).collect()
    if len(rows) <= LITERAL_GROUPS:
        cases = F.lit(False)
        for r in rows:
            here = reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c])) for c in group_cols], F.lit(True))
            cases = F.when(here, at_most([F.lit(r[c]) for c in order_cols])).otherwise(cases)
        return df.withColumn(flag, cases)
    limits = found.withColumnsRenamed({c: f"_of_{c}" for c in (*group_cols, *order_cols)})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group_cols], F.lit(True))
    marked = df.join(limits, same, "left").withColumn(flag, F.coalesce(at_most([F.col(f"_of_{c}") for c in order_cols]), F.lit(False)))
    return marked.drop(*[f"_of_{c}" for c in (*group_cols, *order_cols)])


def first_in_hash_order(df: DataFrame, id_col: str, hash_of: Column, group_cols: list[str], wanted: Column, flag: str) -> DataFrame:
    """`df` with a flag on the first `wanted` (an expression of `group_n`) rows of each group by hash, then id."""
    keyed = df.withColumn("_hkey", hash_of)
    found = thresholds(keyed, group_cols, ["_hkey", id_col], F.substring("_hkey", 1, HASH_BUCKET_HEX), wanted)
    return _upto_threshold(keyed, found, group_cols, ["_hkey", id_col], flag).drop("_hkey")


def sample_exact_n(df: DataFrame, id_col: str, n: int, seed=42, group_cols: list[str] | None = None) -> DataFrame:
    """Exactly min(n, group size) rows per group, chosen by hash order."""
    return first_in_hash_order(df, id_col, hash_key(id_col, seed), list(group_cols or []), F.lit(n), "_take").filter("_take").drop("_take")


def sample_fraction_seeds(df: DataFrame, id_col: str, frac: float = 0.2, seeds=(100, 101, 102, 103, 104)) -> DataFrame:
    """For each seed, round(frac * n) rows (half to even), by md5(id|seed); all seeds in the same scans."""
    x = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col("seed").cast("string")))
    return first_in_hash_order(x, id_col, key, ["seed"], F.bround(F.col("group_n") * F.lit(float(frac)), 0), "_take").filter("_take").drop("_take")


def split_flag(df: DataFrame, id_col: str, test_size: float = 0.2, seed=42,
               stratify_col: str | None = None) -> DataFrame:
    """Adds `is_test` (int): the ceil(test_size * n) first rows in hash order,
    per class when `stratify_col` is given."""
    groups = [stratify_col] if stratify_col else []
    wanted = F.ceil(F.col("group_n") * F.lit(float(test_size)))
    return first_in_hash_order(df, id_col, hash_key(id_col, seed), groups, wanted, "is_test").withColumn("is_test", F.col("is_test").cast("int"))


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed=42) -> DataFrame:
    """Adds `fold` = (hash rank within class - 1) mod k."""
    r = hash_ranked(df, id_col, seed, [label_col])
    return r.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "group_n")


def contiguous_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5) -> DataFrame:
    """Adds `fold`: ntile(k) - 1 over each class in id order (the first
    n mod k folds get one extra row)."""
    r = id_ranked(df, id_col, [label_col])
    n, rk = F.col("group_n"), F.col("rank")
    q, rem = F.floor(n / k), n % k
    big = rem * (q + 1)
    fold = F.when(rk <= big, F.floor((rk - 1) / (q + 1))).otherwise(rem + F.floor((rk - 1 - big) / q))
    return r.withColumn("fold", fold.cast("int")).drop("rank", "group_n")

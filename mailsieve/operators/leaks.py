"""Which features tell the label, and whether they only tell the source.

A feature that separates the classes because each source has a class of its own
is a leak: a model learns the source.  For every feature this reports the mutual
information with the label, and the same given the source, in bits.  Far more of
the first than of the second points to the source; much of the second within
every source points to the label itself.

Features are cut at deciles of all rows; nulls are a bucket of their own.  One
aggregation over (feature, source, bucket, label) gives all figures; its size
does not depend on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def decile_limits(df: DataFrame, features: list[str], parts: int = 10) -> dict[str, list[float]]:
    """The distinct values at the inner deciles of each feature (discrete, to one part in ACCURACY of the rows)."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, ACCURACY).alias(f) for f in features]).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def _bucket(feature: str, limits: list[float]) -> Column:
    """How many limits the value exceeds; null: -1."""
    value = F.col(feature).cast("double")
    over = sum(((value > F.lit(x)).cast("int") for x in limits), F.lit(0))
    return F.coalesce(over, F.lit(-1))


def leak_report(df: DataFrame, features: list[str], label_col: str = "label", source_col: str = "source") -> DataFrame:
    """(feature, bits, bits_given_source, rank): mutual information of each feature's bucket with the label; rank by `bits`, then name."""
    limits = decile_limits(df, features)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), _bucket(f, limits[f]).alias("bucket")) for f in features]))
    counts = (df.select(F.col(source_col).alias("s"), F.col(label_col).alias("y"), cells.alias("c"))
              .groupBy("c.feature", "s", "c.bucket", "y").agg(F.count("*").alias("n")))

    def over(*keys: str) -> Column:
        return F.sum("n").over(Window.partitionBy("feature", *keys))

    def information(rows: DataFrame, given: list[str], name: str) -> DataFrame:
        joint = rows.groupBy("feature", *given, "bucket", "y").agg(F.sum("n").alias("n"))
        ratio = F.col("n") * over(*given) / (over(*given, "bucket") * over(*given, "y"))
        terms = joint.select("feature", (F.col("n") / over() * F.log2(ratio)).alias("t"))
        return terms.groupBy("feature").agg(F.round(F.greatest(F.sum("t"), F.lit(0.0)), 6).alias(name))

    out = information(counts, [], "bits").join(information(counts, ["s"], "bits_given_source"), "feature")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bits"), "feature")))

"""Relational operators of the ingestion chain: defaults, alignment, dedup,
label counts, unions, prefix decontamination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..schemas import EMAIL_COLUMNS


def filter_by_label(df: DataFrame, label: int = 0, label_col: str = "label") -> DataFrame:
    return df.filter(F.col(label_col) == label)


def binarize_label(df: DataFrame, src: str = "label_id", dst: str = "label") -> DataFrame:
    """0 -> 0, anything else (null included) -> 1."""
    return df.withColumn(dst, F.when(F.col(src) == 0, F.lit(0)).otherwise(F.lit(1)))


def default_columns(df: DataFrame) -> DataFrame:
    """subject/sender trimmed ('Unknown' if absent or blank), reply_to and
    received_count constants, body 'Empty_Body' when blank."""
    return df.withColumns({
        "subject": T.default_text(F.col("subject")),
        "sender": T.default_text(F.col("sender")),
        "reply_to": F.lit(K.REPLY_TO_DEFAULT),
        "received_count": F.lit(0),
        "body": T.body_or_empty(F.col("body")),
    })


def align_to_email(df: DataFrame, body_col: str, label_col: str, source_dataset: str | None = None) -> DataFrame:
    """Project a (body, label) table onto the e-mail schema with constants."""
    cols = {
        "subject": F.lit(K.UNKNOWN), "sender": F.lit(K.UNKNOWN), "reply_to": F.lit(K.REPLY_TO_DEFAULT),
        "received_count": F.lit(0), "body": F.col(body_col),
        "urls": F.array().cast("array<string>"), "url_count": F.lit(0),
        "label": F.col(label_col).cast("int"),
    }
    if source_dataset is not None:
        cols["source_dataset"] = F.lit(source_dataset)
    return df.select(*[c.alias(n) for n, c in cols.items()], *[c for c in df.columns if c in ("mail_id",)])


def dedup_keep_first(df: DataFrame, key_col: str = "body", order_cols=("source_rank", "mail_id")) -> DataFrame:
    """Keep the first row of each key in (source_rank, mail_id) order.

    `row_number() == 1` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle: each map task forwards at most one row per key, so a
    key holding a third of the rows (e.g. 'Empty_Body') costs one row per
    task in the exchange.  The key that travels and is sorted is the text's
    SHA-256, not the text."""
    w = Window.partitionBy(F.sha2(F.col(key_col).cast("string"), 256)).orderBy(*[F.col(c) for c in order_cols])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def label_counts(df: DataFrame, label_col: str = "label", group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(label_col) == 0, 1).otherwise(0)).cast("bigint").alias("n_label0"),
        F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).cast("bigint").alias("n_label1"),
    )


def dedup_report(df: DataFrame, key_col: str = "body") -> DataFrame:
    """Rows before, distinct keys after, removed: one partial-aggregated
    count per key (its SHA-256), then a global sum/count over the per-key rows."""
    per_key = df.groupBy(F.sha2(F.col(key_col).cast("string"), 256).alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    return per_key.agg(F.sum("_c").cast("bigint").alias("n_before"), F.count(F.lit(1)).alias("n_after")) \
        .withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """Union of frames with differing columns; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefix_key(c) -> "F.Column":
    """First 100 characters of the stripped text (null -> '')."""
    return F.substring(T.py_strip(F.coalesce(c, F.lit(""))), 1, K.DECONTAMINATION_PREFIX)


def prefix_decontaminate(train: DataFrame, known: DataFrame, train_body: str = "body",
                         known_body: str = "body") -> DataFrame:
    """Drop training rows whose stripped 100-char prefix occurs in `known`.

    The known side is reduced to its distinct prefixes first; Catalyst picks
    a broadcast anti join when that set is small and a shuffle anti join
    otherwise."""
    keys = known.select(prefix_key(F.col(known_body)).alias("_pk")).distinct()
    return (train.withColumn("_pk", prefix_key(F.col(train_body)))
            .join(keys, "_pk", "left_anti").drop("_pk"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select(
        label_col, "n_c",
        F.round(F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")), 6).alias("weight"),
    )


def email_projection(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in EMAIL_COLUMNS if c in df.columns])

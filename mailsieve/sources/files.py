"""Delimited-file sources and sinks, optional sources, stored LLM replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import constants as K
from .quoted import read_quoted

# Options that make a CSV/TSV round trip lossless (quoted multi-line fields,
# doubled quotes, whitespace kept).  Reading goes through `quoted`, which splits files.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}

REPLY_SCHEMA = "array<struct<type:string,tone:string,subject:string,body:string>>"


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="\t", **CSV_OPTIONS).csv(path)


def scan_tsv_positional(spark: SparkSession, path: str, names=("label_id", "body"),
                        types=("int", "string")) -> DataFrame:
    """Two-column TSV with a header whose names are ignored: columns are
    taken by position and renamed."""
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    return read_quoted(spark, path, schema, sep="\t")


def write_email_csv(df: DataFrame, path: str) -> None:
    """CSV sink for e-mail rows; the URL array travels as JSON text."""
    out = df.withColumn("urls", F.to_json("urls")) if "urls" in df.columns else df
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def scan_email_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV source with a declared schema (no inference); `urls` parsed back."""
    df = read_quoted(spark, path, schema)
    if "urls" in df.columns:
        df = df.withColumn("urls", F.coalesce(F.from_json("urls", "array<string>"), F.array().cast("array<string>")))
    return df


def read_optional(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """The source at `path`, or an empty frame of `schema` when it is absent."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def ingest_llm_replies(replies: DataFrame, content_col: str = "content", keys=("reply_id",)) -> DataFrame:
    """Stored model replies -> one row per generated mail object.

    The text from the first '[' to the last ']' is parsed as a JSON array of
    {type, tone, subject, body}; a reply without brackets, with malformed
    JSON or with a non-object element yields no row.  Missing or null fields
    take their defaults."""
    arr = F.from_json(F.regexp_extract(F.col(content_col), r"(?s)\[.*\]", 0), REPLY_SCHEMA)
    x = replies.select(*keys, F.posexplode(arr).alias("obj_pos", "o"))
    return x.select(
        *keys, (F.col("obj_pos") + 1).alias("obj_pos"),
        F.coalesce("o.subject", F.lit(K.UNKNOWN)).alias("subject"),
        F.lit("AI Generated").alias("sender"), F.lit(K.REPLY_TO_DEFAULT).alias("reply_to"),
        F.lit(0).alias("received_count"), F.coalesce("o.body", F.lit("")).alias("body"),
        F.array().cast("array<string>").alias("urls"), F.lit(0).alias("url_count"), F.lit(1).alias("label"),
        F.coalesce("o.type", F.lit("unknown")).alias("phish_type"),
        F.coalesce("o.tone", F.lit("unknown")).alias("tone"), F.lit("ai_generated").alias("source"),
    )


def parse_quoted_list(c: Column) -> Column:
    """Items of list text such as ['a', "it's"]: each item is read between its
    own quotes (single or double), so the other kind may stand inside it; a
    backslash takes the next character as it is.  Null stays null."""
    items = F.regexp_extract_all(c, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    inner = F.transform(items, lambda i: F.regexp_replace(i.substr(F.lit(2), F.length(i) - 2), r"\\(.)", "$1"))
    return F.when(c.isNotNull(), inner)

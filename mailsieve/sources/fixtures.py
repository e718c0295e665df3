"""Test tables derived from the driver tables (documents, labels, ...).

MAIL: one mail per document.  The body is the document text, a space, a
lexicon word chosen by `doc_id % 36` (36th choice: none), a space and a URL
chosen by `doc_id % 20` (URLFIX, then none twice).  The subject is missing for
every 11th document.  The label is `labels.toxic` (0 where unlabelled).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import read_table

# URLFIX: URL risk goldens (position, url, expected score).
URLFIX = [
    (1, "https://paypal-login.parcel-desk.example/open?n=7", 4),
    (2, "http://10.20.30.40/panel", 4),
    (3, "https://tinyurl.com/k7", 3),
    (4, "https://shop.amazon.com/account", 0),
    (5, "https://parcel-account-desk.top/a", 3),
    (6, "https://docs.google.com/d", 0),
    (7, "https://netflix.com/", 3),
    (8, "https://www.microsoft.cn/", 3),
    (9, "https://qq.jd.com/", 2),
    (10, "https://sf-express.com/", 3),
    (11, "http://user@evil-login-secure-update.tk:9999/a", 10),
    (12, "https://apple-support.com/", 3),
    (13, "https://a.b.c.d.example.com/", 1),
    (14, "https://h.com:8443/", 0),
    (15, "nodots", 0),
    (16, "https://HOST.EXAMPLE.COM/x", 0),
    (17, "https://x.com/a@b", 7),
    (18, "http://1.2.3/x", 1),
]
MAIL_KEYWORDS = K.LEXICON_FULL35 + [""]
MAIL_URLS = [u for _, u, _ in URLFIX] + ["", ""]


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def mail_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mail_id, subject, sender, raw_body, label, source_dataset, lang, text."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    d = docs.join(labels, "doc_id", "left")
    mid = F.col("doc_id")
    return d.select(
        mid.alias("mail_id"),
        F.when(mid % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("msg "), F.col("source"))).alias("subject"),
        F.concat(F.col("source"), F.lit("@"), F.col("lang"), F.lit(".example")).alias("sender"),
        F.concat(F.col("text"), F.lit(" "), _pick(MAIL_KEYWORDS, mid % 36), F.lit(" "),
                 _pick(MAIL_URLS, mid % 20)).alias("raw_body"),
        F.coalesce(F.col("toxic"), F.lit(0)).cast("int").alias("label"),
        F.col("source").alias("source_dataset"),
        F.col("lang"),
        F.col("text"),
        F.col("quality"),
    )


def render_message(subject: Column, sender: Column, body: Column) -> Column:
    """RFC 822 bytes of a single-part UTF-8 text message."""
    head = F.concat(
        F.when(subject.isNull(), F.lit("")).otherwise(F.concat(F.lit("Subject: "), subject, F.lit("\r\n"))),
        F.concat(F.lit("From: "), sender, F.lit("\r\n")),
        F.lit("MIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\n"
              "Content-Transfer-Encoding: 8bit\r\n\r\n"),
    )
    return F.encode(F.concat(head, body), "UTF-8")


def fraud_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-class labelled message table (the fraud-TSV shape) derived
    from `conversations`: row_id, label_id (0-10, null for every text whose
    length is a multiple of 13), body."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.when(F.length("text") % 13 == 0, F.lit(None).cast("int"))
         .otherwise(((F.col("conv_id") + F.col("turn")) % 11).cast("int")).alias("label_id"),
        F.col("text").alias("body"),
    )


def llm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated-phishing rows (the LLM-output shape) derived from `benchmark`."""
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("mail_id"),
        F.lit(K.UNKNOWN).alias("subject"), F.lit("AI Generated").alias("sender"),
        F.lit(K.REPLY_TO_DEFAULT).alias("reply_to"), F.lit(0).alias("received_count"),
        F.col("text").alias("body"), F.array().cast("array<string>").alias("urls"),
        F.lit(0).alias("url_count"), F.lit(1).alias("label"),
        F.lit("benchmark").alias("phish_type"), F.lit("mild").alias("tone"), F.lit("ai_generated").alias("source"),
    )


MIME_BOUNDARY = "=_mailsieve_part_boundary_7f3a"


def render_multipart(subject: Column, sender: Column, body: Column) -> Column:
    """multipart/mixed bytes: text/plain body, text/html part holding the
    subject, and a text attachment."""
    crlf = "\r\n"
    b = MIME_BOUNDARY
    return F.encode(F.concat(
        F.when(subject.isNull(), F.lit("")).otherwise(F.concat(F.lit("Subject: "), subject, F.lit(crlf))),
        F.lit("From: "), sender, F.lit(crlf),
        F.lit(f'MIME-Version: 1.0{crlf}Content-Type: multipart/mixed; boundary="{b}"{crlf}{crlf}'
              f"--{b}{crlf}Content-Type: text/plain; charset=utf-8{crlf}Content-Transfer-Encoding: 8bit{crlf}{crlf}"),
        body,
        F.lit(f"{crlf}--{b}{crlf}Content-Type: text/html; charset=utf-8{crlf}{crlf}<p>"),
        F.coalesce(subject, F.lit("")),
        F.lit(f"</p>{crlf}--{b}{crlf}Content-Type: text/plain; charset=utf-8{crlf}"
              f'Content-Disposition: attachment; filename="note.txt"{crlf}{crlf}attached note{crlf}--{b}--{crlf}'),
    ), "UTF-8")


def mail_files_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content) of the message files: data/<mail_id>.eml; every 29th
    mail is a zero-byte file."""
    m = mail_table(spark, sf_dir)
    content = F.when(F.col("mail_id") % 29 == 0, F.lit(b"").cast("binary")).otherwise(
        render_message(F.col("subject"), F.col("sender"), F.col("raw_body")))
    return m.select(F.concat(F.lit("data/"), F.col("mail_id").cast("string"), F.lit(".eml")).alias("name"),
                    content.alias("content"), "mail_id")


def label_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines in file order: conflicting early lines (every 7th mail),
    noise (blank, spaces only, one token), the real lines (upper-case labels
    for 'de' mails, tab-separated for every 17th) and lines for files that
    do not exist (one per benchmark item)."""
    m = mail_table(spark, sf_dir)
    mid = F.col("mail_id").cast("string")
    early = m.filter(F.col("mail_id") % 7 == 0).select(F.concat(F.lit("spam ./data/"), mid, F.lit(".eml")).alias("value"))
    noise = m.filter(F.col("mail_id") % 13 == 0).select(F.explode(F.array(
        F.lit(""), F.lit("   "), F.lit("spam"))).alias("value"))
    lab = F.when(F.col("label") == 0, F.lit("ham")).otherwise(F.lit("spam"))
    lab = F.when(F.col("lang") == "de", F.upper(lab)).otherwise(lab)
    sep = F.when(F.col("mail_id") % 17 == 0, F.lit("\t")).otherwise(F.lit(" "))
    main = m.select(F.concat(lab, sep, F.lit("../data/"), mid, F.lit(".eml  ")).alias("value"))
    b = read_table(spark, sf_dir, "benchmark")
    missing = b.select(F.concat(F.lit("spam ../data/missing-"), F.col("item_id").cast("string"),
                                F.lit(".eml")).alias("value"))
    return early.unionByName(noise).unionByName(main).unionByName(missing)


def llm_reply_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored replies (reply_id, conv_id, turn, content), one per
    conversation turn; `turn % 6` picks the shape: 0 clean array of one,
    1 array cut inside an object, 2 no bracket, 3 array of two, 4 explicit
    null subject, 5 an object followed by a number."""
    c = read_table(spark, sf_dir, "conversations")
    obj = F.struct(F.col("role").alias("type"), F.lit("urgent").alias("tone"),
                   F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("subject"),
                   F.col("text").alias("body"))
    obj_null = F.struct(F.col("role").alias("type"), F.lit("mild").alias("tone"),
                        F.lit(None).cast("string").alias("subject"), F.col("text").alias("body"))
    obj2 = F.struct(F.lit("delivery").alias("type"), F.lit("mild").alias("tone"),
                    F.lit("second").alias("subject"),
                    F.concat(F.lit("copy: "), F.col("text")).alias("body"))
    one = F.to_json(F.array(obj))
    kind = F.col("turn") % 6
    arr = (F.when(kind == 0, one)
           .when(kind == 1, F.concat(F.substring(one, 1, (F.length(one) / 2).cast("int")), F.lit("]")))
           .when(kind == 2, F.lit("I cannot produce that list."))
           .when(kind == 3, F.to_json(F.array(obj, obj2)))
           .when(kind == 4, F.to_json(F.array(obj_null), {"ignoreNullFields": "false"}))
           .otherwise(F.regexp_replace(one, r"\]$", ", 5]")))
    content = F.concat(F.lit("Sure, here they are:\n"), arr, F.lit("\nLet me know if you need more."))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), "conv_id", "turn",
                    content.alias("content"))

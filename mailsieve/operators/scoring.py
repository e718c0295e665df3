"""Score fusion, URL boost, verdicts and the batch mailbox scorer.

All of it is narrow: one projection per mail, no shuffle.  Scores are
rounded to 6 places before any threshold so that the floating-point order of
an engine cannot move a mail across 0.5 or 0.75.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import features as FT
from ..functions import text as T
from ..functions import urls as U

MODES = K.MODES


def fuse(p_rf: Column, p_second: Column, w_rf: float = K.DEFAULT_RF_WEIGHT,
         w_second: float = K.DEFAULT_SECOND_WEIGHT) -> Column:
    return F.round(F.lit(float(w_rf)) * p_rf + F.lit(float(w_second)) * p_second, 6)


def boosted(p: Column, boost: Column) -> Column:
    """Probability plus URL boost, capped at 1 (the boost is applied once)."""
    return F.round(F.least(p + boost, F.lit(1.0)), 6)


def is_phishing(p: Column) -> Column:
    return (p > 0.5).cast("int")


def verdict_text(p: Column) -> Column:
    return F.when(p > 0.5, F.lit(K.VERDICT_PHISHING)).otherwise(F.lit(K.VERDICT_SAFE))


def band(p: Column) -> tuple[Column, Column]:
    """Three-way band (<0.5, <0.75, else): (result text, level text)."""
    res = (F.when(p < 0.5, F.lit(K.BAND_SAFE[0])).when(p < 0.75, F.lit(K.BAND_MEDIUM[0]))
           .otherwise(F.lit(K.BAND_HIGH[0])))
    lvl = (F.when(p < 0.5, F.lit(K.BAND_SAFE[1])).when(p < 0.75, F.lit(K.BAND_MEDIUM[1]))
           .otherwise(F.lit(K.BAND_HIGH[1])))
    return res, lvl


def resolve_mode(mode: str) -> str:
    """Accepts RF / BERT / ENSEMBLE or an engine display name; anything else
    raises before a job is planned."""
    mode = K.MODE_NAMES.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return mode


def mode_probability(mode: str, p_rf: Column, p_second: Column, w_rf: float = K.DEFAULT_RF_WEIGHT,
                     w_second: float = K.DEFAULT_SECOND_WEIGHT) -> Column:
    mode = resolve_mode(mode)
    if mode == "RF":
        return F.round(p_rf, 6)
    if mode == "BERT":
        return F.round(p_second, 6)
    return fuse(p_rf, p_second, w_rf, w_second)


def score_mailbox(mails: DataFrame, mode: str = "ENSEMBLE", lexicon=K.LEXICON_FULL35,
                  w_rf: float = K.DEFAULT_RF_WEIGHT, w_second: float = K.DEFAULT_SECOND_WEIGHT,
                  body_col: str = "raw_body", keep=()) -> DataFrame:
    """One row per mail: URL risks, keyword density, fused and boosted score,
    two-way verdict, three-way band and the URL report.

    Columns named in `keep` stay.  `mails` needs mail_id, subject, label, the body column and model scores
    p_rf / p_second.  Narrow plan: URLs are scored inside the row by two
    `transform` passes, so there is no explode, no shuffle and no skew."""
    mode = resolve_mode(mode)
    staged = mails.select(
        *keep, "mail_id", "label", "p_rf", "p_second",
        T.mail_text(F.col("subject"), T.html_to_text(F.col(body_col))).alias("_text"),
        U.url_risks(U.extract_urls(F.col(body_col))).alias("_risks"),
    )
    prob_base = mode_probability(mode, F.col("p_rf"), F.col("p_second"), w_rf, w_second)
    staged = staged.withColumn("keyword_hits", FT.keyword_hits(F.col("_text"), lexicon))
    scored = staged.select(
        *keep, "mail_id", "label", "p_rf", "p_second",
        F.size("_risks").alias("url_count"),
        U.max_risk(F.col("_risks")).alias("url_max_risk"),
        "keyword_hits",
        (F.col("keyword_hits") / F.greatest(F.length(F.coalesce(F.col("_text"), F.lit(""))), F.lit(1)))
        .alias("subjectivity"),
        prob_base.alias("p_mode"),
        U.url_report(F.col("_risks")).alias("url_report"),
    )
    scored = scored.withColumn("url_boost", U.url_boost(F.col("url_max_risk")))
    scored = scored.withColumn("prob", boosted(F.col("p_mode"), F.col("url_boost")))
    res, lvl = band(F.col("prob"))
    return scored.select(
        *keep, "mail_id", "label", "url_count", "url_max_risk", "keyword_hits", "subjectivity",
        "p_rf", "p_second", "p_mode", "url_boost", "prob",
        is_phishing(F.col("prob")).alias("is_phishing"),
        verdict_text(F.col("prob")).alias("verdict"),
        res.alias("band"), lvl.alias("level"),
        T.format_percent(F.col("prob")).alias("prob_text"),
        "url_report",
    )


def score_parsed(parsed: DataFrame, scorers, mode: str = "ENSEMBLE") -> DataFrame:
    """Score parsed messages (path, error, mail_id, label, subject, raw_body)
    with fitted scorers.  A message with an error keeps its row, path and
    error; its other results are null."""
    keep = ("path", "error")
    out = score_mailbox(scorers.score(parsed), mode, keep=keep)
    known = (*keep, "mail_id", "label")
    return out.select(*known, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in out.columns if c not in known])

"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or tables Spark derives from them) in
full; none runs on fixed inline input alone.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bayes as BY
from ..operators import ranking as RK
from ..operators import scoring as SC
from ..sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def split_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAIL with is_test: a fifth of each class, in hash order."""
    return RK.split_flag(FX.mail_table(spark, sf_dir), "mail_id", 0.2, 42, "label")


_FITTED: dict[tuple[str, str], BY.MailScorers] = {}


def mail_scorers(spark: SparkSession, sf_dir: str) -> BY.MailScorers:
    """Both scorers, fitted on the training part of MAIL once an application; they are a few hundred numbers."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FITTED:
        _FITTED[key] = BY.MailScorers.fit(split_mail(spark, sf_dir).filter("is_test = 0"))
    return _FITTED[key]


def scored_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_scorers(spark, sf_dir).score(FX.mail_table(spark, sf_dir))


@query("score_mailbox")
def q_score_mailbox(spark, sf_dir):
    """Flagship: MAIL -> URLs -> rule risks -> max risk, keyword density,
    fused scores of the two trained scorers -> boost -> verdict and band, one row per mail."""
    return SC.score_mailbox(scored_mail(spark, sf_dir))


# ---------------------------------------------------------------- shared inputs
from .. import constants as K  # noqa: E402
from ..functions import features as FT  # noqa: E402
from ..functions import text as T  # noqa: E402
from ..functions import urls as U  # noqa: E402
from ..operators import lexicon as LX  # noqa: E402
from ..operators import metrics as M  # noqa: E402
from ..operators import relational as R  # noqa: E402
from ..operators import segmentation as SG  # noqa: E402
from ..session import materialize, read_table  # noqa: E402


def mail_urls(spark, sf_dir):
    """(mail_id, pos 1-based, url) for every URL found in a MAIL body."""
    m = FX.mail_table(spark, sf_dir)
    return (m.select("mail_id", F.posexplode(U.extract_urls(F.col("raw_body"))).alias("pos0", "url"))
            .select("mail_id", (F.col("pos0") + 1).alias("pos"), "url"))


def url_inputs(spark, sf_dir):
    """(src, id, pos, url): MAIL URLs and page URLs."""
    pages = read_table(spark, sf_dir, "pages").select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"), F.lit(1).alias("pos"), "url")
    mails = mail_urls(spark, sf_dir).select(F.lit("mail").alias("src"), F.col("mail_id").alias("id"), "pos", "url")
    return mails.unionByName(pages)


def pred_table(spark, sf_dir, labelled_only=False):
    """(mail_id, y, p_rf, p_second, url_max_risk); with `labelled_only` the
    held-out mails that have a label."""
    m = mail_scorers(spark, sf_dir).score(split_mail(spark, sf_dir))
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("mail_id"), F.col("toxic").cast("int").alias("y"))
    p = m.join(labels, "mail_id", "left")
    p = p.filter((F.col("is_test") == 1) & F.col("y").isNotNull()) if labelled_only else p
    risk = U.max_risk(U.url_risks(U.extract_urls(F.col("raw_body"))))
    return p.select("mail_id", "y", "p_rf", "p_second", risk.cast("int").alias("url_max_risk"))


def pred_long(spark, sf_dir, p=None):
    """(mail_id, model, y, pred) for the three scorers on labelled mails, or on those of a prediction table."""
    p = pred_table(spark, sf_dir, labelled_only=True) if p is None else p
    fused = SC.fuse(F.col("p_rf"), F.col("p_second"))
    models = F.array(
        F.struct(F.lit("rf").alias("model"), SC.is_phishing(F.round(F.col("p_rf"), 6)).alias("pred")),
        F.struct(F.lit("second").alias("model"), SC.is_phishing(F.round(F.col("p_second"), 6)).alias("pred")),
        F.struct(F.lit("fused").alias("model"), SC.is_phishing(fused).alias("pred")),
    )
    return p.select("mail_id", "y", F.explode(models).alias("m")).select("mail_id", "m.model", "y", "m.pred")


def pred_prob(spark, sf_dir):
    p = pred_table(spark, sf_dir)
    p = p.withColumn("p_fused", SC.fuse(F.col("p_rf"), F.col("p_second")))
    p = p.withColumn("url_boost", U.url_boost(F.col("url_max_risk")))
    return p.withColumn("prob", SC.boosted(F.col("p_fused"), F.col("url_boost")))


# ---------------------------------------------------------------- URL keys
@query("extract_urls")
def q_extract_urls(spark, sf_dir):
    return mail_urls(spark, sf_dir)


@query("url_netloc")
def q_url_netloc(spark, sf_dir):
    nl = U.netloc(F.col("url"))
    return url_inputs(spark, sf_dir).select("src", "id", "pos", "url", nl.alias("netloc"),
                                            U.netloc_labels(nl).alias("netloc_labels"))


@query("url_parts")
def q_url_parts(spark, sf_dir):
    return url_inputs(spark, sf_dir).select("src", "id", "pos", U.url_parts(F.col("url")).alias("p")) \
        .select("src", "id", "pos", "p.url", "p.scheme", "p.domain", "p.port")


@query("url_risk_score")
def q_url_risk_score(spark, sf_dir):
    return url_inputs(spark, sf_dir).select("src", "id", "pos", U.url_risk(F.col("url")).alias("r")) \
        .select("src", "id", "pos", "r.url", "r.risk_score", "r.risk_level")


@query("url_risk_rules")
def q_url_risk_rules(spark, sf_dir):
    """One row per rule hit; per URL the points sum to its risk score."""
    return url_inputs(spark, sf_dir).select("src", "id", "pos", F.explode(U.rule_hits(F.col("url"))).alias("h")) \
        .select("src", "id", "pos", "h.rule_no", "h.rule", "h.points", "h.reason")


@query("url_risk_reasons")
def q_url_risk_reasons(spark, sf_dir):
    r = U.url_risk(F.col("url"))
    return url_inputs(spark, sf_dir).select("src", "id", "pos", r.alias("r")).select(
        "src", "id", "pos", F.size("r.reasons").alias("n_reasons"),
        F.array_join("r.reasons", " | ").alias("reasons_text"))


@query("url_risk_level")
def q_url_risk_level(spark, sf_dir):
    r = url_inputs(spark, sf_dir).select("src", U.url_risk(F.col("url"))["risk_level"].alias("risk_level"))
    return r.groupBy("src", "risk_level").agg(F.count(F.lit(1)).alias("n_urls"))


@query("mail_url_risks")
def q_mail_url_risks(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir).select("mail_id", U.url_risks(U.extract_urls(F.col("raw_body"))).alias("r"))
    return m.select(
        "mail_id", F.size("r").alias("n_urls"),
        F.array_join(F.transform("r", lambda x: x["risk_score"].cast("string")), ",").alias("scores"),
        F.array_join(F.transform("r", lambda x: x["risk_level"]), ",").alias("levels"),
    )


@query("mail_max_risk")
def q_mail_max_risk(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir)
    return m.select("mail_id", U.max_risk(U.url_risks(U.extract_urls(F.col("raw_body")))).alias("url_max_risk"))


@query("url_report")
def q_url_report(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir)
    return m.select("mail_id", U.url_report(U.url_risks(U.extract_urls(F.col("raw_body")))).alias("url_report"))


@query("url_features")
def q_url_features(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir).select("mail_id", U.extract_urls(F.col("raw_body")).alias("urls"))
    return m.select("mail_id", *FT.url_features(F.col("urls")))


# ---------------------------------------------------------------- scoring keys
@query("fuse_scores")
def q_fuse_scores(spark, sf_dir):
    return pred_prob(spark, sf_dir).select("mail_id", "p_rf", "p_second", "p_fused")


@query("score_mode")
def q_score_mode(spark, sf_dir):
    p = pred_table(spark, sf_dir)  # scored once; a mail's modes are rows of one scan
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), SC.mode_probability(m, F.col("p_rf"), F.col("p_second")).alias("p_mode")) for m in SC.MODES])
    return p.select("mail_id", F.explode(modes).alias("m")).select("mail_id", "m.mode", "m.p_mode")


@query("url_boost")
def q_url_boost(spark, sf_dir):
    return pred_prob(spark, sf_dir).select("mail_id", "url_max_risk", "url_boost")


@query("boosted_score")
def q_boosted_score(spark, sf_dir):
    return pred_prob(spark, sf_dir).select("mail_id", "p_fused", "url_boost", "prob")


@query("verdict")
def q_verdict(spark, sf_dir):
    return pred_prob(spark, sf_dir).select("mail_id", "prob", SC.is_phishing(F.col("prob")).alias("is_phishing"),
                                           SC.verdict_text(F.col("prob")).alias("verdict"))


@query("risk_band")
def q_risk_band(spark, sf_dir):
    res, lvl = SC.band(F.col("prob"))
    return pred_prob(spark, sf_dir).select("mail_id", "prob", res.alias("band"), lvl.alias("level"))


@query("format_score")
def q_format_score(spark, sf_dir):
    return pred_prob(spark, sf_dir).select("mail_id", "prob", T.format_percent(F.col("prob")).alias("prob_text"))


# ---------------------------------------------------------------- text keys
def text_inputs(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                                      F.col("html").alias("s"))
    docs = read_table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                                         F.col("text").alias("s"))
    return pages.unionByName(docs)


@query("html_to_text")
def q_html_to_text(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("clean_text_deep")
def q_clean_text_deep(spark, sf_dir):
    return text_inputs(spark, sf_dir).select("src", "id", T.clean_text_deep(F.col("s")).alias("clean"))


@query("clean_text_light")
def q_clean_text_light(spark, sf_dir):
    return text_inputs(spark, sf_dir).select("src", "id", T.clean_text_light(F.col("s")).alias("clean"))


@query("mail_text")
def q_mail_text(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir)
    return m.select("mail_id", T.mail_text(F.col("subject"), T.html_to_text(F.col("raw_body"))).alias("mail_text"))


@query("keyword_density")
def q_keyword_density(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir)
    return m.select(
        "mail_id",
        FT.keyword_hits(F.col("raw_body"), K.LEXICON_FULL35).alias("hits_full35"),
        FT.keyword_density(F.col("raw_body"), K.LEXICON_FULL35).alias("density_full35"),
        FT.keyword_hits(F.col("raw_body"), K.LEXICON_SHORT9).alias("hits_short9"),
        FT.keyword_density(F.col("raw_body"), K.LEXICON_SHORT9).alias("density_short9"),
    )


def mail_subject_runs(spark, sf_dir):
    """MAIL bodies whose lexicon words stand together with those of a neighbour, so that words have to be found in longer runs."""
    m = FX.mail_table(spark, sf_dir)
    word = lambda i: FX._pick(FX.MAIL_KEYWORDS, i % len(FX.MAIL_KEYWORDS))
    together = F.concat(word(F.col("mail_id")), word(F.col("mail_id") * 7 + 3), word(F.col("mail_id") * 5 + 1))
    return m.select("mail_id", F.concat(F.col("raw_body"), F.lit(" "), together).alias("text"))


@query("learnt_words")
def q_learnt_words(spark, sf_dir):
    """Words of scripts without spaces, with their cohesion and freedom, learnt from all mails."""
    return SG.learn_words(mail_subject_runs(spark, sf_dir), "text")


@query("tokenize_learnt")
def q_tokenize_learnt(spark, sf_dir):
    """Tokens of all mails, runs without spaces cut into learnt words."""
    m = mail_subject_runs(spark, sf_dir)
    return SG.count_learnt(m, "mail_id", "text", materialize(SG.learn_words(m, "text"), "learnt-words"))


@query("lexicon_hits")
def q_lexicon_hits(spark, sf_dir):
    """How many of the words of all benchmark items each mail contains, as substrings, and how densely."""
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(T.tokenize(F.col("text"))).alias("term"))
    m = FX.mail_table(spark, sf_dir).select("mail_id", "raw_body")
    return LX.lexicon_density(m, "raw_body", words).select("mail_id", "hits", "density")


@query("tokenize_corpus")
def q_tokenize_corpus(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir)
    return (m.select("mail_id", F.explode(T.tokenize(F.col("raw_body"))).alias("token"))
            .groupBy("mail_id", "token").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- relational keys
def mail_email(spark, sf_dir, mails=None):
    """MAIL (or some of it) as e-mail rows: defaults applied, deep-cleaned body, URLs."""
    m = FX.mail_table(spark, sf_dir) if mails is None else mails
    m = m.withColumns({"body": T.clean_text_deep(F.col("raw_body")),
                       "urls": U.extract_urls(F.col("raw_body"))})
    m = R.default_columns(m).withColumn("url_count", F.size("urls"))
    return m


def fraud_email(spark, sf_dir):
    f = R.binarize_label(FX.fraud_table(spark, sf_dir))
    f = f.withColumn("body", T.clean_text_light(F.col("body")))
    return R.align_to_email(f.withColumnRenamed("row_id", "mail_id"), "body", "label", "fraud")


@query("filter_by_label")
def q_filter_by_label(spark, sf_dir):
    return R.filter_by_label(FX.mail_table(spark, sf_dir), 0).select("mail_id", "label", "source_dataset")


@query("binarize_label")
def q_binarize_label(spark, sf_dir):
    return R.binarize_label(FX.fraud_table(spark, sf_dir)).select("row_id", "label_id", "label")


@query("default_columns")
def q_default_columns(spark, sf_dir):
    return mail_email(spark, sf_dir).select("mail_id", "subject", "sender", "reply_to", "received_count",
                                            "body", "url_count", "label")


@query("align_schema")
def q_align_schema(spark, sf_dir):
    return fraud_email(spark, sf_dir).select("mail_id", "subject", "sender", "reply_to", "received_count",
                                             "body", "url_count", "label", "source_dataset")


@query("label_counts")
def q_label_counts(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir).select(F.lit("mail").alias("origin"), "label")
    f = fraud_email(spark, sf_dir).select(F.lit("fraud").alias("origin"), "label")
    return R.label_counts(m.unionByName(f), group_cols=["origin"])


@query("dedup_report")
def q_dedup_report(spark, sf_dir):
    return R.dedup_report(FX.mail_table(spark, sf_dir), "text")


@query("dedup_keep_first")
def q_dedup_keep_first(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir).withColumn("source_rank", F.lit(0))
    f = FX.fraud_table(spark, sf_dir).select(F.col("row_id").alias("mail_id"), F.col("body").alias("text"),
                                             F.lit(1).alias("source_rank"))
    both = m.select("mail_id", "text", "source_rank").unionByName(f)
    return R.dedup_keep_first(both, "text").select("mail_id", "source_rank")


@query("url_presence_by_label")
def q_url_presence_by_label(spark, sf_dir):
    m = mail_email(spark, sf_dir).select("source_dataset", "label", "url_count")
    f = fraud_email(spark, sf_dir).select("source_dataset", "label", "url_count")
    return m.unionByName(f).groupBy("source_dataset", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("url_count") > 0).cast("int")), 6).alias("share_with_urls"))


@query("leak_report")
def q_leak_report(spark, sf_dir):
    """Mutual information with the label, alone and given the source, of the mails' and the fraud table's features."""
    columns = ["source", "label", "urls", "body"]
    m = mail_email(spark, sf_dir).withColumn("source", F.col("source_dataset")).select(*columns)
    f = fraud_email(spark, sf_dir).withColumn("source", F.col("source_dataset")).select(*columns)
    rows = m.unionByName(f).select("source", "label", F.size("urls").alias("url_count"), F.length("body").alias("body_len"),
                                   FT.keyword_hits(F.col("body")).alias("keyword_hits"))
    return LK.leak_report(materialize(rows, "leak-features"), ["url_count", "body_len", "keyword_hits"])


@query("union_sources")
def q_union_sources(spark, sf_dir):
    m = mail_email(spark, sf_dir).select(F.lit("mail").alias("origin"), "mail_id", "label", "body")
    f = fraud_email(spark, sf_dir).select(F.lit("fraud").alias("origin"), "mail_id", "label", "body")
    return R.union_sources([m, f]).select("origin", "mail_id", "label", F.length("body").alias("body_len"))


@query("union_ragged")
def q_union_ragged(spark, sf_dir):
    m = mail_email(spark, sf_dir).select("mail_id", "subject", "sender", "body", "url_count", "label", "source_dataset")
    f = fraud_email(spark, sf_dir).select("mail_id", "subject", "sender", "body", "url_count", "label", "source_dataset")
    a = FX.llm_rows(spark, sf_dir).select("mail_id", "subject", "sender", "body", "url_count", "label",
                                          "phish_type", "tone", "source")
    u = R.union_ragged([m.withColumn("origin", F.lit("mail")), f.withColumn("origin", F.lit("fraud")),
                        a.withColumn("origin", F.lit("llm"))])
    return u.select("origin", "mail_id", "subject", "sender", "url_count", "label", "source_dataset",
                    "phish_type", "tone", "source", F.length("body").alias("body_len"))


@query("head_preview")
def q_head_preview(spark, sf_dir):
    first = FX.mail_table(spark, sf_dir).orderBy("mail_id").limit(5)  # cleaned after the limit: five bodies, not all
    return mail_email(spark, sf_dir, first).select("mail_id", "subject", "sender", "reply_to", "received_count",
                                                 F.substring("body", 1, 60).alias("body_head"), "url_count", "label")


@query("prefix_decontaminate")
def q_prefix_decontaminate(spark, sf_dir):
    m = FX.mail_table(spark, sf_dir)
    known = read_table(spark, sf_dir, "documents").filter(F.col("source") == "src0")
    return R.prefix_decontaminate(m, known, "text", "text").select("mail_id", "label")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return R.class_weights(FX.mail_table(spark, sf_dir))


# ---------------------------------------------------------------- ranking keys
@query("sample_exact_n")
def q_sample_exact_n(spark, sf_dir):
    return RK.sample_exact_n(FX.mail_table(spark, sf_dir), "mail_id", 200, 42, ["label"]).select("mail_id", "label")


@query("sample_fraction_seeds")
def q_sample_fraction_seeds(spark, sf_dir):
    return RK.sample_fraction_seeds(FX.mail_table(spark, sf_dir).select("mail_id"), "mail_id").select("seed", "mail_id")


@query("split_random")
def q_split_random(spark, sf_dir):
    return RK.split_flag(FX.mail_table(spark, sf_dir), "mail_id", 0.2, 42).select("mail_id", "is_test")


@query("split_stratified")
def q_split_stratified(spark, sf_dir):
    return RK.split_flag(FX.mail_table(spark, sf_dir), "mail_id", 0.2, 42, "label").select("mail_id", "label", "is_test")


@query("stratified_kfold")
def q_stratified_kfold(spark, sf_dir):
    return RK.stratified_folds(FX.mail_table(spark, sf_dir), "mail_id", "label").select("mail_id", "label", "fold")


@query("kfold_contiguous")
def q_kfold_contiguous(spark, sf_dir):
    return RK.contiguous_folds(FX.mail_table(spark, sf_dir), "mail_id", "label").select("mail_id", "label", "fold")


# ---------------------------------------------------------------- metric keys
@query("metrics_binary")
def q_metrics_binary(spark, sf_dir):
    return M.binary_metrics(pred_long(spark, sf_dir), "y", "pred", ["model"])


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_counts(pred_long(spark, sf_dir), "y", "pred", ["model"])


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return M.classification_report(pred_long(spark, sf_dir), "y", "pred", ["model"])


def fold_metrics(spark, sf_dir):
    p = materialize(pred_table(spark, sf_dir, True), "held-out-scores")
    folds = RK.stratified_folds(p, "mail_id", "y").select("mail_id", "fold")
    return M.binary_metrics(pred_long(spark, sf_dir, p).join(folds, "mail_id"), "y", "pred", ["model", "fold"])


@query("fold_summary")
def q_fold_summary(spark, sf_dir):
    return M.mean_std(fold_metrics(spark, sf_dir), ["accuracy", "f1"], ["model"])


@query("seed_stability")
def q_seed_stability(spark, sf_dir):
    """Five 20% hash samples of the held-out labelled rows, accuracy/F1 of the fused score per seed, then mean and deviation."""
    p = materialize(pred_table(spark, sf_dir, True), "held-out-scores")
    samples = RK.sample_fraction_seeds(p.select("mail_id"), "mail_id")
    preds = pred_long(spark, sf_dir, p).filter(F.col("model") == "fused")
    per_seed = M.binary_metrics(samples.join(preds, "mail_id"), "y", "pred", ["seed"])
    return M.mean_std(per_seed, ["accuracy", "f1"]).withColumn("n_seeds", F.lit(5))


@query("model_comparison")
def q_model_comparison(spark, sf_dir):
    s = M.mean_std(fold_metrics(spark, sf_dir).filter(F.col("model").isin("rf", "second")),
                   ["accuracy", "f1"], ["model"])
    stacked = s.select("model", F.explode(F.array(
        F.struct(F.lit("Accuracy").alias("metric"), F.col("accuracy_text").alias("text")),
        F.struct(F.lit("F1-Score").alias("metric"), F.col("f1_text").alias("text")))).alias("x")) \
        .select("model", "x.metric", "x.text")
    return stacked.groupBy("metric").pivot("model", ["rf", "second"]).agg(F.first("text"))


def mixed_testset(spark, sf_dir):
    """Known generated rows (documents of source src0, label 1) plus up to
    200 held-out normal mails from a decontaminated stratified split."""
    docs = read_table(spark, sf_dir, "documents")
    ai = docs.filter(F.col("source") == "src0")
    train = R.prefix_decontaminate(FX.mail_table(spark, sf_dir), ai, "text", "text")
    held = RK.split_flag(train, "mail_id", 0.2, 42, "label").filter((F.col("is_test") == 1) & (F.col("label") == 0))
    normal = RK.sample_exact_n(held, "mail_id", 200, 42).select("mail_id", "label", F.lit("normal").alias("origin"))
    ai_rows = ai.select(F.col("doc_id").alias("mail_id"), F.lit(1).alias("label"), F.lit("ai").alias("origin"))
    return R.union_sources([ai_rows, normal])


@query("mixed_testset")
def q_mixed_testset(spark, sf_dir):
    return mixed_testset(spark, sf_dir)


@query("ablation_report")
def q_ablation_report(spark, sf_dir):
    """The shape scorer with and without perplexity, fitted on the training
    mails that are not in the mixed test set, judged on that set."""
    shaped = split_mail(spark, sf_dir).withColumns(BY.text_shape(F.col("raw_body")))
    # cleaned once: the perplexity reads the texts for its counts and again for its means
    email = materialize(mail_email(spark, sf_dir, shaped).select("mail_id", "label", "is_test", "body", *BY.SHAPE), "ablation-mails")
    ppl = CM.bigram_perplexity(email, "mail_id", "body")
    rows = materialize(email.drop("body").join(ppl, "mail_id").select("mail_id", "label", "is_test", "perplexity", *BY.SHAPE), "ablation")
    mixed = materialize(mixed_testset(spark, sf_dir), "mixed")
    train = rows.filter("is_test = 0").join(mixed.select("mail_id"), "mail_id", "left_anti")
    test = mixed.select("mail_id", F.col("label").alias("y")).join(rows.drop("label"), "mail_id")
    with_ppl, without = (BY.GaussianScorer.fit(train, f) for f in ((*BY.SHAPE, "perplexity"), BY.SHAPE))
    variants = F.array(
        F.struct(F.lit("full").alias("variant"), SC.is_phishing(with_ppl.probability()).alias("pred")),
        F.struct(F.lit("no_ppl").alias("variant"), SC.is_phishing(without.probability()).alias("pred")))
    long = test.select("mail_id", "y", F.explode(variants).alias("v")).select("mail_id", "y", "v.*")
    c = M.confusion_counts(long, "y", "pred", ["variant"])
    m = M.binary_metrics(long, "y", "pred", ["variant"]).drop("n")
    return c.join(m, "variant")


# ---------------------------------------------------------------- corpus model keys
from ..operators import corpus_models as CM  # noqa: E402
from ..operators import feature_models as FM  # noqa: E402
from ..operators import heavy_terms as HT  # noqa: E402
from ..operators import leaks as LK  # noqa: E402


def clean_corpus(spark, sf_dir):
    return materialize(mail_email(spark, sf_dir).select(
        "mail_id", "subject", "sender", "body", "urls", "url_count", "label", "source_dataset", "quality"), "corpus")


def corpus_terms(spark, sf_dir):
    """Cleaned mail corpus and its (mail_id, term, tf) table, each written
    once to the shared folder and reused by every model job."""
    c = clean_corpus(spark, sf_dir)
    return c, materialize(CM.doc_terms(c, "mail_id", "body", ("label", "quality")), "doc-terms")


@query("term_stats")
def q_term_stats(spark, sf_dir):
    _, dt = corpus_terms(spark, sf_dir)
    return CM.term_stats(dt, "mail_id")


@query("vocab_top500")
def q_vocab_top500(spark, sf_dir):
    _, dt = corpus_terms(spark, sf_dir)
    return CM.vocabulary(CM.term_stats(dt, "mail_id"), K.VOCAB_SIZE).select("term", "cf", "df", "term_index")


@query("vocab_top500_summary")
def q_vocab_top500_summary(spark, sf_dir):
    """The same vocabulary from mergeable summaries and an exact count of the candidates."""
    return HT.top_terms(mail_email(spark, sf_dir).select("mail_id", "body"), "body", K.VOCAB_SIZE)


@query("topk_terms")
def q_topk_terms(spark, sf_dir):
    _, dt = corpus_terms(spark, sf_dir)
    return CM.vocabulary(CM.term_stats(dt, "mail_id"), 10).select("term", "cf", "df", "term_index")


@query("term_counts")
def q_term_counts(spark, sf_dir):
    _, dt = corpus_terms(spark, sf_dir)
    vocab = CM.vocabulary(CM.term_stats(dt, "mail_id")).select("term", "term_index")
    return dt.join(F.broadcast(vocab), "term").select("mail_id", "term", "term_index", "tf")


@query("tfidf_table")
def q_tfidf_table(spark, sf_dir):
    c, dt = corpus_terms(spark, sf_dir)
    vocab = CM.vocabulary(CM.term_stats(dt, "mail_id"))
    return CM.tfidf(dt, vocab, "mail_id", c.count())


@query("sentiment_nb")
def q_sentiment_nb(spark, sf_dir):
    return CM.sentiment(*corpus_terms(spark, sf_dir), "quality")


@query("perplexity_ngram")
def q_perplexity_ngram(spark, sf_dir):
    c = materialize(mail_email(spark, sf_dir).select("mail_id", "body"), "corpus")
    return CM.bigram_perplexity(c, "mail_id", "body")


def feature_table(spark, sf_dir):
    """Nine numeric features per mail in their fixed order (one function for
    training, scoring and ablation)."""
    c, dt = corpus_terms(spark, sf_dir)
    models = FM.FeatureModels.of(FM.FeatureCounts.fit(c, dt, "quality"))
    return models.features(c, dt).select("mail_id", "label", "body", "urls", *K.FEATURES)


@query("feature_table")
def q_feature_table(spark, sf_dir):
    return feature_table(spark, sf_dir).drop("body", "urls")


@query("parse_url_list_text")
def q_parse_url_list_text(spark, sf_dir):
    """URL lists stored as Python-style list text, parsed back item by item."""
    m = FX.mail_table(spark, sf_dir).select("mail_id", U.extract_urls(F.col("raw_body")).alias("urls"))
    quoted = F.transform("urls", lambda u: F.when(u.contains("'"), F.concat(F.lit('"'), u, F.lit('"')))
                         .otherwise(F.concat(F.lit("'"), u, F.lit("'"))))
    as_text = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return m.select("mail_id", SF.parse_quoted_list(as_text).alias("p")).select(
        "mail_id", F.size("p").alias("url_count"), F.array_join("p", " ").alias("urls_text"))


# ---------------------------------------------------------------- ingestion keys
from ..session import many_small_files, scratch_path  # noqa: E402
from ..sources import files as SF  # noqa: E402
from ..sources import mail as SM  # noqa: E402


def written_index(spark, sf_dir):
    path = scratch_path(spark, "index")
    FX.label_index_lines(spark, sf_dir).write.mode("overwrite").text(path)
    return SM.scan_label_index(spark, path)


def written_mailbox(spark, sf_dir):
    root = scratch_path(spark, "mailbox")
    SM.write_message_files(FX.mail_files_frame(spark, sf_dir), root, "name", "content")
    return root


@query("scan_label_index")
def q_scan_label_index(spark, sf_dir):
    return written_index(spark, sf_dir)


@query("scan_mail_files")
def q_scan_mail_files(spark, sf_dir):
    root = written_mailbox(spark, sf_dir)
    files = SM.found_files(spark, root)
    index = written_index(spark, sf_dir)
    return SM.restore_empty_files(index, files, root).select("rel_path", "length")


@query("join_index_files")
def q_join_index_files(spark, sf_dir):
    root = written_mailbox(spark, sf_dir)
    index = written_index(spark, sf_dir)
    files = SM.restore_empty_files(index, SM.found_files(spark, root), root)
    return index.join(files, "rel_path").select("rel_path", "label", "length")


@query("ingest_skip_report")
def q_ingest_skip_report(spark, sf_dir):
    root = written_mailbox(spark, sf_dir)
    index = written_index(spark, sf_dir)
    files = SM.found_files(spark, root)
    with many_small_files(spark):
        parsed = materialize(SM.parse_messages(SM.scan_mail_files(spark, root), carry=("rel_path",)).select("rel_path", "error"), "parse-results")
    return SM.skip_report(index, files, parsed, root)


def rendered_mail(spark, sf_dir, multipart=False):
    m = FX.mail_table(spark, sf_dir)
    render = FX.render_multipart if multipart else FX.render_message
    return m.select(F.col("mail_id").cast("string").alias("path"),
                    render(F.col("subject"), F.col("sender"), F.col("raw_body")).alias("content"), "label")


@query("parse_mail_corpus")
def q_parse_mail_corpus(spark, sf_dir):
    """Message bytes -> MIME job -> e-mail rows (the label rides along)."""
    rows = SM.mail_rows(SM.parse_messages(rendered_mail(spark, sf_dir), carry=("label",)), keep=("label",))
    return rows.withColumn("mail_id", F.col("path").cast("bigint")).select(
        "mail_id", "subject", "sender", "body", "url_count", F.array_join("urls", " ").alias("urls_text"), "label")


@query("mail_part_report")
def q_mail_part_report(spark, sf_dir):
    r = rendered_mail(spark, sf_dir, multipart=True)
    rep = SM.part_report(SM.parse_message_parts(r))
    return rep.select(F.col("path").cast("bigint").alias("mail_id"), "part_no", "content_type", "text_head",
                      "total_len", "truncated")


@query("mail_header_report")
def q_mail_header_report(spark, sf_dir):
    rep = SM.header_report(rendered_mail(spark, sf_dir, multipart=True))
    return rep.select(F.col("path").cast("bigint").alias("mail_id"), F.col("from").alias("sender"),
                      F.col("to").alias("recipient"), "subject", F.col("date").alias("sent"))


@query("decode_lenient")
def q_decode_lenient(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit(" tail"), "UTF-8"))
    return d.select("doc_id", T.decode_lenient(raw).alias("text"))


@query("scan_fraud_tsv")
def q_scan_fraud_tsv(spark, sf_dir):
    path = scratch_path(spark, "fraud-tsv")
    SF.write_tsv(FX.fraud_table(spark, sf_dir).select("label_id", "body"), path)
    return SF.scan_tsv_positional(spark, path)


EMAIL_CSV_SCHEMA = ("mail_id bigint, subject string, sender string, reply_to string, received_count int, "
                    "body string, urls string, url_count int, label int, source_dataset string")


@query("scan_csv_roundtrip")
def q_scan_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "email-csv")
    e = mail_email(spark, sf_dir).select("mail_id", "subject", "sender", "reply_to", "received_count", "body",
                                         "urls", "url_count", "label", "source_dataset")
    SF.write_email_csv(e, path)
    back = SF.scan_email_csv(spark, path, EMAIL_CSV_SCHEMA)
    return back.select("mail_id", "subject", "sender", "body", "url_count",
                       F.array_join("urls", " ").alias("urls_text"), "label")


@query("optional_source_union")
def q_optional_source_union(spark, sf_dir):
    present = scratch_path(spark, "optional-present")
    fraud_email(spark, sf_dir).select("mail_id", "label").write.mode("overwrite").parquet(present)
    schema = "mail_id bigint, label int"
    frames = [mail_email(spark, sf_dir).select("mail_id", "label").withColumn("origin", F.lit("mail")),
              SF.read_optional(spark, present, schema).withColumn("origin", F.lit("fraud")),
              SF.read_optional(spark, scratch_path(spark, "optional-absent"), schema).withColumn("origin", F.lit("llm"))]
    return R.union_sources(frames).select("origin", "mail_id", "label")


@query("ingest_llm_replies")
def q_ingest_llm_replies(spark, sf_dir):
    rows = SF.ingest_llm_replies(FX.llm_reply_table(spark, sf_dir))
    return rows.select("reply_id", "obj_pos", "subject", "sender", "body", "label", "phish_type", "tone", "source")


# ---------------------------------------------------------------- model keys
from ..operators import ml as ML  # noqa: E402


def split_features(spark, sf_dir):
    """Feature table with a persisted stratified 80/20 split column."""
    ft = materialize(feature_table(spark, sf_dir).drop("urls"), "features")
    return materialize(RK.split_flag(ft, "mail_id", 0.2, 42, "label"), "split-features")


def split_tokens(spark, sf_dir):
    """The split feature table with the known tokens instead of the texts, and the vocabulary of its training part.

    The terms that the features are counted from give the vocabulary too."""
    mails = mail_email(spark, sf_dir).select("mail_id", "body", "urls", "label", "quality")
    c = materialize(RK.split_flag(mails, "mail_id", 0.2, 42, "label"), "split-corpus")
    dt = materialize(CM.doc_terms(c, "mail_id", "body", ("label", "quality", "is_test")), "doc-terms")
    train = c.filter("is_test = 0")
    if "is_test" in dt.columns:
        top = CM.vocabulary(CM.term_stats(dt.filter("is_test = 0"), "mail_id"))
        vocabulary = ML.Vocabulary.of(top.withColumn("n_mails", F.lit(train.count())).collect())
    else:  # ids with several texts, whose counts are sums
        vocabulary = ML.Vocabulary.fit(train, "mail_id", "body", K.VOCAB_SIZE)
    tokens = ML.known_tokens(F.col("body"), [vocabulary]).alias("tokens")
    rows = FM.FeatureModels.of(FM.FeatureCounts.fit(c, dt, "quality")).features(c, dt, derived=[tokens])
    return materialize(rows.select("mail_id", "label", "is_test", "tokens", *K.FEATURES), "split-tokens"), vocabulary


@query("rf_scores")
def q_rf_scores(spark, sf_dir):
    data = split_features(spark, sf_dir)
    model = ML.fit_text_classifier(data.filter("is_test = 0"), kind="rf")
    out = ML.positive_probability(model, data.filter("is_test = 1"), "p_rf")
    return out.select("mail_id", "label", F.round("p_rf", 6).alias("p_rf"), "pred")


@query("second_scores")
def q_second_scores(spark, sf_dir):
    data, vocabulary = split_tokens(spark, sf_dir)
    model = ML.fit_text_classifier(data.filter("is_test = 0"), kind="logreg", vocabulary=vocabulary, tokenized=True)
    out = ML.positive_probability(model, data.filter("is_test = 1"), "p_second")
    return out.select("mail_id", "label", F.round("p_second", 6).alias("p_second"), "pred")


@query("topk_importance")
def q_topk_importance(spark, sf_dir):
    data = split_features(spark, sf_dir)
    model = ML.fit_text_classifier(data.filter("is_test = 0"), kind="rf")
    imp = spark.createDataFrame(ML.feature_importances(model), "feature string, importance double")
    return imp.orderBy(F.desc("importance"), F.asc("feature")).limit(10)


@query("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    from pyspark.ml import PipelineModel
    data = split_features(spark, sf_dir)
    model = ML.fit_text_classifier(data.filter("is_test = 0"), kind="rf")
    path = scratch_path(spark, "rf-model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    test = data.filter("is_test = 1")
    a = ML.positive_probability(model, test, "p_before").select("mail_id", "p_before")
    b = ML.positive_probability(loaded, test, "p_after").select("mail_id", "p_after")
    return a.join(b, "mail_id").withColumn("same", (F.col("p_before") == F.col("p_after")).cast("int"))


FOLDS = 5
FITS = 3  # folds fitted at once
FOLD_PLANS = {"stratified": RK.stratified_folds, "contiguous": RK.contiguous_folds}


def folded_corpus(spark, sf_dir, plan, written=True):
    """Cleaned corpus with its folds, and its (mail_id, term, tf) table with the folds and classes (written, if it is read more than once)."""
    c = materialize(FOLD_PLANS[plan](clean_corpus(spark, sf_dir), "mail_id", "label", FOLDS), "folded-corpus")
    dt = CM.doc_terms(c, "mail_id", "body", ("fold", "label", "quality"))
    return c, materialize(dt, "doc-terms") if written else dt


def cv_predictions(spark, sf_dir, plan, kind="rf", numeric=tuple(K.FEATURES)):
    """(fold, mail_id, y, pred): every mail scored by the classifier of the fold that leaves it out.

    Vocabulary, IDF, sentiment and perplexity of all folds come from one set of
    counts, total less fold; the features of all training parts from one pass."""
    c, dt = folded_corpus(spark, sf_dir, plan)
    counts = FM.FeatureCounts.fit(c, dt, "quality", "fold")
    terms = counts.vocabulary(range(FOLDS)).collect()  # the vocabulary size times the folds
    vocabularies = [ML.Vocabulary.of([r for r in terms if r["variant"] == k]) for k in range(FOLDS)]
    # texts are cut into tokens once, not for every fold's training and scoring
    tokens = ML.known_tokens(F.col("body"), vocabularies).alias("tokens")
    features = materialize(FM.FeatureModels.of(counts, range(FOLDS)).features(c, dt, derived=[tokens])
                           .select("mail_id", "label", "tokens", "fold", *K.FEATURES), "cv-features")

    def predict(k: int) -> DataFrame:
        train, test = FM.held_out(features, k)
        model = ML.fit_text_classifier(train, kind=kind, vocabulary=vocabularies[k], numeric_cols=numeric, tokenized=True)
        return ML.positive_probability(model, test, "p").select("fold", "mail_id", F.col("label").alias("y"), "pred")

    with ThreadPoolExecutor(FITS) as pool:  # a fit's partitions and its driver's steps leave cores idle, which another one's use
        rows = list(pool.map(inheritable_thread_target(spark)(predict), range(FOLDS)))
    return R.union_sources(rows)


@query("cv_report")
def q_cv_report(spark, sf_dir):
    """Stratified 5-fold CV of the forest, everything fitted without the held-out fold;
    per-fold accuracy / F1 plus mean and population deviation."""
    per_fold = M.binary_metrics(cv_predictions(spark, sf_dir, "stratified"), "y", "pred", ["fold"])
    return M.with_mean_std(per_fold, ["accuracy", "f1"])


@query("cv_quick")
def q_cv_quick(spark, sf_dir):
    """Quick CV: folds are contiguous runs of each class; accuracy per fold, mean and population deviation."""
    per_fold = M.binary_metrics(cv_predictions(spark, sf_dir, "contiguous"), "y", "pred", ["fold"])
    return M.with_mean_std(per_fold.drop("f1"), ["accuracy"])


@query("cv_feature_models")
def q_cv_feature_models(spark, sf_dir):
    """(mail_id, fold, variant, sentiment, perplexity): every mail under the count models of every training part."""
    c, dt = folded_corpus(spark, sf_dir, "stratified")
    models = FM.FeatureModels.of(FM.FeatureCounts.fit(c, dt, "quality", "fold"), range(FOLDS))
    rows = models.features(c, dt).select("mail_id", "fold", F.posexplode(F.arrays_zip("sentiment", "perplexity")).alias("variant", "x"))
    return rows.select("mail_id", "fold", "variant", "x.sentiment", "x.perplexity")


@query("cv_vocabulary")
def q_cv_vocabulary(spark, sf_dir):
    """The vocabulary and smoothed IDF of every training part."""
    c, dt = folded_corpus(spark, sf_dir, "stratified", written=False)
    voc = FM.FeatureCounts.fit(c, dt, "quality", "fold", pairs=False).vocabulary(range(FOLDS))
    idf = F.round(F.log((F.col("n_mails") + 1) / (F.col("df") + 1)) + 1, 6)
    return voc.select("variant", "term", "cf", "df", "term_index", idf.alias("idf"))


@query("cv_naive_bayes")
def q_cv_naive_bayes(spark, sf_dir):
    """Cross-validated naive Bayes on the mail label, under both fold plans: one
    aggregation and one scoring pass for all folds of a plan."""
    c = clean_corpus(spark, sf_dir)
    for plan, folds in FOLD_PLANS.items():
        c = folds(c, "mail_id", "label", FOLDS).withColumnRenamed("fold", plan)
    c = materialize(c, "folded-corpus")
    dt = materialize(CM.doc_terms(c, "mail_id", "body", (*FOLD_PLANS, "label")), "doc-terms")  # counted once for both plans
    out = []
    for plan in FOLD_PLANS:
        llr, priors = FM.FeatureCounts.fit(c, dt, "label", plan, pairs=False).naive_bayes(range(FOLDS))
        scored = FM.class_log_odds(c.select("mail_id", F.col(plan).alias("fold"), "label"), dt, llr, priors)
        own = F.round(F.element_at("_odds", F.col("fold") + 1), 6)  # the model that left the mail's fold out
        preds = scored.select("fold", F.col("label").alias("y"), (own > 0).cast("int").alias("pred"))
        out.append(M.with_mean_std(M.binary_metrics(preds, "y", "pred", ["fold"]), ["accuracy", "f1"]).withColumn("plan", F.lit(plan)))
    return R.union_sources(out)


@query("ablation_classifier")
def q_ablation_classifier(spark, sf_dir):
    """The trained second scorer with and without perplexity among its columns, on the held-out mails.

    Variants are read from their store; one that is not there is left out of the report."""
    data = split_features(spark, sf_dir)
    root = scratch_path(spark, "ablation-models")
    columns = {"full": tuple(K.FEATURES), "no_ppl": tuple(c for c in K.FEATURES if c != "perplexity")}
    train = data.filter("is_test = 0")
    vocabulary = ML.Vocabulary.fit(train, "mail_id", "body", K.VOCAB_SIZE)  # both variants' texts are the same
    for variant, numeric in columns.items():
        ML.fit_text_classifier(train, kind="logreg", numeric_cols=numeric, vocabulary=vocabulary).write().overwrite().save(f"{root}/{variant}")
    rows = []
    for variant in (*columns, "never_trained"):
        model = ML.load_optional(spark, f"{root}/{variant}")
        if model is not None:
            scored = ML.positive_probability(model, data.filter("is_test = 1"), "p")
            rows.append(scored.select(F.lit(variant).alias("variant"), F.col("label").alias("y"), "pred"))
    long = R.union_sources(rows)
    return M.confusion_counts(long, "y", "pred", ["variant"]).join(M.binary_metrics(long, "y", "pred", ["variant"]).drop("n"), "variant")


# ---------------------------------------------------------------- streaming keys
from ..streaming import mailbox as ST  # noqa: E402
from ..streaming.seen import SeenStore  # noqa: E402


def drop_folder(spark, sf_dir):
    """A mail drop folder holding every MAIL message (no empty files)."""
    root = scratch_path(spark, "dropbox")
    m = FX.mail_table(spark, sf_dir)
    files = m.select(F.concat(F.lit("in/"), F.col("mail_id").cast("string"), F.lit(".eml")).alias("name"),
                     FX.render_message(F.col("subject"), F.col("sender"), F.col("raw_body")).alias("content"))
    SM.write_message_files(files, root, "name", "content")
    return root


@query("stream_score")
def q_stream_score(spark, sf_dir):
    """Streaming mailbox scoring; its result equals the batch flagship."""
    root = drop_folder(spark, sf_dir)
    labels = materialize(FX.mail_table(spark, sf_dir).select("mail_id", "label"), "mail-labels")  # joined by every micro-batch
    sink, ckpt = scratch_path(spark, "stream-score-out"), scratch_path(spark, "stream-score-ckpt")
    ST.run_available_now(ST.scoring_stream(spark, root, labels, mail_scorers(spark, sf_dir), ckpt), sink, ckpt)
    return spark.read.parquet(sink).drop("path", "error")


@query("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    root = drop_folder(spark, sf_dir)
    store, sink, ckpt = (scratch_path(spark, f"stream-dedup-{n}") for n in ("seen", "out", "ckpt"))
    ST.dedup_folder(spark, root, SeenStore(store), sink, ckpt)
    return spark.read.parquet(sink).select("body_sha", "body_len")


@query("stream_dedup_restart")
def q_stream_dedup_restart(spark, sf_dir):
    """Three runs of the stream: bodies of the mail corpus are known from a seeded batch table except every
    body of the label-1 mails; a copy of the folder arrives after the first run; the last run has a new checkpoint."""
    root = drop_folder(spark, sf_dir)
    m = FX.mail_table(spark, sf_dir)
    known = F.sha2(T.clean_text_deep(F.col("raw_body")), 256).alias("hash")
    store, sink = SeenStore(scratch_path(spark, "seen")), scratch_path(spark, "restart-out")
    store.seed(m.filter("label = 0").select(known))
    first, second = scratch_path(spark, "restart-ckpt"), scratch_path(spark, "restart-ckpt")
    ST.dedup_folder(spark, root, store, sink, first)
    late = m.select(F.concat(F.lit("late/"), F.col("mail_id").cast("string"), F.lit(".eml")).alias("name"),
                    FX.render_message(F.col("subject"), F.col("sender"), F.col("raw_body")).alias("content"))
    SM.write_message_files(late, root, "name", "content")
    ST.dedup_folder(spark, root, store, sink, first)
    store.compact(spark)
    ST.dedup_folder(spark, root, store, sink, second)
    return spark.read.parquet(sink).select("body_sha", "body_len")


@query("rf_holdout_report")
def q_rf_holdout_report(spark, sf_dir):
    """Classification report of the forest on the held-out 20% (stratified split)."""
    preds = q_rf_scores(spark, sf_dir).select(F.col("label").alias("y"), "pred")
    return M.classification_report(preds, "y", "pred")


@query("score_mailbox_models")
def q_score_mailbox_models(spark, sf_dir):
    """End-to-end M11 with trained models: fit the detector on the training
    split, save and reload it, then score the held-out mails parsed from
    their message bytes."""
    from ..operators import detection as D
    corpus = materialize(mail_email(spark, sf_dir).select("mail_id", "subject", "body", "urls", "label", "quality"),
                         "corpus")
    corpus = RK.split_flag(corpus, "mail_id", 0.2, 42, "label")
    train = corpus.filter("is_test = 0")
    path = scratch_path(spark, "detector")
    D.train_detector(train).save(path)
    detector = D.Detector.load(spark, path)
    test_ids = corpus.filter("is_test = 1").select("mail_id")
    msgs = rendered_mail(spark, sf_dir).join(test_ids.select(F.col("mail_id").cast("string").alias("path")), "path")
    parsed = SM.parse_messages(msgs).filter(F.col("error").isNull()).select(
        F.col("path").cast("bigint").alias("mail_id"), "subject", "raw_body")
    labelled = parsed.join(FX.mail_table(spark, sf_dir).select("mail_id", "label"), "mail_id")
    out = D.score_mails(labelled, detector, "ENSEMBLE")
    return out.select("mail_id", "label", F.round("p_rf", 6).alias("p_rf"), F.round("p_second", 6).alias("p_second"),
                      "url_max_risk", "prob", "is_phishing", "level")

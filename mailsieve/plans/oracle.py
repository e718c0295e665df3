"""DuckDB oracle SQL for the registered queries (same column names)."""

from __future__ import annotations

from . import oracle_sql_parts as S

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


oracle("score_mailbox", S.score_mailbox_sql("ENSEMBLE"))

# ---------------------------------------------------------------- shared CTEs
from .. import constants as K  # noqa: E402

q, lst, NL = S.q, S.lst, S.NL
MAIL = S.MAIL_CTE
MAIL_URLS = f"""{MAIL},
mu0 AS (SELECT mail_id, {S.extract_urls('raw_body')} AS urls FROM mail),
mu AS (SELECT mail_id, CAST(generate_subscripts(urls, 1) AS INTEGER) AS pos, unnest(urls) AS url FROM mu0)"""
URL_INPUTS = f"""{MAIL_URLS},
ui AS (SELECT 'mail' AS src, mail_id AS id, pos, url FROM mu
       UNION ALL SELECT 'page', page_id, 1, url FROM pages)"""
PRED = f"WITH {S.PRED_CTE}"
PRED_PROB = f"""WITH {S.PRED_CTE},
pp0 AS (SELECT *, {S.fuse_sql()} AS p_fused, {S.boost_sql('url_max_risk')} AS url_boost FROM pred),
pp AS (SELECT *, round(least(p_fused + url_boost, 1.0), 6) AS prob FROM pp0)"""

# ---------------------------------------------------------------- URL keys
oracle("extract_urls", f"WITH {MAIL_URLS} SELECT mail_id, pos, url FROM mu")

oracle("url_netloc", f"""WITH {URL_INPUTS},
n AS (SELECT *, regexp_extract(url, {q(S.NETLOC)}, 1) AS netloc FROM ui)
SELECT src, id, pos, url, netloc,
  CAST(CASE WHEN contains(netloc, '[') <> contains(netloc, ']') THEN 0
       WHEN contains(netloc, '[') AND NOT regexp_matches(regexp_extract(netloc, '\\[([^\\]]*)', 1),
            '^([0-9a-fA-F]*:[0-9a-fA-F:.]*|v[0-9a-fA-F]+\\..+)$') THEN 0
       ELSE length(netloc) - length(replace(netloc, '.', '')) + 1 END AS INTEGER) AS netloc_labels
FROM n""")

oracle("url_parts", f"WITH {URL_INPUTS}, {S.url_parts_ctes('ui')} SELECT src, id, pos, url, scheme, domain, port FROM u_lv")

oracle("url_risk_score", f"WITH {URL_INPUTS}, {S.url_parts_ctes('ui')} SELECT src, id, pos, url, risk_score, risk_level FROM u_lv")

_RULE_ROWS = [
    (1, "http", "r_http", 1, q(K.REASON_HTTP)),
    (2, "ip", "r_ip", 3, q(K.REASON_IP)),
    (3, "shortener", "r_short", 3, f"{q(K.REASON_SHORTENER.split('{}')[0])} || shortener || {q(K.REASON_SHORTENER.split('{}')[1])}"),
    (4, "tld", "r_tld", 2, f"{q(K.REASON_TLD.split('{}')[0])} || tld || {q(K.REASON_TLD.split('{}')[1])}"),
    (5, "brand", "r_brand_h", 3, f"{q(K.REASON_BRAND_HYPHEN.split('{}')[0])} || brand || {q(K.REASON_BRAND_HYPHEN.split('{}')[1])}"),
    (6, "brand", "r_brand_u", 2, f"{q(K.REASON_BRAND_UNOFFICIAL.split('{}')[0])} || brand || {q(K.REASON_BRAND_UNOFFICIAL.split('{}')[1])}"),
    (7, "hyphens", "r_hyph", 1, f"{q(K.REASON_HYPHENS.split('{}')[0])} || CAST(hyphens AS VARCHAR) || {q(K.REASON_HYPHENS.split('{}')[1])}"),
    (8, "term", "r_term", 1, f"{q(K.REASON_TERM.split('{}')[0])} || term || {q(K.REASON_TERM.split('{}')[1])}"),
    (9, "depth", "r_deep", 1, f"{q(K.REASON_DEPTH.split('{}')[0])} || CAST(labels AS VARCHAR) || {q(K.REASON_DEPTH.split('{}')[1])}"),
    (10, "at", "r_at", 4, q(K.REASON_AT)),
    (11, "port", "r_port", 1, f"{q(K.REASON_PORT.split('{}')[0])} || CAST(port AS VARCHAR) || {q(K.REASON_PORT.split('{}')[1])}"),
]
oracle("url_risk_rules", f"WITH {URL_INPUTS}, {S.url_parts_ctes('ui')} " + " UNION ALL ".join(
    f"SELECT src, id, pos, {n} AS rule_no, {q(name)} AS rule, {pts} AS points, {reason} AS reason "
    f"FROM u_lv WHERE NOT guarded AND {cond}" for n, name, cond, pts, reason in _RULE_ROWS))

oracle("url_risk_reasons", f"""WITH {URL_INPUTS}, {S.url_parts_ctes('ui')}
SELECT src, id, pos, CAST(length(reasons) AS INTEGER) AS n_reasons, array_to_string(reasons, ' | ') AS reasons_text FROM u_lv""")

oracle("url_risk_level", f"""WITH {URL_INPUTS}, {S.url_parts_ctes('ui')}
SELECT src, risk_level, count(*) AS n_urls FROM u_lv GROUP BY src, risk_level""")

_PER_MAIL_RISK = f"""WITH {MAIL_URLS}, {S.url_parts_ctes('mu')},
pm AS (SELECT mail_id, count(*) AS n, max(risk_score) AS mx,
              string_agg(CAST(risk_score AS VARCHAR), ',' ORDER BY pos) AS scores,
              string_agg(risk_level, ',' ORDER BY pos) AS levels,
              string_agg({S.report_block()}, {NL} ORDER BY pos) AS report
       FROM u_lv GROUP BY mail_id)"""

oracle("mail_url_risks", f"""{_PER_MAIL_RISK}
SELECT m.mail_id, CAST(coalesce(pm.n, 0) AS INTEGER) AS n_urls, coalesce(pm.scores, '') AS scores,
       coalesce(pm.levels, '') AS levels FROM mail m LEFT JOIN pm ON m.mail_id = pm.mail_id""")

oracle("mail_max_risk", f"""{_PER_MAIL_RISK}
SELECT m.mail_id, CAST(coalesce(pm.mx, 0) AS INTEGER) AS url_max_risk FROM mail m LEFT JOIN pm ON m.mail_id = pm.mail_id""")

oracle("url_report", f"""{_PER_MAIL_RISK}
SELECT m.mail_id, coalesce(pm.report, {q(K.REPORT_NO_LINKS)}) AS url_report FROM mail m LEFT JOIN pm ON m.mail_id = pm.mail_id""")

oracle("url_features", f"""WITH {MAIL_URLS},
f AS (SELECT mail_id, avg(length(url)) AS l, avg(length(url) - length(replace(url, '.', ''))) AS d,
             max(CASE WHEN contains(url, '@') THEN 1 ELSE 0 END) AS a,
             max(CASE WHEN regexp_matches(url, {q(S.OCTETS)}) THEN 1 ELSE 0 END) AS ip,
             avg(CASE WHEN contains(nl, '[') <> contains(nl, ']') THEN 0
                      WHEN contains(nl, '[') AND NOT regexp_matches(regexp_extract(nl, '\\[([^\\]]*)', 1),
                           '^([0-9a-fA-F]*:[0-9a-fA-F:.]*|v[0-9a-fA-F]+\\..+)$') THEN 0
                      ELSE length(nl) - length(replace(nl, '.', '')) + 1 END) AS s, count(*) AS c
      FROM (SELECT *, regexp_extract(url, {q(S.NETLOC)}, 1) AS nl FROM mu) GROUP BY mail_id)
SELECT m.mail_id, coalesce(f.l, 0.0) AS avg_url_len, coalesce(f.d, 0.0) AS avg_url_dots,
       CAST(coalesce(f.a, 0) AS INTEGER) AS has_at_symbol, CAST(coalesce(f.ip, 0) AS INTEGER) AS has_ip_url,
       coalesce(f.s, 0.0) AS avg_subdomains, CAST(coalesce(f.c, 0) AS INTEGER) AS url_count
FROM mail m LEFT JOIN f ON m.mail_id = f.mail_id""")

# ---------------------------------------------------------------- scoring keys
oracle("fuse_scores", f"{PRED_PROB} SELECT mail_id, p_rf, p_second, p_fused FROM pp")
oracle("score_mode", f"""{PRED}
SELECT mail_id, 'RF' AS mode, round(p_rf, 6) AS p_mode FROM pred
UNION ALL SELECT mail_id, 'BERT', round(p_second, 6) FROM pred
UNION ALL SELECT mail_id, 'ENSEMBLE', {S.fuse_sql()} FROM pred""")
oracle("url_boost", f"{PRED_PROB} SELECT mail_id, url_max_risk, url_boost FROM pp")
oracle("boosted_score", f"{PRED_PROB} SELECT mail_id, p_fused, url_boost, prob FROM pp")
oracle("verdict", f"{PRED_PROB} SELECT mail_id, prob, CAST(prob > 0.5 AS INTEGER) AS is_phishing, {S.verdict_sql('prob')} AS verdict FROM pp")
_res, _lvl = S.band_sql("prob")
oracle("risk_band", f"{PRED_PROB} SELECT mail_id, prob, {_res} AS band, {_lvl} AS level FROM pp")
oracle("format_score", f"{PRED_PROB} SELECT mail_id, prob, {S.percent_sql('prob')} AS prob_text FROM pp")

# ---------------------------------------------------------------- text keys
TEXT_INPUTS = """ti AS (SELECT 'page' AS src, page_id AS id, html AS s FROM pages
       UNION ALL SELECT 'doc', doc_id, text FROM documents)"""
oracle("html_to_text", f"SELECT page_id, {S.html_to_text('html')} AS text FROM pages")
oracle("clean_text_deep", f"WITH {TEXT_INPUTS} SELECT src, id, {S.clean_deep('s')} AS clean FROM ti")
oracle("clean_text_light", f"WITH {TEXT_INPUTS} SELECT src, id, {S.clean_light('s')} AS clean FROM ti")
oracle("mail_text", f"WITH {MAIL} SELECT mail_id, concat_ws(' ', subject, {S.html_to_text('raw_body')}) AS mail_text FROM mail")
oracle("keyword_density", f"""WITH {MAIL}
SELECT mail_id, CAST({S.keyword_hits('raw_body', K.LEXICON_FULL35)} AS INTEGER) AS hits_full35,
       {S.keyword_density('raw_body', K.LEXICON_FULL35)} AS density_full35,
       CAST({S.keyword_hits('raw_body', K.LEXICON_SHORT9)} AS INTEGER) AS hits_short9,
       {S.keyword_density('raw_body', K.LEXICON_SHORT9)} AS density_short9 FROM mail""")
_JOINED = " || ".join(f"{S.lst(S.MAIL_KEYWORDS)}[({e}) % {len(S.MAIL_KEYWORDS)} + 1]" for e in ("mail_id", "mail_id * 7 + 3", "mail_id * 5 + 1"))
oracle("learnt_words", f"""WITH {MAIL}, runs AS (SELECT unnest(regexp_extract_all(raw_body || ' ' || {_JOINED}, '[{S.WRITTEN_TOGETHER}]+')) AS run FROM mail),
g AS (SELECT gram, count(*) AS n, length(gram) AS size FROM (SELECT unnest(flatten(list_transform(range(1, 6), lambda k:
  list_transform(range(1, length(run) - k + 2), lambda i: substring(run, i, k))))) AS gram FROM runs) GROUP BY gram),
total AS (SELECT sum(n) AS t FROM g WHERE size = 1),
w AS (SELECT * FROM g WHERE size BETWEEN 2 AND 4 AND n >= 5),
cuts AS (SELECT gram, n, size, unnest(range(1, size)) AS cut FROM w),
held AS (SELECT cuts.gram, min(ln(cuts.n * CAST(t AS DOUBLE) / (a.n * b.n))) AS cohesion FROM cuts CROSS JOIN total
         JOIN g a ON a.gram = substring(cuts.gram, 1, cut) JOIN g b ON b.gram = substring(cuts.gram, cut + 1) GROUP BY cuts.gram),
after AS (SELECT substring(gram, 1, size - 1) AS gram, sum(n * ln(n)) AS t FROM g WHERE size > 1 GROUP BY 1),
before AS (SELECT substring(gram, 2) AS gram, sum(n * ln(n)) AS t FROM g WHERE size > 1 GROUP BY 1),
r AS (SELECT w.gram AS word, w.n, round(cohesion, 6) AS cohesion,
             round(least(ln(w.n) - coalesce(after.t, 0.0) / w.n, ln(w.n) - coalesce(before.t, 0.0) / w.n), 6) AS freedom
      FROM w JOIN held ON w.gram = held.gram LEFT JOIN after ON w.gram = after.gram LEFT JOIN before ON w.gram = before.gram)
SELECT * FROM r WHERE cohesion >= 2.0 AND freedom >= 0.5""")
oracle("lexicon_hits", f"""WITH {MAIL}, lex AS (SELECT DISTINCT unnest({S.tokenize('text')}) AS term FROM benchmark),
h AS (SELECT mail_id, count(*) AS n FROM mail JOIN lex ON contains(raw_body, term) GROUP BY mail_id)
SELECT mail_id, CAST(coalesce(n, 0) AS BIGINT) AS hits, coalesce(n, 0) / greatest(length(coalesce(raw_body, '')), 1) AS density
FROM mail LEFT JOIN h USING (mail_id)""")
oracle("tokenize_corpus", f"""WITH {MAIL},
t AS (SELECT mail_id, unnest({S.tokenize('raw_body')}) AS token FROM mail)
SELECT mail_id, token, count(*) AS n FROM t GROUP BY mail_id, token""")

# ---------------------------------------------------------------- relational keys
_DEEP_BODY = S.clean_deep("raw_body")
MAIL_EMAIL = f"""{MAIL},
me AS (SELECT mail_id,
  CASE WHEN subject IS NULL OR {S.py_strip('subject')} = '' THEN 'Unknown' ELSE {S.py_strip('subject')} END AS subject,
  CASE WHEN sender IS NULL OR {S.py_strip('sender')} = '' THEN 'Unknown' ELSE {S.py_strip('sender')} END AS sender,
  'None' AS reply_to, 0 AS received_count,
  CASE WHEN {_DEEP_BODY} = '' THEN 'Empty_Body' ELSE {_DEEP_BODY} END AS body,
  CAST(length({S.extract_urls('raw_body')}) AS INTEGER) AS url_count, label, source_dataset
  FROM mail)"""
FRAUD = """fr AS (SELECT conv_id * 1000 + turn AS row_id,
  CASE WHEN length(text) % 13 = 0 THEN NULL ELSE CAST((conv_id + turn) % 11 AS INTEGER) END AS label_id,
  text AS body FROM conversations)"""
FRAUD_EMAIL = f"""{FRAUD},
fe AS (SELECT row_id AS mail_id, 'Unknown' AS subject, 'Unknown' AS sender, 'None' AS reply_to, 0 AS received_count,
  {S.clean_light('body')} AS body, 0 AS url_count,
  CASE WHEN label_id = 0 THEN 0 ELSE 1 END AS label, 'fraud' AS source_dataset FROM fr)"""

oracle("filter_by_label", f"WITH {MAIL} SELECT mail_id, label, source_dataset FROM mail WHERE label = 0")
oracle("binarize_label", f"WITH {FRAUD} SELECT row_id, label_id, CASE WHEN label_id = 0 THEN 0 ELSE 1 END AS label FROM fr")
oracle("default_columns", f"WITH {MAIL_EMAIL} SELECT mail_id, subject, sender, reply_to, received_count, body, url_count, label FROM me")
oracle("align_schema", f"WITH {FRAUD_EMAIL} SELECT * FROM fe")
oracle("label_counts", f"""WITH {MAIL}, {FRAUD_EMAIL},
u AS (SELECT 'mail' AS origin, label FROM mail UNION ALL SELECT 'fraud', label FROM fe)
SELECT origin, count(*) AS n, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_label0,
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_label1 FROM u GROUP BY origin""")
oracle("dedup_report", f"""WITH {MAIL}
SELECT count(*) AS n_before, count(DISTINCT text) AS n_after, count(*) - count(DISTINCT text) AS n_removed FROM mail""")
oracle("dedup_keep_first", f"""WITH {MAIL}, {FRAUD},
b AS (SELECT mail_id, text, 0 AS source_rank FROM mail UNION ALL SELECT row_id, body, 1 FROM fr),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, mail_id) AS rn FROM b)
SELECT mail_id, source_rank FROM r WHERE rn = 1""")
oracle("url_presence_by_label", f"""WITH {MAIL_EMAIL}, {FRAUD_EMAIL},
u AS (SELECT source_dataset, label, url_count FROM me UNION ALL SELECT source_dataset, label, url_count FROM fe)
SELECT source_dataset, label, count(*) AS n, round(avg(CASE WHEN url_count > 0 THEN 1 ELSE 0 END), 6) AS share_with_urls
FROM u GROUP BY source_dataset, label""")


def _bits(given: str) -> str:
    """Mutual information of bucket and label within the groups of `given` (a comma and columns, or nothing)."""
    w = lambda keys: f"sum(n) OVER (PARTITION BY feature{given}{keys})"
    return (f"SELECT feature, round(greatest(sum(t), 0.0), 6) AS bits FROM (SELECT feature, n / sum(n) OVER (PARTITION BY feature) "
            f"* log2(n * {w('')} / ({w(', bucket')} * {w(', label')})) AS t "
            f"FROM (SELECT feature{given}, bucket, label, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY feature{given}, bucket, label)) GROUP BY feature")


oracle("leak_report", f"""WITH {MAIL_EMAIL}, {FRAUD_EMAIL},
u AS (SELECT source_dataset AS source, label, body, url_count FROM me UNION ALL SELECT source_dataset, label, body, url_count FROM fe),
wide AS (SELECT source, label, url_count, length(body) AS body_len, {S.keyword_hits('body')} AS keyword_hits FROM u),
long AS (SELECT 'url_count' AS feature, source, label, url_count AS v FROM wide UNION ALL SELECT 'body_len', source, label, body_len FROM wide
         UNION ALL SELECT 'keyword_hits', source, label, keyword_hits FROM wide),
lim AS (SELECT feature, list_distinct(quantile_disc(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM long GROUP BY feature),
cells AS (SELECT feature, source, label, len(list_filter(q, lambda x: v > x)) AS bucket FROM long JOIN lim USING (feature)),
alone AS ({_bits('')}), given AS ({_bits(', source')})
SELECT feature, alone.bits, given.bits AS bits_given_source, CAST(row_number() OVER (ORDER BY alone.bits DESC, feature) AS INTEGER) AS rank
FROM alone JOIN given USING (feature)""")
oracle("union_sources", f"""WITH {MAIL_EMAIL}, {FRAUD_EMAIL}
SELECT 'mail' AS origin, mail_id, label, CAST(length(body) AS INTEGER) AS body_len FROM me
UNION ALL SELECT 'fraud', mail_id, label, CAST(length(body) AS INTEGER) FROM fe""")
oracle("union_ragged", f"""WITH {MAIL_EMAIL}, {FRAUD_EMAIL}
SELECT 'mail' AS origin, mail_id, subject, sender, url_count, label, source_dataset,
       NULL::VARCHAR AS phish_type, NULL::VARCHAR AS tone, NULL::VARCHAR AS source, CAST(length(body) AS INTEGER) AS body_len FROM me
UNION ALL SELECT 'fraud', mail_id, subject, sender, url_count, label, source_dataset, NULL, NULL, NULL, CAST(length(body) AS INTEGER) FROM fe
UNION ALL SELECT 'llm', item_id, 'Unknown', 'AI Generated', 0, 1, NULL, 'benchmark', 'mild', 'ai_generated', CAST(length(text) AS INTEGER) FROM benchmark""")
oracle("head_preview", f"""WITH {MAIL_EMAIL}
SELECT mail_id, subject, sender, reply_to, received_count, substring(body, 1, 60) AS body_head, url_count, label
FROM me ORDER BY mail_id LIMIT 5""")
_PK = lambda e: f"substring({S.py_strip(f'coalesce({e}, {q(chr(0))[:0]}{chr(39)}{chr(39)})')}, 1, {K.DECONTAMINATION_PREFIX})"
DECON = f"""{MAIL},
known AS (SELECT DISTINCT {_PK('text')} AS pk FROM documents WHERE source = 'src0'),
train AS (SELECT * FROM mail WHERE {_PK('text')} NOT IN (SELECT pk FROM known))"""
oracle("prefix_decontaminate", f"WITH {DECON} SELECT mail_id, label FROM train")
oracle("class_weights", f"""WITH {MAIL},
c AS (SELECT label, count(*) AS n_c FROM mail GROUP BY label)
SELECT label, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight FROM c""")

# ---------------------------------------------------------------- ranking keys
def _hrank(idc: str, seed, part: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY md5(concat_ws('|', CAST({idc} AS VARCHAR), {seed})), {idc})"


def _cnt(part: str) -> str:
    return f"count(*) OVER (PARTITION BY {part})" if part else "count(*) OVER ()"


oracle("sample_exact_n", f"""WITH {MAIL}, r AS (SELECT mail_id, label, {_hrank('mail_id', "'42'", 'label')} AS rk FROM mail)
SELECT mail_id, label FROM r WHERE rk <= 200""")
oracle("sample_fraction_seeds", f"""WITH {MAIL},
x AS (SELECT seed, mail_id FROM mail CROSS JOIN (SELECT unnest([100, 101, 102, 103, 104]) AS seed)),
r AS (SELECT seed, mail_id, {_hrank('mail_id', 'CAST(seed AS VARCHAR)', 'seed')} AS rk, {_cnt('seed')} AS n FROM x)
SELECT seed, mail_id FROM r WHERE rk <= round_even(n * 0.2::DOUBLE, 0)""")
oracle("split_random", f"""WITH {MAIL}, r AS (SELECT mail_id, {_hrank('mail_id', "'42'", '')} AS rk, {_cnt('')} AS n FROM mail)
SELECT mail_id, CAST(rk <= ceil(n * 0.2::DOUBLE) AS INTEGER) AS is_test FROM r""")
oracle("split_stratified", f"""WITH {MAIL}, r AS (SELECT mail_id, label, {_hrank('mail_id', "'42'", 'label')} AS rk, {_cnt('label')} AS n FROM mail)
SELECT mail_id, label, CAST(rk <= ceil(n * 0.2::DOUBLE) AS INTEGER) AS is_test FROM r""")
oracle("stratified_kfold", f"""WITH {MAIL}, r AS (SELECT mail_id, label, {_hrank('mail_id', "'42'", 'label')} AS rk FROM mail)
SELECT mail_id, label, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r""")
oracle("kfold_contiguous", f"""WITH {MAIL}
SELECT mail_id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY mail_id) - 1 AS INTEGER) AS fold FROM mail""")

# ---------------------------------------------------------------- metric keys
PRED_LONG = f"""{S.PRED_CTE},
pl AS (SELECT mail_id, 'rf' AS model, y, CAST(round(p_rf, 6) > 0.5 AS INTEGER) AS pred FROM judged
  UNION ALL SELECT mail_id, 'second', y, CAST(round(p_second, 6) > 0.5 AS INTEGER) FROM judged
  UNION ALL SELECT mail_id, 'fused', y, CAST({S.fuse_sql()} > 0.5 AS INTEGER) FROM judged)"""


def _cm(src: str, group: str) -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return (f"SELECT {g}count(*) AS n, "
            f"CAST(sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
            f"CAST(sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            f"CAST(sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
            f"CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM {src}{gb}")


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def _metrics(cm: str, group: str) -> str:
    g = f"{group}, " if group else ""
    return (f"SELECT {g}n, round({_div('tp + tn', 'n')}, 6) AS accuracy, "
            f"round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM ({cm})")


oracle("metrics_binary", f"WITH {PRED_LONG} {_metrics(_cm('pl', 'model'), 'model')}")
oracle("confusion_matrix", f"WITH {PRED_LONG} {_cm('pl', 'model')}")


def _f1(p, r):
    return f"(CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END)"


_p1, _r1, _p0, _r0 = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("tn", "tn + fn"), _div("tn", "tn + fp")
oracle("classification_report", f"""WITH {PRED_LONG}, c AS ({_cm('pl', 'model')}),
rows AS (
  SELECT model, '0' AS row, {_p0} AS precision, {_r0} AS recall, {_f1(_p0, _r0)} AS f1, tn + fp AS support FROM c
  UNION ALL SELECT model, '1', {_p1}, {_r1}, {_f1(_p1, _r1)}, tp + fn FROM c
  UNION ALL SELECT model, 'accuracy', NULL, NULL, {_div('tp + tn', 'n')}, n FROM c
  UNION ALL SELECT model, 'macro avg', ({_p0} + {_p1}) / 2, ({_r0} + {_r1}) / 2, ({_f1(_p0, _r0)} + {_f1(_p1, _r1)}) / 2, n FROM c
  UNION ALL SELECT model, 'weighted avg', {_div(f'{_p0} * (tn + fp) + {_p1} * (tp + fn)', 'n')},
         {_div(f'{_r0} * (tn + fp) + {_r1} * (tp + fn)', 'n')},
         {_div(f'{_f1(_p0, _r0)} * (tn + fp) + {_f1(_p1, _r1)} * (tp + fn)', 'n')}, n FROM c)
SELECT model, row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rows""")

FOLD_METRICS = f"""{PRED_LONG},
folds AS (SELECT mail_id, CAST(({_hrank('mail_id', "'42'", 'y')} - 1) % 5 AS INTEGER) AS fold FROM judged),
plf AS (SELECT pl.*, folds.fold FROM pl JOIN folds ON pl.mail_id = folds.mail_id),
fm AS ({_metrics(_cm('plf', 'model, fold'), 'model, fold')})"""


def _mean_std(src: str, group: str) -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    cols = []
    for v in ("accuracy", "f1"):
        cols += [f"round(avg({v}), 6) AS {v}_mean", f"round(stddev_pop({v}), 6) AS {v}_std"]
    inner = f"SELECT {g}{', '.join(cols)} FROM {src}{gb}"
    txt = ", ".join(f"printf('%.4f ± %.4f', round({v}_mean, 4), round({v}_std, 4)) AS {v}_text" for v in ("accuracy", "f1"))
    return f"SELECT *, {txt} FROM ({inner})"


oracle("fold_summary", f"WITH {FOLD_METRICS} {_mean_std('fm', 'model')}")
oracle("seed_stability", f"""WITH {PRED_LONG},
lab AS (SELECT mail_id FROM judged),
x AS (SELECT seed, mail_id FROM lab CROSS JOIN (SELECT unnest([100, 101, 102, 103, 104]) AS seed)),
r AS (SELECT seed, mail_id, {_hrank('mail_id', 'CAST(seed AS VARCHAR)', 'seed')} AS rk, {_cnt('seed')} AS n FROM x),
s AS (SELECT seed, mail_id FROM r WHERE rk <= round_even(n * 0.2::DOUBLE, 0)),
sp AS (SELECT s.seed, pl.y, pl.pred FROM s JOIN pl ON s.mail_id = pl.mail_id WHERE pl.model = 'fused'),
ps AS ({_metrics(_cm('sp', 'seed'), 'seed')})
SELECT *, 5 AS n_seeds FROM ({_mean_std('ps', '')})""")
oracle("model_comparison", f"""WITH {FOLD_METRICS}, ms AS ({_mean_std("(SELECT * FROM fm WHERE model IN ('rf', 'second'))", 'model')})
SELECT 'Accuracy' AS metric, max(CASE WHEN model = 'rf' THEN accuracy_text END) AS rf,
       max(CASE WHEN model = 'second' THEN accuracy_text END) AS second FROM ms
UNION ALL SELECT 'F1-Score', max(CASE WHEN model = 'rf' THEN f1_text END), max(CASE WHEN model = 'second' THEN f1_text END) FROM ms""")
MIXED = f"""{DECON},
held AS (SELECT *, {_hrank('mail_id', "'42'", 'label')} AS rk, {_cnt('label')} AS n FROM train),
ht AS (SELECT * FROM held WHERE rk <= ceil(n * 0.2::DOUBLE) AND label = 0),
hn AS (SELECT mail_id, label, {_hrank('mail_id', "'42'", '')} AS rk2 FROM ht),
mixed AS (SELECT doc_id AS mail_id, 1 AS label, 'ai' AS origin FROM documents WHERE source = 'src0'
          UNION ALL SELECT mail_id, label, 'normal' FROM hn WHERE rk2 <= 200)"""
oracle("mixed_testset", f"WITH {MIXED} SELECT * FROM mixed")

# ---------------------------------------------------------------- corpus model keys
DT = f"""{MAIL_EMAIL},
dt AS (SELECT mail_id, term, count(*) AS tf FROM (SELECT mail_id, unnest({S.tokenize('body')}) AS term FROM me)
       GROUP BY mail_id, term),
st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM dt GROUP BY term)"""


def _voc(k: int) -> str:
    return (f"SELECT term, cf, df, CAST(row_number() OVER (ORDER BY cf DESC, term) - 1 AS INTEGER) AS term_index "
            f"FROM (SELECT * FROM st ORDER BY cf DESC, term LIMIT {k})")


oracle("term_stats", f"WITH {DT} SELECT * FROM st")
oracle("vocab_top500", f"WITH {DT} {_voc(500)}")
oracle("vocab_top500_summary", f"WITH {DT} {_voc(500)}")
oracle("topk_terms", f"WITH {DT} {_voc(10)}")
oracle("term_counts", f"WITH {DT}, voc AS ({_voc(500)}) SELECT dt.mail_id, dt.term, voc.term_index, dt.tf FROM dt JOIN voc ON dt.term = voc.term")
oracle("tfidf_table", f"""WITH {DT}, voc AS ({_voc(500)}), nd AS (SELECT count(*) AS n FROM me),
x AS (SELECT dt.mail_id, dt.term, voc.term_index, dt.tf, dt.tf * (ln((1.0 + n) / (df + 1)) + 1) AS w
      FROM dt JOIN voc ON dt.term = voc.term CROSS JOIN nd)
SELECT mail_id, term, term_index, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY mail_id)), 6) AS weight FROM x""")
NB = f"""lab AS (SELECT mail_id, CAST(quality AS INTEGER) AS c FROM mail WHERE quality IS NOT NULL),
per AS (SELECT term, sum(CASE WHEN c = 1 THEN tf ELSE 0 END) AS n1, sum(CASE WHEN c = 0 THEN tf ELSE 0 END) AS n0
        FROM dt JOIN lab ON dt.mail_id = lab.mail_id GROUP BY term),
tot AS (SELECT CAST(sum(n1) AS DOUBLE) AS t1, CAST(sum(n0) AS DOUBLE) AS t0, count(*) AS v FROM per),
pr AS (SELECT ln(sum(c) / count(*)) - ln((count(*) - sum(c)) / count(*)) AS prior FROM lab),
model AS (SELECT term, ln((n1 + 1) / (t1 + v)) - ln((n0 + 1) / (t0 + v)) AS llr FROM per CROSS JOIN tot),
nbs AS (SELECT dt.mail_id, sum(dt.tf * model.llr) AS s FROM dt JOIN model ON dt.term = model.term GROUP BY dt.mail_id),
sent AS (SELECT me.mail_id, round(1.0 / (1.0 + exp(-(prior + coalesce(nbs.s, 0.0)))), 6) AS sentiment
         FROM me LEFT JOIN nbs ON me.mail_id = nbs.mail_id CROSS JOIN pr)"""
PPL = f"""p AS (SELECT mail_id, body AS t FROM me),
bgr AS (SELECT mail_id, unnest(CASE WHEN length(t) < 2 THEN []::VARCHAR[]
          ELSE list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) END) AS bg FROM p),
cnt AS (SELECT bg, count(*) AS c_ab, substring(bg, 1, 1) AS a FROM bgr GROUP BY bg),
ctx AS (SELECT a, sum(c_ab) AS c_a FROM cnt GROUP BY a),
vv AS (SELECT count(DISTINCT ch) AS v FROM (SELECT unnest(regexp_extract_all(t, '(?s).')) AS ch FROM p)),
pm AS (SELECT bg, ln((c_ab + 1) / (c_a + v)) AS lp FROM cnt JOIN ctx ON cnt.a = ctx.a CROSS JOIN vv),
pper AS (SELECT bgr.mail_id, avg(lp) AS m FROM bgr JOIN pm ON bgr.bg = pm.bg GROUP BY bgr.mail_id),
ppl AS (SELECT me.mail_id, round(coalesce(ln(1 + exp(-m)), 0.0), 6) AS perplexity FROM me LEFT JOIN pper ON me.mail_id = pper.mail_id)"""
_SHAPE_PPL = [*S.SHAPE_SQL, "perplexity"]
oracle("ablation_report", f"""WITH {MIXED}, {MAIL_EMAIL.split(MAIL, 1)[1].lstrip(', ' + chr(10))}, {PPL},
ranked AS (SELECT *, {_hrank('mail_id', "'42'", 'label')} AS rk_split, {_cnt('label')} AS n_split FROM mail),
shaped AS (SELECT ranked.mail_id, ranked.label, rk_split <= ceil(n_split * 0.2::DOUBLE) AS is_test, perplexity,
                  {", ".join(f"{e} AS {n}" for n, e in S.SHAPE_SQL.items())} FROM ranked JOIN ppl ON ranked.mail_id = ppl.mail_id),
gs AS (SELECT {S.gaussian_stats(_SHAPE_PPL)} FROM shaped WHERE NOT is_test AND mail_id NOT IN (SELECT mail_id FROM mixed)),
t AS (SELECT mixed.mail_id, mixed.label AS y, {S.logistic(S.gaussian_odds(_SHAPE_PPL, 'gs'))} AS p_full,
             {S.logistic(S.gaussian_odds(S.SHAPE_SQL, 'gs'))} AS p_no FROM mixed JOIN shaped ON mixed.mail_id = shaped.mail_id CROSS JOIN gs),
long AS (SELECT mail_id, y, 'full' AS variant, CAST(p_full > 0.5 AS INTEGER) AS pred FROM t
         UNION ALL SELECT mail_id, y, 'no_ppl', CAST(p_no > 0.5 AS INTEGER) FROM t),
c AS ({_cm('long', 'variant')})
SELECT c.*, round({_div('tp + tn', 'n')}, 6) AS accuracy, round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c""")
oracle("sentiment_nb", f"WITH {DT}, {NB} SELECT * FROM sent")
oracle("perplexity_ngram", f"WITH {MAIL_EMAIL}, {PPL} SELECT * FROM ppl")
oracle("feature_table", f"""WITH {DT}, {NB}, {PPL},
uf AS (SELECT mail_id, {S.extract_urls('raw_body')} AS urls FROM mail),
ue AS (SELECT mail_id, unnest(urls) AS url FROM uf),
f AS (SELECT mail_id, avg(length(url)) AS l, avg(length(url) - length(replace(url, '.', ''))) AS d,
             max(CASE WHEN contains(url, '@') THEN 1 ELSE 0 END) AS a,
             max(CASE WHEN regexp_matches(url, {q(S.OCTETS)}) THEN 1 ELSE 0 END) AS ip,
             avg(CASE WHEN contains(nl, '[') <> contains(nl, ']') THEN 0
                      ELSE length(nl) - length(replace(nl, '.', '')) + 1 END) AS s, count(*) AS c
      FROM (SELECT *, regexp_extract(url, {q(S.NETLOC)}, 1) AS nl FROM ue) GROUP BY mail_id)
SELECT me.mail_id, me.label, sent.sentiment, {S.keyword_density('me.body')} AS subjectivity,
       coalesce(f.l, 0.0) AS avg_url_len, coalesce(f.d, 0.0) AS avg_url_dots,
       CAST(coalesce(f.a, 0) AS INTEGER) AS has_at_symbol, CAST(coalesce(f.ip, 0) AS INTEGER) AS has_ip_url,
       coalesce(f.s, 0.0) AS avg_subdomains, CAST(coalesce(f.c, 0) AS INTEGER) AS url_count, ppl.perplexity
FROM me JOIN sent ON me.mail_id = sent.mail_id JOIN ppl ON me.mail_id = ppl.mail_id LEFT JOIN f ON me.mail_id = f.mail_id""")
# Cross-validation: every training part is counted anew, by leaving its fold out
_FOLD = {"stratified": f"CAST(({_hrank('mail_id', "'42'", 'label')} - 1) % 5 AS INTEGER)",
         "contiguous": "CAST(ntile(5) OVER (PARTITION BY label ORDER BY mail_id) - 1 AS INTEGER)"}
_VARIANTS = "variants AS (SELECT unnest([0, 1, 2, 3, 4]) AS variant)"


def _cv_bayes(class_rel: str, fold: str, p: str = "") -> str:
    """CTEs: folds, class marks, naive Bayes of each training part and the log odds of every mail under each."""
    return f"""{p}fo AS (SELECT mail_id, label, {fold} AS fold FROM mail),
{p}lab AS ({class_rel.format(fo=p + 'fo')}),
{p}per AS (SELECT variant, term, sum(CASE WHEN c = 1 THEN tf ELSE 0 END) AS n1, sum(CASE WHEN c = 0 THEN tf ELSE 0 END) AS n0
  FROM dt JOIN {p}lab USING (mail_id) CROSS JOIN variants WHERE fold <> variant GROUP BY variant, term),
{p}tot AS (SELECT variant, CAST(sum(n1) AS DOUBLE) AS t1, CAST(sum(n0) AS DOUBLE) AS t0, count(*) AS v FROM {p}per GROUP BY variant),
{p}pr AS (SELECT variant, ln(sum(c) / count(*)) - ln((count(*) - sum(c)) / count(*)) AS prior FROM {p}lab CROSS JOIN variants
  WHERE fold <> variant GROUP BY variant),
{p}nbs AS (SELECT dt.mail_id, variant, sum(tf * (ln((n1 + 1) / (t1 + v)) - ln((n0 + 1) / (t0 + v)))) AS s
  FROM dt JOIN {p}per USING (term) JOIN {p}tot USING (variant) GROUP BY dt.mail_id, variant),
{p}odds AS (SELECT {p}fo.mail_id, label, fold, variant, prior + coalesce(s, 0.0) AS odds
  FROM {p}fo CROSS JOIN {p}pr LEFT JOIN {p}nbs USING (mail_id, variant))"""


_QUALITY = "SELECT mail_id, CAST(quality AS INTEGER) AS c, fold FROM mail JOIN {fo} USING (mail_id) WHERE quality IS NOT NULL"
_LABEL = "SELECT mail_id, label AS c, fold FROM {fo}"
oracle("cv_feature_models", f"""WITH {DT}, {_VARIANTS}, {_cv_bayes(_QUALITY, _FOLD['stratified'])},
t AS (SELECT me.mail_id, fold, body AS t FROM me JOIN fo ON me.mail_id = fo.mail_id),
bgr AS (SELECT mail_id, fold, bg, count(*) AS n FROM (SELECT mail_id, fold, unnest(CASE WHEN length(t) < 2 THEN []::VARCHAR[]
          ELSE list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) END) AS bg FROM t) GROUP BY mail_id, fold, bg),
cnt AS (SELECT variant, bg, substring(bg, 1, 1) AS a, sum(n) AS c_ab FROM bgr CROSS JOIN variants WHERE fold <> variant GROUP BY variant, bg),
ctx AS (SELECT variant, a, sum(c_ab) AS c_a FROM cnt GROUP BY variant, a),
vv AS (SELECT variant, count(DISTINCT ch) AS v FROM (SELECT fold, unnest(regexp_extract_all(t, '(?s).')) AS ch FROM t) CROSS JOIN variants
       WHERE fold <> variant GROUP BY variant),
pp AS (SELECT mail_id, variant, sum(n * ln((coalesce(c_ab, 0) + 1) / (coalesce(c_a, 0) + v))) / sum(n) AS m
       FROM bgr CROSS JOIN vv LEFT JOIN cnt USING (variant, bg) LEFT JOIN ctx ON ctx.variant = vv.variant AND ctx.a = substring(bgr.bg, 1, 1)
       GROUP BY mail_id, variant)
SELECT odds.mail_id, odds.fold, odds.variant, round(1.0 / (1.0 + exp(-odds)), 6) AS sentiment, round(coalesce(ln(1 + exp(-m)), 0.0), 6) AS perplexity
FROM odds LEFT JOIN pp ON odds.mail_id = pp.mail_id AND odds.variant = pp.variant""")
oracle("cv_vocabulary", f"""WITH {DT}, {_VARIANTS}, fo AS (SELECT mail_id, {_FOLD['stratified']} AS fold FROM mail),
per AS (SELECT variant, term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM dt JOIN fo USING (mail_id) CROSS JOIN variants
        WHERE fold <> variant GROUP BY variant, term),
n AS (SELECT variant, count(*) AS n_mails FROM fo CROSS JOIN variants WHERE fold <> variant GROUP BY variant),
r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY cf DESC, term) - 1 AS i FROM per)
SELECT variant, term, cf, df, CAST(i AS INTEGER) AS term_index, round(ln((1.0 + n_mails) / (df + 1)) + 1, 6) AS idf
FROM r JOIN n USING (variant) WHERE i < 500""")


def _cv_metrics(p: str, plan: str) -> str:
    preds = f"(SELECT fold, label AS y, CAST(round(odds, 6) > 0 AS INTEGER) AS pred FROM {p}odds WHERE fold = variant)"
    cols = ", ".join(f"round(avg({v}) OVER (), 6) AS {v}_mean, round(stddev_pop({v}) OVER (), 6) AS {v}_std" for v in ("accuracy", "f1"))
    return f"SELECT *, {cols}, '{plan}' AS plan FROM ({_metrics(_cm(preds, 'fold'), 'fold')})"


oracle("cv_naive_bayes", f"""WITH {DT}, {_VARIANTS}, {_cv_bayes(_LABEL, _FOLD['stratified'], 's')}, {_cv_bayes(_LABEL, _FOLD['contiguous'], 'q')}
{_cv_metrics('s', 'stratified')} UNION ALL {_cv_metrics('q', 'contiguous')}""")
oracle("parse_url_list_text", f"""WITH {MAIL}, uf AS (SELECT mail_id, {S.extract_urls('raw_body')} AS urls FROM mail)
SELECT mail_id, CAST(length(urls) AS INTEGER) AS url_count, array_to_string(urls, ' ') AS urls_text FROM uf""")

# ---------------------------------------------------------------- ingestion keys
INDEX_EXPECTED = f"""{MAIL},
idx AS (SELECT 'data/' || CAST(mail_id AS VARCHAR) || '.eml' AS rel_path, CASE WHEN label = 0 THEN 0 ELSE 1 END AS label FROM mail
        UNION ALL SELECT 'data/missing-' || CAST(item_id AS VARCHAR) || '.eml', 1 FROM benchmark)"""
RENDERED = f"""{MAIL},
msg AS (SELECT mail_id, label, CASE WHEN mail_id % 29 = 0 THEN 0 ELSE strlen(
  CASE WHEN subject IS NULL THEN '' ELSE 'Subject: ' || subject || chr(13) || chr(10) END
  || 'From: ' || sender || chr(13) || chr(10) || 'MIME-Version: 1.0' || chr(13) || chr(10)
  || 'Content-Type: text/plain; charset=utf-8' || chr(13) || chr(10)
  || 'Content-Transfer-Encoding: 8bit' || chr(13) || chr(10) || chr(13) || chr(10) || raw_body) END AS length
  FROM mail)"""
oracle("scan_label_index", f"WITH {INDEX_EXPECTED} SELECT rel_path, label FROM idx")
oracle("scan_mail_files", f"WITH {RENDERED} SELECT 'data/' || CAST(mail_id AS VARCHAR) || '.eml' AS rel_path, CAST(length AS BIGINT) AS length FROM msg")
oracle("join_index_files", f"WITH {RENDERED} SELECT 'data/' || CAST(mail_id AS VARCHAR) || '.eml' AS rel_path, label, CAST(length AS BIGINT) AS length FROM msg")
oracle("ingest_skip_report", f"""WITH {MAIL}
SELECT (SELECT count(*) FROM mail) + (SELECT count(*) FROM benchmark) AS n_index,
       CAST((SELECT count(*) FROM mail WHERE mail_id % 29 <> 0) AS BIGINT) AS n_parsed, CAST(0 AS BIGINT) AS n_failed,
       CAST((SELECT count(*) FROM mail WHERE mail_id % 29 = 0) AS BIGINT) AS n_empty,
       CAST((SELECT count(*) FROM benchmark) AS BIGINT) AS n_missing""")
_DB = S.clean_deep("raw_body")
oracle("parse_mail_corpus", f"""WITH {MAIL}
SELECT mail_id, CASE WHEN subject IS NULL OR {S.py_strip('subject')} = '' THEN 'Unknown' ELSE {S.py_strip('subject')} END AS subject,
       {S.py_strip('sender')} AS sender, CASE WHEN {_DB} = '' THEN 'Empty_Body' ELSE {_DB} END AS body,
       CAST(length({S.extract_urls('raw_body')}) AS INTEGER) AS url_count,
       array_to_string({S.extract_urls('raw_body')}, ' ') AS urls_text, label FROM mail""")
_HT = S.html_to_text("'<p>' || coalesce(subject, '') || '</p>'")
oracle("mail_part_report", f"""WITH {MAIL}
SELECT mail_id, 1 AS part_no, 'text/plain' AS content_type, substring(raw_body, 1, 3000) AS text_head,
       CAST(length(raw_body) AS INTEGER) AS total_len, CAST(length(raw_body) > 3000 AS INTEGER) AS truncated FROM mail
UNION ALL SELECT mail_id, 2, 'text/html', substring({_HT}, 1, 3000), CAST(length({_HT}) AS INTEGER),
       CAST(length({_HT}) > 3000 AS INTEGER) FROM mail""")
oracle("mail_header_report", f"""WITH {MAIL}
SELECT mail_id, sender, 'N/A' AS recipient, coalesce(subject, 'N/A') AS subject, 'N/A' AS sent FROM mail""")
oracle("decode_lenient", "SELECT doc_id, text || ' tail' AS text FROM documents")
oracle("scan_fraud_tsv", f"WITH {FRAUD} SELECT label_id, body FROM fr")
oracle("scan_csv_roundtrip", f"""WITH {MAIL_EMAIL}, uf AS (SELECT mail_id, {S.extract_urls('raw_body')} AS urls FROM mail)
SELECT me.mail_id, subject, sender, body, url_count, array_to_string(uf.urls, ' ') AS urls_text, label
FROM me JOIN uf ON me.mail_id = uf.mail_id""")
oracle("optional_source_union", f"""WITH {MAIL}, {FRAUD}
SELECT 'mail' AS origin, mail_id, label FROM mail
UNION ALL SELECT 'fraud', row_id, CASE WHEN label_id = 0 THEN 0 ELSE 1 END FROM fr""")
oracle("ingest_llm_replies", """SELECT conv_id * 1000 + turn AS reply_id, 1 AS obj_pos,
       CASE WHEN turn % 6 = 4 THEN 'Unknown' ELSE 'turn ' || CAST(turn AS VARCHAR) END AS subject,
       'AI Generated' AS sender, text AS body, 1 AS label, role AS phish_type,
       CASE WHEN turn % 6 = 4 THEN 'mild' ELSE 'urgent' END AS tone, 'ai_generated' AS source
FROM conversations WHERE turn % 6 IN (0, 3, 4)
UNION ALL SELECT conv_id * 1000 + turn, 2, 'second', 'AI Generated', 'copy: ' || text, 1, 'delivery', 'mild', 'ai_generated'
FROM conversations WHERE turn % 6 = 3""")

# ---------------------------------------------------------------- streaming keys
oracle("stream_score", S.score_mailbox_sql("ENSEMBLE"))
oracle("stream_dedup", f"""WITH {MAIL_EMAIL}, b AS (SELECT {S.clean_deep('raw_body')} AS body FROM mail)
SELECT DISTINCT sha256(body) AS body_sha, CAST(length(body) AS INTEGER) AS body_len FROM b""")
oracle("stream_dedup_restart", f"""WITH {MAIL_EMAIL}, b AS (SELECT {S.clean_deep('raw_body')} AS body, label FROM mail)
SELECT sha256(body) AS body_sha, CAST(length(body) AS INTEGER) AS body_len FROM b GROUP BY body HAVING min(label) = 1""")

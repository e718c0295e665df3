"""DuckDB SQL fragments shared by the oracle queries.

They restate, in plain SQL over the driver tables, what the Spark operators
compute.  Patterns and lists are stated here on their own, from the rules, so
an error in an operator's pattern does not repeat itself; only fixed values and
the test tables' inputs are shared.  DuckDB needs the 'g' option for a global
replace.
"""

from __future__ import annotations

from .. import constants as K
from ..sources.fixtures import MAIL_KEYWORDS, MAIL_URLS

# white space as Python's str.isspace() has it, as a set and as a class
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE_CLASS = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in SPACES) + "]"
CONTROLS = r"[\x{0}-\x{9}\x{b}-\x{1f}\x{7f}-\x{9f}]|\p{Cf}"
# the references that occur in the driver's pages
REFERENCES = [("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
MARKUP = (r"(?is)<!--.*?(-->|\z)|<(?:script)\b.*?(</script\s*>|\z)|<(?:style)\b.*?(</style\s*>|\z)|<(?:template)\b.*?(</template\s*>|\z)"
          r"|<(?:![a-z]|\?|/?[a-z])[^>]*>")
WRITTEN_TOGETHER = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}"
TOKENS = rf"[{WRITTEN_TOGETHER}]+|[\p{{L}}\p{{M}}]+|\p{{Nd}}+"
URL = r"https?://[!\x24-\x5f\x61-\x7a]+"
NETLOC = r"^[A-Za-z][A-Za-z0-9.+-]*://([^#?/]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9.+-]*):"
OCTETS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


NL = "chr(10)"


def rx_replace(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def html_to_text(expr: str) -> str:
    expr = rx_replace(expr, MARKUP)
    for reference, char in REFERENCES:
        expr = f"replace({expr}, {q(reference)}, {q(char)})"
    return expr


def py_strip(expr: str) -> str:
    return f"trim({expr}, {q(SPACES)})"


def clean_deep(expr: str) -> str:
    e = html_to_text(f"coalesce({expr}, '')")
    e = f"translate({e}, {q(chr(0xa0) + chr(9) + chr(13))}, '   ')"
    e = rx_replace(e, CONTROLS)
    e = rx_replace(e, " +", " ")
    e = rx_replace(e, rf"\n{SPACE_CLASS}*\n+", "\n")
    return py_strip(e)


def clean_light(expr: str) -> str:
    t = py_strip(rx_replace(html_to_text(expr), rf"{SPACE_CLASS}+", " "))
    return (f"CASE WHEN {expr} IS NULL OR {py_strip(expr)} = '' OR {t} = '' "
            f"THEN {q(K.EMPTY_BODY)} ELSE {t} END")


def tokenize(expr: str) -> str:
    apart = rx_replace(f"lower(coalesce({expr}, ''))", f"([{WRITTEN_TOGETHER}]+)", r" \1 ")
    runs = f"regexp_extract_all({apart}, {q(TOKENS)})"
    return (f"flatten(list_transform({runs}, lambda t: CASE WHEN regexp_matches(t, {q('^[' + WRITTEN_TOGETHER + ']')}) "
            f"AND length(t) > 1 THEN list_transform(range(1, length(t)), lambda i: substring(t, i, 2)) "
            f"ELSE [t] END))")


def keyword_hits(expr: str, lexicon=K.LEXICON_FULL35) -> str:
    return f"length(list_filter({lst(lexicon)}, lambda w: contains(coalesce({expr}, ''), w)))"


def keyword_density(expr: str, lexicon=K.LEXICON_FULL35) -> str:
    return f"({keyword_hits(expr, lexicon)} / greatest(length(coalesce({expr}, '')), 1))"


def extract_urls(expr: str) -> str:
    return f"coalesce(regexp_extract_all({expr}, {q(URL)}), [])"


MAIL_CTE = f"""mail AS (
  SELECT d.doc_id AS mail_id,
         CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE 'msg ' || d.source END AS subject,
         d.source || '@' || d.lang || '.example' AS sender,
         d.text || ' ' || {lst(MAIL_KEYWORDS)}[d.doc_id % 36 + 1] || ' ' || {lst(MAIL_URLS)}[d.doc_id % 20 + 1] AS raw_body,
         CAST(coalesce(l.toxic, 0) AS INTEGER) AS label,
         d.source AS source_dataset, d.lang, d.text, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

def _share(pattern: str) -> str:
    n, body = "length(coalesce(raw_body, ''))", "coalesce(raw_body, '')"
    return f"({n} - length({rx_replace(body, pattern)})) / CAST(greatest({n}, 1) AS DOUBLE)"


SHAPE_SQL = {"log_length": "ln(1 + CAST(length(coalesce(raw_body, '')) AS DOUBLE))", "digits": _share("[0-9]"), "capitals": _share("[A-Z]"),
             "marks": _share("[!?]"), "spaces": _share(r"[ \n]")}


def logistic(odds: str) -> str:
    return f"round(1 / (1 + exp(-least(greatest({odds}, -500.0), 500.0))), 6)"


def gaussian_odds(features, stats: str) -> str:
    """Log odds of class 1 from columns n0, n1 and m0_f, v0_f, m1_f, v1_f of relation `stats`."""
    def side(c: int) -> str:
        terms = [f"ln({stats}.n{c} / CAST({stats}.n0 + {stats}.n1 AS DOUBLE))"]
        for f in features:
            v = f"({stats}.v{c}_{f} + 1e-6)"
            terms.append(f"(-0.5 * ln(2 * pi() * {v}) - power({f} - {stats}.m{c}_{f}, 2) / (2 * {v}))")
        return " + ".join(terms)
    return f"(({side(1)}) - ({side(0)}))"


def gaussian_stats(features) -> str:
    cols = [f"count(*) FILTER (label = {c}) AS n{c}" for c in (0, 1)]
    cols += [f"{fn}({f}) FILTER (label = {c}) AS {name}{c}_{f}"
             for c in (0, 1) for f in features for name, fn in (("m", "avg"), ("v", "var_pop"))]
    return ", ".join(cols)


SCORED_CTE = f"""{MAIL_CTE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(mail_id AS VARCHAR) || '|42'), mail_id) AS rk_split,
                  count(*) OVER (PARTITION BY label) AS n_split FROM mail),
shaped AS (SELECT *, CAST(rk_split <= ceil(n_split * 0.2::DOUBLE) AS INTEGER) AS is_test,
                  {", ".join(f"{e} AS {n}" for n, e in SHAPE_SQL.items())} FROM ranked),
gs AS (SELECT {gaussian_stats(SHAPE_SQL)} FROM shaped WHERE is_test = 0),
words AS (SELECT mail_id, label, is_test, unnest(list_distinct({tokenize('raw_body')})) AS term FROM shaped),
held_words AS (SELECT term, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM words WHERE is_test = 0 GROUP BY term),
odds AS (SELECT term, ln((h.n1 + 1) / (gs.n1 + 2.0)) - ln((h.n0 + 1) / (gs.n0 + 2.0)) AS w, h.n1 + h.n0 AS n FROM held_words h CROSS JOIN gs),
telling AS (SELECT term, w FROM odds ORDER BY round(abs(w) * n, 6) DESC, term LIMIT 200),
word_sum AS (SELECT mail_id, sum(w) AS w FROM words JOIN telling USING (term) GROUP BY mail_id),
smail AS (SELECT shaped.* EXCLUDE (rk_split, n_split), {logistic(gaussian_odds(SHAPE_SQL, 'gs'))} AS p_rf,
                 {logistic('(ln(gs.n1 / CAST(gs.n0 AS DOUBLE)) + coalesce(word_sum.w, 0.0))')} AS p_second
          FROM shaped CROSS JOIN gs LEFT JOIN word_sum ON shaped.mail_id = word_sum.mail_id)"""


def url_parts_ctes(src: str, url_col: str = "url", prefix: str = "u") -> str:
    """CTEs {prefix}_p1.. {prefix}_risk over relation `src` holding `url_col`.
    Final CTE `{prefix}_risk` adds scheme, domain, port, risk_score,
    risk_level, reasons."""
    u = url_col

    def first(values, pred):
        return f"list_filter({lst(values)}, lambda s: {pred})[1]"

    def fmt(t, v):
        left, right = t.split("{}")
        return f"({q(left)} || CAST({v} AS VARCHAR) || {q(right)})"

    return f"""{prefix}_p1 AS (
  SELECT *, regexp_extract({u}, {q(NETLOC)}, 1) AS netloc,
         lower(regexp_extract({u}, {q(SCHEME)}, 1)) AS scheme FROM {src}),
{prefix}_p2 AS (SELECT *, regexp_extract(netloc, '([^@]*)$', 1) AS hostinfo FROM {prefix}_p1),
{prefix}_p3 AS (
  SELECT *, lower(CASE WHEN contains(hostinfo, '[') THEN regexp_extract(hostinfo, '\\[([^\\]]*)', 1)
                       ELSE regexp_extract(hostinfo, '^([^:]*)', 1) END) AS domain,
         CASE WHEN contains(hostinfo, '[') THEN regexp_extract(hostinfo, '\\[[^\\]]*\\][^:]*:(.*)$', 1)
              ELSE regexp_extract(hostinfo, '^[^:]*:(.*)$', 1) END AS port_text
  FROM {prefix}_p2),
{prefix}_p4 AS (
  SELECT *, CASE WHEN regexp_matches(port_text, '^[0-9]+$') THEN coalesce(nullif(ltrim(port_text, '0'), ''), '0') END AS port,
         {first(K.SHORTENERS, 'contains(domain, s)')} AS shortener,
         {first(K.SUSPICIOUS_TLDS, 'suffix(domain, s)')} AS tld,
         {first(K.BRANDS, 'contains(domain, s)')} AS brand,
         {first(K.PHISH_TERMS, 'contains(domain, s)')} AS term,
         length(domain) - length(replace(domain, '-', '')) AS hyphens,
         length(domain) - length(replace(domain, '.', '')) + 1 AS labels
  FROM {prefix}_p3),
{prefix}_p5 AS (
  SELECT *, scheme = 'http' AS r_http,
         regexp_matches(domain, {q('^' + OCTETS + '$')}) AS r_ip,
         shortener IS NOT NULL AS r_short, tld IS NOT NULL AS r_tld,
         brand IS NOT NULL AND contains(domain, '-') AS r_brand_h,
         brand IS NOT NULL AND NOT contains(domain, '-') AND NOT suffix(domain, brand || '.com')
           AND NOT suffix(domain, brand || '.cn') AS r_brand_u,
         hyphens > 2 AS r_hyph, term IS NOT NULL AS r_term, labels > 4 AS r_deep,
         contains({u}, '@') AS r_at,
         port IS NOT NULL AND port <> '0' AND port NOT IN ({', '.join(q(str(x)) for x in K.ALLOWED_PORTS)}) AS r_port,
         {u} IS NULL OR NOT contains({u}, '.') AS guarded
  FROM {prefix}_p4),
{prefix}_risk AS (
  SELECT *,
    CASE WHEN guarded THEN 0 ELSE
      (CASE WHEN r_http THEN 1 ELSE 0 END) + (CASE WHEN r_ip THEN 3 ELSE 0 END)
      + (CASE WHEN r_short THEN 3 ELSE 0 END) + (CASE WHEN r_tld THEN 2 ELSE 0 END)
      + (CASE WHEN r_brand_h THEN 3 ELSE 0 END) + (CASE WHEN r_brand_u THEN 2 ELSE 0 END)
      + (CASE WHEN r_hyph THEN 1 ELSE 0 END) + (CASE WHEN r_term THEN 1 ELSE 0 END)
      + (CASE WHEN r_deep THEN 1 ELSE 0 END) + (CASE WHEN r_at THEN 4 ELSE 0 END)
      + (CASE WHEN r_port THEN 1 ELSE 0 END) END AS risk_score,
    CASE WHEN guarded THEN []::VARCHAR[] ELSE list_filter([
      CASE WHEN r_http THEN {q(K.REASON_HTTP)} END,
      CASE WHEN r_ip THEN {q(K.REASON_IP)} END,
      CASE WHEN r_short THEN {fmt(K.REASON_SHORTENER, 'shortener')} END,
      CASE WHEN r_tld THEN {fmt(K.REASON_TLD, 'tld')} END,
      CASE WHEN r_brand_h THEN {fmt(K.REASON_BRAND_HYPHEN, 'brand')} END,
      CASE WHEN r_brand_u THEN {fmt(K.REASON_BRAND_UNOFFICIAL, 'brand')} END,
      CASE WHEN r_hyph THEN {fmt(K.REASON_HYPHENS, 'hyphens')} END,
      CASE WHEN r_term THEN {fmt(K.REASON_TERM, 'term')} END,
      CASE WHEN r_deep THEN {fmt(K.REASON_DEPTH, 'labels')} END,
      CASE WHEN r_at THEN {q(K.REASON_AT)} END,
      CASE WHEN r_port THEN {fmt(K.REASON_PORT, 'port')} END], lambda x: x IS NOT NULL) END AS reasons
  FROM {prefix}_p5),
{prefix}_lv AS (
  SELECT *, CASE WHEN risk_score = 0 THEN 'safe' WHEN risk_score <= 1 THEN 'low'
                 WHEN risk_score <= 3 THEN 'medium' ELSE 'high' END AS risk_level
  FROM {prefix}_risk)"""


PRED_CTE = f"""{SCORED_CTE},
wu AS (SELECT mail_id, unnest({extract_urls('raw_body')}) AS url FROM mail),
{url_parts_ctes('wu', prefix='w')},
wr AS (SELECT mail_id, max(risk_score) AS mx FROM w_lv GROUP BY mail_id),
pred AS (SELECT smail.mail_id, CAST(toxic AS INTEGER) AS y, p_rf, p_second, CAST(coalesce(wr.mx, 0) AS INTEGER) AS url_max_risk, is_test
         FROM smail LEFT JOIN wr ON smail.mail_id = wr.mail_id),
judged AS (SELECT * FROM pred WHERE y IS NOT NULL AND is_test = 1)"""


def report_block(prefix_rel: str = "") -> str:
    icon = "CASE risk_level " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.LEVEL_ICONS.items()) + " END"
    return (f"({icon} || ' [' || risk_level || '] ' || substring(url, 1, {K.URL_REPORT_WIDTH}) || "
            f"array_to_string(list_transform(reasons, lambda r: {NL} || {q(K.REPORT_REASON_PREFIX)} || r), '') || {NL})")


def boost_sql(mx: str) -> str:
    return (f"CASE WHEN {mx} >= {K.BOOST_HIGH_RISK} THEN CAST({K.BOOST_HIGH} AS DOUBLE) "
            f"WHEN {mx} >= {K.BOOST_MEDIUM_RISK} THEN CAST({K.BOOST_MEDIUM} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END")


def band_sql(p: str) -> tuple[str, str]:
    res = (f"CASE WHEN {p} < 0.5 THEN {q(K.BAND_SAFE[0])} WHEN {p} < 0.75 THEN {q(K.BAND_MEDIUM[0])} "
           f"ELSE {q(K.BAND_HIGH[0])} END")
    lvl = (f"CASE WHEN {p} < 0.5 THEN {q(K.BAND_SAFE[1])} WHEN {p} < 0.75 THEN {q(K.BAND_MEDIUM[1])} "
           f"ELSE {q(K.BAND_HIGH[1])} END")
    return res, lvl


def verdict_sql(p: str) -> str:
    return f"CASE WHEN {p} > 0.5 THEN {q(K.VERDICT_PHISHING)} ELSE {q(K.VERDICT_SAFE)} END"


def percent_sql(p: str) -> str:
    hundredths = f"((CAST(round({p} * 1000000) AS BIGINT) + 50) // 100)"
    return f"({hundredths} // 100) || '.' || lpad(CAST({hundredths} % 100 AS VARCHAR), 2, '0') || '%'"


def fuse_sql(a: str = "p_rf", b: str = "p_second", wa: float = K.DEFAULT_RF_WEIGHT,
             wb: float = K.DEFAULT_SECOND_WEIGHT) -> str:
    return f"round(CAST({wa} AS DOUBLE) * {a} + CAST({wb} AS DOUBLE) * {b}, 6)"


def score_mailbox_sql(mode: str = "ENSEMBLE", body: str = "raw_body", mail_cte: str = SCORED_CTE) -> str:
    p_mode = {"RF": "round(p_rf, 6)", "BERT": "round(p_second, 6)", "ENSEMBLE": fuse_sql()}[mode]
    res, lvl = band_sql("prob")
    return f"""WITH {mail_cte},
staged AS (
  SELECT mail_id, label, p_rf, p_second, concat_ws(' ', subject, {html_to_text(body)}) AS _text,
         {extract_urls(body)} AS urls
  FROM smail),
uu AS (SELECT mail_id, unnest(urls) AS url, generate_subscripts(urls, 1) AS pos FROM staged),
{url_parts_ctes('uu')},
per_mail AS (
  SELECT mail_id, max(risk_score) AS mx, string_agg({report_block()}, {NL} ORDER BY pos) AS report
  FROM u_lv GROUP BY mail_id),
scored AS (
  SELECT s.mail_id, s.label, s.p_rf, s.p_second, CAST(length(s.urls) AS INTEGER) AS url_count,
         CAST(coalesce(pm.mx, 0) AS INTEGER) AS url_max_risk,
         CAST({keyword_hits('s._text')} AS INTEGER) AS keyword_hits,
         {keyword_density('s._text')} AS subjectivity,
         {p_mode} AS p_mode,
         coalesce(pm.report, {q(K.REPORT_NO_LINKS)}) AS url_report
  FROM staged s LEFT JOIN per_mail pm ON s.mail_id = pm.mail_id),
boosted AS (SELECT *, {boost_sql('url_max_risk')} AS url_boost FROM scored),
final AS (SELECT *, round(least(p_mode + url_boost, 1.0), 6) AS prob FROM boosted)
SELECT mail_id, label, url_count, url_max_risk, keyword_hits, subjectivity, p_rf, p_second, p_mode,
       url_boost, prob, CAST(prob > 0.5 AS INTEGER) AS is_phishing, {verdict_sql('prob')} AS verdict,
       {res} AS band, {lvl} AS level, {percent_sql('prob')} AS prob_text, url_report
FROM final"""

"""URL extraction, parsing, rule-based risk scoring and the URL report.

Every function maps Columns to a Column, so the same code scores a flat
column of URLs (`df.select(url_risk(...))`) or every element of a per-mail
URL array inside `transform`, with no shuffle and no Python.

Parsing mirrors `urllib.parse.urlsplit`: netloc is the text between `://`
and the first of `/?#`; the host is what follows the last `@`, lower-cased,
without the port; a bracketed host is the text between the first `[` and `]`.
A port that is not a run of ASCII digits counts as absent; a port above
65535 counts as abnormal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# http/https followed by characters of the class {!} U [$-_] U [a-z]; this is
# the same set as the original alternation (which overflows Java's stack on
# long URLs) and already contains `%XX`.
URL_PATTERN = r"https?://[!$-_a-z]+"
NETLOC_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
SCHEME_PATTERN = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
IPV4_ANYWHERE = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
IPV4_HOST = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


# ------------------------------------------------------------------ extraction
def extract_urls(text: Column) -> Column:
    """All URLs of `text` in order, duplicates kept; null text -> []."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(URL_PATTERN), 0), F.array().cast("array<string>"))


# ------------------------------------------------------------------ parsing
def netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC_PATTERN, 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME_PATTERN, 1))


def hostinfo(nl: Column) -> Column:
    """netloc after its last '@'."""
    return F.regexp_extract(nl, r"([^@]*)$", 1)


def hostname(hi: Column) -> Column:
    """Lower-cased host from `hostinfo` ('' when absent)."""
    return F.lower(
        F.when(hi.contains("["), F.regexp_extract(hi, r"\[([^\]]*)", 1))
        .otherwise(F.regexp_extract(hi, r"^([^:]*)", 1))
    )


def port_text(hi: Column) -> Column:
    return (
        F.when(hi.contains("["), F.regexp_extract(hi, r"\[[^\]]*\][^:]*:(.*)$", 1))
        .otherwise(F.regexp_extract(hi, r"^[^:]*:(.*)$", 1))
    )


def port_digits(pt: Column) -> Column:
    """Port as text without leading zeros, of any length; null when empty or
    not a run of ASCII digits."""
    bare = F.ltrim(pt, F.lit("0"))
    return F.when(pt.rlike(r"^[0-9]+$"), F.when(bare == "", F.lit("0")).otherwise(bare))


def netloc_parse_ok(nl: Column) -> Column:
    """False where urlsplit raises (unbalanced brackets, bad bracketed host)."""
    has_open, has_close = nl.contains("["), nl.contains("]")
    bracket_ok = F.regexp_extract(nl, r"\[([^\]]*)", 1).rlike(r"^([0-9a-fA-F]*:[0-9a-fA-F:.]*|v[0-9a-fA-F]+\..+)$")
    return F.when(has_open != has_close, F.lit(False)).when(has_open, bracket_ok).otherwise(F.lit(True))


def netloc_labels(nl: Column) -> Column:
    """len(netloc.split('.')); 0 when the URL does not parse."""
    return F.when(netloc_parse_ok(nl), _count_char(nl, ".") + 1).otherwise(F.lit(0))


def url_parts(url: Column) -> Column:
    """struct<url, scheme, domain, port> computed once per URL."""
    nl = netloc(url)
    hi = hostinfo(nl)
    return F.struct(
        url.alias("url"),
        scheme(url).alias("scheme"),
        hostname(hi).alias("domain"),
        port_digits(port_text(hi)).alias("port"),
    )


# ------------------------------------------------------------------ rules
def _first_contained(domain: Column, values) -> Column:
    return F.try_element_at(F.filter(_lit_array(values), lambda v: domain.contains(v)), F.lit(1))


def _first_suffix(domain: Column, values) -> Column:
    return F.try_element_at(F.filter(_lit_array(values), lambda v: domain.endswith(v)), F.lit(1))


def _fmt(template: str, value: Column) -> Column:
    left, right = template.split("{}")
    return F.concat(F.lit(left), value.cast("string"), F.lit(right))


def _rules(url: Column, sch: Column, domain: Column, port: Column):
    """[(rule name, condition, points, reason text)] in rule order."""
    shortener = _first_contained(domain, K.SHORTENERS)
    tld = _first_suffix(domain, K.SUSPICIOUS_TLDS)
    brand = _first_contained(domain, K.BRANDS)
    term = _first_contained(domain, K.PHISH_TERMS)
    hyphens = _count_char(domain, "-")
    labels = _count_char(domain, ".") + 1
    brand_official = (domain.endswith(F.concat(brand, F.lit(".com")))
                      | domain.endswith(F.concat(brand, F.lit(".cn"))))
    return [
        ("http", sch == "http", 1, F.lit(K.REASON_HTTP)),
        ("ip", domain.rlike(IPV4_HOST), 3, F.lit(K.REASON_IP)),
        ("shortener", shortener.isNotNull(), 3, _fmt(K.REASON_SHORTENER, shortener)),
        ("tld", tld.isNotNull(), 2, _fmt(K.REASON_TLD, tld)),
        ("brand", brand.isNotNull() & domain.contains("-"), 3, _fmt(K.REASON_BRAND_HYPHEN, brand)),
        ("brand", brand.isNotNull() & ~domain.contains("-") & ~brand_official, 2,
         _fmt(K.REASON_BRAND_UNOFFICIAL, brand)),
        ("hyphens", hyphens > 2, 1, _fmt(K.REASON_HYPHENS, hyphens)),
        ("term", term.isNotNull(), 1, _fmt(K.REASON_TERM, term)),
        ("depth", labels > 4, 1, _fmt(K.REASON_DEPTH, labels)),
        ("at", url.contains("@"), 4, F.lit(K.REASON_AT)),
        ("port", port.isNotNull() & (port != "0") & ~port.isin(*map(str, K.ALLOWED_PORTS)), 1, _fmt(K.REASON_PORT, port)),
    ]


def _guarded(url: Column) -> Column:
    """Null or dot-less input is safe with score 0 and no reason."""
    return url.isNull() | ~url.contains(".")


def risk_from_parts(url: Column, sch: Column, domain: Column, port: Column) -> Column:
    """struct<url, risk_level, risk_score, reasons> from parsed parts."""
    rules = _rules(url, sch, domain, port)
    score = sum((F.when(c, F.lit(p)).otherwise(F.lit(0)) for _, c, p, _ in rules[1:]),
                F.when(rules[0][1], F.lit(rules[0][2])).otherwise(F.lit(0)))
    reasons = F.array_compact(F.array(*[F.when(c, r) for _, c, _, r in rules]))
    guarded = _guarded(url)
    final_score = F.when(guarded, F.lit(0)).otherwise(score)
    final_reasons = F.when(guarded, F.array().cast("array<string>")).otherwise(reasons)
    return F.struct(
        url.alias("url"),
        risk_level(final_score).alias("risk_level"),
        final_score.alias("risk_score"),
        final_reasons.alias("reasons"),
    )


def _hits_from_parts(p: Column) -> Column:
    rules = _rules(p["url"], p["scheme"], p["domain"], p["port"])
    hits = F.array(*[
        F.when(c, F.struct(F.lit(i + 1).alias("rule_no"), F.lit(n).alias("rule"),
                           F.lit(pt).alias("points"), r.alias("reason")))
        for i, (n, c, pt, r) in enumerate(rules)
    ])
    return F.when(_guarded(p["url"]), F.array_compact(F.array(F.lit(None).cast(
        "struct<rule_no:int,rule:string,points:int,reason:string>")))).otherwise(F.array_compact(hits))


def rule_hits(url: Column) -> Column:
    """array<struct<rule_no, rule, points, reason>>: one element per rule hit
    (parts parsed once, as in `url_risk`)."""
    return F.flatten(F.transform(F.transform(F.array(url), url_parts), _hits_from_parts))


def risk_level(score: Column) -> Column:
    return (F.when(score == 0, F.lit("safe")).when(score <= 1, F.lit("low"))
            .when(score <= 3, F.lit("medium")).otherwise(F.lit("high")))


def url_risk(url: Column) -> Column:
    """Risk struct of one URL column.  Routed through a one-element array so
    the parsed parts are materialised once and the rule lambdas read struct
    fields instead of re-running the host regexes."""
    return F.element_at(url_risks(F.array(url)), 1)


def url_risks(urls: Column) -> Column:
    """array<struct<url, risk_level, risk_score, reasons>> for a URL array.

    Two passes of `transform`: the first parses each URL once, the second
    applies the rules to the parsed fields, so no regex runs twice."""
    parts = F.transform(urls, url_parts)
    return F.transform(parts, lambda p: risk_from_parts(p["url"], p["scheme"], p["domain"], p["port"]))


def max_risk(risks: Column) -> Column:
    """Highest risk score of a mail, 0 when it has no URL."""
    return F.coalesce(F.array_max(F.transform(risks, lambda r: r["risk_score"])), F.lit(0))


def url_report(risks: Column) -> Column:
    """Multi-line report: icon, level, URL cut to 80 chars, indented reasons,
    blank line per URL; a fixed text when there is no URL."""
    icons = F.create_map(*[x for kv in K.LEVEL_ICONS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    blocks = F.transform(risks, lambda r: F.concat(
        F.array(F.concat(icons[r["risk_level"]], F.lit(" ["), r["risk_level"], F.lit("] "),
                         F.substring(r["url"], 1, K.URL_REPORT_WIDTH))),
        F.transform(r["reasons"], lambda s: F.concat(F.lit(K.REPORT_REASON_PREFIX), s)),
        F.array(F.lit("")),
    ))
    return F.when(F.size(risks) == 0, F.lit(K.REPORT_NO_LINKS)).otherwise(F.array_join(F.flatten(blocks), "\n"))


# ------------------------------------------------------------------ features
def url_structure_features(urls: Column) -> dict[str, Column]:
    """The six URL features of a mail; an empty list gives six zeros."""
    n = F.size(urls)
    empty = n == 0

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        return F.when(empty, F.lit(0.0)).otherwise(total / n)

    nls = F.transform(urls, netloc)
    return {
        "avg_url_len": mean(F.transform(urls, F.length)),
        "avg_url_dots": mean(F.transform(urls, lambda u: _count_char(u, "."))),
        "has_at_symbol": F.exists(urls, lambda u: u.contains("@")).cast("int"),
        "has_ip_url": F.exists(urls, lambda u: u.rlike(IPV4_ANYWHERE)).cast("int"),
        "avg_subdomains": mean(F.transform(nls, netloc_labels)),
        "url_count": n,
    }


def url_boost(max_score: Column) -> Column:
    return (F.when(max_score >= K.BOOST_HIGH_RISK, F.lit(K.BOOST_HIGH))
            .when(max_score >= K.BOOST_MEDIUM_RISK, F.lit(K.BOOST_MEDIUM)).otherwise(F.lit(0.0)))

from pyspark.sql import functions as F

from mailsieve.functions import urls as U
from mailsieve.sources.fixtures import URLFIX

EXTRA = [
    # (url, expected score, expected level)
    ("https://微信-pay.com/", 3, "medium"),           # direct-input Chinese brand with hyphen
    ("https://安全.example.com/", 1, "low"),          # Chinese term in host
    ("https://h.example.com:abc/", 0, "safe"),        # non-numeric port -> no port
    ("https://h.example.com:70000/", 1, "low"),       # port above 65535 -> abnormal
    ("https://h.example.com:0/", 0, "safe"),          # port 0 is falsy
    ("https://h.example.com:000443/", 0, "safe"),     # leading zeros of an allowed port
    ("https://h.example.com:65534/", 1, "low"),
    ("https://h.example.com:" + "9" * 18 + "/", 1, "low"),
    ("https://h.example.com:" + "9" * 25 + "/", 1, "low"),
    ("http://[::1]:8080/x.html", 1, "low"),           # bracketed host, allowed port, http
    ("http://[::1]:8080/x", 0, "safe"),               # no '.' anywhere: guarded
    ("http://", 0, "safe"),                           # empty netloc, no '.': guarded
    (None, 0, "safe"),
]


def _score(spark, rows):
    df = spark.createDataFrame(rows, "url string")
    return [tuple(r) for r in df.select(U.url_risk(F.col("url")).alias("r"))
            .select("r.risk_score", "r.risk_level", "r.reasons").collect()]


def test_urlfix_goldens(spark):
    got = _score(spark, [(u,) for _, u, _ in URLFIX])
    assert [g[0] for g in got] == [s for _, _, s in URLFIX]


def test_extra_goldens(spark):
    got = _score(spark, [(u,) for u, _, _ in EXTRA])
    for (u, score, level), (s, lv, reasons) in zip(EXTRA, got):
        assert (s, lv) == (score, level), (u, s, lv, reasons)


def test_first_declared_brand_wins(spark):
    (s, lv, reasons), = _score(spark, [("https://qq.jd.com/",)])
    assert s == 2 and reasons == ["疑似仿冒 qq（非官方域名）"]


def test_rule_rows_sum_to_score(spark):
    df = spark.createDataFrame([(u,) for _, u, _ in URLFIX], "url string")
    hits = df.select("url", F.explode(U.rule_hits(F.col("url"))).alias("h")).groupBy("url").agg(
        F.sum("h.points").alias("pts"))
    scores = df.select("url", U.url_risk(F.col("url"))["risk_score"].alias("s"))
    j = scores.join(hits, "url", "left").select("s", F.coalesce("pts", F.lit(0)).alias("p")).collect()
    assert all(r.s == r.p for r in j)


def test_extract_urls_keeps_markup_and_order(spark):
    df = spark.createDataFrame([("<p>http://a.cn/x</p> and https://b.com/#frag http://a.cn/x",)], "t string")
    (urls,), = df.select(U.extract_urls(F.col("t"))).collect()
    assert urls == ["http://a.cn/x</p>", "https://b.com/", "http://a.cn/x"]


def test_long_url_does_not_overflow(spark):
    long = "http://a.com/" + "x" * 20000
    df = spark.createDataFrame([(long,)], "t string")
    (urls,), = df.select(U.extract_urls(F.col("t"))).collect()
    assert urls == [long]


def test_url_features_and_report(spark):
    df = spark.createDataFrame([(["https://x.com/a@b", "http://1.2.3/x"],), ([],)], "u array<string>")
    rows = df.select(*[c.alias(k) for k, c in U.url_structure_features(F.col("u")).items()],
                     U.url_report(U.url_risks(F.col("u"))).alias("rep")).collect()
    a, b = rows
    assert (a.avg_url_len, a.avg_url_dots, a.has_at_symbol, a.has_ip_url, a.avg_subdomains, a.url_count) == \
        (15.5, 1.5, 1, 0, 2.5, 2)
    assert (b.avg_url_len, b.has_at_symbol, b.url_count) == (0.0, 0, 0)
    assert a.rep == ("🔴 [high] https://x.com/a@b\n   └ 短网址服务 (x.co)\n   └ URL 含 @ 符号（重定向攻击）\n\n"
                     "🟢 [low] http://1.2.3/x\n   └ HTTP 非加密\n")
    assert b.rep == "未提取到链接"


# ---------------------------------------------------------------- fixed values
# The original URL pattern text, used here only as a test oracle for the
# character class of U.URL_PATTERN.
ORIGINAL_URL_PATTERN = r'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+'


def test_short_class_matches_original_class():
    import re
    orig = re.compile(ORIGINAL_URL_PATTERN)
    short = re.compile(U.URL_PATTERN)
    for cp in range(0x10000):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        s = "http://a" + ch
        assert bool(orig.fullmatch(s)) == bool(short.fullmatch(s)), hex(cp)

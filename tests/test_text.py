from pyspark.sql import functions as F

from mailsieve.functions import text as T

CASES = [
    (1, None),
    (2, ""),
    (3, "　"),
    (4, "a b\tc\r\n\r\n\r\n　　d  e"),
    (5, "wo\u0007rd zero​width"),
    (6, "<!-- c --><script>var x='<p>';</script><style>p{}</style>Hi &amp; bye&copy;<b>!</b>"),
    (7, "a < b and <unclosed"),
    (8, "a\U0001F600b"),
]


def _run(spark, fn):
    df = spark.createDataFrame(CASES, "id int, s string")
    return {r.id: r.c for r in df.select("id", fn(F.col("s")).alias("c")).collect()}


def test_clean_deep(spark):
    got = _run(spark, T.clean_text_deep)
    assert got[1] == "" and got[2] == "" and got[3] == ""
    assert got[4] == "a b c \n　　d e"
    assert got[5] == "word zerowidth"
    assert got[6] == "Hi & bye©!"
    assert got[7] == "a < b and <unclosed"
    assert got[8] == "a\U0001F600b"


def test_clean_light(spark):
    got = _run(spark, T.clean_text_light)
    assert got[1] == "Empty_Body" and got[2] == "Empty_Body" and got[3] == "Empty_Body"
    assert got[4] == "a b c d e"
    assert got[6] == "Hi & bye©!"


def test_deep_clean_idempotent(spark):
    df = spark.createDataFrame(CASES, "id int, s string")
    once = df.select("id", T.clean_text_deep(F.col("s")).alias("a"))
    twice = once.select("id", "a", T.clean_text_deep(F.col("a")).alias("b")).collect()
    assert all(r.a == r.b for r in twice)


def test_length_counts_code_points(spark):
    (n,), = spark.createDataFrame([("a\U0001F600b",)], "s string").select(F.length("s")).collect()
    assert n == 3


def test_tokenize_bigrams_and_words(spark):
    df = spark.createDataFrame([("请验证账号 Login NOW 123 é",)], "s string")
    (toks,), = df.select(T.tokenize(F.col("s"))).collect()
    assert toks == ["请验", "验证", "证账", "账号", "login", "now", "123", "é"]


def test_decode_lenient(spark):
    df = spark.createDataFrame([(bytes("héllo", "utf-8") + b"\xff\xfe" + b" x",)], "b binary")
    (s,), = df.select(T.decode_lenient(F.col("b"))).collect()
    assert s == "héllo x"


def test_format_percent(spark):
    (s,), = spark.createDataFrame([(0.5123,)], "p double").select(T.format_percent(F.col("p"))).collect()
    assert s == "51.23%"


def test_char_bigrams_are_code_point_pairs(spark):
    from pyspark.sql import functions as F
    from mailsieve.functions import text as T
    cases = ["a😀b", "😀😀", "x😀", "😀", "𠀀中𠀁", "中文邮件\r\n测试　 x", "ab​c\x07d", "\n\n", "a", ""]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, t string")
    got = {r.id: r.bg for r in df.select("id", T.char_bigrams(F.col("t")).alias("bg")).collect()}
    for i, s in enumerate(cases):
        assert got[i] == [s[j:j + 2] for j in range(len(s) - 1)], s


SCRIPTS = "Привет мир, カタカナです 한국어 مرحبا ไทย hello 验证码 42 ٣"


def test_tokens_of_all_scripts(spark):
    (toks,), = spark.createDataFrame([(SCRIPTS,)], "s string").select(T.tokenize(F.col("s"))).collect()
    assert toks == ["привет", "мир", "カタ", "タカ", "カナ", "ナで", "です", "한국어", "مرحبا", "ไท", "ทย", "hello", "验证", "证码", "42", "٣"]


def test_references_decode_as_the_standard_library_does(spark):
    import html

    texts = ["&#39564;&#35777;&hellip;&eacute;&#x9a8c;&#xA0;", "&notin; &notit; &not; &ampx &amp;lt; &copy2 &unknown; &; & &#; &#x; a&",
             "&#0; &#x80; &#150; &#xD800; &#1114112; &#99999999999999; &#xFFFFFFFFFF; &#1; &#x1F600; &#xFDD0; &#13;", "&NotEqualTilde; &AMP &lt&gt"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(T.decode_references(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == [html.unescape(t) for t in texts]


def test_open_elements_end_with_the_text(spark):
    cases = {"a<script>b < c": "a", "a<!-- b <i>c": "a", "a<style>x</style >b<template>c": "ab", "x<b>y</b> <!-- z": "xy ", "1 < 2 <i>3</i> <u": "1 < 2 3 <u"}
    got = spark.createDataFrame([(t,) for t in cases], "s string").select("s", T.html_to_text(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in got} == cases


def test_hostile_markup_is_linear(spark):
    import time

    frame = spark.createDataFrame([("<a" * 500_000,), ("<!--" * 250_000,), ("<script" * 150_000 + ">",)], "s string")
    start = time.perf_counter()
    lengths = [r.n for r in frame.select(F.length(T.html_to_text(F.col("s"))).alias("n")).collect()]
    assert lengths[0] == 1_000_000 and lengths[1:] == [0, 0] and time.perf_counter() - start < 30

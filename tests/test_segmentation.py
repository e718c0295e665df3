"""Learnt words and the most probable segmentation."""

import math
import random
from collections import Counter
from itertools import product

from mailsieve.operators import segmentation as SG

WORDS = ["验证", "账号", "银行卡", "安全", "点击", "验证码"]


def corpus(seed=5, n=300):
    rng = random.Random(seed)
    return ["see " + "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) + rng.choice([".", " ok", "日"]) for _ in range(n)]


def brute(texts, longest, least):
    """Counts, cohesion and freedom by definition, over all positions."""
    runs = ["".join(c for c in t if "一" <= c <= "鿿") for t in texts]
    counts, left, right = Counter(), {}, {}
    for r, run in enumerate(runs):
        for i, j in product(range(len(run)), range(1, longest + 2)):
            if i + j <= len(run):
                w = run[i:i + j]
                counts[w] += 1
                left.setdefault(w, Counter())[run[i - 1] if i else ("edge", r, i)] += 1
                right.setdefault(w, Counter())[run[i + j] if i + j < len(run) else ("edge", r, i)] += 1
    total, out = sum(n for w, n in counts.items() if len(w) == 1), {}
    entropy = lambda c: -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values())
    for w, n in counts.items():
        if 2 <= len(w) <= longest and n >= least:
            out[w] = n, min(math.log(n * total / (counts[w[:k]] * counts[w[k:]])) for k in range(1, len(w))), min(entropy(left[w]), entropy(right[w]))
    return out


def test_learnt_words_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "latin only"])], "id int, t string").repartition(4)
    got = {r["word"]: (r["n"], r["cohesion"], r["freedom"]) for r in SG.learn_words(docs, "t", cohesion=-99, freedom=-1).collect()}
    expected = brute([t for t in texts], SG.LONGEST, SG.LEAST)
    assert got.keys() == expected.keys()
    for w, (n, c, f) in expected.items():
        assert got[w][0] == n and abs(got[w][1] - c) < 1e-5 and abs(got[w][2] - f) < 1e-5
    learnt = {r["word"] for r in SG.learn_words(docs, "t").collect()}
    assert {"账号", "安全", "点击", "银行卡"} <= learnt and "号安" not in learnt


def test_segmentation_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(200):
        weight = {"".join(rng.choices("甲乙丙", k=rng.randint(1, 3))): -rng.random() * 5 for _ in range(8)}
        run = "".join(rng.choices("甲乙丙丁", k=rng.randint(1, 7)))
        value = lambda parts: sum(weight.get(p, -6.0 if len(p) == 1 else -math.inf) for p in parts)
        best = -math.inf
        for cuts in product((0, 1), repeat=len(run) - 1):
            parts, at = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(run[at:k])
                    at = k
            best = max(best, value([*parts, run[at:]]))
        got = SG.segment(run, weight, 3, -6.0)
        assert "".join(got) == run and abs(value(got) - best) < 1e-9


def test_tokens_of_mixed_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "id int, t string")
    words = SG.learn_words(docs, "t", cohesion=1.0)
    asked = spark.createDataFrame([(1, "Click 点击验证码 now 42"), (2, None), (3, ""), (4, "银行卡安全龘")], "id int, t string")
    got = {r["id"]: r["tokens"] for r in SG.tokenize_learnt(asked, "t", words).collect()}
    assert got == {1: ["click", "点击", "验证码", "now", "42"], 2: [], 3: [], 4: ["银行卡", "安全", "龘"]}
    assert [r["tokens"] for r in SG.tokenize_learnt(asked.filter("id = 4"), "t", words.filter("false")).collect()] == [list("银行卡安全龘")]


def test_learnt_tokens_are_counted_in_the_row(spark):
    """No shuffle of tokens where ids are unique; texts of one id are added up; counts are those of the tokens."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "id int, t string")
    words = SG.learn_words(docs, "t", cohesion=1.0)
    rows = [(1, "Click 点击验证码 now now 42 点击"), (2, None), (3, ""), (4, "银行卡安全龘"), (5, "only plain plain")]
    for asked in (rows, [*rows, (4, "银行卡 x"), (None, "null id"), (None, "null")]):
        frame = spark.createDataFrame(asked, "id int, t string")
        got = SG.count_learnt(frame, "id", "t", words)
        tokens = SG.tokenize_learnt(frame, "t", words).collect()
        want = Counter((r["id"], t) for r in tokens for t in r["tokens"])
        assert {(r["id"], r["token"]): r["n"] for r in got.collect()} == want and got.count() == len(want)
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (len(asked) > len(rows))

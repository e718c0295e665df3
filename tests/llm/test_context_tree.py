import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mailsieve.llm import context_tree as C


def naive_scores(texts, train, depth=C.DEPTH):
    """Context-tree weighting by plain recursion over dictionaries."""
    data = [bytes([C.END]) * depth + t.encode().lower() + bytes([C.END]) for t in texts]
    counts = defaultdict(lambda: [0, 0])
    for d, learn in zip(data, train):
        for i in range(depth, len(d)):
            for bit in range(8):
                prefix = d[i] >> (8 - bit) | 1 << bit
                for k in range(depth + 1):
                    counts[d[i - k:i], prefix][d[i] >> (7 - bit) & 1] += learn
    kids = defaultdict(set)
    for context, prefix in counts:
        if context:
            kids[context[1:], prefix].add(context)

    def estimate(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known = {}

    def weight(context, prefix):
        if (context, prefix) not in known:
            own = estimate(*counts[context, prefix])
            if len(context) < depth:
                below = sum(weight(c, prefix) for c in kids[context, prefix])
                high = max(own, below)
                own = high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)
            known[context, prefix] = own
        return known[context, prefix]

    def probability(context, prefix, bit):
        a, b = counts.get((context, prefix), (0, 0))
        return ((b if bit else a) + .5) / (a + b + 1)

    out = []
    for d in data:
        total = 0.0
        for i in range(depth, len(d)):
            for bit in range(8):
                prefix, one = d[i] >> (8 - bit) | 1 << bit, d[i] >> (7 - bit) & 1
                p = None
                for k in range(depth, -1, -1):
                    context = d[i - k:i]
                    own, seen = probability(context, prefix, one), sum(counts.get((context, prefix), (0, 0))) > 0
                    if p is None:
                        p = own if seen or not k else None
                    else:
                        below = sum(weight(c, prefix) for c in kids[context, prefix])
                        stop = 1 / (1 + math.exp(min(700, max(-700, below - estimate(*counts[context, prefix])))))
                        p = stop * own + (1 - stop) * p
                total += math.log10(p)
        out.append(total)
    return out


TEXTS = ["the cat sat on the mat", "the cat sat on the hat", "", None, "THE CAT\tsat é", "zzz zzz zzz qqq", "the cat sat on the mat",
         "unseen words only here!", "a", "the the the the"]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def scored(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out string, extra int")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return {r["doc_id"]: r for r in C.score_documents(docs, fold).collect()}


def test_scores_match_plain_recursion(spark):
    ids = list(range(len(TEXTS)))
    got = scored(spark, [(i, t, 0.0, "x", 1) for i, t in zip(ids, TEXTS)])
    train = [int(not held(i)) for i in ids]
    assert any(train) and not all(train)
    expected = naive_scores([t or "" for t in TEXTS], train)
    assert [got[i]["score"] for i in ids] == pytest.approx(expected, abs=1e-3)
    words = [re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in TEXTS]
    c = Counter(w for ws, t in zip(words, train) if t for w in ws)
    n, v = sum(c.values()), len(c)
    for i in ids:
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(words[i]), sum(c[w] > 0 for w in words[i]), n)
        assert got[i]["held_out"] == held(i)


def test_next_byte_probabilities_sum_to_one():
    import numpy as np

    texts = [b"abracadabra abracadabra", b"banana band"]
    keys, counts = C._ngrams(texts)
    context = keys[5] >> np.uint64(8) << np.uint64(8)
    every = context + np.arange(256, dtype=np.uint64)
    union = np.unique(np.concatenate((keys, every)))
    n = C._with_training(union, keys, counts)
    upper = C.Upper(*C.subtree_sums(union, n))
    p = 10 ** C.log_probabilities(union, n, upper)
    assert p[np.searchsorted(union, every)].sum() == pytest.approx(1.0)






def test_empty_table_and_null_id(spark):
    assert scored(spark, []) == {}
    one = scored(spark, [(None, "only text", 0.0, "x", 1)])
    assert one[None]["held_out"] is False and one[None]["n_known"] == one[None]["n_tokens"] == 3

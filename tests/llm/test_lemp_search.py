import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from mailsieve.llm import lemp_search

DOCS = [(1, "the cat sat on the mat"), (2, "The CAT"), (3, None), (4, ""), (5, "!!! ..."), (6, "the cat sat on the mat"), (None, "the cat mat"),
        (7, "ñandú Ñandú cat's 42"), (8, "the " * 30000 + "mat"), (9, "x-ray,x_ray"), (10, "mat")]
ITEMS = [(1, "The cat sat on the MAT"), (2, "ñandú 42"), (3, None), (4, "nothing-here"), (5, "the"), (6, "Ñandú ray"), (7, "the cat sat on the mat")]


def brute(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    terms = [(i, pattern.findall((t or "").translate(lower))) for i, t in docs]
    N, L = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in items:
        asked, scored = set(pattern.findall((text or "").translate(lower))), []
        for doc_id, t in terms:
            tf, m = Counter(t), 10 + 90 * len(t) * N // max(L, 1)
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in asked & tf.keys())
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, 3, "r") for i, t in rows], "item_id long, text string, rank int, term string")


def ranked(frame):
    return sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in frame.collect())


def test_query_equals_brute_force_and_sql(spark, documents, items, folder):
    path = folder(documents=documents(DOCS), benchmark=items(ITEMS))
    got = ranked(lemp_search.op12_norm_bucket_search(spark, path))
    assert got == brute(DOCS, ITEMS)
    named = [d for d in DOCS if d[0] is not None]
    path = folder(documents=documents(named), benchmark=items(ITEMS))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    assert sorted(con.execute(lemp_search.ORACLE_SQL).fetchall()) == ranked(lemp_search.op12_norm_bucket_search(spark, path)) == brute(named, ITEMS)


def test_many_documents_with_ties_and_small_buckets(spark, documents, items, monkeypatch):
    monkeypatch.setattr(lemp_search, "BUCKET", 50)
    random.seed(4)
    words = [f"w{int(random.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(random.choices(words, k=random.randint(1, 60)))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(400)]  # a large group of copies
    asked = [(i, " ".join(random.choices(words, k=12))) for i in range(30)] + [(99, docs[7][1])]
    assert ranked(lemp_search.rank(documents(docs).repartition(5), items(asked))) == brute(docs, asked)


def test_items_in_blocks_and_empty_tables(spark, documents, items, monkeypatch):
    monkeypatch.setattr(lemp_search, "ITEM_BYTES", 30)
    assert ranked(lemp_search.rank(documents(DOCS), items(ITEMS), 3)) == brute(DOCS, ITEMS, 3)
    assert ranked(lemp_search.rank(documents([]), items(ITEMS))) == []
    assert ranked(lemp_search.rank(documents(DOCS), items([]))) == []


def test_bounds_never_lose_a_reachable_document():
    random_ = np.random.default_rng(1)
    weight = random_.integers(0, 9000, 40)
    for _ in range(200):
        rows, terms = random_.integers(1, 30), np.sort(random_.choice(40, 12, replace=False)).astype(np.int32)
        held = random_.random((rows, 40)) < 0.3
        row, term = np.nonzero(held)
        impact = random_.integers(1, 10**6, len(row))
        length = np.sqrt(np.bincount(row, weight[term] * impact.astype(float) ** 2, rows))
        bucket = lemp_search.Bucket(np.arange(rows), np.maximum(length, length.max()), row, term.astype(np.int32), impact, weight)
        bucket.square = length ** 2
        terms = terms[np.argsort(-weight[terms], kind="stable")]
        rest = np.sqrt(np.append(np.cumsum(weight[terms][::-1])[::-1], 0))
        scores = bucket.scores(terms)
        floor = float(np.quantile(scores, 0.7))
        assert bucket.candidates(terms, rest, floor * (1 - 1e-9))[scores >= floor].all()

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import embedding_dedup, ngram_join, shingles
from mailsieve.llm.components import components


def smallest(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, width):
    words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def near_corpus(seed, n):
    """Texts of many sizes with chains of edits, passages in common and copies."""
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [random.choice(vocabulary) for _ in range(30)]
    rows = []
    while len(rows) < n:
        words = [random.choice(vocabulary) for _ in range(random.choice((1, 2, 3, 4, 5, 8, 20, 45, 90, 200)))]
        if random.random() < 0.3:
            words += passage
        for _ in range(random.choice((1, 1, 2, 6))):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(random.randint(0, max(1, len(words) // 40))):
                words[random.randrange(len(words))] = random.choice(vocabulary)
    return rows[:n]


@pytest.mark.parametrize("width,num,den,small,words", [(4, 85, 100, 32, 1 << 20), (5, 4, 5, 32, 1 << 20), (4, 85, 100, 1, 64), (5, 4, 5, 3, 1 << 20)])
def test_join_loses_no_link(documents, monkeypatch, width, num, den, small, words):
    monkeypatch.setattr(ngram_join, "SMALL", small)  # 1: every signature that two documents share is one of many
    monkeypatch.setattr(ngram_join, "FILTER_WORDS", words)
    texts = near_corpus(width, 300) + [None, "", "one", "ONE", " \t"]
    sets = [shingle_set(t, width) for t in texts]
    edges = [(a, b) for a, b in combinations(range(len(texts)), 2)
             if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert len(edges) > 50
    got = ngram_join.join(documents(texts).repartition(5), width, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {
        i: (len(sets[i]), c) for i, c in smallest(range(len(texts)), edges).items()}


def test_every_similar_pair_shares_a_signature():
    scheme, random_ = ngram_join.Scheme(85, 100), np.random.default_rng(8)
    met = 0
    for size in (1, 2, 3, 5, 7, 9, 12, 13, 20, 40, 77, 130, 400):
        for _ in range(60):
            a = np.unique(random_.integers(0, 2**63, size, dtype=np.uint64))
            drop = random_.integers(0, max(1, size // 8) + 1)
            b = np.unique(np.concatenate((a[drop:], random_.integers(0, 2**63, random_.integers(0, size // 12 + 2), dtype=np.uint64))))
            if len(b) and ngram_join._similar(a, b, 85, 100):
                met += 1
                assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))
    assert met > 200


def test_a_large_group_of_near_copies_and_a_chain_of_chance_hits(documents):
    """100 copies with an edit each, and documents that only share short passages with the next one."""
    random.seed(3)
    word = lambda: f"v{random.randrange(5000)}"
    base = [word() for _ in range(60)]
    texts = []
    for i in range(100):
        words = list(base)
        words[i % 60] = f"edit{i}"
        texts.append(" ".join(words))
    passages = [[word() for _ in range(9)] for _ in range(81)]
    texts += [" ".join(passages[i] + passages[i + 1] + [word()]) for i in range(80)]
    sets = [shingle_set(t, 4) for t in texts]
    edges = [(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = ngram_join.join(documents(texts).repartition(4), 4, 85, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == smallest(range(len(texts)), edges)


def test_sketches_never_part_a_similar_pair():
    random_ = np.random.default_rng(5)
    parted = 0
    for size in (1, 5, 30, 200, 1000, 5000):
        for _ in range(60):
            a = np.unique(random_.integers(0, 2**63, size, dtype=np.uint64))
            b = np.unique(np.concatenate((a[random_.integers(0, size // 2 + 1):], random_.integers(0, 2**63, random_.integers(0, size // 3 + 2), dtype=np.uint64))))
            x, y = (np.frombuffer(ngram_join.sketch(s), np.uint64)[None] for s in (a, b))
            able = ngram_join.may_link(np.array([len(a)]), np.array([len(b)]), x, y, 85, 100)[0]
            assert able or not ngram_join._similar(a, b, 85, 100)
            parted += not able
    assert parted > 100


def test_wide_sketches_fold_to_narrow_ones_and_tell_large_sets_apart():
    random_ = np.random.default_rng(6)
    for size in (1, 1024, 1025, 9000):
        a = np.unique(random_.integers(0, 2**63, size, dtype=np.uint64))
        wide = np.frombuffer(ngram_join.wide_sketch(a), np.uint8)[None]
        assert len(a) <= wide.shape[1] * 8 < max(2 * len(a), 1025)
        assert ngram_join.folded(wide, 128).tobytes() == ngram_join.sketch(a)
    parted = 0
    for size in (1500, 4000, 7000, 9000):
        for part in (0.0, 0.02, 0.05, 0.08, 0.3, 0.9):
            a = np.unique(random_.integers(0, 2**63, size, dtype=np.uint64))
            b = np.unique(np.concatenate((a[int(size * part):], random_.integers(0, 2**63, int(size * part * 1.1), dtype=np.uint64))))
            x, y = (np.frombuffer(ngram_join.wide_sketch(s), np.uint8)[None] for s in (a, b))
            size_ = min(x.shape[1], y.shape[1])
            able = ngram_join.may_link(np.array([len(a)]), np.array([len(b)]), *(ngram_join.folded(s, size_).view(np.uint64) for s in (x, y)), 85, 100)[0]
            assert able or not ngram_join._similar(a, b, 85, 100)
            parted += not able
            assert not able or part < 0.9
    assert parted >= 4


def test_pairs_of_large_sets_go_on_only_if_wide_sketches_allow_it(spark, documents):
    """Ids 1 and 2 are near copies, 3 is another text, 4 a short one and a copy of 1 under one id."""
    random.seed(4)
    first, other = ([f"w{random.randrange(10**6)}" for _ in range(6000)] for _ in range(2))
    edited = list(first)
    edited[100] = "edit"
    docs = documents([(1, " ".join(first)), (2, " ".join(edited)), (3, " ".join(other)), (4, "a b c d e f"), (4, " ".join(first)), (5, "a b c d e f")])
    sizes = spark.createDataFrame([(1, 5997), (2, 5997), (3, 5997), (4, 3), (4, 5997), (5, 3)], "a long, n long")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (4, 1), (5, 4)], "a long, b long")
    got = ngram_join._sketched_wide(pairs, sizes, docs, 4, 85, 100)
    assert sorted(tuple(r) for r in got.collect()) == [(2, 1), (4, 1), (5, 4)]
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.join(docs, 4, 85, 100).collect()} == {(1, 1), (2, 1), (3, 3), (4, 1), (5, 1)}


def test_likely_documents_hold_all_wanted_ones(spark, documents):
    docs = documents([(i, "t") for i in range(2000)] + [(None, "n"), (7, "again")])
    wanted = spark.createDataFrame([(i,) for i in range(0, 2000, 40)], "a long")
    got = [r["doc_id"] for r in ngram_join.likely(docs, wanted).collect()]
    assert set(range(0, 2000, 40)) <= set(got) and len(got) < 700
    assert ngram_join.likely(docs, wanted.filter("false")).collect() == []


def test_join_with_odd_ids(documents):
    text = "a b c d e f g h i j k l m n"
    got = ngram_join.join(documents([(7, text), (None, text), (3, text), (3, text), (9, "x")]), 4, 85, 100).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == [(3, 3), (3, 3), (7, 3), (9, 9), (None, None)]
    assert ngram_join.join(documents([]), 4, 85, 100).collect() == []
    docs = documents([(7, text), (None, text), (3, text), (9, None), (4, text + " o")])
    kept = ngram_join.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 9, None]


def test_shingles_of_long_and_short_texts():
    texts = ["", "a", "a b c d", "A\x0bB c D", "a b c d " * 20000, "é " * 9]
    sets = shingles.shingle_sets(texts, 4)
    assert [len(s) for s in sets] == [0, 1, 1, 1, 4, 1] and sets[2] == sets[3]
    assert shingles.shingle_sets([], 4) == []
    assert [len(s) for s in shingles.shingle_sets(["a b"], 5)] == [1] and [len(s) for s in shingles.shingle_sets(["a", ""], 5)] == [1, 0]


def test_components_of_paths_stars_and_rings(spark):
    random.seed(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    edges += [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(60)] + [(5, 5), (1, 0)]
    random.shuffle(edges)
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in components(frame).collect()} == smallest(nodes, edges)
    assert components(frame.limit(0)).collect() == []


def test_embeddings_equal_brute_force(spark):
    random_ = np.random.default_rng(3)
    centres = random_.standard_normal((40, 64))
    vectors, labels = [], []
    for i in range(900):
        c = i % 40
        vectors.append((centres[c] + random_.standard_normal(64) * random_.choice([0.02, 0.1, 0.15, 3])).astype(np.float32).tolist())
        labels.append(c % 4)
    vectors[5] = list(vectors[4])  # copies, of another label too
    labels[5] = labels[4]
    vectors[44] = list(vectors[4])
    odd = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] + vectors[0][1:], 0), (1003, vectors[0], None), (1004, [None] + vectors[0][1:], 0),
           (1005, vectors[0][:32], 0), (1006, [float("inf")] + vectors[0][1:], 0), (None, vectors[0], 0)]
    rows = [(i, v, k, "x", 1) for i, (v, k) in enumerate(zip(vectors, labels))] + [(*o, "x", 1) for o in odd]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string, usable int")
    got = {r["vec_id"]: r for r in embedding_dedup.link(frame, 0.93).collect()}
    unit = np.array(vectors)
    unit /= np.sqrt((unit ** 2).sum(1, keepdims=True))
    close = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(close, False)
    true = close.sum(1)
    found = np.array([got[i]["n_links"] for i in range(900)])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum() > 0
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006):
        assert tuple(got[i]) == (i, 0, i, True)
    assert tuple(got[None]) == (None, 0, None, True)
    component = smallest(range(900), [(a, b) for a, b in zip(*np.nonzero(close)) if a < b])
    assert sum(got[i]["component_id"] == component[i] for i in range(900)) >= 0.9 * 900
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(900))
    assert embedding_dedup.link(frame.limit(0), 0.93).collect() == []


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    random_ = np.random.default_rng(5)
    centre = random_.standard_normal(32)
    rows = [(i, (centre + random_.standard_normal(32) * 0.01).tolist(), 1) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = embedding_dedup.link(frame, 0.93)
    assert got.agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first() == (119, 119, 0)


def test_verify_gets_one_pair_a_document_of_a_group_of_copies(spark, documents, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:200 + k] + [f"own{k}"] + words[200 + k:]) for k in range(24)]
    asked, verify = [], ngram_join.verify

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verify", counted)
    rows = ngram_join.join(documents(texts), 4, 85, 100).collect()
    assert {r["component_id"] for r in rows} == {0}
    assert sum(asked) < 2 * len(texts)  # all pairs would be 276


def test_join_of_documents_apart_from_their_smallest_partner(spark, documents, monkeypatch):
    """A chain: 0 and 2 are no copies of each other but may be compared first; the links by way of 1 still join all."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([f"x{k}_{i}" if i < 6 * k else w for i, w in enumerate(words)]) for k in (0, 1, 2, 3)]
    chain = [" ".join([f"x{i}" if i < 8 * k else w for i, w in enumerate(words)]) for k in range(5)]
    for given in (texts, chain):
        sets = [{tuple(t.split()[i:i + 4]) for i in range(197)} for t in given]
        linked = [[100 * len(a & b) >= 85 * len(a | b) for b in sets] for a in sets]
        expected = list(range(len(given)))
        for _ in given:
            expected = [min(expected[j] for j in range(len(given)) if linked[i][j]) for i in range(len(given))]
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(documents(given), 4, 85, 100).collect()}
        assert [got[i] for i in range(len(given))] == expected


def test_shingles_of_many_texts_take_little_memory():
    import tracemalloc

    texts = [" ".join(f"w{(i * 7919 + k) % 5003}" for k in range(1000)) for i in range(600)]
    tracemalloc.start()
    sets = shingles.shingle_sets(texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sets) == 600 and peak < sum(s.nbytes for s in sets) + 30e6


def test_parts_of_the_signatures_grow_with_the_documents():
    assert ngram_join._buckets(1, 8) == 64 and ngram_join._buckets(1, 200) == 200
    assert ngram_join._buckets(5000, 8) == 2 * ngram_join._buckets(2500, 8)

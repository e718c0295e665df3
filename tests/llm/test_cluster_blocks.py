"""What moves and is compared of long texts and of large clusters."""

import random
from itertools import combinations

import pytest

from mailsieve.llm import ngram_join

from .test_links import shingle_set, smallest


def test_long_texts_are_read_once_for_their_wide_sketches(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = [" ".join(f"w{i}" for i in range(k, k + 1200)) for k in (0, 5, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").mapInArrow(seen, "doc_id long, text string")
    sizes = spark.createDataFrame([(i, 1197, b"") for i in range(3)], "a long, n long, packed binary")
    pairs = spark.createDataFrame([(1, 0), (2, 0)], "a long, b long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in ngram_join._sketched_wide(pairs, sizes, docs, 4, 85, 100).collect()] == [(1, 0)]
    assert read.value == 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def chained_corpus():
    """Texts that have a long passage in common, which chains them, and among them families whose members link only here and there."""
    rand = random.Random(5)
    line = " ".join(f"c{i}" for i in range(60))
    texts = [line + " " + " ".join(f"t{k}x{i}" for i in range(30)) for k in range(120)]
    for family in range(3):
        words = [f"f{family}y{i}" for i in range(60)]
        for _ in range(50):
            own = list(words)
            for _ in range(rand.randint(1, 5)):
                own[rand.randrange(60)] = f"e{rand.randrange(10**9)}"
            texts.append(line + " " + " ".join(own))
    rand.shuffle(texts)
    return texts


@pytest.mark.parametrize("few", [256, 1])
def test_only_documents_that_may_link_are_compared_by_blocks(documents, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    if few == 1:  # each rare shingle that two documents share is one of many: the tasks are given its function
        met = ngram_join._rare_met
        monkeypatch.setattr(ngram_join, "_rare_met", lambda num, den: met(num, den, few))
    compared, within = [], ngram_join._within_clusters

    def seen(clusters, *rest):
        compared.extend(r["n"] for r in clusters.groupBy("cluster").count().withColumnRenamed("count", "n").collect())
        return within(clusters, *rest)

    monkeypatch.setattr(ngram_join, "_within_clusters", seen)
    texts = chained_corpus()
    sets = [shingle_set(t, 5) for t in texts]
    edges = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert 100 < len(edges) < 3 * 50 * 49 // 2
    got = ngram_join.join(documents(texts).repartition(4), 5, 4, 5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == smallest(range(len(texts)), edges)
    assert not compared or max(compared) <= 50  # not the 270 that the passage chains


def test_documents_that_link_share_one_of_their_rarest_shingles(spark, documents):
    texts = chained_corpus()
    sets = [shingle_set(t, 5) for t in texts]
    edges = {(b, a) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    rows = spark.createDataFrame([(0, i, i, t) for i, t in enumerate(texts)], "cluster long, node long, own long, text string").repartition(3)
    rarity = spark.sparkContext.broadcast(ngram_join._rarity(rows, 5))
    met = ngram_join._prefixes(rows, rarity, 5, 4, 5, 8).groupBy("bucket").applyInArrow(ngram_join._rare_met(4, 5), "kind tinyint, a long, b long")
    assert edges <= {(r["a"], r["b"]) for r in met.filter("kind = 4").collect()}

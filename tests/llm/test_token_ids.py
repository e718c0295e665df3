import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from mailsieve.llm import byte_bpe, packing, repair_files, word_ids

WORDS = P.path("word_bpe_49k.json")
ODD = ["a\x1cb don't STOP.  ﬁ Σας é x́ <|endoftext|>hi,. 12'34", "", "　", "ß.,", "ŒUVRE.", "don'T.,", "\x00 a", "a.\x85b", "x_.", "x).", "µª º.",
       "1.2.3, 4.", "É.É,", "a\xa0b. c", "ÿ. Ÿ.", "a<b <| x", "日本語 한국어 😀", "word " * 5000, "a" * 20000]
DOCS = [(5, "The cat."), (3, None), (9, ""), (3, "the cat"), (None, "no id"), (7, "the cat sat on the mat. " * 900), (1, ODD[0]), (2, ODD[-2]), (2, ODD[-2])]


def whole_ids(text):
    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def test_word_ids_equal_the_library():
    random.seed(3)
    texts = ODD + ["".join(random.choice("ab.,'é1 _\n(!ÀsS<|") for _ in range(120)) for _ in range(200)]
    encoder = word_ids.WordIds(WORDS, limit=50)
    assert encoder.encode(texts) == [u32(whole_ids(t)) for t in texts]
    assert encoder.encode([]) == []


def test_rank_merges_equal_the_library_on_all_vocabulary_words():
    library = Tokenizer.from_file(WORDS)
    random.seed(11)
    words = sorted({t.removesuffix("</w>") for t in library.get_vocab()})
    words = [w for w in words if w.isalpha() and w.isascii()]
    words += [a + b for a, b in zip(random.choices(words, k=20000), random.choices(words, k=20000))]
    words += ["".join(random.choices("abcdeèéñöß", k=random.randint(1, 15))) for _ in range(20000)]
    assert word_ids.WordIds(WORDS).encode(words) == [u32(e.ids) for e in library.encode_batch_fast(words, add_special_tokens=False)]


def test_word_ids_refuse_other_vocabularies():
    with pytest.raises(ValueError):
        word_ids.WordIds(P.path("byte_bpe_50k.json"))


def test_byte_bpe_equals_tiktoken_and_round_trips():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    texts = ODD + ["=" * 5000, "\n\n\t x", "I'LL 's"] + ["".join(random.choice("abcdé =\n.AB日") for _ in range(200)) for _ in range(200)]
    codec = byte_bpe.MergeReplay(ranks, P.PATTERN, word_limit=100)
    ids = codec.encode(texts)
    assert ids == [u32(library.encode_ordinary(t)) for t in texts]
    assert [codec.decode(i) for i in ids] == [t.encode() for t in texts]


def test_byte_bpe_with_a_merge_that_opens_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258, b"ca": 259, b"abca": 260}
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    random.seed(5)
    texts = ["".join(random.choice("abc") for _ in range(random.randint(1, 30))) for _ in range(500)]
    assert byte_bpe.MergeReplay(ranks, r"\S+|\s+").encode(texts) == [u32(library.encode_ordinary(t)) for t in texts]


def test_byte_bpe_query(spark, documents, folder):
    rows = byte_bpe.op3_merge_replay_bpe(spark, folder(documents=documents(DOCS))).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = [(i, len(x := library.encode_ordinary(t or "")), hashlib.sha256(u32(x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                for i, t in DOCS]
    assert Counter(map(tuple, rows)) == Counter(expected)
    assert byte_bpe.encode_documents(documents([]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() == []


@pytest.mark.parametrize("ids", [[], [5], [0] * 999, [1, 2] * 700, list(range(300)) * 9, [7] * 65 + [8, 7, 7] * 40])
def test_repair_blocks_round_trip(ids):
    ids = np.array(ids, "<u4")
    block = repair_files.Block(repair_files.pack_block(ids))
    assert (block.all() == ids).all()
    for start in range(0, len(ids), 37):
        assert (block.ids(start, min(50, len(ids) - start)) == ids[start:start + 50]).all()


def test_repair_random_blocks_round_trip():
    random_ = np.random.default_rng(2)
    for n, top in ((4000, 3), (30000, 40), (5000, 70000)):
        ids = random_.integers(0, top, n).astype("<u4")
        block = repair_files.Block(repair_files.pack_block(ids))
        assert (block.all() == ids).all() and (block.ids(n // 2, 100) == ids[n // 2:n // 2 + 100]).all()
    assert len(repair_files.pack_block(np.tile(random_.integers(0, 9000, 200), 100).astype("<u4"))) < 100 * 200 / 2


def test_token_files_query(spark, documents, folder):
    rows = repair_files.op4_repair_token_files(spark, folder(documents=documents(DOCS))).collect()
    ordered = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    start, expected = 0, []
    for i, t in ordered:
        ids = whole_ids(t) + [2]
        expected.append((i, start, len(ids), zlib.crc32(u32(ids))))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected
    empty = repair_files.write_ids(documents([]), WORDS, 2)
    assert repair_files.read_documents(empty).collect() == []
    blocks = repair_files.write_ids(documents(DOCS), WORDS, 2, block_ids=100)
    whole = {(r["doc_id"], r["n_tokens"]): r["ids"] for r in repair_files.read_documents(blocks).collect()}
    assert whole[5, len(whole_ids("The cat.")) + 1] == u32(whole_ids("The cat.") + [2])


def placed(plan, counts):
    """Sequences as lists of (offset, length), from a plan's rows."""
    rows, out = sorted(plan.rows), defaultdict(list)
    for k, (length, first, sequence, each, offset) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
        for i in range(end - first):
            out[sequence + i // each].append((offset + i % each * length, length))
    return out


@pytest.mark.parametrize("seed,n", [(0, 0), (1, 1), (2, 60), (3, 5000)])
def test_packing_plan_is_whole_gapless_and_tight(seed, n):
    lengths = np.minimum(np.random.default_rng(seed).lognormal(6.5, 1, n).astype(int) + 1, packing.CAPACITY)
    counts = dict(Counter(lengths.tolist()))
    plan = packing.make_plan(counts)
    sequences = placed(plan, counts)
    assert Counter(x for s in sequences.values() for _, x in s) == Counter(lengths.tolist())
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) <= 1.02 * -(-lengths.sum() // packing.CAPACITY) + 1


def test_packing_counts_that_do_not_fit_together():
    for counts in ({2049: 1000}, {4096: 3, 1: 10}, {1366: 7, 1365: 5, 1: 1}, {3000: 50, 2000: 100, 1500: 7}):
        sequences = placed(packing.make_plan(counts), counts)
        assert sum(len(s) for s in sequences.values()) == sum(counts.values())


def test_packing_query(spark, documents, folder):
    rows = packing.op1_best_fit_packing(spark, folder(documents=documents(DOCS))).collect()
    expected = Counter()
    for i, t in DOCS:
        ids = whole_ids(t) + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            expected[i, piece, start, len(part), zlib.crc32(u32(part))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in held.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))] and sum(n for _, n in items) <= 4096
    assert packing.pack(documents([]), WORDS).collect() == []

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mailsieve.llm import concat_cut
from mailsieve.llm.byte_ids import ByteIds

PATH = P.path("byte_bpe_50k.json")
DOCS = [(5, "The cat."), (3, None), (9, ""), (3, "the cat"), (None, "no id"), (7, "the cat sat on the mat. " * 900), (1, "a\x1cb  x\n\n\ny <|endoftext|>z"),
        (2, "日本 ok."), (2, "日本 ok."), (8, "word, " * 9000)]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_byte_ids_equal_the_library():
    random.seed(3)
    texts = [None, "", "\n", "\n\nx", "x\n\n", " x", "x ", "it's.\nWe've, 12.5", "a" * 20000, "日本語 한국어 😀"]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 25))) for letters in ("ab.,'é1 _\n\n  (!À²ºsS<|\xad\t\xa0", "ab '\n.s1é ")
              for _ in range(3000)]
    library, own = Tokenizer.from_file(PATH), ByteIds(PATH, limit=300)  # few remembered, so that the memory is emptied often
    got = [x for at in range(0, len(texts), 50) for x in own.encode(pa.array(texts[at:at + 50], pa.string()))]
    assert [np.frombuffer(x, own.dtype).tolist() for x in got] == [ids_of(library, t) for t in texts]
    assert own.encode(pa.array([], pa.string())) == []


def test_byte_ids_refuse_other_vocabularies():
    with pytest.raises(ValueError):
        ByteIds(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("total", [0, 1, 2047, 2048, 2049, 5000, 8192, 3 * 2048 + 1023])
def test_windows_are_full_or_powers_of_two(total):
    windows = concat_cut.Windows(total)
    numbers = windows.number(np.arange(total))
    sizes = np.bincount(numbers) if total else []
    assert all(s == 2048 or s & (s - 1) == 0 for s in sizes) and (np.diff(numbers) >= 0).all()
    assert (windows.begin(numbers) == np.searchsorted(numbers, numbers)).all()


@pytest.mark.parametrize("window,parts", [(2048, 1), (2048, 4), (16, 7)])
def test_pieces_hold_each_id_once_without_padding(spark, documents, window, parts):
    library = Tokenizer.from_file(PATH)
    rows = concat_cut.pack(documents(DOCS).repartition(parts), PATH, window=window).collect()
    held, pieces = defaultdict(list), defaultdict(int)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for items in held.values():
        items.sort()
        filled = sum(n for _, n in items)
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))]
        assert filled == window or filled & (filled - 1) == 0
    expected = defaultdict(list)
    for doc_id, text in DOCS:
        expected[doc_id].append(ids_of(library, text) + [1])
    whole = defaultdict(int)
    for (doc_id, start, length, crc, n), times in pieces.items():
        assert any(len(x) == n and zlib.crc32(np.array(x[start:start + length], "<u4").tobytes()) == crc for x in expected[doc_id])
        whole[doc_id] += length * times
    assert whole == {i: sum(map(len, x)) for i, x in expected.items()}


def test_prefix_sums_over_many_tasks(spark):
    stream = spark.createDataFrame([(p, p % 5) for p in range(0, 5000, 3)] + [(6, 100)], "part int, n long")
    totals, at = defaultdict(int), 0
    for p in range(0, 5000, 3):
        totals[p] += p % 5 + (100 if p == 6 else 0)
    got = dict(map(tuple, concat_cut.task_offsets(stream).collect()))
    for p in sorted(totals):
        assert got[p] == at
        at += totals[p]


def test_query_on_an_empty_table(spark, documents, folder):
    assert concat_cut.op11_concatenate_and_cut(spark, folder(documents=documents([]))).collect() == []

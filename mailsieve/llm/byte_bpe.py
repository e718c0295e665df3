"""Byte-level BPE by merge replay over a corpus of distinct words.

A text is cut into words by the vocabulary's pattern.  The words that a task
has not met yet form a corpus; an inverted index from each mergeable pair to
its positions in that corpus drives the merges: pairs come up in rank order,
all their positions are merged at once, and only the two neighbours of each
merged place are looked up again.  Texts are then encoded by word.

Which neighbours merge depends on the bytes of both together, so the index is
kept by the rank of the joined bytes.  Where a merge makes a pair of a lower
rank than the present one (possible in such tables, though rare), the order
within the word matters: such a word is encoded alone, place by place.

Edge cases: a null or empty text has no ids; a word of any length is merged
whole; repeated rows are encoded as often as they occur; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keep_only, table, text_slices

SLICE_CHARS = 6_000_000  # texts whose new words make one corpus
WORD_LIMIT = 400_000  # words that a worker remembers

_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encoder and decoder for one rank table and word pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, word_limit: int = WORD_LIMIT):
        import regex

        self.cut = regex.compile(pattern).findall
        self.pieces = [b""] * (max(ranks.values()) + 1)
        keys, joined = [], []
        for token, rank in ranks.items():
            self.pieces[rank] = token
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    joined.append(rank)
        order = np.argsort(keys)
        self.keys, self.joined = np.array(keys, np.int64)[order], np.array(joined, np.int32)[order]
        self.pairs = dict(zip(keys, joined))
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.word_limit = word_limit

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.joined[at], _NONE)

    def _alone(self, word: bytes) -> list[int]:
        """One word, merging the leftmost pair of least rank each time."""
        ids = self.bytes_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pair = lambda p: self.pairs.get(ids[p] << 32 | ids[after[p]]) if p >= 0 and after[p] < len(ids) else None
        heap = [(r, p) for p in range(len(ids)) if (r := pair(p)) is not None]
        heapq.heapify(heap)
        alive = [True] * len(ids)
        while heap:
            rank, p = heapq.heappop(heap)
            if not alive[p] or pair(p) != rank:
                continue
            q = after[p]
            ids[p], alive[q], after[p] = rank, False, after[q]
            if after[p] < len(ids):
                before[after[p]] = p
            for x in (before[p], p):
                if (r := pair(x)) is not None:
                    heapq.heappush(heap, (r, x))
        return [i for i, a in zip(ids, alive) if a]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, 4 bytes an id, little-endian."""
        text = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        n = len(text)
        ids = self.bytes_ids[text]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends - 1], before[ends - sizes] = -1, -1
        rank = np.full(n, _NONE)  # of the pair that begins at a place; none at a dead place
        alive = np.ones(n, bool)
        at = np.flatnonzero(after >= 0)
        rank[at] = self._rank(ids[at], ids[after[at]])
        at = at[rank[at] != _NONE]
        index: dict[int, list[int]] = {}
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, cuts) if len(at) else []:
            index[int(rank[part[0]])] = part.tolist()
        heap = list(index)
        heapq.heapify(heap)
        apart: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            places = np.array(index.pop(r), np.int32)
            places = places[rank[places] == r]
            if not len(places):
                continue
            left = before[places]
            if ((left >= 0) & (rank[left] == r)).any():  # overlapping places: leftmost first
                places = np.unique(places)
                taken: set[int] = set()
                for p, q in zip(places.tolist(), before[places].tolist()):
                    if q not in taken:
                        taken.add(p)
                places = np.array(sorted(taken), np.int32)
            gone = after[places]
            ids[places] = r
            alive[gone] = False
            rank[gone] = _NONE
            follow = after[gone]
            after[places] = follow
            ahead = follow >= 0
            before[follow[ahead]] = places[ahead]
            rank[places[~ahead]] = _NONE
            left = before[places]
            changed = np.concatenate((places[ahead], left[left >= 0]))
            if not len(changed):
                continue
            fresh = self._rank(ids[changed], ids[after[changed]])
            if fresh.min() < r:
                lower = np.unique(word[changed[fresh < r]])
                apart.update(lower.tolist())
                for w in lower.tolist():
                    rank[ends[w] - sizes[w]:ends[w]] = _NONE
                keep = ~np.isin(word[changed], lower)
                changed, fresh = changed[keep], fresh[keep]
            rank[changed] = fresh
            some = fresh != _NONE
            for f, p in zip(fresh[some].tolist(), changed[some].tolist()):
                if f in index:
                    index[f].append(p)
                else:
                    index[f] = [p]
                    heapq.heappush(heap, f)
        raw = ids[alive].astype("<u4").tobytes()
        stops = 4 * np.cumsum(np.bincount(word[alive], minlength=len(words)))
        starts = np.concatenate(([0], stops[:-1])).tolist()
        out = [raw[a:b] for a, b in zip(starts, stops.tolist())]
        for w in apart:
            out[w] = np.array(self._alone(words[w]), "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, 4 bytes an id, little-endian."""
        cut = [self.cut(t) for t in texts]
        fresh: set[str] = set()
        for words in cut:
            fresh.update(words)
        fresh.difference_update(self.known)
        if len(self.known) + len(fresh) > self.word_limit:
            fresh.update(*cut)
            self.known = {}
        if fresh:
            new = list(fresh)
            self.known.update(zip(new, self.replay([w.encode() for w in new])))
        ids = self.known.__getitem__
        return [b"".join(map(ids, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_REPLAYS: dict[str, MergeReplay] = {}


def merge_replay(path: str, pattern: str) -> MergeReplay:
    """The worker process's encoder for a rank file."""
    if path not in _REPLAYS:
        _REPLAYS[path] = MergeReplay(read_ranks(path), pattern)
    return _REPLAYS[path]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary) of every document; ids are 4 bytes each, little-endian."""
    return _encoded(docs, path, pattern, lambda codec, ids: (ids,), [("ids", pa.binary())], "doc_id long, ids binary")


def _encoded(docs: DataFrame, path: str, pattern: str, make, fields: list, schema: str) -> DataFrame:
    arrow = pa.schema([("doc_id", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = merge_replay(path, pattern)
        for batch in batches:
            for at, texts in text_slices(batch, "text", SLICE_CHARS):
                rows = [make(codec, ids) for ids in codec.encode(texts)]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)).cast(pa.int64()), *columns], schema=arrow)

    return keep_only(docs, "doc_id", "text").mapInArrow(run, schema)


def op3_merge_replay_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 3: every document's ids and the bytes they decode to, as digests."""
    import public_tokenizers

    def digests(codec: MergeReplay, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                    public_tokenizers.PATTERN, digests,
                    [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())],
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

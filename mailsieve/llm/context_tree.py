"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision (a prefix of the byte's bits)
has a context tree over the preceding bytes, down to DEPTH of them.  A node
holds how often the decision was 0 and 1 after its context; its
Krichevsky-Trofimov estimate is weighted against its children's by the
context-tree recursion, bottom up, from the counts of all training texts.  A
text's code length is then fixed by its byte n-grams (DEPTH bytes and the next).
A context that training never met has no estimate; its weight stays with the
longest one that was met.  Texts are in lower case (A-Z) and end with an end
mark, so probabilities are over whole texts.

The work follows the n-grams, not the positions.  Texts are gathered in chunks;
a chunk sends each distinct n-gram and word once, with its training count, in
packed arrays to buckets.  A bucket holds whole subtrees (all n-grams with the
same last two context bytes, hashed), adds the chunks' counts and weighs its
nodes; the two upper levels, at most 65,792 nodes whatever the corpus, are
weighed from the buckets' sums and broadcast.  Buckets answer each chunk with
the log probabilities in the order in which it asked, and the chunk adds them up
per document.  The base model's word counts take the same way.

Edge cases: a null or empty text is the end mark alone; a null doc_id belongs to
the training rows; without training rows every decision has probability 1/2;
repeated rows are counted and scored as often as they occur; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, materialize, table
from .shingles import mixed, word_hashes

DEPTH = 5  # context bytes
CHUNK_BYTES = 16_000_000  # text of a chunk
WINDOW = 2_000_000  # positions handled at once
END = 255  # end mark, and what stands before a text; no byte of UTF-8
_END_WORD = np.uint64(0x5851F42D4C957F2D)  # stands for the end token among word hashes


# ---- arrays -------------------------------------------------------------------------------

def _packed(array: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts[order], at)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0."""
    shift = np.zeros_like(x)
    low = x < 8
    y = np.where(low, x + 8, x)
    product = np.ones_like(x)
    for k in range(8):
        product *= np.where(low, x + k, 1.0)
    shift = np.log(product)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - 1.1447298858494002


def _weighed(estimate: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Log of half the estimate plus half the children's product."""
    return np.logaddexp(estimate, below) - 0.6931471805599453


def _stop(estimate: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate against its children."""
    return 1 / (1 + np.exp(np.clip(below - estimate, -700, 700)))


class _Level:
    """The nodes of one context length in a bucket, for one decision each of eight."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, context_bytes: int):
        drop = np.uint64(8 * (DEPTH - context_bytes) + 8)
        own = keys >> drop << np.uint64(8) | keys & np.uint64(255) if context_bytes < DEPTH else keys
        if context_bytes < DEPTH:
            self.keys, back = np.unique(own, return_inverse=True)
            self.counts = np.bincount(back, weights=counts, minlength=len(self.keys))
            self.back = back  # row of each n-gram
        else:
            self.keys, self.counts, self.back = keys, counts.astype(float), None

    def decision(self, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node names, zeros, ones, node of each row, bit of each row) of one decision."""
        names = self.keys >> np.uint64(8 - bit)
        begins = np.concatenate(([True], names[1:] != names[:-1]))
        at, node = np.flatnonzero(begins), np.cumsum(begins) - 1
        bits = (self.keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        total = np.add.reduceat(self.counts, at)
        ones = np.add.reduceat(np.where(bits, self.counts, 0.0), at)
        return names[at], total - ones, ones, node, bits


def _parents(names: np.ndarray, bit: int, context_bytes: int, parent_bytes: int) -> np.ndarray:
    """Names of the nodes with a shorter context that the nodes belong to."""
    context, prefix = names >> np.uint64(bit), names & np.uint64((1 << bit) - 1)
    return context >> np.uint64(8 * (context_bytes - parent_bytes)) << np.uint64(bit) | prefix


def subtree_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a bucket adds to the nodes of one context byte: (name, zeros, ones, log weight of the children).

    A name is the context byte, then a 1 and the prefix of the byte's bits.
    """
    levels = {d: _Level(keys, counts, d) for d in range(2, DEPTH + 1)}
    out = []
    for bit in range(8):
        names, zeros, ones, _, _ = levels[DEPTH].decision(bit)
        weight = _estimate(zeros, ones)
        for d in range(DEPTH - 1, 1, -1):
            up, zeros, ones, _, _ = levels[d].decision(bit)
            below = np.bincount(np.searchsorted(up, _parents(names, bit, d + 1, d)), weights=weight, minlength=len(up))
            weight, names = _weighed(_estimate(zeros, ones), below), up
        up, back = np.unique(_parents(names, bit, 2, 1), return_inverse=True)
        sums = [np.bincount(back, weights=v, minlength=len(up)) for v in (zeros, ones, weight)]
        context, prefix = up >> np.uint64(bit), up & np.uint64((1 << bit) - 1)
        out.append((context << np.uint64(8) | np.uint64(1 << bit) | prefix, *sums))
    return tuple(np.concatenate(c) for c in zip(*out))


class Upper:
    """The two upper levels: probability of a one and stop weight, by context byte and decision."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        grid = np.zeros((3, 256, 256))
        for plane, values in zip(grid, (zeros, ones, below)):
            plane[(names >> 8).astype(int), (names & 255).astype(int)] = values
        zeros1, ones1, below1 = grid
        estimate1 = _estimate(zeros1, ones1)
        self.one = (ones1 + 0.5) / (zeros1 + ones1 + 1)
        self.stop = _stop(estimate1, below1)
        self.seen = zeros1 + ones1 > 0
        zeros0, ones0 = zeros1.sum(0), ones1.sum(0)
        below0 = np.where(self.seen, _weighed(estimate1, below1), 0.0).sum(0)
        self.one0 = (ones0 + 0.5) / (zeros0 + ones0 + 1)
        self.stop0 = _stop(_estimate(zeros0, ones0), below0)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, upper: Upper) -> np.ndarray:
    """Log10 probability of each n-gram's last byte after the others; keys sorted and distinct."""
    levels = {d: _Level(keys, counts, d) for d in range(2, DEPTH + 1)}
    last = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
    byte = (keys & np.uint64(255)).astype(np.int64)
    out = np.zeros(len(keys))
    for bit in range(8):
        found = {}
        names, weight = None, None
        for d in range(DEPTH, 1, -1):
            own, zeros, ones, node, bits = levels[d].decision(bit)
            estimate = _estimate(zeros, ones)
            if d == DEPTH:
                weight, stop = estimate, np.ones(len(own))
            else:
                below = np.bincount(np.searchsorted(own, _parents(names, bit, d + 1, d)), weights=weight, minlength=len(own))
                weight, stop = _weighed(estimate, below), _stop(estimate, below)
            names = own
            one = (ones + 0.5) / (zeros + ones + 1)
            seen = zeros + ones > 0
            rows = np.where(bits, one[node], 1 - one[node]), stop[node], seen[node]
            found[d] = rows if levels[d].back is None else tuple(r[levels[d].back] for r in rows)
        p, met, _ = found[DEPTH][0], found[DEPTH][2], None
        for d in range(DEPTH - 1, 1, -1):
            own, stop, seen = found[d]
            p = np.where(met, stop * own + (1 - stop) * p, own)
            met = seen
        decision = 1 << bit | byte >> (8 - bit)
        ones_here = (byte >> (7 - bit) & 1).astype(bool)
        one, stop = upper.one[last, decision], upper.stop[last, decision]
        own = np.where(ones_here, one, 1 - one)
        p = np.where(met, stop * own + (1 - stop) * p, own)
        one, stop = upper.one0[decision], upper.stop0[decision]
        own = np.where(ones_here, one, 1 - one)
        p = np.where(upper.seen[last, decision], stop * own + (1 - stop) * p, own)
        out += np.log10(p)
    return out


# ---- chunks -------------------------------------------------------------------------------

def _windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, places in the joined texts, and the joined texts' begin and end mark of each text) piece by piece."""
    pad = bytes([END]) * DEPTH
    joined = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    stops = np.cumsum([len(t) + DEPTH + 1 for t in texts])
    starts = np.concatenate(([0], stops[:-1])) + DEPTH
    inside = np.ones(len(joined), bool)
    for k in range(1, DEPTH + 1):
        inside[starts - k] = False
    for a in range(DEPTH, len(joined), WINDOW):
        b = min(a + WINDOW, len(joined))
        key = joined[a:b].astype(np.uint64)
        for k in range(1, DEPTH + 1):
            key |= joined[a - k:b - k].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
        place = np.flatnonzero(inside[a:b])
        yield key[place], place + a, starts, stops


def _ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts and their counts."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for key, _, _, _ in _windows(texts) if texts else ():
        k, n = _distinct(key)
        keys, counts = _summed(np.concatenate((keys, k)), np.concatenate((counts, n)))
    return keys, counts


def _words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, words of each text) of runs of texts, WINDOW bytes or one text each."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text)
        if held >= WINDOW:
            yield word_hashes(run)
            run, held = [], 0
    if run:
        yield word_hashes(run)


def _word_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of the texts, the end token among them, and their counts."""
    keys, counts = np.array([_END_WORD]), np.array([len(texts)], np.int64)
    for hashes, _ in _words(texts):
        k, n = _distinct(hashes)
        keys, counts = _summed(np.concatenate((keys, k)), np.concatenate((counts, n)))
    return keys, counts


def _with_training(all_keys: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(all_keys), np.int64)
    out[np.searchsorted(all_keys, keys)] = counts
    return out


def _buckets_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key: of n-grams (kind 0) by the two last context bytes, of words (kind 1) by the hash."""
    if kind == 0:
        return (mixed(keys >> np.uint64(8 * (DEPTH - 1))) % np.uint64(buckets)).astype(np.int32)
    return (keys % np.uint64(buckets)).astype(np.int32) + np.int32(buckets)


def _asked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and distinct words of a chunk."""
    return _ngrams(texts)[0], _word_counts(texts)[0]


def _chunks(docs: DataFrame, held_out: Column, buckets: int) -> DataFrame:
    """Chunk rows (chunk, doc_ids, held, sizes, texts) and what they send (chunk, bucket, keys, counts)."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
                        ("texts", pa.binary()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def flush(chunk: int, ids: list, held: list[bool], texts: list[bytes]) -> pa.RecordBatch:
        rows = [{"chunk": chunk, "doc_ids": ids, "held": held, "sizes": [len(t) for t in texts],
                 "texts": _packed(np.frombuffer(b"".join(texts), np.uint8))}]
        learnt = [t for t, h in zip(texts, held) if not h]
        unseen = [t for t, h in zip(texts, held) if h]
        for kind, count in enumerate((_ngrams, _word_counts)):
            known, counts = count(learnt)
            keys = np.unique(np.concatenate((known, count(unseen)[0])))
            counts = _with_training(keys, known, counts)
            bucket = _buckets_of(kind, keys, buckets)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for k, n in zip(np.split(keys, cuts), np.split(counts, cuts)):
                if len(k):
                    rows.append({"chunk": chunk, "bucket": int(_buckets_of(kind, k[:1], buckets)[0]), "keys": _packed(k), "counts": _packed(n.astype("<u4"))})
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(c) for c in ("doc_id", "held", "text"))):
                raw = (text.as_py() or "").encode("utf-8", "replace").lower()
                ids.append(doc_id.as_py())
                held.append(out.as_py())
                texts.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield flush(chunk, ids, held, texts)
                    chunk, ids, held, texts, size = chunk + 1, [], [], [], 0
        if ids:
            yield flush(chunk, ids, held, texts)

    narrow = keep_only(docs, "doc_id", "text").withColumn("held", held_out)
    return narrow.mapInArrow(run, "chunk long, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, texts binary, "
                                  "bucket int, keys binary, counts binary")


def _received(rows: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """A bucket's rows: chunks, the keys of each, and all distinct keys with their counts."""
    chunks = rows.column("chunk").to_pylist()
    keys = [_unpacked(k.as_py(), "<u8") for k in rows.column("keys")]
    counts = [_unpacked(c.as_py(), "<u4").astype(np.int64) for c in rows.column("counts")]
    return chunks, keys, *_summed(np.concatenate(keys), np.concatenate(counts))


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and code length per byte of every document."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_rows = materialize(_chunks(docs, held_out, buckets), "chunks")
    sent = all_rows.filter("bucket is not null").select("chunk", "bucket", "keys", "counts")

    def sums(rows: pa.Table) -> pa.Table:
        _, _, keys, counts = _received(rows)
        if rows.column("bucket")[0].as_py() >= buckets:  # words: distinct ones and tokens of training
            name, zeros, ones, below = np.array([-1]), np.array([(counts > 0).sum()]), np.array([counts.sum()]), np.zeros(1)
        else:
            name, zeros, ones, below = subtree_sums(keys, counts)
        return pa.table({"name": pa.array(name.astype(np.int64)), "zeros": pa.array(zeros.astype(np.float64)),
                         "ones": pa.array(ones.astype(np.float64)), "below": pa.array(below)})

    upper_rows = (sent.groupBy("bucket").applyInArrow(sums, "name long, zeros double, ones double, below double")
                  .groupBy("name").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
                  .toArrow())  # 65,281 rows at most: context byte and decision, and one for the words
    name, zeros, ones, below = (upper_rows.column(c).to_numpy() for c in ("name", "zeros", "ones", "below"))
    words = name < 0
    vocabulary, tokens = int(zeros[words].sum()), int(ones[words].sum())
    upper = spark.sparkContext.broadcast(Upper(*(v[~words] for v in (name, zeros, ones, below))))

    def answers(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        chunks, asked, keys, counts = _received(rows)
        value = log_probabilities(keys, counts, upper.value).astype("<f4") if bucket < buckets else counts.astype("<u4")
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int32()),
                         "values": pa.array([_packed(value[np.searchsorted(keys, k)]) for k in asked], pa.binary())})

    answered = sent.groupBy("bucket").applyInArrow(answers, "chunk long, bucket int, values binary")
    chunks = (all_rows.filter("bucket is null")
              .select(F.col("chunk").alias("of"), "doc_ids", "held", "sizes", "texts"))

    def add_up(chunk: pa.Table, values: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        raw = _unpacked(row["texts"], "u1").tobytes()
        ends = np.cumsum(row["sizes"]).tolist()
        texts = [raw[b - n:b] for b, n in zip(ends, row["sizes"])]
        told = dict(zip(values.column("bucket").to_pylist(), values.column("values").to_pylist()))
        answer = []
        for kind, keys in enumerate(_asked(texts)):
            bucket = _buckets_of(kind, keys, buckets)
            order = np.argsort(bucket, kind="stable")
            got = np.concatenate([_unpacked(told[b], "<f4" if kind == 0 else "<u4") for b in np.unique(bucket).tolist()])
            value = np.empty(len(keys))
            value[order] = got
            answer.append((keys, value))
        (ngrams, logs), (known, counts) = answer
        score = np.zeros(len(texts))
        for key, place, starts, stops in _windows(texts):
            running = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(ngrams, key)])))
            first, last = np.searchsorted(place, starts), np.searchsorted(place, stops)
            score += running[last] - running[first]
        base = np.log10((counts + 1) / (tokens + vocabulary + 1))
        end = int(np.searchsorted(known, _END_WORD))
        sums, number, met = [], [], []
        for hashes, per_text in _words(texts):
            at = np.searchsorted(known, hashes)
            cuts = np.concatenate(([0], np.cumsum(per_text)))
            for out, values_ in ((sums, base[at]), (met, (counts[at] > 0).astype(float))):
                running = np.concatenate(([0.0], np.cumsum(values_)))
                out.append(running[cuts[1:]] - running[cuts[:-1]])
            number.append(per_text)
        sums_, number_, met_ = (np.concatenate(v) if v else np.zeros(0) for v in (sums, number, met))
        n_known = np.round(met_).astype(np.int64) + int(counts[end] > 0)
        size = np.array(row["sizes"], np.int64)
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": pa.array(number_.astype(np.int64) + 1), "n_known": pa.array(n_known),
            "train_tokens": pa.array([tokens] * len(texts), pa.int64()), "base_score": pa.array(sums_ + base[end]),
            "score": pa.array(score), "bits_per_byte": pa.array(-score * 3.321928094887362 / (size + 1))})

    return (chunks.groupBy("of").cogroup(answered.groupBy("chunk"))
            .applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double, bits_per_byte double"))


def op10_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 10: every text's scores, learnt outside the held-out fold."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_documents(table(spark, sf_dir, "documents"), held)

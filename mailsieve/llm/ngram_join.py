"""Exact Jaccard join of documents' word shingles by partitioned signatures.

Sets are grouped into size bands whose limits grow by the inverse of the
similarity, so a partner is in the same or the next band.  For a band, the
hashed universe is cut into as many segments as the largest difference that a
pair may have, plus one: then at least one segment must be equal (pigeonhole).
A set's signatures are its non-empty segments, hashed as sets.

Segments with few elements say little and would collide for unrelated sets.
Segments 2q and 2q+1 share an allowance of two, spent by a fixed rule (LIGHT), not
by cost; frequencies of signatures are not looked at.  Normally they have one each
(either may be equal), but where one of them is that light, both on their union,
which then may differ by one element: its one-deletion neighbourhood is indexed.
A set whose lighter segment has one element more emits the same signatures, as
its partner may have decided so.

Signatures travel in packed arrays.  Documents of a signature that few share
(SMALL) are paired with each other; where more do, each meets the smallest one,
already in its task.  A pair goes on if its sizes allow the similarity and so do
the documents' sketches: parities of hashed shingles, in which as many bits
differ as elements do at most, for two large sets again with as many bits as they
have shingles.  Exact overlaps of whole texts decide, of one pair of
each document first and then of those still in two components, and linked documents
form components.  For signatures of many documents that are not all in
one component by then, the documents that such signatures connect meet again by
their rarest shingles: two that link have one in common, whatever the order that
tells what is rare (counts in a bounded sample do).  Documents of different
components that meet and whose sizes and sketches allow the similarity, or that
more than FEW bring together, form smaller clusters, and within these they are compared
across components, by blocks, exactly, and only pairs that share a rare shingle.
So no link between components is lost, and large groups of copies are never
made pairs.  Texts are moved only of documents that a bit filter of bounded size
takes for members of pairs.

Edge cases: a text without words is empty and linked with nothing; with fewer
words than a shingle the whole sequence is one; a null doc_id has no component;
rows with one doc_id are one node; exact copies are linked in the task that
reads them; an empty table gives no rows; other columns are ignored by `join`
and kept by `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, drop_shuffles, input_mb, keep_only, materialize, release, small_batches, table, text_slices
from .components import components
from .shingles import mixed, overlap, shingle_sets

LIGHT = 0  # elements of a segment up to which a pair's allowance goes to the union
SMALL = 32  # documents that share a signature up to which all are paired
SKETCH_BITS = 1024  # parities kept of a set
SIGNATURES = 500_000  # signatures that a task packs at once
BUCKETS = 64  # parts of the signatures, at least
SIGNATURE_BYTES = 5  # of a signature that go to its bucket
BUCKET_MB, MOST_BUCKETS = 4, 1 << 13  # of documents that a part is for
SLICE = 500_000  # characters of texts that are signed at once
COPIES = 50_000  # texts of a task among which exact copies are found before they are signed
FILTER_WORDS = 1 << 20  # 64-bit words of a filter at most
LONG = 100  # texts that go to Python at once where they may be long ones
SKETCHES = 256  # pairs whose sketches are compared at once
MEMBERS = 64  # documents that are compared with one in one group
LARGE = 1 << 20  # bytes of a group's texts from which its memory is given back at once
BLOCK = 1024  # documents of a block of a cluster
COUNTERS = 1 << 21  # counts of shingles by which the rare ones of a set are told
COUNTED = 8192  # documents whose shingles are counted for that, about: they give an order only
FEW = 256  # documents of a rare shingle up to which all are paired


class Scheme:
    """Bands and segments for a similarity of num / den."""

    def __init__(self, num: int, den: int, light: int = LIGHT):
        self.num, self.den, self.light = num, den, light
        self.limits = [1]

    def band(self, size: int) -> int:
        """The band of a set of this size: limits[band] <= size < limits[band + 1]."""
        while self.limits[-1] <= size:
            self.limits.append(max(self.limits[-1] + 1, self.limits[-1] * self.den // self.num + 1))
        return int(np.searchsorted(self.limits, size, "right")) - 1

    def segments(self, band: int) -> int:
        """Number of segments, even unless it is one: more than any linked pair whose larger set is in the band differs by."""
        self.band(self.limits[-1] + 1) if len(self.limits) < band + 2 else None
        most = 2 * (self.limits[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        return 1 if not most else most + 1 + (most + 1) % 2

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        """Signatures of a set (distinct 64-bit hashes), under its own band and the next."""
        band = self.band(len(hashes))
        return np.concatenate([self._signatures(hashes, b) for b in (band, band + 1)])

    def _signatures(self, hashes: np.ndarray, band: int) -> np.ndarray:
        m = self.segments(band)
        salt = np.uint64((band + 1) * 0xA24BAED4963EE407 % 2**64)
        segment = ((hashes >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # hashes are sorted, so segments are too
        value = mixed(hashes ^ salt)
        count = np.bincount(segment, minlength=m)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        ends = np.cumsum(count)
        total = sums[ends] - sums[ends - count]
        number = np.arange(m, dtype=np.uint64)
        some = count > 0
        out = [mixed(total[some] + mixed(salt + number[some]))]
        if m > 1:
            light = np.flatnonzero(np.minimum(count[::2], count[1::2]) <= self.light + 1)
            if len(light):
                union = total[2 * light] + total[2 * light + 1]
                tag = mixed(salt + np.uint64(1 << 40) + light.astype(np.uint64))
                out.append(mixed(union + tag))
                sizes = count[2 * light] + count[2 * light + 1]
                begin = ends[2 * light] - count[2 * light]
                at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                out.append(mixed(np.repeat(union, sizes) - value[at] + np.repeat(tag, sizes)))
        return np.concatenate(out)


@cache
def _scheme(num: int, den: int) -> Scheme:
    return Scheme(num, den)


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    common = overlap(a, b)
    return den * common >= num * (len(a) + len(b) - common)


def sketch(hashes: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the elements that each bit stands for (their number is a power of two)."""
    at = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_sketch(hashes: np.ndarray) -> bytes:
    """A sketch of as many bits as the set has elements, or up to twice as many: SKETCH_BITS say little of large sets."""
    return sketch(hashes, max(SKETCH_BITS, 1 << max(len(hashes) - 1, 0).bit_length()))


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (a row each) as they would be with `size` bytes: a bit of a shorter one stands for neighbours of a longer one."""
    if x.shape[1] == size:
        return x
    bits = np.unpackbits(x, axis=1).reshape(len(x), size * 8, -1)
    return np.packbits(np.bitwise_xor.reduce(bits, axis=2), axis=1)


def may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes n and m with sketches x and y (a row each) can be similar enough: differing bits are differing elements."""
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (apart * (den + num) <= (n + m) * (den - num))


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is among the (distinct) ids, and a few others: one bit an id in a filter of at most FILTER_WORDS words."""
    words = 1 << max(6, min(FILTER_WORDS, ids.count() // 4 + 1).bit_length())

    def at(column: str):
        return (F.pmod(F.shiftright(F.xxhash64(column), 6), F.lit(words)).alias("_word"),
                F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 AS int))"))

    word, bit = at(ids.columns[0])
    bits = ids.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = at("doc_id")
    near = docs.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
    return near.filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_bits")


def _signed(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """Sizes, links of exact copies within a task, and packed signatures by bucket.

    Row kinds: 0 a document (a, n, sketch in packed); 1 a link (a, b); 3 packed signatures of a
    bucket; 4 a pair to be verified (a, b); 6 a document and the smallest one of a signature that many share (a, b).
    """
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("bucket", pa.int32()),
                        ("packed", pa.binary())])

    def rows(**columns) -> pa.RecordBatch:
        n = max(len(c) for c in columns.values() if not isinstance(c, int))
        arrays = []
        for f in schema:
            c = columns.get(f.name)
            arrays.append(pa.nulls(n, f.type) if c is None else pa.array([c] * n if isinstance(c, int) else c, f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = _scheme(num, den)
        held: list[tuple[np.ndarray, int, int]] = []  # signatures, id and size of documents
        first: dict[bytes, int] = {}
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in text_slices(batch, "text", SLICE):
                ids = doc_ids[at:at + len(texts)]
                sets = shingle_sets(texts, width)
                yield rows(kind=0, a=ids, n=[len(s) for s in sets], packed=[sketch(s) for s in sets])
                copies: list[tuple[int, int]] = []
                first = first if len(first) < COPIES else {}
                for doc_id, s in zip(ids, sets):
                    if doc_id is None or not len(s):
                        continue
                    same = first.setdefault(s.tobytes() if len(s) < 64 else s[:2].tobytes() + mixed(s).sum(dtype=np.uint64).tobytes()
                                            + s.sum(dtype=np.uint64).tobytes() + len(s).to_bytes(8, "little"), doc_id)
                    if same != doc_id:
                        copies.append((doc_id, same))
                        continue
                    held.append((scheme.signatures(s), doc_id, len(s)))
                if copies:
                    yield rows(kind=1, a=[c for c, _ in copies], b=[c for _, c in copies])
                if sum(len(x) for x, _, _ in held) >= SIGNATURES:
                    yield from packed_rows(held)
                    held = []
        yield from packed_rows(held)
        release()

    def packed_rows(held: list[tuple[np.ndarray, int, int]]) -> Iterator[pa.RecordBatch]:
        """Stars of signatures that many of these documents share, and the signatures that go on, by bucket."""
        if not held:
            return
        sig = np.concatenate([x for x, _, _ in held])
        doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x, _, _ in held])
        doc_id, size = (np.array([h[c] for h in held], np.int64) for c in (1, 2))
        order = np.lexsort((doc_id[doc], sig))
        sig, doc = sig[order], doc[order]
        lead, count = _groups(sig)  # where many share a signature, just so many go to the other tasks that it counts as such there too
        if (count > SMALL).any():
            many = np.repeat(count > SMALL, count)
            for kind, pairs in _stars(doc_id[doc[many]], size[doc[many]], *_groups(sig[many]), num, den).items():
                if len(pairs):
                    yield rows(kind=kind, a=pairs[:, 0], b=pairs[:, 1])
            stay = np.arange(len(sig)) - np.repeat(lead, count) <= SMALL
            sig, doc = sig[stay], doc[stay]
        bucket = (sig % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((doc, bucket))
        sig, doc, bucket = sig[order], doc[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        packed, names = [], []
        for k in range(buckets):
            x, y = cuts[k], cuts[k + 1]
            if x < y:
                of, counts = np.unique(doc[x:y], return_counts=True)
                head = np.array([len(of)], "<i8").tobytes()
                packed.append(b"".join((head, doc_id[of].tobytes(), size[of].astype("<i4").tobytes(),
                                        counts.astype("<i4").tobytes(), _short(sig[x:y]))))
                names.append(k)
        yield rows(kind=3, bucket=names, packed=packed)

    return keep_only(docs, "doc_id", "text").mapInArrow(
        run, "kind tinyint, a long, b long, n long, bucket int, packed binary")


def _short(sig: np.ndarray) -> bytes:
    """The first SIGNATURE_BYTES bytes of signatures: in a bucket few are equal by chance, and then only bring a pair too many."""
    return sig.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES].tobytes()


def _signatures_of(packed: bytes) -> np.ndarray:
    """The signatures, as numbers of SIGNATURE_BYTES bytes."""
    n = int(np.frombuffer(packed, "<i8", 1)[0])
    short = np.frombuffer(packed, np.uint8, -1, 8 + 16 * n).reshape(-1, SIGNATURE_BYTES)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, -SIGNATURE_BYTES:] = short
    return wide.view(">u8").ravel().astype(np.uint64)


def _shared(packed: bytes, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the signatures that are among the (sorted) shared ones, and the documents and set sizes of each."""
    n = int(np.frombuffer(packed, "<i8", 1)[0])
    ids = np.frombuffer(packed, "<i8", n, 8)
    sizes = np.frombuffer(packed, "<i4", n, 8 + 8 * n)
    counts = np.frombuffer(packed, "<i4", n, 8 + 12 * n)
    sig = _signatures_of(packed)
    at = np.searchsorted(shared, sig)
    keep = np.flatnonzero(np.append(shared, sig[:1])[at] == sig) if len(shared) else np.zeros(0, np.int64)
    keep = keep[at[keep] < len(shared)]
    of = np.searchsorted(np.cumsum(counts), keep, "right")
    return sig[keep], ids[of], sizes[of]


def _groups(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values."""
    lead = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    return lead, np.diff(np.append(lead, len(sig)))


def _fit(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * np.minimum(n, m) >= num * np.maximum(n, m)


def _stars(doc: np.ndarray, size: np.ndarray, lead: np.ndarray, count: np.ndarray, num: int, den: int) -> dict[int, np.ndarray]:
    """Distinct pairs of each run's documents with its first: all as kind 6, those whose sizes allow the similarity as kind 4 too."""
    first = np.repeat(lead, count)
    a, b, apart = doc, doc[first], doc != doc[first]
    close = _fit(size, size[first], num, den)
    return {kind: np.unique(np.stack((a[keep], b[keep]), 1), axis=0) for kind, keep in ((4, apart & close), (6, apart))}


def _pairs(doc: np.ndarray, size: np.ndarray, lead: np.ndarray, count: np.ndarray, num: int, den: int,
           most: int = SMALL, own: np.ndarray | None = None) -> np.ndarray:
    """Distinct pairs (larger id, smaller id) within runs of at most `most` documents, as far as the sizes allow the similarity and the components differ."""
    out = [np.zeros((0, 2), np.int64)]
    own = doc if own is None else own
    place = np.where(np.repeat(count <= most, count), np.arange(len(doc)) - np.repeat(lead, count), 0)
    for step in range(1, most):  # each document and the one `step` places before it
        keep = np.flatnonzero(place >= step)
        if not len(keep):
            break
        x, y = doc[keep], doc[keep - step]
        good = (own[keep] != own[keep - step]) & _fit(size[keep], size[keep - step], num, den)
        out.append(np.unique(np.stack((np.maximum(x, y)[good], np.minimum(x, y)[good]), 1), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def _buckets(mb: float, partitions: int) -> int:
    """Number of parts of the signatures: it grows with the documents, for a task holds a part at once."""
    return max(BUCKETS, partitions, min(MOST_BUCKETS, int(mb / BUCKET_MB)))


def _met(num: int, den: int):
    """Function of a bucket's rows: the pairs of documents that signatures bring together."""

    def run(table_: pa.Table) -> pa.Table:
        packed = [p.as_py() for p in table_.column("packed")]
        values = np.sort(np.concatenate([_signatures_of(p) for p in packed]))
        shared = np.unique(values[1:][values[1:] == values[:-1]])  # most signatures are one document's
        del values
        sig, doc, size = (np.concatenate(c) for c in zip(*[_shared(p, shared) for p in packed]))
        del packed
        order = np.lexsort((doc, sig))
        sig, doc, size = sig[order], doc[order], size[order].astype(np.int64)
        lead, count = _groups(sig)
        many = np.repeat(count > SMALL, count)
        found = _stars(doc[many], size[many], *_groups(sig[many]), num, den)
        found[4] = np.unique(np.concatenate((found[4], _pairs(doc, size, lead, count, num, den))), axis=0)
        del sig, doc, size
        release()
        return pa.table({"kind": pa.array(np.repeat(list(found), [len(p) for p in found.values()]), pa.int8()),
                         **{c: pa.array(np.concatenate([p[:, i] for p in found.values()])) for i, c in enumerate("ab")}})

    return run


def _sketched(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity.  Rows that repeat a doc_id have a sketch each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m, p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b", "s_a", "s_b"))
                sizes_ = np.array([(len(x), len(y)) for x, y in zip(p, q)])
                good = np.zeros(len(n), bool)
                for of_a, of_b in np.unique(sizes_, axis=0).tolist():
                    alike = np.flatnonzero((sizes_ == (of_a, of_b)).all(axis=1))
                    for first in range(0, len(alike), SKETCHES):
                        at = alike[first:first + SKETCHES]
                        x, y = (folded(np.frombuffer(b"".join(s[at]), np.uint8).reshape(len(at), -1), min(of_a, of_b)).view(np.uint64) for s in (p, q))
                        good[at] = may_link(n[at], m[at], x, y, num, den)
                yield batch.select(["a", "b"]).filter(pa.array(good))
        release()

    for side in "ab":
        mine = sizes.select(F.col("a").alias(side), F.col("n").alias(f"n_{side}"), F.col("packed").alias(f"s_{side}"))
        pairs = pairs.join(mine.hint("merge"), side)  # by shuffles at every size: either side grows with the documents
    return pairs.mapInArrow(run, "a long, b long").distinct()


def _wide_sketches(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(a, n, packed), written: size and wide sketch of all texts of the documents among the (distinct) ids, and of a few others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, "text", SLICE):
                sets = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([wide_sketch(s) for s in sets], pa.binary())], ["a", "n", "packed"])
        release()

    near = likely(keep_only(docs, "doc_id", "text"), ids).select("doc_id", "text")
    with small_batches(docs.sparkSession, LONG):  # these texts may be the long ones
        return materialize(near.mapInArrow(run, "a long, n long, packed binary"), "wide-sketches")


def _sketched_wide(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), those of two large sets only if sketches as long as the sets allow the similarity too: they are much shorter than the texts."""
    large = sizes.filter(F.col("n") > SKETCH_BITS).select("a").distinct()
    both = materialize(pairs.join(large.hint("merge"), "a").join(large.withColumnRenamed("a", "b").hint("merge"), "b").select("a", "b"), "large-pairs")
    if not both.limit(1).count():
        return pairs
    ids = both.select("a").unionByName(both.select(F.col("b").alias("a"))).distinct()
    # all texts of an id, whatever their size, have a sketch here; both sides of the pairs read it
    wide = _wide_sketches(docs, ids, width)
    with small_batches(docs.sparkSession):
        kept = materialize(_sketched(both, wide, num, den), "able")
    return pairs.join(both.hint("merge"), ["a", "b"], "left_anti").unionByName(kept)


def _close_pairs(sets: list[np.ndarray], group: list[int], side: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of sets that link, as far as they join groups; with two sides, pairs across them.

    Exact by prefixes: with values in the order of their frequency, rare first,
    two sets that link share a value among the first (1 - similarity) part of
    each.  Near copies have their edits there, so few of their pairs meet.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, value, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((value, uses[value], owner))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = order[place < np.repeat(sizes - -(-num * sizes // den) + 1, sizes)]
    keep = keep[np.lexsort((owner[keep], value[keep]))]
    value, owner = value[keep], owner[keep]
    parent = {g: g for g in group}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    crossing, seen, out = len(set(side)) > 1, set(), []
    cuts = np.flatnonzero(np.diff(value)) + 1
    for part in np.split(owner, cuts):
        met = part.tolist()
        for k, x in enumerate(met):
            for y in met[k + 1:]:
                if (crossing and side[x] == side[y]) or root(group[x]) == root(group[y]) or (x, y) in seen:
                    continue
                seen.add((x, y))
                if _similar(sets[x], sets[y], num, den):
                    parent[root(group[x])] = root(group[y])
                    out.append((x, y))
    return out


def _rarity(texts: DataFrame, width: int) -> np.ndarray:
    """How often these texts have shingles of each of COUNTERS parts of the hashes, up to 65,535 times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for _, part in text_slices(batch, "text", SLICE):
                at, n = np.unique(_part(np.concatenate(shingle_sets(part, width))), return_counts=True)
                total[at] += n.astype(np.int32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["part", "n"])
        release()

    seen = texts.select("text").mapInArrow(run, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    out = np.ones(COUNTERS, np.uint16)
    out[seen.column("part").to_numpy()] = np.minimum(seen.column("n").to_numpy(), 65535)
    return out


def _part(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(COUNTERS)).astype(np.int64)


def _prefixes(texts: DataFrame, rarity, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """(bucket, packed): the rarest shingles of each set, so many that two sets which link have one of them in common; with its document, component and size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "node", "own")]
            for at, part in text_slices(batch, "text", SLICE):
                sets = shingle_sets(part, width)
                sizes = np.array([len(s) for s in sets])
                value = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets)), sizes)
                order = np.lexsort((value, rarity.value[_part(value)], owner))
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = order[place < np.repeat(sizes - -(-num * sizes // den) + 1, sizes)]
                cluster, node, own = (c[at:at + len(sets)][owner[keep]] for c in columns)
                held.append((mixed(value[keep] ^ mixed(cluster.astype(np.uint64))), node, own, sizes[owner[keep]]))
            if sum(len(h[0]) for h in held) >= SIGNATURES:
                yield packed(held)
                held = []
        if held:
            yield packed(held)
        release()

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        value, node, own, size = (np.concatenate(c) for c in zip(*held))
        bucket = (value % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((node, bucket))
        value, node, own, size, bucket = (c[order] for c in (value, node, own, size, bucket))
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        rows = [b"".join((np.array([y - x], "<i8").tobytes(), node[x:y].astype("<i8").tobytes(), own[x:y].astype("<i8").tobytes(),
                          size[x:y].astype("<i4").tobytes(), _short(value[x:y]))) for x, y in zip(cuts[some], cuts[some + 1])]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "packed"])

    return texts.mapInArrow(run, "bucket int, packed binary")


def _unpacked(packed: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(packed, "<i8", 1)[0])
    wide = np.zeros((n, 8), np.uint8)
    wide[:, -SIGNATURE_BYTES:] = np.frombuffer(packed, np.uint8, -1, 8 + 20 * n).reshape(-1, SIGNATURE_BYTES)
    return (wide.view(">u8").ravel().astype(np.uint64), np.frombuffer(packed, "<i8", n, 8), np.frombuffer(packed, "<i8", n, 8 + 8 * n),
            np.frombuffer(packed, "<i4", n, 8 + 16 * n).astype(np.int64))


def _rare_met(num: int, den: int, few: int = FEW):
    """Function of a bucket's rows: the pairs of documents of two components that share one of their rarest shingles (kind 4),
    and, where more than `few` share it, each and the first one (kind 6)."""

    def run(table_: pa.Table) -> pa.Table:
        value, node, own, size = (np.concatenate(c) for c in zip(*[_unpacked(p.as_py()) for p in table_.column("packed")]))
        order = np.lexsort((node, own, value))
        value, node, own, size = (c[order] for c in (value, node, own, size))
        lead, count = _groups(value)
        apart = np.repeat(own[lead] != own[lead + count - 1], count)  # the others' documents are in one component, or alone
        value, node, own, size = (c[apart] for c in (value, node, own, size))
        if not len(value):
            return pa.table({c: pa.array([], t) for c, t in (("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()))})
        lead, count = _groups(value)
        many = np.repeat(count > few, count)
        found = {4: _pairs(node, size, lead, count, num, den, few, own)}
        if many.any():
            found[6] = _stars(node[many], size[many], *_groups(value[many]), num, den)[6]
        release()
        return pa.table({"kind": pa.array(np.repeat(list(found), [len(p) for p in found.values()]), pa.int8()),
                         **{c: pa.array(np.concatenate([p[:, i] for p in found.values()])) for i, c in enumerate("ab")}})

    return run


def _narrowed(clusters: DataFrame, found: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """(node, cluster): smaller clusters in which all links between components of the given ones are.

    Signatures of many chain documents that have little but a common line in
    common; here only those stay together that share rare shingles and may link."""
    spark = docs.sparkSession
    named = clusters.join(found.withColumnRenamed("component", "own"), "node", "left").select("cluster", "node", F.coalesce("own", "node").alias("own"))
    open_ = named.groupBy("cluster").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high").select("cluster")
    members = materialize(named.join(open_, "cluster"), "members")

    def texts(some: DataFrame) -> DataFrame:
        near = likely(keep_only(docs, "doc_id", "text"), some.select("node").distinct())
        return near.join(some, F.col("doc_id") == F.col("node")).select("cluster", "node", "own", "text")

    every = max(1, members.count() // COUNTED)
    with small_batches(spark):
        rarity = spark.sparkContext.broadcast(_rarity(texts(members.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)), width))
        prefixes = materialize(_prefixes(texts(members), rarity, width, num, den, buckets), "prefixes")
    met = materialize(prefixes.groupBy("bucket").applyInArrow(_rare_met(num, den), "kind tinyint, a long, b long").distinct(), "rare-met")
    discard(prefixes)
    rarity.destroy()
    able = materialize(_sketched(met.filter("kind = 4").select("a", "b"), sizes, num, den), "able")
    drop_shuffles(spark)
    able = _sketched_wide(able, sizes, docs, width, num, den)
    return components(able.unionByName(met.filter("kind = 6").select("a", "b"))).select("node", F.col("component").alias("cluster"))


def _within_clusters(clusters: DataFrame, found: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links that join components of documents whose signatures connect them, by blocks of clusters."""
    named = (clusters.join(found.withColumnRenamed("component", "own"), "node", "left")
             .select("cluster", "node", F.coalesce("own", "node").alias("own")))
    open_ = (named.groupBy("cluster").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n"))
             .filter("low <> high").select("cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    members = (named.join(open_, "cluster")
               .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")))
    members = materialize(members, "open")
    texts = likely(keep_only(docs, "doc_id", "text"), members.select("node").distinct()).join(members.hint("merge"), F.col("doc_id") == F.col("node"))
    placed = (texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("cluster", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "own", "text"))

    def compare(rows: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for batch in rows.combine_chunks().to_batches():
            for _, part in text_slices(batch, "text"):
                sets += shingle_sets(part, width)
        node, own, side = (rows.column(c).to_pylist() for c in ("node", "own", "part"))
        mixed_block = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        pairs = _close_pairs(sets, own, side, num, den) if not mixed_block or len(set(side)) > 1 else []
        del sets
        if rows.nbytes > LARGE:
            release()
        return pa.table({"a": pa.array([node[x] for x, _ in pairs], pa.int64()), "b": pa.array([node[y] for _, y in pairs], pa.int64())})

    return placed.groupBy("cluster", "low", "high").applyInArrow(compare, "a long, b long")


def verify(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, by their whole texts.

    Documents compared with one and the same are split into groups of about
    MEMBERS, each with a copy of that one's text.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("parts"))
    texts = likely(keep_only(docs, "doc_id", "text"), pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct())
    split = pairs.join(groups, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts").cast("long")).cast("int"))
    members = split.select("a", "b", "part").join(texts.withColumnRenamed("doc_id", "a").hint("merge"), "a").select("b", "part", "a", "text")
    leads = (groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .join(texts.withColumnRenamed("doc_id", "b").hint("merge"), "b")
             .select(F.col("b").alias("lead"), F.col("part").alias("share"), F.col("text").alias("lead_text")))

    def compare(lead: pa.Table, member: pa.Table) -> pa.Table:
        out: set[tuple[int, int]] = set()
        if lead.num_rows and member.num_rows:
            leads_ = shingle_sets([t.as_py() or "" for t in lead.column("lead_text")], width)
            b = lead.column("lead")[0].as_py()
            for batch in member.combine_chunks().to_batches():
                for at, part in text_slices(batch, "text"):
                    for a, s in zip(batch.column("a")[at:at + len(part)], shingle_sets(part, width)):
                        if any(_similar(s, x, num, den) for x in leads_):
                            out.add((a.as_py(), b))
        if lead.nbytes + member.nbytes > LARGE:
            release()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return leads.groupBy("lead", "share").cogroup(members.groupBy("b", "part")).applyInArrow(compare, "a long, b long")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents are not in one component yet."""
    for side in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("component").alias(f"in_{side}")), side, "left")
    return pairs.filter(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b")


def join(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; documents link at a similarity of num / den."""
    spark = docs.sparkSession
    buckets = _buckets(input_mb(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    with small_batches(spark):
        signed = materialize(_signed(docs, width, num, den, buckets), "signatures")
    met = materialize(signed.filter("kind = 3").select("bucket", "packed").groupBy("bucket")
                      .applyInArrow(_met(num, den), "kind tinyint, a long, b long")
                      .unionByName(signed.filter("kind > 3").select("kind", "a", "b")).distinct(), "met")
    rows = materialize(signed.filter("kind < 2").select("kind", "a", "b", "n", "packed"), "rows")
    discard(signed)  # the packed signatures are done with
    copies = rows.filter("kind = 1").select("a", "b")

    # first round: pairs of signatures of a few documents, and stars of those of many
    able = materialize(_sketched(met.filter("kind = 4").select("a", "b"), rows.filter("kind = 0"), num, den), "able")
    drop_shuffles(spark)  # of sketches, a pair's each
    able = materialize(_sketched_wide(able, rows.filter("kind = 0"), docs, width, num, den), "able")
    drop_shuffles(spark)
    # texts are compared with one other each, and then only where that has not joined the two yet: groups of copies have few links verified
    one = able.groupBy("a").agg(F.min("b").alias("b"))
    links = materialize(copies.unionByName(verify(one, docs, width, num, den)), "links")
    found = materialize(components(links), "components")
    rest = materialize(_apart(able.join(one, ["a", "b"], "left_anti"), found), "rest")
    drop_shuffles(spark)  # of texts
    if rest.limit(1).count():
        links = materialize(links.unionByName(verify(rest, docs, width, num, den)), "links")
        found = materialize(components(links), "components")

    # second round: documents that signatures of many connect, however indirectly, but no link yet
    stars = met.filter("kind = 6").select("a", "b")
    if stars.limit(1).count():
        clusters = components(stars).select("node", F.col("component").alias("cluster"))
        clusters = _narrowed(clusters, found, rows.filter("kind = 0"), docs, width, num, den, buckets)
        drop_shuffles(spark)
        late = materialize(_within_clusters(clusters, found, docs, width, num, den), "links")
        if late.limit(1).count():
            found = components(links.unionByName(late))
    sizes = rows.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"))
    return (sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def filter_documents(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents less all of each group of near copies but the one of smallest id; rows without words or id stay."""
    gone = join(docs, width, num, den).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def op5_partition_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 5: four words, a similarity of 85 in 100."""
    return join(table(spark, sf_dir, "documents"), width=4, num=85, den=100)

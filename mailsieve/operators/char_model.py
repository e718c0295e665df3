"""Character bigrams as packed counts.

A bigram is one long, `first code point << 21 | second`.  Tasks turn Arrow
batches of texts into arrays of these codes, so counting sends one row per
distinct code and batch through the shuffle, and scoring looks every code up in
a sorted array: no row, and no exchange, carries a position of a text.

The smoothed model is ln((c_ab + 1) / (c_a + V)), V being the distinct
characters.  Counts are additive.  Given a fold column, one table of counts
yields the model of every training part: its counts are the total less the
fold's own.  Training and scoring use the same rule; a pair that was never seen
has c_ab = 0, an unknown first character c_a = 0.

Where the characters are few their pairs are counted and looked up in a dense
table, without a sort.  A model of up to PACKED codes travels with the task; a larger one (an alphabet
of ideographs has many pairs) is joined to per-text histograms instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT = 21
ALONE = (1 << SHIFT) - 1  # second half of the code of a text of one character: counts towards V only
PACKED = 4_000_000  # codes of a model that is sent to the tasks: 8 bytes and 8 more per variant each
DENSE = 4_000_000  # entries of a table over all pairs of the characters met; of more characters, codes are sorted
_SLICE = 8_000_000  # bytes of text turned into codes at once


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // _SLICE
    firsts = np.flatnonzero(np.append(True, size[1:] != size[:-1])).tolist() if len(texts) else []
    for first, end in zip(firsts, [*firsts[1:], len(texts)]):
        yield first, texts.slice(first, end - first)


def text_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of every pair of neighbouring code points of each text, and of each single character."""
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    inside = row[:-1] == row[1:]
    pairs = (points[:-1] << SHIFT | points[1:])[inside]
    alone = length == 1
    codes = np.append(pairs, points[np.repeat(alone, length)] << SHIFT | ALONE)
    return codes, np.append(row[:-1][inside], np.flatnonzero(alone))


def code_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and how often each is there."""
    first, second = codes >> SHIFT, codes & ALONE
    met = np.zeros(ALONE + 1, bool)
    met[first], met[second] = True, True
    points = np.flatnonzero(met)
    if len(points) ** 2 > min(DENSE, 4 * len(codes)):
        return np.unique(codes, return_counts=True)
    place = np.zeros(ALONE + 1, np.int64)
    place[points] = np.arange(len(points))
    n = np.bincount(place[first] * len(points) + place[second], minlength=len(points) ** 2)
    found = np.flatnonzero(n)
    return points[found // len(points)] << SHIFT | points[found % len(points)], n[found]


def bigram_counts(docs: DataFrame, text: Column, fold: Column | None = None) -> DataFrame:
    """(fold, code, n): counts of the codes of all texts, by fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for at, texts in _slices(batch.column("text")):
                codes, row = text_codes(texts)
                of = folds[at:at + len(texts)][row]
                for f in np.unique(of).tolist():
                    code, n = code_counts(codes[of == f])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), f, np.int32)), pa.array(code), pa.array(n.astype(np.int64))],
                                                     ["fold", "code", "n"])

    rows = docs.select(F.coalesce(fold, F.lit(-1)).cast("int").alias("fold") if fold is not None else F.lit(-1).alias("fold"), text.alias("text"))
    return rows.mapInArrow(run, "fold int, code long, n long").groupBy("fold", "code").agg(F.sum("n").alias("n"))


def _without(column: str, variant: int | None) -> Column:
    """A sum over all folds but one (None: over all)."""
    whole = F.sum(column)
    return whole if variant is None else whole - F.sum(F.when(F.col("fold") == variant, F.col(column)).otherwise(0))


class CharModel:
    """Log probabilities of codes, one column a variant: of all folds (None), or of all but the one named.

    `pairs` (code, lp) and `unseen` (a, lp for pairs of `a` not met) are tables;
    `unknown` is the value for a character not met.
    """

    def __init__(self, pairs: DataFrame, unseen: DataFrame, unknown: Sequence[float]):
        self.pairs, self.unseen, self.unknown = pairs, unseen, list(unknown)

    @classmethod
    def of(cls, counts: DataFrame, variants: Sequence[int | None] = (None,)) -> CharModel:
        names = [f"c{i}" for i in range(len(variants))]
        per = counts.groupBy("code").agg(*[_without("n", v).alias(c) for c, v in zip(names, variants)]).withColumn("a", F.shiftright("code", SHIFT))
        per = per.withColumn("b", F.col("code").bitwiseAND(ALONE))
        seen = (per.select(F.explode(F.array("a", "b")).alias("ch"), *names).filter(F.col("ch") != ALONE)
                .groupBy("ch").agg(*[F.max((F.col(c) > 0).cast("int")).alias(c) for c in names]))
        alphabet = [float(x or 0) for x in seen.agg(*[F.sum(c) for c in names]).first()]
        pairs = per.filter(F.col("b") != ALONE)
        contexts = pairs.groupBy("a").agg(*[F.sum(c).alias(f"a_{c}") for c in names])
        smooth = [F.greatest(F.col(f"a_{c}") + F.lit(v), F.lit(1.0)) for c, v in zip(names, alphabet)]
        lp = F.array(*[F.log((F.col(c) + 1) / s) for c, s in zip(names, smooth)])
        return cls(pairs.join(contexts, "a").select("code", lp.alias("lp")),
                   contexts.select("a", F.array(*[-F.log(s) for s in smooth]).alias("lp")),
                   [-float(np.log(max(v, 1.0))) for v in alphabet])

    def add_means(self, docs: DataFrame, text_col: str, id_col: str, out: str = "_m") -> DataFrame:
        """The rows with `out`: each variant's mean log probability of the text's pairs (null: it has none)."""
        if self.pairs.limit(PACKED + 1).count() > PACKED:
            return self._joined(docs, text_col, id_col, out)
        return self._packed(docs, text_col, out)

    def _arrays(self) -> tuple[np.ndarray, ...]:
        packed = []
        for table, key in ((self.pairs, "code"), (self.unseen, "a")):
            found = table.toArrow()
            keys = found.column(key).to_numpy()
            lp = found.column("lp").combine_chunks().flatten().to_numpy().reshape(len(keys), -1) if len(keys) else np.zeros((0, len(self.unknown)))
            order = np.argsort(keys)
            packed += [keys[order], lp[order]]
        return tuple(packed)

    def _packed(self, docs: DataFrame, text_col: str, out: str) -> DataFrame:
        keys, lps, contexts, unseen = self._arrays()
        unknown = np.array(self.unknown)

        def look(sorted_keys, values, wanted):
            place = np.minimum(np.searchsorted(sorted_keys, wanted), max(len(sorted_keys) - 1, 0))
            hit = sorted_keys[place] == wanted if len(sorted_keys) else np.zeros(len(wanted), bool)
            return hit, values[place[hit]]

        points = np.unique(np.concatenate([keys >> SHIFT, keys & ALONE, contexts]))
        dense = (len(points) + 1) ** 2 * len(unknown) <= DENSE

        def table() -> tuple[np.ndarray, np.ndarray]:
            """The place of every code point (0: not met), and the values by variant and pair of places."""
            place, width = np.zeros(ALONE + 1, np.int64), len(points) + 1
            place[points] = np.arange(1, width)
            values = np.empty((len(unknown), width, width))
            values[:] = unknown[:, None, None]
            values[:, place[contexts]] = unseen.T[:, :, None]
            values[:, place[keys >> SHIFT], place[keys & ALONE]] = lps.T
            return place, values.reshape(len(unknown), -1)

        def valued(codes: np.ndarray, built) -> Iterator[np.ndarray]:
            """The value of each code, a variant after the other."""
            if built is not None:
                place, values = built
                at = place[codes >> SHIFT] * (len(points) + 1) + place[codes & ALONE]
                yield from (v[at] for v in values)
                return
            code, where = np.unique(codes, return_inverse=True)
            value = np.tile(unknown, (len(code), 1))
            for sorted_keys, of, wanted in ((contexts, unseen, code >> SHIFT), (keys, lps, code)):
                hit, found = look(sorted_keys, of, wanted)
                value[hit] = found
            yield from (value[where, v] for v in range(len(unknown)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built = table() if dense else None
            for batch in batches:
                sums, n = np.zeros((batch.num_rows, len(unknown))), np.zeros(batch.num_rows, np.int64)
                for at, texts in _slices(batch.column(text_col)):
                    codes, row = text_codes(texts)
                    paired = codes & ALONE != ALONE
                    row = at + row[paired]
                    n += np.bincount(row, minlength=len(n))
                    for v, value in enumerate(valued(codes[paired], built)):
                        sums[:, v] += np.bincount(row, value, len(n))
                mean = pa.array((sums / np.maximum(n, 1)[:, None]).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(unknown)), mean)
                lists = pc.if_else(pa.array(n > 0), lists, pa.nulls(len(n), lists.type))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

        schema = docs.withColumn(out, F.lit(None).cast("array<double>")).schema
        return docs.mapInArrow(run, schema)

    def _joined(self, docs: DataFrame, text_col: str, id_col: str, out: str) -> DataFrame:
        """The same from histograms: one row per text and distinct code."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(id_col)
                for at, texts in _slices(batch.column(text_col)):
                    codes, row = text_codes(texts)
                    paired = codes & ALONE != ALONE
                    code, where = np.unique(codes[paired], return_inverse=True)
                    both, n = np.unique(row[paired] * len(code) + where, return_counts=True) if len(code) else (np.array([], np.int64),) * 2
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at + both // max(len(code), 1))), pa.array(code[both % max(len(code), 1)]), pa.array(n.astype(np.int64))],
                        [id_col, "code", "n"])

        kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, code long, n long")
        rows = rows.join(self.pairs, "code", "left").join(self.unseen.select(F.col("a"), F.col("lp").alias("lp_a")),
                                                          F.shiftright("code", SHIFT) == F.col("a"), "left")
        lp = F.coalesce("lp", "lp_a", F.array(*[F.lit(u) for u in self.unknown]))
        sums = [F.sum(F.col("n") * lp[v]) / F.sum("n") for v in range(len(self.unknown))]
        return docs.join(rows.groupBy(id_col).agg(F.array(*sums).alias(out)), id_col, "left")

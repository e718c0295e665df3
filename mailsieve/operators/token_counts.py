"""Counts of tokens where the texts are: Arrow batches of token lists, a few million tokens at once.

What a task sends on is a row per text and distinct token, or per group and
distinct token, never one per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_TOKENS = 2_000_000  # tokens counted at once


def _counts(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(row, code, number, terms by code) of the distinct tokens of each list, slice by slice."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // _TOKENS
    firsts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(size) else []
    for first, end in zip(firsts, [*firsts[1:], len(size)]):
        tokens = lists.slice(first, end - first).flatten().dictionary_encode()
        codes, terms = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(tokens.dictionary), 1)
        both, n = np.unique(np.repeat(np.arange(first, end), size[first:end]) * terms + codes, return_counts=True)
        yield both // terms, both % terms, n.astype(np.int64), tokens.dictionary


def count_by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a last column of token lists -> a row per text and distinct token, with its number."""
    for batch in batches:
        *kept, lists = batch.columns
        for row, code, n, terms in _counts(lists):
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in kept], terms.take(pa.array(code)), pa.array(n)],
                                             [*batch.schema.names[:-1], "term", "tf"])


def _count_by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, code, n, terms in _counts(batch.column(1)):
            both, where = np.unique(groups[row] * max(len(terms), 1) + code, return_inverse=True)
            texts, tokens = np.bincount(where, minlength=len(both)), np.bincount(where, n, len(both)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((both // max(len(terms), 1)).astype(np.int32)), terms.take(pa.array(both % max(len(terms), 1))),
                 pa.array(texts.astype(np.int64)), pa.array(tokens)], ["y", "term", "df", "cf"])


def group_counts(texts: DataFrame, text_col: str, group: Column) -> DataFrame:
    """(y, term, df, cf): texts that hold a token, and its occurrences, by group (a small number, 0 or more); sums are still to be taken."""
    rows = texts.select(group.cast("int").alias("y"), T.tokenize(F.col(text_col)).alias("_tokens"))
    return rows.mapInArrow(_count_by_group, "y int, term string, df long, cf long")

"""Which of very many terms a text contains.

`functions.features.keyword_hits` tests each term of a short list by itself.
For lists of 10^5 terms an Aho-Corasick automaton finds all of them in one run
over a text, in Arrow batches; overlapping terms, and terms inside longer ones,
each count.  The list is cut into blocks of about BLOCK_CHARS characters, an
automaton each, so a task's memory does not grow with the list; a block adds its
hits to the same column, and all blocks run in the same narrow stage.

A term counts once however often it stands in the list or the text; null terms
are no terms; the empty term is in every text.  Null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 4_000_000


def term_blocks(terms: Sequence[str], block_chars: int) -> Iterator[list[str]]:
    block, held = [], 0
    for term in terms:
        block.append(term)
        held += len(term)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


_AUTOMATA: dict[int, tuple[list[str], ahocorasick.Automaton]] = {}


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """The automaton of a list; a worker process keeps the one it used last."""
    key = hash(tuple(terms))
    if key not in _AUTOMATA or _AUTOMATA[key][0] != terms:
        built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in enumerate(terms):
            built.add_word(term, number)
        built.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = terms, built
    return _AUTOMATA[key][1]


def count_terms(df: DataFrame, text_col: str, terms: list[str], hits_col: str) -> DataFrame:
    """Add to `hits_col` how many of the (distinct, not empty) terms each text contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(terms).iter
        for batch in batches:
            found = [len({number for _, number in find(text.as_py() or "")}) for text in batch.column(text_col)]
            at = batch.schema.get_field_index(hits_col)
            hits = pa.array(batch.column(at).to_numpy(zero_copy_only=False) + np.array(found, np.int64))
            yield batch.set_column(at, hits_col, hits)

    return df.mapInArrow(run, df.schema)


def lexicon_hits(df: DataFrame, text_col: str, lexicon: DataFrame, term_col: str = "term", hits_col: str = "hits",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`df` with the number of distinct terms of the lexicon that the text contains.

    The list passes through the driver block by block, in the order of a range
    partitioning by term; only one block is held at a time."""
    listed = lexicon.select(F.col(term_col).alias("t")).filter("t is not null").distinct()
    empty = listed.filter("t = ''").count()
    out = df.withColumn(hits_col, F.lit(empty).cast("long"))
    terms = (r["t"] for r in listed.filter("t <> ''").orderBy("t").toLocalIterator())
    for block in term_blocks(terms, block_chars):
        out = count_terms(out, text_col, block, hits_col)
    return out


def lexicon_density(df: DataFrame, text_col: str, lexicon: DataFrame, term_col: str = "term") -> DataFrame:
    """`df` with `hits` and `density`, the hits per character of the text."""
    out = lexicon_hits(df, text_col, lexicon, term_col)
    return out.withColumn("density", F.col("hits") / F.greatest(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1)))

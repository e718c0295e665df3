"""Per-mail feature expressions (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .urls import url_structure_features


def keyword_hits(text: Column, lexicon=K.LEXICON_FULL35) -> Column:
    """Number of distinct lexicon words contained in the text; overlapping
    words (a word inside a longer one) each count."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.array(*[F.lit(w) for w in lexicon]), lambda w: t.contains(w)))


def keyword_density(text: Column, lexicon=K.LEXICON_FULL35) -> Column:
    """Lexicon words present / max(length, 1); stored as `subjectivity`."""
    t = F.coalesce(text, F.lit(""))
    return keyword_hits(t, lexicon) / F.greatest(F.length(t), F.lit(1))


def url_features(urls: Column) -> list[Column]:
    return [c.alias(name) for name, c in url_structure_features(urls).items()]

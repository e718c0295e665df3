"""Ids of whole texts by the tokenizers library, computed once per unseen word.

The vocabulary files meant here drop white space before the merges, so a text's
ids are the ids of its white-space separated chunks, one after the other.  The
encoder keeps the ids of chunks that it has met and gives only unseen ones to the
library, many in one call; unseen words of letters alone are merged by tiktoken
under the same merges, the end of a word being a byte that no text here holds.
Splitting, the search for distinct chunks and the
joining of ids work on whole Arrow arrays of texts.  A vocabulary for which that
does not hold is refused when the encoder is made.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .byte_ids import bytes_of_symbols

# Latin-1 texts whose normal form and case map character by character, and that are split alike here and in the library
_PLAIN = r"\A[\t-\r -~\xa1-\xff]*\z"
# after a letter or digit, a point or comma before white space is a piece of its own
_POINT = (r"([0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff])([.,])([\t-\r ]|\z)", r"\1 \2\3")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split() splits there, the library does not
_SPECIAL = "<|"  # begins a special token
_MARK = "\x00"  # stands between chunks of several pieces; never part of a plain chunk
_END = "\x00"  # ends a word in the text that tiktoken merges
_WORDS = 2000  # words merged in one call
_TOGETHER = 500  # chunks given to the library as one text


def _rank_merge(model: dict, suffix: str):
    """(function from words, each followed by _END, to ranks; the id of each rank) of a BPE model with word ends."""
    import tiktoken

    symbols = {c: bytes([b]) for c, b in bytes_of_symbols().items()}
    real, ranks = [], {}

    def add(token: str) -> None:
        word = token.endswith(suffix)
        text = b"".join(symbols[c] for c in (token[:-len(suffix)] if word else token)) + (_END.encode() if word else b"")
        ranks[text] = len(real)
        real.append(model["vocab"][token])

    for token in [*symbols, *(c + suffix for c in symbols), *(m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"])]:
        add(token)
    if len(ranks) != len(real):
        raise ValueError("two merges make one token")
    encoding = tiktoken.Encoding("own", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, np.array(real, "<u4")


class WordIds:
    """Encoder for one vocabulary file; `limit` bounds the chunks it remembers."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores; threads here would only hold memory
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec))
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        probe = "It's  soÉt, 42x　ü!.\nEnd <|endoftext|>a"
        if not suffix or self._ids(self.whole, probe) != [i for c in probe.split() for i in self._ids(self.whole, c)]:
            raise ValueError(f"{path}: the ids of a text are not those of its chunks")
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))  # for chunks already in lower case
        self.mark = self._ids(self.plain, _MARK)
        if len(self.mark) != 1:
            raise ValueError(f"{path}: the mark is not one token")
        self.merge, self.real = _rank_merge(spec["model"], suffix)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}  # chunk -> its number
        self.stops = array("q", [0])  # where the ids of each number end in `held`
        self.held = array("I")

    @staticmethod
    def _ids(tokenizer, text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: set[str]) -> None:
        """Remember the ids of plain chunks in lower case."""
        words = [c for c in chunks if c.isalpha()]  # one piece each: their last tokens have the suffix
        mixed = [c for c in chunks if not c.isalpha()]
        for at in range(0, len(words), _WORDS):
            part = words[at:at + _WORDS]
            ids = self.real[self.merge(_END.join(part) + _END)]
            self._cut(part, ids, np.flatnonzero(self.ends[ids]) + 1, 0)
        for part, ids in self._joined(mixed, f" {_MARK} ", f" {_MARK}"):
            self._cut(part, ids, np.flatnonzero(ids == self.mark[0]) + 1, 1)

    def _joined(self, chunks: list[str], between: str, last: str):
        parts = [chunks[at:at + _TOGETHER] for at in range(0, len(chunks), _TOGETHER)]
        for at in range(0, len(parts), 8):
            some = parts[at:at + 8]
            for part, found in zip(some, self.plain.encode_batch_fast([between.join(p) + last for p in some], add_special_tokens=False)):
                yield part, np.array(found.ids, "<u4")

    def _cut(self, part: list[str], ids: np.ndarray, ends: np.ndarray, drop: int) -> None:
        if len(ends) != len(part):
            raise ValueError("the library cut the chunks in another way")
        start = 0
        for chunk, end in zip(part, ends.tolist()):
            self.held.frombytes(ids[start:end - drop].tobytes())
            self.known[chunk] = len(self.stops)
            self.stops.append(len(self.held))
            start = end

    def _other(self, text: str) -> bytes:
        """Ids of a text that is not plain, chunk by chunk where that is possible."""
        if _ODD_SPACE.search(text):
            return np.array(self._ids(self.whole, text), "<u4").tobytes()
        chunks = text.split()
        found = self.whole.encode_batch_fast(list(dict.fromkeys(chunks)), add_special_tokens=False)
        ids = dict(zip(dict.fromkeys(chunks), (np.array(f.ids, "<u4").tobytes() for f in found)))
        return b"".join([ids[c] for c in chunks])

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """The ids of plain texts: their distinct chunks looked up, and the ids of all chunks joined."""
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), *_POINT)
        split = pc.split_pattern_regex(apart, "[\t-\r ]+")
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = set(chunks).difference(self.known)
        if len(self.known) + len(fresh) > self.limit:
            self._forget()
            fresh = set(chunks).difference(self.known)
        self._learn(fresh)
        number = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))[coded.indices.to_numpy(zero_copy_only=False)]
        stops = np.frombuffer(self.stops, np.int64)
        begin = np.append(0, stops[:-1])[number]
        length = stops[number] - begin
        until = np.append(0, np.cumsum(length))
        flat = np.frombuffer(self.held, "<u4")[np.repeat(begin - until[:-1], length) + np.arange(until[-1])].tobytes()
        bounds = 4 * until[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (null: none), 4 bytes each, little-endian."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        plain = pc.and_not(pc.match_substring_regex(texts, _PLAIN), pc.match_substring(texts, _SPECIAL))
        out: list[bytes] = [b""] * len(texts)
        places = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        if len(places):
            for k, ids in zip(places.tolist(), self._plain(texts.filter(plain))):
                out[k] = ids
        for k in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self._other(texts[k].as_py())
        return out


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str, limit: int = 500_000) -> WordIds:
    """The worker process's encoder for a vocabulary file; it remembers at most `limit` chunks from now on."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    _ENCODERS[path].limit = limit
    return _ENCODERS[path]

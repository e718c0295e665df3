"""Ids of whole texts under a byte-level BPE vocabulary of the tokenizers library.

The library cuts a text at its pattern and merges each match by itself.  A space
that follows or precedes a visible character always begins a match, so a text
whose white space is single spaces and one or two line feeds between visible
characters falls into chunks whose ids do not depend on their neighbours.  The
ids of a chunk are remembered; unseen ones are merged in rank order by tiktoken
under the same vocabulary, once per distinct chunk.  Any other text goes to the library whole, and so
does one with a special token.  Empty text: no ids.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# printable Latin-1, for which the classes of the pattern are the same in both libraries, between single spaces or one or two line feeds
_EVEN = r"\A\n?[!-~\xa1-\xff]+(?:(?: |\n\n?)[!-~\xa1-\xff]+)*\n?\z"
_POINT = r"([A-Za-z\xc0-\xd6])([.,])( |\z)"  # a point or comma after a letter is a match of its own; \x01 stands before such a chunk
_SPECIAL = "<|"  # begins a special token
_PROBE = "It's 42 ñandú's,\n\n(don't) x1²º.\nThe end... I'LL we've"


def bytes_of_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in such a vocabulary: itself if printable, else the next character from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteIds:
    """Encoder for one vocabulary file; `limit` bounds the chunks it remembers."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec))
        special = {t["content"] for t in spec["added_tokens"]}
        symbols = bytes_of_symbols()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ids = [vocab[m.replace(" ", "")] for m in merged]
        if ids != sorted(ids) or spec.get("normalizer") or not all(c in symbols for t in vocab for c in t):
            raise ValueError(f"{path}: not a byte-level vocabulary whose ids rise with the merges")
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items()}
        self.merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        top = max(self.library.get_vocab().values())
        self.code, self.dtype = ("H", np.dtype("<u2")) if top < 1 << 16 else ("I", np.dtype("<u4"))
        self.limit = limit
        self._forget()
        self.lead = len(self._pack(self.merge("\n")))
        probes = [_PROBE, "\n" + _PROBE, ""]
        if self.encode(pa.array(probes)) != list(map(self._whole, probes)):
            raise ValueError(f"{path}: the ids of a text are not those of its chunks")

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids)

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}  # chunk -> its number
        self.ends = array("q", [0])  # where the ids of each number end in `ids`
        self.ids = array(self.code)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each distinct chunk; a chunk without a line feed or \\x01 in front lost a space there."""
        fresh = set(chunks).difference(self.known)
        if len(self.known) + len(fresh) > self.limit:
            self._forget()
            fresh = set(chunks).difference(self.known)
        merge, known, ids, ends = self.merge, self.known, self.ids, self.ends
        for chunk in fresh:
            ids.extend(merge(chunk if chunk[0] == "\n" else chunk[1:] if chunk[0] == "\x01" else " " + chunk))
            known[chunk] = len(ends)
            ends.append(len(ids))
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def _even(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts that fall into chunks."""
        marked = pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n")
        split = pc.split_pattern(pc.replace_substring_regex(marked, _POINT, "\\1 \x01\\2\\3"), " ")
        coded = split.flatten().dictionary_encode()
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.frombuffer(self.ends, np.int64)
        begin = np.append(0, ends[:-1])[number]
        length = ends[number] - begin
        until = np.cumsum(length)
        flat = np.frombuffer(self.ids, self.dtype)[np.repeat(begin - until + length, length) + np.arange(until[-1])].tobytes()
        bounds = np.append(0, until)[split.offsets.to_numpy() - split.offsets[0].as_py()] * self.dtype.itemsize
        return [flat[a + self.lead:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: none) as little-endian integers of type `dtype`."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        even = pc.and_not(pc.match_substring_regex(texts, _EVEN), pc.match_substring(texts, _SPECIAL))
        out: list[bytes] = [b""] * len(texts)
        places = np.flatnonzero(even.to_numpy(zero_copy_only=False))
        if len(places):
            for k, ids in zip(places.tolist(), self._even(texts.filter(even))):
                out[k] = ids
        for k in np.flatnonzero(~even.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self._whole(texts[k].as_py())
        return out


_ENCODERS: dict[str, ByteIds] = {}


def encoder(path: str) -> ByteIds:
    """The worker process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteIds(path)
    return _ENCODERS[path]

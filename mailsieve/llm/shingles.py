"""64-bit hashes of word shingles, computed over many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
CHARS = 250_000  # characters hashed at once, unless one text has more: some 40 bytes of memory each


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, in order, and the number of words of each text.

    Words are runs of bytes other than space and \\t to \\r.  A word's hash is a
    polynomial of its bytes and its length, scrambled.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], white))))
    starts, ends = edges[::2], edges[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(joined)), dtype=np.uint64)))
    hashes = (total[ends] - total[starts]) * _powers(_INVERSE, len(joined))[starts]
    hashes = mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, stops))))
    return hashes, counts


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the `width`-word shingles of each text, A-Z in lower case.

    A text of fewer words has its whole sequence as one shingle, a text without
    words has none.
    """
    out: list[np.ndarray] = []
    part = np.cumsum([len(t) for t in texts]) // CHARS
    for first, end in zip(firsts := np.flatnonzero(np.diff(part, prepend=-1)).tolist(), [*firsts[1:], len(texts)]):
        out += _sets(texts[first:end], width)
    return out


def _sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The same for a few texts, hashed together."""
    hashes, counts = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    n = len(hashes)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(_BASE) + hashes[k:k + len(rolled)]
    rolled = mixed(rolled)
    out, start = [], 0
    for count in counts.tolist():
        if count >= width:
            s = np.sort(rolled[start:start + count - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif count:
            whole = np.uint64(count)
            for h in hashes[start:start + count]:
                whole = np.uint64((int(whole) * _BASE + int(h)) % 2**64)
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
        start += count
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())

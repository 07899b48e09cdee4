"""Words and word triples of whole Arrow batches, in numpy.

A *word* is a longest run of letters and digits in lower case, a *triple* three words in a row. A batch of texts is
laid out as one array of code points; words get a position-free polynomial hash from one cumulative sum, triples a mix
of three word hashes. There is no Python loop over words or characters. Triple hashes have 48 bits, so a batch may hold
at most 65,536 texts (Arrow batches have 10,000).

Defined cases: a null text counts as an empty one; texts of fewer than ``min_words`` words have no triples at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIN_WORDS = 12
LIMIT = 0x32400  # no letters or digits are assigned beyond the ideographs of plane 3
U = np.uint64
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def letter_hashes() -> np.ndarray:
    """By code point: a random value of its lower-case form, 0 if it is no letter or digit."""
    if "letters" not in _cache:
        low = np.zeros(LIMIT + 1, U)
        for c in range(LIMIT):
            ch = chr(c)
            if ch.isalnum():
                low[c] = ord(ch.lower()[0])
        _cache["letters"] = np.where(low > 0, mix(low + U(0x1234567)) | U(1), U(0))
    return _cache["letters"]


BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_cache.get("powers", ())) < n:
        m = max(n, 1 << 20)
        for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            x = np.full(m, base, U)
            x[0] = 1
            _cache[name] = np.cumprod(x)
    return _cache["powers"][:n], _cache["inverse"][:n]


FEW = 1 << 18  # bytes whose arrays stay in the processor's cache


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes of text or packed items (or one row), so that long ones don't add up in memory."""
    for b in batches:
        size = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if any(of(c.type) for of in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary)):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        if size.sum() <= most or b.num_rows < 2:
            yield b
            continue
        part = (np.cumsum(size) - size) // most
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for i, j in zip(edge[:-1], edge[1:]):
            yield b.slice(i, j - i)


class Words(NamedTuple):
    hash: np.ndarray  #: of each word of the batch
    doc: np.ndarray  #: index of its text in the batch
    count: np.ndarray  #: words of each text


def words(texts: list[str | None]) -> Words:
    n = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    cp = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(cp):
        return Words(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
    ends = np.cumsum(n)
    h = letter_hashes()[np.minimum(cp, LIMIT)]
    inside = h != 0
    first = np.empty(len(cp), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    begins = ends - n
    first[begins[n > 0]] = True
    last = np.empty(len(cp), bool)
    last[:-1] = first[1:] | ~inside[1:]
    last[-1] = True
    start, stop = np.flatnonzero(inside & first), np.flatnonzero(inside & last)
    up, down = powers(len(cp))
    total = np.cumsum(h * up)
    hashed = mix((total[stop] - np.where(start > 0, total[start - 1], U(0))) * down[start])
    doc = np.searchsorted(ends, start, side="right")
    return Words(hashed, doc, np.bincount(doc, minlength=len(texts)))


def triples(w: Words, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(doc, 48-bit hash) of the distinct triples of each text, ordered by both."""
    if len(w.hash) < 3:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h, d = w.hash, w.doc
    ok = (d[:-2] == d[2:]) & (w.count[d[:-2]] >= min_words)
    t = mix(h[:-2] * U(0x9FB21C651E98DF25) + (h[1:-1] ^ (h[1:-1] >> U(31))) * U(0xD6E8FEB86659FD93) + h[2:])
    both = np.sort((d[:-2][ok].astype(U) << U(48)) | (t[ok] >> U(16)))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return (both >> U(48)).astype(np.int64), both & U((1 << 48) - 1)


def set_hashes(doc: np.ndarray, items: np.ndarray, docs: int) -> np.ndarray:
    """A 64-bit hash of the set of items of each doc; docs without items have 0."""
    out = np.zeros(docs, U)
    if len(doc):
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[at]] = mix(np.add.reduceat(mix(items + U(0x51ED270B)), at)) | U(1)
    return out

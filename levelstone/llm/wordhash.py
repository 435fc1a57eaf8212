"""Vectorised identities and hashes of the words of many texts at once.

Words are runs of bytes other than space and the control characters 9 to 13; A-Z are lower-cased.
A word has an identity of two 64-bit halves. Up to 16 bytes are the identity themselves, put through a permutation that
the word's length keys, so two different words of one length never share it; a longer word has its BLAKE2b digest. No
arithmetic in the bytes of a word is left that chosen texts could fold.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
#: Powers kept while a task runs.
POWERS: list[np.ndarray] = []
#: Bytes of a word that its identity holds as they are.
PLAIN = 16
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for hashes of ranges read off one prefix sum."""
    if not POWERS or len(POWERS[0]) < n:
        POWERS.clear()
        for b in (_BASE, _INV):
            power = np.full(max(n, 1 << 18), b, np.uint64)
            power[0] = 1
            POWERS.append(np.cumprod(power, dtype=np.uint64))
    return POWERS[0], POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors without small linear relations: words that change places change the sum.
_FACTORS = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case and 16 zero bytes behind."""
    out = np.zeros(len(raw) + PLAIN, np.uint8)
    capital = (raw >= 65) & (raw <= 90)
    np.add(raw, capital.view(np.uint8) * np.uint8(32), out=out[: len(raw)])
    return out


def identities(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the identity of each stretch ``low[start:end]``; ``low`` has 16 bytes more than any stretch reaches."""
    at = np.ndarray((max(0, len(low) - 7),), np.dtype("<u8"), buffer=low.data, strides=(1,))
    n = end - start
    a = at[start] & _MASK[np.minimum(n, 8)]
    b = at[start + np.minimum(n, 8)] & _MASK[np.clip(n - 8, 0, 8)]
    a = a ^ mix(b + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    b = b ^ mix(a + np.uint64(0xA0761D6478BD642F))
    a = a ^ mix(b + np.uint64(0xE7037ED1A0B428DB))
    b = b ^ mix(a + np.uint64(0x8EBC6AF09C88C6E3))
    if len(long := np.flatnonzero(n > PLAIN)):
        data = low.data
        digests = b"".join([hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(start[long].tolist(), end[long].tolist())])
        a[long], b[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return a, b


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(identity's halves, text number, start byte, end byte) of each word of the texts ``raw[off[i]:off[i+1]]``."""
    n = len(raw)
    if n == 0:
        z, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return u, u, z, z, z
    inside = ~_SEP[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inside[edges]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    a, b = identities(lowered(raw), start, end)
    doc = np.searchsorted(off, start, side="right") - 1
    return a, b, doc, start, end


def gram(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position, for positions 0 to len(h) - k."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += h[j : j + m] * _FACTORS[j]
    return mix(out + np.uint64(k))


def ranges(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the words ``h[first:last]`` of each pair, off one prefix sum."""
    power, inverse = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(1)) * power[: len(h)], out=total[1:])
    return mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))


def shingles(raw: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text as (sorted hashes, the other half of each, offsets by text); a shorter text is one shingle."""
    n = len(off) - 1
    a, b, doc, _, _ = words(raw, off)
    counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    parts, more, owner = [], [], []
    if len(a) >= k:
        ok = doc[: len(a) - k + 1] == doc[k - 1 :]
        parts.append(gram(a, k)[ok])
        more.append(gram(b, k)[ok])
        owner.append(doc[: len(ok)][ok])
    for m in range(1, k):
        if len(which := np.flatnonzero(counts == m)):
            parts.append(gram(a, m)[first[which]])
            more.append(gram(b, m)[first[which]])
            owner.append(which)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    g, g2, d = np.concatenate(parts), np.concatenate(more), np.concatenate(owner)
    order = np.lexsort((g, d))
    g, g2, d = g[order], g2[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (g2[1:] != g2[:-1]) | (d[1:] != d[:-1])
    g, g2, d = g[new], g2[new], d[new]
    return g, g2, np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n))))

"""Word shingles of whole texts, hashed in bulk with numpy.

Words are maximal runs of bytes other than the six ASCII white-space characters, A-Z lower-cased. A word's
64-bit hash is a polynomial over random byte values modulo 2**64, taken from one running sum over the
whole chunk of texts, and mixed; a shingle's hash combines those of its five words. Two different shingles
agree with a probability near 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 21

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _RANDOM.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 2**64)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)])


def _hash_chunk(data: np.ndarray, offsets: np.ndarray, powers: _Powers) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (as int64) of each text in ``data``."""
    n = len(data)
    docs = len(offsets) - 1
    if not n:
        return [np.zeros(0, np.int64)] * docs
    powers.grow(n)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.r_[False, word[:-1]] & ~edge[:-1]
    after = np.r_[word[1:], False] & ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers.up[:n], out=running[1:])
    words = mix((running[ends] - running[starts]) * powers.down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.searchsorted(starts, offsets)  # index of each text's first word
    m = max(len(words) - WIDTH + 1, 0)
    grams = np.zeros(m, np.uint64)
    for k in range(WIDTH):
        grams += words[k : k + m] * _PLACE[k]
    grams = mix(grams).view(np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(grams[a : b - WIDTH + 1]))
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.asarray([short], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def shingle_sets(texts: pa.Array, powers: _Powers | None = None) -> list[np.ndarray]:
    """For each text (null: empty) its sorted distinct shingle hashes."""
    powers = powers or _Powers()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    out: list[np.ndarray] = []
    at = 0
    with np.errstate(over="ignore"):
        while at < len(texts):
            end = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
            end = min(max(end, at + 1), len(texts))
            part = offsets[at : end + 1]
            out += _hash_chunk(data[part[0] : part[-1]], part - part[0], powers)
            at = end
    return out


def set_digest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, independent of order."""
    sizes = np.asarray([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets).view(np.uint64) if sets else np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            sums = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(mix(flat ^ np.uint64(salt)), out=sums[1:])
            out.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return out[0], out[1]

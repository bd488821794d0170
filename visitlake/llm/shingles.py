"""Sets of word shingles of whole texts as 64-bit numbers, worked out for many texts at once."""
from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20_240_601)
#: a random number for each byte; A-Z count as a-z
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = b" "


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, for as many bytes as the largest batch had."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])


_POWERS = Powers()


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of `raw` (bytes other than ASCII white space) and where it starts."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_IS_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    _POWERS.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _POWERS.up[:len(data)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: `width` consecutive words, A-Z as a-z; fewer words are one shingle, none is empty."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    whole = _SEPARATOR.join(raws)
    words, starts = word_hashes(whole)
    lengths = np.array([len(r) for r in raws])
    bounds = np.searchsorted(starts, np.cumsum(lengths + 1))  # words before the end of each text
    if len(words) >= width:
        grams = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            grams = mix(grams + words[k:len(words) - width + 1 + k] * np.uint64(2 * k + 0x632BE59BD9B4E019))
    else:
        grams = np.zeros(0, np.uint64)
    out, first = [], 0
    for last in bounds.tolist():
        n = last - first
        if n >= width:
            out.append(np.unique(grams[first:last - width + 1]))
        elif n:
            one = np.array([n], np.uint64)
            for k in range(first, last):
                one = mix(one * np.uint64(3) + words[k:k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        first = last
    return out

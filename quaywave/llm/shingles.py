"""Word shingles of whole texts, hashed from the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x5851F42D4C957F2D)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {True: np.ones(1, dtype=np.uint64), False: np.ones(1, dtype=np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with well spread bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int, inverse: bool) -> np.ndarray:
    if len(_powers[inverse]) < n:
        base = np.full(max(n, 2 * len(_powers[inverse])), _P_INVERSE if inverse else _P)
        base[0] = 1
        _powers[inverse] = np.multiply.accumulate(base)
    return _powers[inverse][:n]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data: the texts' UTF-8 bytes; offsets: where each begins, and the end. Returns text, hash, words per text.

    Words are runs of anything but ASCII white space. A text of 1 to k-1 words has one shingle, all its
    words; a text without words has none."""
    n, texts = len(data), len(offsets) - 1
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(n + 1, dtype=bool)
    before[1:] = ~solid
    starts = np.flatnonzero(solid & (before[:-1] | edge[:-1]))
    after = np.ones(n, dtype=bool)
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(n, False), out=prefix[1:])
    words = mix((prefix[ends] - prefix[starts]) * _power(n, True)[starts] + _GOLD * (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    factors = [np.uint64(pow(0x2545F4914F6CDD1D, j + 1, 1 << 64)) for j in range(k)]
    total = words * factors[0]
    for j in range(1, k):
        if len(words) > j:
            total[:-j] += words[j:] * factors[j]
    each = np.maximum(counts - k + 1, 0)
    text = np.repeat(np.arange(texts), each)
    within = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    hashes = mix(total[first[:-1][text] + within]) if len(text) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        sums = mix(counts[short].astype(np.uint64))
        for j in range(k - 1):
            has = counts[short] > j
            sums[has] += words[first[:-1][short[has]] + j] * factors[j]
        text, hashes = np.concatenate([text, short]), np.concatenate([hashes, mix(sums)])
    return text, hashes, counts


def multisets(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with how often each occurs."""
    own = mix(hashes ^ mix(text.astype(np.uint64) * _GOLD))
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return text[order[first]], hashes[order[first]], np.diff(np.concatenate([first, [len(own)]]))

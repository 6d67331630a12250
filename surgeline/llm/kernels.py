"""Array kernels over the bytes of many documents at once: words, n-gram hashes, prefix hashes."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word: all but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for key, base in (("up", BASE), ("down", inverse)):
            out = np.full(size, base, U)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 sums: the hash of data[s:e] is (P[e] - P[s]) * BASE**-s."""
    up, _ = powers(max(1, len(data)))
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(max(1, len(prefix)))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, none across documents, and the first word of each document (n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the first word of each document."""
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, offs)
    return span_hash(prefix_hash(data), starts, ends), first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values."""
    out = np.zeros(max(0, len(words) - n + 1), U)
    for k in range(n if len(out) else 0):
        out += words[k : len(words) - n + 1 + k] * U((BASE ** (k + 1)) % (1 << 64))
    return mix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each document; fewer words than n: the whole sequence as one."""
    words, first = word_hashes(data, offs)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.add.reduce(words[a:b] * powers(n + 1)[0][1 : b - a + 1], keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


#: Token classes of a byte: 0 white space, 1 letters, digits and bytes beyond ASCII, 2 the rest.
TOKEN_CLASS = np.full(256, 2, np.uint8)
TOKEN_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
TOKEN_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def token_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each token, a run of bytes of one class other than white space, and the first token of each document."""
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = TOKEN_CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    change = (kind[1:] != kind[:-1]) | cut
    starts = np.flatnonzero(change & (kind[1:] > 0))
    ends = np.flatnonzero(change & (kind[:-1] > 0))
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(starts, offs)

"""Words, shingles and their hashes over whole Arrow batches, in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: White space that separates words: space and the control characters 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64 to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, start and end of each word in them, and the first word of each text.

    The last array has one entry more than there are texts.
    """
    first = offsets[0]
    text = LOWER[data[first : offsets[-1]]]
    local = offsets - first
    inside = ~white[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = np.unique(local[(local > 0) & (local < len(text))])
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return text, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, local)


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes: a rolling polynomial, finished by mix."""
    up, down = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, U64)
    np.cumsum(BYTE[text] * up[: len(text)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text, and the text each belongs to.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    last = first[1:][owner]
    at = np.arange(len(words))
    total = np.zeros(len(words), U64)
    for j in range(n):
        step = mix(U64(0xA0761D6478BD642F) * np.arange(j + 1, j + 2, dtype=U64))[0] | U64(1)
        shifted = np.zeros(len(words), U64)
        shifted[: max(len(words) - j, 0)] = words[j:]
        if j:
            shifted[at + j >= last] = 0
        total += shifted * step
    kept = (at + n <= last) | ((counts[owner] < n) & (at == first[:-1][owner]))
    return mix(total[kept]), owner[kept]


P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of the bytes. Spans of one length are hashed together."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(), (len(text) + 1, 8), (1, 1))
    lengths = ends - starts
    out = np.empty(len(starts), U64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        n, at, seed64 = int(lengths[group[0]]), starts[group], U64(seed)

        def lane(k: int, at: np.ndarray = at) -> np.ndarray:
            return np.ascontiguousarray(eight[at + k]).view("<u8").ravel()

        k = 0
        if n >= 32:
            acc = [np.full(len(at), v, U64) for v in ((seed + int(P1) + int(P2)) % 2**64, (seed + int(P2)) % 2**64, seed, (seed - int(P1)) % 2**64)]
            while k + 32 <= n:
                acc = [_round(a, lane(k + 8 * j)) for j, a in enumerate(acc)]
                k += 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.zeros(len(at), U64), a)) * P1 + P4
        else:
            h = np.full(len(at), (seed + int(P5)) % 2**64, U64)
        h = h + U64(n)
        while k + 8 <= n:
            h = _rotl(h ^ _round(np.zeros(len(at), U64), lane(k)), 27) * P1 + P4
            k += 8
        if k + 4 <= n:
            h = _rotl(h ^ ((lane(k) & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            k += 4
        while k < n:
            h = _rotl(h ^ (padded[at + k].astype(U64) * P5), 11) * P1
            k += 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        out[group] = h ^ (h >> U64(32))
    return out

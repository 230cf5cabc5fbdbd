"""Hashes of words and of runs of words, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
#: ASCII white space parts words, and A-Z count as a-z.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Only 0-9, a-z and bytes of non-ASCII characters make words.
PLAIN = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: a bijection whose bits all depend on all."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


LETTER = mix(np.arange(1, 257, dtype=U) * BASE)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        held = np.full(size, base, U)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _POWERS[int(base)] = held
    return held[:n]


def spans(buf: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of bytes that don't part words."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~parts[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def range_sums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each byte range, from one running sum over all."""
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(LETTER[buf] * powers(BASE, len(buf)), out=total[1:])
    return (total[ends] - total[starts]) * powers(_INVERSE, len(buf) + 1)[starts]


def hashed_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A well-mixed hash of each byte range and its length."""
    return mix(range_sums(buf, starts, ends) + (ends - starts).astype(U))


def joined(texts: Sequence[bytes], limit: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes or one text: first, end, their bytes (each ends in a line feed), and the first byte of each."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < limit):
            size += len(texts[hi]) + 1
            hi += 1
        buf = np.frombuffer(b"\n".join([*texts[lo:hi], b""]), np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts[lo:hi]), np.int64, hi - lo)
        yield lo, hi, buf, np.concatenate([[0], np.cumsum(sizes)])
        lo = hi


def words(texts: Sequence[bytes], parts: np.ndarray, limit: int = 4_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """For each text in order, its place and the hashes of its words, A-Z as a-z."""
    for lo, hi, buf, firsts in joined(texts, limit):
        buf = FOLD[buf]
        starts, ends = spans(buf, parts)
        hashes = hashed_spans(buf, starts, ends)
        cuts = np.searchsorted(starts, firsts)
        for k in range(hi - lo):
            yield lo + k, hashes[cuts[k] : cuts[k + 1]]


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; fewer words are one run, none give none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        factors = powers(BASE, n + 1)[1:]
        return mix(np.array([(hashes * factors).sum()], U) + U(n))
    out = np.zeros(n - width + 1, U)
    for k, factor in enumerate(powers(BASE, width + 1)[1:]):
        out += hashes[k : n - width + 1 + k] * factor
    return mix(out + U(width))

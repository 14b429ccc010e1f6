"""Words of many texts at once, on their UTF-8 bytes.

A word is a maximal run of characters other than the space and code points 9 to 13, which are
single bytes in UTF-8, so bytes suffice. Hashes of words are polynomials over the bytes modulo
2**64, finished by a bit mixer; equal words have equal hashes in every batch and process.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import groups

#: Bytes worked on at once; a longer text is cut at white space.
SPAN = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n or further."""
    if len(_powers.get("up", ())) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(m, base)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """n + 1 sums of value * BASE**index, from which any window's polynomial follows."""
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def windows(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mixed polynomial of each [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def _cuts(data: np.ndarray, a: int, b: int, space: np.ndarray = _SPACE) -> list[int]:
    """Places in [a, b] that cut it in pieces of about SPAN bytes, none inside a word."""
    out = [a]
    while b - out[-1] > SPAN:
        near = out[-1] + SPAN
        while near < b:
            found = np.flatnonzero(space[data[near : near + 4096]])
            if len(found):
                near += int(found[0])
                break
            near += 4096
        out.append(min(near, b))
    if out[-1] < b:
        out.append(b)
    return out


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, counts): each word's hash and byte range, and the words of each text.

    ``space`` tells of each byte whether it stands between words.
    """
    hashes, starts, ends = [], [], []
    for a, b in groups(offsets, SPAN):
        lo, hi = int(offsets[a]), int(offsets[b])
        for x, y in zip(c := _cuts(data, lo, hi, space), c[1:], strict=False):
            piece = data[x:y]
            inside = ~space[piece]
            before = np.empty(len(piece), bool)
            before[0] = False
            before[1:] = inside[:-1]
            at = offsets[a : b + 1]
            at = at[(at > x) & (at < y)] - x
            before[at] = False
            start = np.flatnonzero(inside & ~before)
            after = np.empty(len(piece), bool)
            after[-1] = False
            after[:-1] = inside[1:]
            after[at - 1] = False
            end = np.flatnonzero(inside & ~after) + 1
            if lower:
                piece = LOWER[piece]
            sums = prefix_sums(piece.astype(np.uint64) + np.uint64(1))
            hashes.append(windows(sums, start, end))
            starts.append(start + x)
            ends.append(end + x)
    if not hashes:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(len(offsets) - 1, np.int64)
    start = np.concatenate(starts)
    counts = np.diff(np.searchsorted(start, offsets))
    return np.concatenate(hashes), start, np.concatenate(ends), counts


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, counts): the n-grams of each text in order; with ``short`` a text of fewer words
    (one at least) has its whole sequence as one."""
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    have = np.maximum(counts - n + 1, 0)
    size = np.where(have > 0, n, counts)
    if short:
        have = np.where((counts > 0) & (have == 0), 1, have)
    total = int(have.sum())
    text = np.repeat(np.arange(len(counts)), have)
    begin = np.arange(total) - np.repeat(np.cumsum(have) - have, have) + first[text]
    out = np.zeros(total, np.uint64)
    length = size[text]
    for k in range(n):
        live = length > k
        if live.all():
            out = mix(out * _BASE + hashes[begin + k])
        elif live.any():
            out[live] = mix(out[live] * _BASE + hashes[begin[live] + k])
    out = mix(out ^ length.astype(np.uint64))
    return out, have

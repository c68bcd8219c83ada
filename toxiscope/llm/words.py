"""Words, word hashes and word shingles of whole batches of texts in numpy.

A word's hash is a polynomial over its bytes taken from prefix sums, so the
cost is a few array passes per byte whatever the words are.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20260117))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words between white space.
SOLID = ~_SPACE
#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the maximal runs of ``inside`` bytes; no run crosses texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    ok = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, ok[:-1]
    starts = np.flatnonzero(ok & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, ok[1:]
    ends = np.flatnonzero(ok & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span of ``data`` follows."""
    up, _ = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of data[start:end] for every span, the same wherever the bytes stand."""
    if sums is None:
        sums = byte_sums(data)
    return mix((sums[ends] - sums[starts]) * _power(len(data))[1][starts])


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every ``k`` consecutive word hashes, the same wherever they stand."""
    n = len(hashes)
    up, down = _power(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)))
    return mix((sums[k:] - sums[:-k]) * down[:max(0, n - k + 1)])


def shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position in the batch) of every run of ``k`` words of one text.

    A text with 1 to k-1 words has one shingle, its whole sequence, marked at
    its first word; a text without words has none.  Ordered by position.
    """
    n = len(hashes)
    counts = np.bincount(owner, minlength=n_texts)
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    if n >= k:
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += hashes[j:n - k + 1 + j] * _PLACE[j]
        at = np.flatnonzero(owner[:n - k + 1] == owner[k - 1:])
        out = mix(total[at])
    else:
        at, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        place = np.arange(n) - firsts[owner]
        few = (counts[owner] < k)
        terms = np.where(few, hashes * _PLACE[np.minimum(place, k - 1)], np.uint64(0))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
        sums = total[firsts[short] + counts[short]] - total[firsts[short]]
        # the count keeps a short sequence apart from a full shingle
        sums = mix(sums + _PLACE[8] * counts[short].astype(np.uint64))
        at, out = np.concatenate((at, firsts[short])), np.concatenate((out, sums))
        order = np.argsort(at, kind="stable")
        at, out = at[order], out[order]
    return out, at

"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from opslens.llm.common import kept

WORDS = 5
_random = np.random.default_rng(20_240_229)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_random.integers(0, 1 << 62)) * 2 + 1
_BACK = pow(_STEP, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(way: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the step, or of its inverse."""
    powers = kept("shingle powers", dict)
    have = powers.get(way)
    if have is None or len(have) < n:
        base = np.uint64(_STEP if way == "up" else _BACK)
        grown = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        powers[way] = have = np.multiply.accumulate(grown)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def placed_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word between white space, and the byte where it starts; the hash depends on the word alone."""
    raw = np.frombuffer(text, dtype=np.uint8)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if not len(raw):
        return none
    inside = np.concatenate(([False], ~_IS_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return none
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * _power("up", len(raw)), dtype=np.uint64)))
    own = (sums[ends] - sums[starts]) * _power("down", len(raw))[starts]
    return mixed(own + (ends - starts).astype(np.uint64) * _PLACE[WORDS]), starts


def folded(text: str | None) -> bytes:
    """The text's bytes with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, an empty one has none."""
    words, _ = placed_words(folded(text))
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        place = _power("up", n + 1)[1:] * np.uint64(n)
        return mixed((words * place).sum(keepdims=True, dtype=np.uint64))
    total = words[:n - WORDS + 1] * _PLACE[0]
    for i in range(1, WORDS):
        total = total + words[i:n - WORDS + 1 + i] * _PLACE[i]
    return np.unique(mixed(total))

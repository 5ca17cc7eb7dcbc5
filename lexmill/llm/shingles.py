"""Word shingles of texts as 64-bit hashes, computed over whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from lexmill.llm.rows import slices, utf8
from lexmill.llm.workers import held

BASE = np.uint64(0x9E3779B97F4A7C15)
# Characters worked on at once: about 60 bytes of memory each.
SLICE = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a well-known 64-bit hash: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, equal for A-Z and a-z, and which bytes part words."""
    value = _mix(np.arange(1, 257, dtype=np.uint64) * BASE)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return value, space


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z in lower case, and where each text's begin."""
    value, space = _bytes()
    raw, ends = utf8([(t or "") + " " for t in texts])
    apart = space[raw]
    starts = np.flatnonzero(~apart & np.concatenate([[True], apart[:-1]]))
    stops = np.flatnonzero(apart & np.concatenate([[False], ~apart[:-1]]))
    # sizes in steps, so that the tables of powers are made a few times only
    up, down = _powers(max(SLICE, 1 << len(raw).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[raw] * up[: len(raw)], dtype=np.uint64)])
    words = _mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64) * BASE)
    return words, np.searchsorted(starts, ends)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has all of them as its one shingle; without words
    its set is empty.
    """
    held("shingles")
    for part in slices(texts, SLICE):
        words, at = word_hashes(texts[part])
        joined = words.copy()
        for k in range(1, width):
            joined = _mix(joined * BASE + np.concatenate([words[k:], np.zeros(min(k, len(words)), np.uint64)]))
        for a, b in zip(at, at[1:]):
            if b - a >= width:
                yield np.unique(joined[a : b - width + 1])
            elif b > a:
                one = words[a : a + 1]
                for k in range(1, b - a):
                    one = _mix(one * BASE + words[a + k : a + k + 1])
                # the number of words tells it from longer shingles
                yield _mix(one + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)

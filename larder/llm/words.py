"""Words as arrays of stable 64-bit hashes, over whole Arrow batches at a time."""

from __future__ import annotations

import re
from functools import cache
from hashlib import blake2b
from itertools import chain

import numpy as np

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Words that a worker remembers before it starts anew.
REMEMBERED = 500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x.copy()
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def hash64(text: str) -> int:
    """A 64-bit hash that is the same in every process."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = hash64(word)
        return value


class WordHasher:
    """Maps words to 64-bit hashes that are the same in every process."""

    def __init__(self) -> None:
        self.known = _Hashes()

    def flat(self, words_of_texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All words of all texts in one array, and the number of words of each text."""
        counts = np.fromiter(map(len, words_of_texts), dtype=np.int64, count=len(words_of_texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = chain.from_iterable(words_of_texts)
        return mix(np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=int(counts.sum()))), counts


#: Characters that are hashed at once, about; the odd base of the hash of a word and its inverse modulo 2**64.
CHARACTERS = 1 << 18
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _letters() -> np.ndarray:
    """A random 64-bit number for each code point that ``WORD`` matches, zero for all others."""
    spoken = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return np.where(spoken, mix(np.arange(1, 0x110001, dtype=np.uint64) * _GOLD) | np.uint64(1), np.uint64(0))


@cache
def _powers(base: int, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.append(np.uint64(1), np.full(length - 1, base, np.uint64)))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash, the same in every process, of every lower-cased word of all texts in one array, and the number of words
    of each text: polynomials over code points, without a Python object for a word."""
    lowered = [t.lower() if t else "" for t in texts]
    block = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1) // CHARACTERS
    ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(lowered)).tolist() if lowered else []
    parts, at = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
    for end in ends:
        parts.append(_block_hashes(lowered[at:end]))
        at = end
    return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])


def _block_hashes(lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    value = _letters()[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], value != 0])))
    length = 1 << len(codes).bit_length()
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(value * _powers(_BASE, length)[: len(codes)], dtype=np.uint64))
        start, end = edge[::2], edge[1::2]
        words = mix((total[end] - total[start]) * _powers(_INVERSE, length)[start])
    text_ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    return words, np.diff(np.searchsorted(start, text_ends), prepend=0)


def windows(flat: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within one text, and the text that each belongs to, in order."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(flat) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(flat) - k + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * _GOLD + flat[j : j + n]
    inside = owner[:n] == owner[k - 1 :]
    return mix(h[inside]), owner[:n][inside]


#: Bits of a hash that stay when it is put behind its owner.
VALUE_BITS = 48
_VALUE = np.uint64((1 << VALUE_BITS) - 1)


def distinct_pairs(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(owner, value)``, ordered by both, from values cut to 48 bits; owners are rows of one batch."""
    if len(owner) and int(owner.max()) >= 1 << 64 - VALUE_BITS:
        raise ValueError("a batch must have fewer than 65,536 rows")
    both = np.sort(owner.astype(np.uint64) << np.uint64(VALUE_BITS) | value & _VALUE)
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    both = both[first]
    return (both >> np.uint64(VALUE_BITS)).astype(np.int64), both & _VALUE


def sums(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of the values of each of ``n`` owners, which are in order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    ends = np.cumsum(np.bincount(owner, minlength=n))
    with np.errstate(over="ignore"):
        return total[ends] - total[np.concatenate([[0], ends[:-1]])]

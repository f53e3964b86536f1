"""Sets of hashed word shingles of whole texts, computed on byte arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18

#: Odd base of the word hash and its inverse modulo 2**64; positions are powers of the base.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (splitmix64's last step)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each word between ASCII white space starts, where it ends)."""
    gap = np.concatenate([[True], GAP[data], [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def hashes_between(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[: len(data)])])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place where each word starts, its hash) for words between ASCII white space."""
    starts, ends = word_places(data)
    return starts, hashes_between(data, starts, ends)


def chunks(texts: list[str]) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """(text numbers, where each begins, bytes) of about PIECE bytes; long texts are cut at white space."""
    numbers, at, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace")
        while True:
            cut = len(data)
            if cut > PIECE:
                cut = PIECE
                while cut < len(data) and not GAP[data[cut]]:
                    cut += 1
            numbers.append(i)
            at.append(size)
            parts.append(data[:cut])
            size += cut + 1
            data = data[cut:]
            if size > PIECE:
                yield numbers, at, np.frombuffer(b" ".join(parts) + b" ", np.uint8)
                numbers, at, parts, size = [], [], [], 0
            if not data:
                break
    if numbers:
        yield numbers, at, np.frombuffer(b" ".join(parts) + b" ", np.uint8)


def words_by_text(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text, in order."""
    got: list[list[np.ndarray]] = [[] for _ in texts]
    for numbers, at, data in chunks(texts):
        starts, hashes = word_hashes(data)
        for i, own in zip(numbers, np.split(hashes, np.searchsorted(starts, at[1:])), strict=True):
            got[i].append(own)
    return [own[0] if len(own) == 1 else np.concatenate(own) for own in got]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, none is an empty set."""
    if len(words) < k:
        return mix((words * PLACE[: len(words)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words))) if len(words) else words
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total += words[j : j + n] * PLACE[j]
    return np.unique(mix(total))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    return [shingle_set(w, k) for w in words_by_text(texts)]


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()

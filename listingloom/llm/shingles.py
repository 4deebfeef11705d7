"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed with numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _STEP)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK + (1 << 18))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size, b, _U)])) for b in (_BASE, _BASE_INVERSE)]
    return _POWERS


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, from prefix sums of a polynomial modulo 2^64."""
    powers, inverse = _powers(len(data))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * powers[: len(data)], dtype=_U)])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one entry more than texts)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = hash_spans(data, starts, ends)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(starts, at + 1)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's set of 5-word shingles, sorted; the whole sequence as one when it has fewer words; empty without words.

    Only A-Z are lower-cased and only bytes 0x20 and 0x09-0x0D separate words, as bytes.lower() and the table above do.
    """
    block: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        block.append(raw)
        size += len(raw) + 1
        if size >= _BLOCK:
            yield from _sets(block)
            block, size = [], 0
    if block:
        yield from _sets(block)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    words, at = word_hashes(texts)
    n = len(words)
    if n >= WIDTH:
        grams = np.zeros(n - WIDTH + 1, _U)
        for k in range(WIDTH):
            grams = (grams + words[k : n - WIDTH + 1 + k]) * (_BASE + _U(2 * k))
        grams = mix(grams)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= WIDTH:
            yield np.unique(grams[a : b - WIDTH + 1])
        elif b > a:
            short = np.array([b - a], _U)
            for w in words[a:b]:
                short = mix(short * _STEP + w)
            yield short
        else:
            yield np.zeros(0, _U)

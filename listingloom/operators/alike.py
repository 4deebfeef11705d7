"""Pairs of texts whose Ratcliff/Obershelp ratio reaches a bound, found without comparing all with all.

The ratio is 2m / (a + b) for texts of a and b characters of which m match, in order. So texts at the bound or above share a
subsequence of m >= bound * (a + b) / 2 characters: at most d = a + b - 2m characters are left over. Two filters follow.

Pieces (for the titles of a block): cut one text into d + 1 pieces and count each left-over character to the piece that it lies
in or stands behind. As d characters can't spoil d + 1 pieces, there is a first piece i, from 0, up to whose end no more than i
are counted; it is whole, with exactly i before it, so it stands in the other text shifted by i - 2k places, for k of them in
its own. Any cuts will do; they are made where the block's titles differ.

A pair is only scored when a longest common subsequence, found by words of bits, leaves so many matches possible.

Bigrams (for a replay): of the bigrams of either, a mark before the first character included, at least 3m - a - b are bigrams
of the other: a character that doesn't match breaks two of its own text and one of the other. Equal bigrams of a text are
numbered, so a text is a set. Two sets that share k members share one among the first (size - k + 1) of each, whatever the
common order; here rare members come first.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from listingloom.session import hinted, materialize

#: How many titles of either side a group has at most; larger blocks are dealt over several groups.
GROUP = 8192
#: Up to how many pairs of two lengths are compared without pieces, and how many candidates are looked at at once.
FEW, AT_ONCE = 1 << 14, 1 << 20
_SLACK = 1e-9
_BASE = 0x9E3779B97F4A7C15


def grams(text: str) -> list[str]:
    """The bigrams of a marked text, each numbered among its equals."""
    seen: Counter = Counter()
    out = []
    for a, b in zip("^" + text, text, strict=False):
        seen[a + b] += 1
        out.append(f"{a}{b}{seen[a + b]}")
    return out


@lru_cache(maxsize=1 << 14)
def _places(text: str) -> dict[str, int]:
    """The places of each character of a text, as bits."""
    out: dict[str, int] = {}
    for k, x in enumerate(text):
        out[x] = out.get(x, 0) | 1 << k
    return out


def in_common(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of the usual table at a time as the bits of one number."""
    places, whole = _places(a), (1 << len(a)) - 1
    row = whole
    for x in b:
        if met := row & places.get(x, 0):
            row = ((row + met) | (row - met)) & whole
    return len(a) - row.bit_count()


def shared(a: int, b: int, least: float) -> int | None:
    """How many bigrams texts of these lengths share at least when their ratio reaches the bound; None where it can't."""
    m = math.ceil(least * (a + b) / 2 - _SLACK)
    return 3 * m - a - b if m <= min(a, b) else None


@lru_cache(maxsize=None)
def first(a: int, least: float) -> int:
    """How many members of a text of this length must be looked at, whatever the length of the other."""
    spread = range(max(1, math.floor(a * least / (2 - least)) - 1), math.ceil(a * (2 - least) / least) + 2)
    fewest = min(k for b in spread if (k := shared(a, b, least)) is not None)
    return a - max(1, fewest) + 1


def prefix(text: str, ranks: dict[str, int], least: float) -> list[str]:
    return sorted(grams(text), key=lambda g: (ranks.get(g, -1), g))[: first(len(text), least)] if text else []


def score(a: str, b: str, least: float) -> float:
    """The ratio, or 0 where the length, or what the texts have in common in order, rules the bound out."""
    if a == b:
        return 1.0 if a else 0.0
    needed = math.ceil(least * (len(a) + len(b)) / 2 - _SLACK)
    if needed > min(len(a), len(b)) or not a or not b or in_common(a, b) < needed:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


class _Side:
    """Texts of one length as a matrix of code points, with the hashes of their beginnings and how often they have which letters."""

    def __init__(self, places: list[int], texts: list[str]):
        self.places, self.n, self.length = np.array(places), len(texts), len(texts[0])
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(self.n, self.length)
        self.starts = np.zeros((self.length + 1, self.n), np.uint64)
        for k in range(self.length):
            self.starts[k + 1] = self.starts[k] * np.uint64(_BASE) + self.codes[:, k]
        letters = self.codes % 32
        self.letters = np.stack([(letters == k).sum(1) for k in range(32)], 1).astype(np.uint16)

    def hashes(self, start: int, end: int) -> np.ndarray:
        return self.starts[end] - self.starts[start] * np.uint64(pow(_BASE, end - start, 1 << 64))

    def cuts(self, pieces: int) -> list[int]:
        """The ends of that many pieces, each with about as much of what tells these texts apart."""
        codes = np.sort(self.codes[:: max(1, self.n // 512)], 0)
        told = 1e-6 + np.log2(len(codes)) - np.array([np.log2((np.diff(np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])) ** 2).sum() / len(c)) for c in codes.T])
        ends = np.searchsorted(np.cumsum(told), np.arange(1, pieces) * told.sum() / pieces) + 1
        out = [0]
        for k, e in enumerate(ends, 1):
            out.append(min(max(int(e), out[-1] + 1), self.length - pieces + k))
        return [*out, self.length]


def _met(keys: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of equal keys, at most about AT_ONCE at a time."""
    order = np.argsort(others)
    held = others[order]
    low = np.searchsorted(held, keys)
    mine = np.flatnonzero(held[np.minimum(low, len(held) - 1)] == keys)
    low, n = low[mine], np.searchsorted(held, keys[mine], "right") - low[mine]
    ends = np.cumsum(n)
    k = 0
    while k < len(mine):
        done = ends[k - 1] if k else 0
        e = max(k + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        times = n[k:e]
        within = np.arange(times.sum()) - np.repeat(ends[k:e] - times - done, times)
        yield np.repeat(mine[k:e], times), order[np.repeat(low[k:e], times) + within]
        k = e


def _pairs(a: _Side, b: _Side, least: float) -> np.ndarray:
    """The pairs of two lengths, as place in a times size of b plus place in b, that pieces and letters don't rule out."""
    m = math.ceil(least * (a.length + b.length) / 2 - _SLACK)
    left, right = a.length - m, b.length - m
    if min(left, right) < 0:
        return np.empty(0, np.int64)

    def kept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        able = np.minimum(a.letters[i], b.letters[j]).sum(1) >= m
        return i[able] * b.n + j[able]

    pieces = left + right + 1
    if a.n * b.n <= FEW or pieces > b.length:
        rows = max(1, AT_ONCE // b.n)
        return np.concatenate([kept(np.repeat(np.arange(k, min(k + rows, a.n)), b.n), np.tile(np.arange(b.n), min(rows, a.n - k))) for k in range(0, a.n, rows)])
    cuts, found = b.cuts(pieces), [np.empty(0, np.int64)]
    for i, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        held = b.hashes(start, end)
        for own in range(max(0, i - right), min(i, left) + 1):
            shift = 2 * own - i
            if start + shift >= 0 and end + shift <= a.length:
                found += [kept(x, y) for x, y in _met(a.hashes(start + shift, end + shift), held)]
    return np.unique(np.concatenate(found))


def candidates(left: list[str], right: list[str], least: float) -> Iterator[tuple[str, str]]:
    """Pairs of texts, each once, that hold all whose ratio reaches the bound."""
    if len(left) * len(right) <= 64:
        yield from ((x, y) for x in left for y in right)
        return
    sides = []
    for texts in (left, right):
        places: dict[int, list[int]] = defaultdict(list)
        for k, x in enumerate(texts):
            places[len(x)].append(k)
        sides.append([_Side(p, [texts[k] for k in p]) for p in places.values()])
    for a in sides[0]:
        for b in sides[1]:
            for pair in _pairs(a, b, least).tolist():
                yield left[a.places[pair // b.n]], right[b.places[pair % b.n]]


class _Recurring:
    """Pairs of titles that come in several blocks, each scored once a task: such a title knows which others it is like.

    A title is known from its second block on. At most MOST of a side are; pairs with others are looked at block by block.
    """

    MOST, SEEN = 1024, 1 << 18

    def __init__(self, least: float):
        self.least = least
        self.seen: tuple[set[str], set[str]] = (set(), set())
        self.near: dict[str, dict[str, float]] = {}
        self.right: set[str] = set()

    def _score(self, left: list[str], right: list[str]) -> Iterator[tuple[str, str, float]]:
        for x, y in candidates(left, right, self.least):
            if (ratio := score(x, y, self.least)) >= self.least:
                yield x, y, ratio

    def _known(self, texts: list[str], side: int, known: dict[str, dict[str, float]] | set[str]) -> list[str]:
        seen = self.seen[side]
        new = [x for x in texts if x in seen and x not in known][: self.MOST - len(known)]
        seen.update(texts)
        if len(seen) > self.SEEN:
            seen.clear()
        return new

    def pairs(self, left: list[str], right: list[str]) -> Iterator[tuple[str, str, float]]:
        """Each pair of a block's titles whose ratio reaches the bound, with it."""
        mine, theirs = self._known(left, 0, self.near), self._known(right, 1, self.right)
        scored = list(self._score(list(self.near), theirs)) if theirs else []
        self.right.update(theirs)
        scored += self._score(mine, list(self.right)) if mine else []
        self.near.update((x, {}) for x in mine)
        for x, y, ratio in scored:
            self.near[x][y] = ratio
        here, old, new = set(right), [x for x in left if x in self.near], [x for x in left if x not in self.near]
        for x in old:
            for y, ratio in self.near[x].items():
                if y in here:
                    yield x, y, ratio
        yield from self._score(new, right)
        yield from self._score(old, [y for y in right if y not in self.right])


Recurring = _Recurring


def _scored(least: float):
    """Rows come ordered by group, with whose titles they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        recurring = _Recurring(least)
        for (block, _, _), own in groupby(rows, key=lambda r: r[:3]):
            sides: tuple[list[str], list[str]] = ([], [])
            for *_, right, title in own:
                sides[right].append(title)
            for found in recurring.pairs(*sides):
                out.append((block, *found))
                if len(out) >= 5000:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], ["block", "l_title", "r_title", "score"])


def _tied(least: float):
    """Rows come ordered by group, with whose titles they are and their keys; pairs of keys that tie all keys of like titles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: tuple[list[str], list[int], list[int]] = ([], [], [])
        recurring = _Recurring(least)
        for (block, _, _), own in groupby(rows, key=lambda r: r[:3]):
            sides: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
            for *_, right, title, key in own:
                sides[right].setdefault(title, []).append(key)
            up: dict[int, int] = {}

            def top(k: int, up: dict[int, int] = up) -> int:
                while (above := up.get(k, k)) != k:
                    up[k] = up.get(above, above)
                    k = above
                return k

            for x, y, _ in recurring.pairs(list(sides[0]), list(sides[1])):
                first = top(sides[1][y][0])
                for k in sides[0][x]:
                    if (k := top(k)) != first:
                        up[k] = first
            for k in up:
                for column, value in zip(out, (block, k, top(k)), strict=True):
                    column.append(value)
            if len(out[0]) >= 5000:
                yield _ties(out)
                out = ([], [], [])
        yield _ties(out)

    return run


def _ties(out: tuple[list[str], list[int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["block", "a", "b"])


def ties(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(block, a, b): pairs of keys by which, in each block, the keys of alike titles hang together; no more than there are keys.

    left has block, title and key, right too, where a title has one key in a block.
    """
    return _dealt(left, right, "key").mapInArrow(_tied(least), "block string, a long, b long")


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(block, l_title, r_title, score) of the pairs of normalised titles of one block whose ratio reaches the bound.

    left and right have block and title; each pair of titles comes once a block. A block of more than GROUP titles of a side
    is dealt over groups by the titles' hashes, every part of one side with every part of the other.
    """
    return _dealt(left, right).mapInArrow(_scored(least), "block string, l_title string, r_title string, score double")


def _dealt(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """(block, l, r, right, title, more) of both sides' titles, a group (block, l, r) in one task and its rows together."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [materialize(rows.where("title <> ''").select("block", "title", *more).distinct(), "titles") for rows in (left, right)]
    large = [rows.groupBy("block").agg(F.ceil(F.count("*") / GROUP).cast("int").alias(f"parts{k}")).where(f"parts{k} > 1") for k, rows in enumerate(sides)]
    dealt = hinted(materialize(large[0].join(large[1], "block", "full"), "large-blocks"))
    grouped = []
    for k, rows in enumerate(sides):
        mine, all_ = F.pmod(F.xxhash64("title"), F.coalesce(f"parts{k}", F.lit(1))).cast("int"), F.explode(F.sequence(F.lit(0), F.coalesce(f"parts{1 - k}", F.lit(1)) - 1))
        rows = rows.join(dealt, "block", "left").select("block", mine.alias("mine"), all_.alias("other"), F.lit(k).alias("right"), "title", *more)
        grouped.append(rows.select("block", F.col(("mine", "other")[k]).alias("l"), F.col(("other", "mine")[k]).alias("r"), "right", "title", *more))
    return grouped[0].unionAll(grouped[1]).repartition(parts, "block", "l", "r").sortWithinPartitions("block", "l", "r")

"""Best-fit packing of tokenised documents into sequences of at most 4096 tokens.

The method is pattern packing: patterns of up to four lengths that fill a sequence exactly are enumerated, a non-negative
least-squares fit to the histogram of lengths says how often each repeats, the repeats are rounded down, and what is left
is packed best fit, longest first. All of it works on the histogram (at most 4096 counts), so the driver's part is bounded;
rows get their place from their rank among rows of the same length, which is a prefix sum over tasks.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from listingloom.llm.held import held, tidied
from listingloom.llm.shingles import hash_spans
from listingloom.session import materialize

LIMIT = 4096
END_ID = 1
#: Ids kept for words by a task; then it starts anew.
CACHE_IDS = 4_000_000
#: Words of Latin letters that normalisation leaves whole, and the bytes behind which a full stop is a word of its own.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]{1,40}").fullmatch
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return held("packing", path, lambda: Tokenizer.from_file(path))


def _ends_word(tokenizer) -> np.ndarray:
    """For each id, whether a word ends with it."""
    return np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(tokenizer.get_vocab_size())])


class Words:
    """Ids of the words met so far, by a 64-bit hash of the word, in one array."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.ends = held("packing", (path, "ends"), lambda: _ends_word(self.tokenizer))
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def _append(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Slots of new words. Plain ones are encoded together, as one text, and told apart by the ids that end a word; others alone."""
        n = len(self.keys)
        while n + len(words) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros(len(x) // 2, np.int32)]) for x in (self.first, self.size))
        plain = [k for k, w in enumerate(words) if _PLAIN(w)]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words[k] for k in plain)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(plain):
                at, own = self._append(ids), n + np.array(plain)
                self.size[own] = np.diff(stops, prepend=0)
                self.first[own] = at + stops - self.size[own]
            else:  # the tokenizer takes one of them apart: each is encoded alone
                plain = []
        there = set(plain)
        odd = [k for k in range(len(words)) if k not in there]
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([words[k] for k in odd], add_special_tokens=False), strict=True):
            self.first[n + k], self.size[n + k] = self._append(np.array(e.ids, np.uint32)), len(e.ids)
        return np.arange(n, n + len(words), dtype=np.int32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Words lie between spaces and line feeds, which the tokenizer removes before it looks at words;
        a full stop or comma that ends a word behind a letter or digit is a word of its own, as it is to the tokenizer."""
        if self.used > CACHE_IDS:
            self.clear()
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        apart = (data == 0x20) | (data == 0x0A)
        stop = np.zeros(len(data), bool)
        stop[1:-1] = ((data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)) & _ALNUM[data[:-2]] & apart[2:]
        starts = np.flatnonzero(~apart[1:] & (apart[:-1] | stop[1:])) + 1
        ends = np.flatnonzero(~apart[:-1] & (apart[1:] | stop[1:])) + 1
        hashes, where, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            slots = self._learn([raw[starts[k] : ends[k]].decode("utf-8", "surrogatepass") for k in where[new].tolist()])
            self.keys, self.slots = np.insert(self.keys, at[new], hashes[new]), np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.keys, hashes)
        slot = self.slots[at][inverse]
        size = self.size[slot].astype(np.int64)
        last = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[slot] - (last - size), size) + np.arange(last[-1] if len(last) else 0)]
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.concatenate([[0], last])[np.searchsorted(starts, at + 1)]
        return [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def token_ids(texts: list[str | None], words: Words) -> Iterator[np.ndarray]:
    """Each text's ids."""
    block: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        block.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(block[-1])
        if size >= 1 << 20 or i + 1 == len(texts):
            yield from words.encode(block)
            block, size = [], 0


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its rank among the pieces of its length in its task."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        ranks: Counter = Counter()
        task = TaskContext.get().partitionId()
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            parts = (batch.slice(i, 512) for i in range(0, batch.num_rows, 512))
            for doc_id, ids in ((d, x) for p in parts for d, x in zip(p.column(0).to_pylist(), token_ids(p.column(1).to_pylist(), words), strict=True)):
                ids = np.concatenate([ids, end])
                for k in range(0, len(ids), limit):
                    own = ids[k : k + limit]
                    n = len(own)
                    for column, x in zip(rows, (doc_id, k // limit, k, n, zlib.crc32(own.astype("<u4").tobytes()), task, ranks[n]), strict=True):
                        column.append(x)
                    ranks[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long")


def _spread(found: np.ndarray, most: int) -> np.ndarray:
    return found if len(found) <= most else found[np.linspace(0, len(found) - 1, most).astype(int)]


def patterns(counts: np.ndarray, limit: int) -> list[tuple[int, ...]]:
    """Combinations of two to four of the lengths present that add up to limit, spread evenly over the possible ones."""
    lengths = np.flatnonzero(counts[:limit])
    there = counts > 0
    out: set[tuple[int, ...]] = set()
    for a in lengths[::-1].tolist():
        rest = limit - a
        if rest <= a and there[rest]:
            out.add((a, rest))
        b = lengths[(lengths <= a) & (2 * lengths >= rest) & (lengths < rest)]
        for x in _spread(b[there[rest - b]], 24).tolist():
            out.add((a, x, rest - x))
        for x in _spread(lengths[(lengths <= a) & (3 * lengths >= rest) & (lengths < rest - 1)], 8).tolist():
            left = rest - x
            c = lengths[(lengths <= x) & (2 * lengths >= left) & (lengths < left)]
            for y in _spread(c[there[left - c]], 4).tolist():
                out.add((a, x, y, left - y))
    return sorted(out, reverse=True)


def fit(counts: np.ndarray, shapes: list[tuple[int, ...]], steps: int = 400) -> np.ndarray:
    """Non-negative least squares: how often each pattern repeats so that the lengths used come near the counts.

    Accelerated projected gradient; each column is scaled by the number of patterns that share its lengths.
    """
    column = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
    row = np.concatenate([np.array(s) for s in shapes])
    size, wanted = len(counts), counts.astype(float)
    weight = 1.0 / np.maximum(np.sqrt(wanted), 1.0)
    degree = np.bincount(row, weights=np.bincount(column)[column], minlength=size) * weight**2
    scale = 1.0 / np.maximum(np.bincount(column, weights=degree[row]), 1e-12)
    x = y = np.zeros(len(shapes))
    momentum = 1.0
    for _ in range(steps):
        off = (np.bincount(row, weights=y[column], minlength=size) - wanted) * weight**2
        ahead = np.maximum(0.0, y - scale * np.bincount(column, weights=off[row]))
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        y, x, momentum = ahead + (momentum - 1) / after * (ahead - x), ahead, after
    return x


def plan(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which together use every count exactly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[limit]:
        out.append(((limit,), int(left[limit])))
        left[limit] = 0
    shapes = patterns(left, limit)
    if shapes:
        repeats = np.floor(fit(left, shapes) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)].tolist():
            uses = Counter(shapes[k])
            n = min(int(repeats[k]), *(int(left[length]) // m for length, m in uses.items()))
            if n:
                out.append((shapes[k], n))
                for length, m in uses.items():
                    left[length] -= n * m
    # Best fit, longest first; sequences that hold the same lengths are treated as one group with a count.
    spaces: dict[int, list] = defaultdict(list)
    open_: list[int] = []

    def put(shape: tuple[int, ...], n: int, space: int) -> None:
        if not spaces[space]:
            bisect.insort(open_, space)
        spaces[space].append((shape, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[length])
        while rest:
            k = bisect.bisect_left(open_, length)
            if k < len(open_):
                space = open_[k]
                shape, n = spaces[space].pop()
                if not spaces[space]:
                    del open_[k]
                taken = min(n, rest)
                if taken < n:
                    put(shape, n - taken, space)
                put((*shape, length), taken, space - length)
            else:
                per = limit // length
                full, odd = divmod(rest, per)
                if full:
                    put((length,) * per, full, limit - per * length)
                if odd:
                    put((length,) * odd, 1, limit - odd * length)
                taken = rest
            rest -= taken
    out += [group for groups in spaces.values() for group in groups]
    return out


def places(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys length * 2^40 + first rank, with the first sequence and the offset of the rows from that rank on."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for shape, n in groups:
        offset = 0
        for length in shape:
            rows.append(((length << 40) + used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat a doc_id are packed each on its own, rows without one too.
    An empty table gives no rows. Very long texts are cut into pieces, none is cut short.
    """
    rows = materialize(pieces(docs, path, limit), "pieces")
    tally = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = tally.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    before = materialize(before, "ranks")
    counts = np.zeros(limit + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most 4096 rows
        counts[r.length] = r.n
    keys, sequences, offsets = places(plan(counts, limit))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column("length").to_numpy() << 40) + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            placed = pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *placed], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = rows.join(before.drop("n").hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())

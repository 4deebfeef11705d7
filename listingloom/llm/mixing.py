"""Mixing of sources to target weights, in blocks of words.

Each source's words, in an order that only its rows decide, are one stream, cut into blocks of a fixed length. What the mix
takes of a source is a list of slots: whole passes over its blocks in a pseudorandom order each, then as much of one more
pass as the target asks for, the last slot cut to the word. Each output shard draws how many of its slots go to which source:
multinomial counts given what every source takes in all, drawn down a tree of shards, so that a shard needs no other shard
and the sources still come out at their targets. Slots and documents meet by block number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from listingloom.session import hinted, materialize

#: Weights of the sources in order, repeating; times that a source may be taken; words in a block; blocks in a shard.
WEIGHTS, MOST_TIMES, BLOCK, SHARD, SEED = (5, 2, 1), 3, 512, 1024, 20
#: Sources are named collections: so many are held in the driver and sent to the tasks. More raise an error.
MOST_SOURCES = 100_000
_WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one group of the prefix sum, and groups that one window takes in order.
_GROUP, _FAN = 256, 1024
#: Marbles that numpy draws from at once; more are split by exact shares first.
_MARBLES = 500_000_000


@dataclass(frozen=True)
class Source:
    """A source: its words, its share of the mix in words, and the words that the mix takes, a whole number."""

    name: str | None
    words: int
    target: float
    taken: int

    def blocks(self, block: int) -> int:
        return -(-self.words // block)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> list[float]:
    """Shares of all words by weight; a share stops at `most` times its source, and the others share what it leaves."""
    free, left, out = list(range(len(sizes))), float(sum(sizes)), [0.0] * len(sizes)
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    while free:
        unit = left / sum(weight[k] for k in free)
        over = {k for k in free if unit * weight[k] > most * sizes[k]}
        for k in over or free:
            out[k] = float(most * sizes[k]) if over else unit * weight[k]
        left -= sum(out[k] for k in over)
        free = [k for k in free if over and k not in over]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of range(size), chosen by key, takes each index: a Feistel network over the next
    power of four, walked until it lands inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    half = np.where((np.uint64(1) << (2 * half)) < size.astype(np.uint64), half + np.uint64(1), half)
    mask, out, open_ = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64), np.arange(len(index))
    key = key.astype(np.uint64)
    while len(open_):
        h, m, k = half[open_], mask[open_], key[open_]
        left, right = out[open_] >> h, out[open_] & m
        for turn in range(4):
            x = (right + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn + 1) * 0xBF58476D1CE4E5B9 % 2**64)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(29))) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= size[open_].astype(np.uint64)]
    return out.astype(np.int64)


def _key(seed: int, *of: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, *of)).encode(), digest_size=8).digest(), "little")


def _slots(source: Source, block: int, seed: int) -> int:
    """How many slots a source takes."""
    if not source.taken:
        return 0
    full, rest = divmod(source.taken, source.words)
    n, short = source.blocks(block), source.words % block or block
    if not rest:
        return full * n
    # The place of the short last block in the pass that is not finished: pass on until it lands there.
    at = _place_of_last(source, block, seed, full)
    if rest <= at * block:
        return full * n + -(-rest // block)
    return full * n + at + 1 + max(0, -(-(rest - at * block - short) // block))


def _place_of_last(source: Source, block: int, seed: int, epoch: int) -> int:
    """The place in a pass of a source's last block, which may be short."""
    n = source.blocks(block)
    return int(_inverse(np.array([n - 1]), n, _key(seed, source.name, epoch))[0])


def _inverse(value: np.ndarray, size: int, key: int) -> np.ndarray:
    """The index that permuted() takes to each value: the same network backwards."""
    half = max(1, (int(np.ceil(np.log2(max(size, 2)))) + 1) // 2)
    half += (1 << 2 * half) < size
    h, m, k = np.uint64(half), np.uint64((1 << half) - 1), np.uint64(key)
    out, open_ = value.astype(np.uint64), np.arange(len(value))
    while len(open_):
        left, right = out[open_] >> h, out[open_] & m
        for turn in reversed(range(4)):
            x = (left + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn + 1) * 0xBF58476D1CE4E5B9 % 2**64)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right ^ ((x ^ (x >> np.uint64(29))) & m), left
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= np.uint64(size)]
    return out.astype(np.int64)


def _dealt(random: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among n marbles drawn; of too many marbles each colour first gives its exact share."""
    total = int(colours.sum())
    if total <= _MARBLES:
        return random.multivariate_hypergeometric(colours, n, method="marginals")
    share = np.array([int(c) * n // total for c in colours], np.int64)
    missing = n - int(share.sum())  # fewer than there are colours
    left = np.flatnonzero(colours - share > 0)
    share[random.permutation(left)[:missing]] += 1
    return share


def shard_counts(slots: np.ndarray, shard: int, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """How many of a shard's slots go to each source, and how many slots of each source lie in the shards before.

    Shards 0, 1, ... have `size` slots each, the last one what is left. A tree halves the shards; at each node on the way
    to a shard the left half's counts are drawn from what the node holds, seeded by the node, so all shards agree.
    """
    total = int(slots.sum())
    low, high = 0, -(-total // size)
    have, before = slots.astype(np.int64), np.zeros(len(slots), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = _dealt(np.random.default_rng([seed, low, high]), have, (middle - low) * size)
        if shard < middle:
            have, high = left, middle
        else:
            have, before, low = have - left, before + left, middle
    return have, before


def keyed(docs: DataFrame) -> DataFrame:
    """source, doc_id, mark, size, task, copies: rows that are alike in all that counts, and were read by one task, are one.

    mark, a hash of doc_id and text, orders the rows of a source. However often a row repeats, no later step has its copies
    in one group.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select("source", "doc_id", _mark().alias("mark"), size.alias("size"), F.spark_partition_id().alias("task"))
    return materialize(rows.groupBy("source", "doc_id", "mark", "size", "task").agg(F.count("*").alias("copies")), "mix-rows")


def _mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def sources_of(rows: DataFrame) -> list[Source]:
    """The sources of keyed rows by code point, those without a name last."""
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).orderBy(F.asc_nulls_last("source")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return [Source(r.source, r.words, t, min(round(t), MOST_TIMES * r.words)) for r, t in zip(found, targets([r.words for r in found]), strict=True)]


def _stream(rows: DataFrame) -> DataFrame:
    """k, doc_id, mark, size, start of each document: start is the words of its source (number k) before it.

    A prefix sum in levels, so that no window takes more than a few thousand rows whatever a source holds: rows are dealt to
    groups by mark, groups to groups of groups, and each level adds what lies before within its own.
    """
    count = rows.count()
    levels = [max(1, -(-count // _GROUP))]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // _FAN))
    high = F.shiftrightunsigned("mark", 33)  # spread evenly over 2^31, so groups are about equal
    rows = rows.withColumns({"g": F.floor(high * F.lit(levels[0]) / F.lit(1 << 31)).cast("long"), "own": F.col("size") * F.col("copies")})
    steps = [materialize(rows.groupBy("k", "g").agg(F.sum("own").alias("n")), "group-sums")]
    for _ in levels[1:]:
        steps.append(materialize(steps[-1].groupBy("k", F.floor(F.col("g") / _FAN).alias("g")).agg(F.sum("n").alias("n")), "group-sums"))
    before = None
    for step in reversed(steps):
        up = Window.partitionBy("k", "up").orderBy("g")
        inside = step.withColumn("up", F.floor(F.col("g") / _FAN)).select("k", "g", "up", (F.sum("n").over(up) - F.col("n")).alias("before"))
        if before is not None:
            above = before.select("k", F.col("g").alias("up"), F.col("before").alias("above"))
            inside = inside.join(above.hint("merge"), ["k", "up"]).withColumn("before", F.col("before") + F.col("above"))
        before = materialize(inside.select("k", "g", "before"), "groups-before")
    order = Window.partitionBy("k", "g").orderBy("mark", F.asc_nulls_last("doc_id"), "size", "task")
    inside = rows.withColumn("inside", F.sum("own").over(order) - F.col("own"))
    start = F.col("before") + F.col("inside") + F.col("copy") * F.col("size")
    return inside.join(before.hint("merge"), ["k", "g"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("k", "doc_id", "mark", "size", start.alias("start"))


@dataclass(frozen=True)
class Mix:
    """docs: k (number of the source), doc_id, mark, size, start; the sources by number; spans: the mix, stretch by stretch."""

    docs: DataFrame
    sources: list[Source]
    spans: DataFrame


def _shards(spark: SparkSession, sources: list[Source], block: int, shard: int, seed: int) -> DataFrame:
    """(shard, place, k, block, words) of every slot: which block of which source (by number) it holds, how much of it."""
    slots = np.array([_slots(s, block, seed) for s in sources], np.int64)
    number = -(-int(slots.sum()) // shard)
    shared = spark.sparkContext.broadcast((sources, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, slots = shared.value
        for batch in batches:
            for h in batch.column(0).to_pylist():
                counts, before = shard_counts(slots, h, shard, seed)
                k = np.repeat(np.arange(len(sources)), counts)
                slot = np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts, counts) + before[k]
                words, taken = (np.array([getattr(s, c) for s in sources], np.int64)[k] for c in ("words", "taken"))
                n = -(-words // block)
                epoch, index = slot // n, slot % n
                keys = {pair: _key(seed, sources[pair[0]].name, pair[1]) for pair in set(zip(k.tolist(), epoch.tolist(), strict=True))}
                own = permuted(index, n, np.array([keys[pair] for pair in zip(k.tolist(), epoch.tolist(), strict=True)], np.uint64))
                # Words of this pass before the slot: whole blocks, less what the short last block lacks once it is past.
                last = {pair: _place_of_last(sources[pair[0]], block, seed, pair[1]) for pair in keys}
                place = np.array([last[pair] for pair in zip(k.tolist(), epoch.tolist(), strict=True)], np.int64)
                past = epoch * words + index * block - np.where(index > place, n * block - words, 0)
                length = np.minimum(np.where(own == n - 1, words - (n - 1) * block, block), taken - past)
                mixed = permuted(np.arange(len(k)), np.full(len(k), len(k)), np.full(len(k), _key(seed, "shard", h), np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(k), h), mixed, k, own, length)], ["shard", "place", "k", "block", "words"])

    tasks = max(1, min(number, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, number, 1, tasks).mapInArrow(run, "shard long, place long, k long, block long, words long")


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """The mix of documents (doc_id, text, source).

    spans has a row for each stretch of a document in a slot of the mix: shard, place (of the slot in its shard), at (the
    stretch's first word in the slot), k and start (which name a document), doc_id, mark, first (its first word in the
    document), words. Null and empty texts have no words and no spans. Rows that repeat a doc_id, have none, or repeat
    altogether are documents of their own; documents without a source are a source of their own. Very long texts span many
    blocks. Other columns are ignored; an empty table gives an empty mix. The order within a source comes from a hash of
    doc_id and text, so reruns and other partitions of the same rows give the same mix.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    sources = sources_of(rows)
    names = spark.createDataFrame([(k, s.name) for k, s in enumerate(sources)], "k long, name string")
    stream = materialize(_stream(rows.join(hinted(names), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")), "mix-stream")
    blocks = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    pieces = stream.where("size > 0").withColumn("block", F.explode(blocks))
    slots = materialize(_shards(spark, sources, block, shard, seed), "mix-slots")
    begin = F.col("block") * block
    low, high = F.greatest("start", begin), F.least(F.col("start") + F.col("size"), begin + F.col("words"))
    spans = pieces.hint("merge").join(slots, ["k", "block"]).withColumns({"low": low, "high": high}).where("high > low")
    return Mix(stream, sources, spans.select("shard", "place", (F.col("low") - begin).alias("at"), "k", "start", "doc_id", "mark", (F.col("low") - F.col("start")).alias("first"), (F.col("high") - F.col("low")).alias("words")))


def by_document(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    spark = mixed.docs.sparkSession
    taken = mixed.spans.groupBy("k", "start").agg(F.sum("words").alias("taken"))
    sources = spark.createDataFrame([(k, s.words, s.target) for k, s in enumerate(mixed.sources)], "k long, source_size long, target double")
    # A document without words starts where another one does.
    with_words = mixed.docs.where("size > 0").join(taken.hint("merge"), ["k", "start"], "left")
    out = with_words.select("k", "doc_id", "size", "taken").unionAll(mixed.docs.where("size = 0").select("k", "doc_id", "size", F.lit(0).cast("long")))
    return out.join(hinted(sources), "k").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def texts(mixed: Mix, docs: DataFrame) -> DataFrame:
    """shard, place and text of every slot: the words of its stretches by one space each. docs: those that were mixed."""
    names = mixed.docs.sparkSession.createDataFrame([(k, s.name) for k, s in enumerate(mixed.sources)], "k long, name string")
    full = docs.join(hinted(names), F.col("source").eqNullSafe(F.col("name"))).select("k", _mark().alias("mark"), F.regexp_extract_all("text", F.lit(f"({_WORD})")).alias("all")).dropDuplicates(["k", "mark"])
    met = mixed.spans.join(full.hint("merge"), ["k", "mark"])
    piece = F.struct("at", F.array_join(F.slice("all", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ").alias("text"))
    cut = met.select("shard", "place", piece.alias("piece"))
    return cut.groupBy("shard", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p.text), " ").alias("text"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))

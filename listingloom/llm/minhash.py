"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations give all coordinates: the first scatters a shingle over the universe, the second, shifted circularly by
k, gives coordinate k. Exact copies collapse into classes before banding. Classes that share a band are compared with the
most central members of their bucket first. Where a bucket still holds several components after that, its members are
joined by their rarest shingles, enough of them that no similar pair is missed (prefix and positional filter), and only pairs
of different components are compared. So a group of copies costs a number of pairs in proportion to its size, and no link
between components is given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from listingloom.llm.held import held, tidied
from listingloom.llm.shingles import shingle_sets
from listingloom.operators.components import components
from listingloom.session import hinted, materialize

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
PIVOTS = 3
UNIVERSE_BITS = 22
#: A key with more rows than HOT_ROWS and a HOT_KEYS-th of all is joined by broadcast. A component with more than HOT_SHINGLE
#: rows of a shingle meets the others of that shingle, and never itself.
HOT_ROWS, HOT_KEYS, HOT_SHINGLE = 64, 20_000, 256
#: Pairs whose estimate from 128 coordinates is lower aren't verified; at a true 0.75 that is 6.5 standard deviations off.
LEAST_ESTIMATE = 0.5


def _shifted() -> np.ndarray:
    """Row i holds the second permutation at i, i+1, ..., i+127 (circular): all coordinates of one element."""

    def build() -> np.ndarray:
        second = np.random.default_rng(20_240_117).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:COORDINATES]]), COORDINATES)

    return held("minhash", "shifted", build)


def _scatter(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: a bijection of the universe (odd multipliers and xor-shifts) of the shingle's low bits."""
    mask = np.uint64((1 << UNIVERSE_BITS) - 1)
    x = shingles & mask
    for odd in (0x2C1B3C6D, 0x297A2D39):
        x = (x * np.uint64(odd)) & mask
        x ^= x >> np.uint64(UNIVERSE_BITS // 2)
    return x.astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 coordinates, low 16 bits of each."""
    rows, out = _shifted(), np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    places = _scatter(shingles)
    for i in range(0, len(places), 1024):
        np.minimum(out, rows[places[i : i + 1024]].min(axis=0), out=out)
    return out.astype(">u2")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@tidied
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            n, low, high, signatures = [], [], [], []
            for own in shingle_sets(part.column("text").to_pylist()):
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                n.append(len(own))
                low.append(_signed(digest & (1 << 64) - 1))
                high.append(_signed(digest >> 64))
                signatures.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "low", "high", "signature"],
            )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set as two longs, and the signature."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digests, "doc_id long, n_shingles long, low long, high long, signature binary")


@tidied
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose signatures agree in enough coordinates."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, COORDINATES) for c in ("signature_a", "signature_b"))
            batch = batch.filter(pa.array((a == b).mean(axis=1) >= LEAST_ESTIMATE))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])


@tidied
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs with 100 * intersection >= 75 * union of the full shingle sets."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            keep = [
                100 * (both := len(np.intersect1d(x, y, assume_unique=True))) >= 75 * (len(x) + len(y) - both)
                for x, y in zip(shingle_sets(part.column("text_a").to_pylist()), shingle_sets(part.column("text_b").to_pylist()), strict=True)
            ]
            part = part.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"])


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class representatives that are similar enough, after an estimate and then exactly."""
    own = classes.select("rep", "n_shingles", "signature")
    for side in "ab":
        pairs = pairs.join(own.toDF(side, f"n_{side}", f"signature_{side}").hint("merge"), side)
    near = pairs.where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)").mapInArrow(_similar, "a long, b long")
    near = materialize(near, "near-pairs")
    ids = materialize(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(hinted(ids), "doc_id", "left_semi")
    texts = materialize(texts, "near-texts")
    for side in "ab":
        near = near.join(texts.toDF(side, f"text_{side}").hint("merge"), side)
    return materialize(near.mapInArrow(_verified, "a long, b long").distinct(), "links")


def _with(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of key, n (rows of the key) and more. Keys of so many rows that one task would feel them are
    joined by broadcast: they are HOT_KEYS at most."""
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > F.lit(total // HOT_KEYS + HOT_ROWS)
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot).hint("merge"), key, how)
    return rest.unionByName(rows.join(F.broadcast(table.where(hot)), key))


@tidied
def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = list(shingle_sets(part.column("text").to_pylist()))
            sizes = [len(x) for x in sets]
            ids = np.repeat(part.column("doc_id").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(sets).view(np.int64), pa.int64())], ["rep", "n", "shingle"])


def _prefix_pairs(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of members (rep, root) of different components that the prefix filter can't rule out.

    With shingles ordered from the rarest, similar sets share one among the first n - ceil(0.75 n) + 1 of the larger and the
    first n - ceil(6 n / 7) + 1 of the smaller set; from the places of the first shared one follows how many can be shared
    at most. Shingles of a single component are left out, so what all copies of a text have in common joins nothing. The
    rows that a component has of a shingle are kept apart from the others' if they are many: they are joined with the rows
    of other components only, so the pairs within a large group of copies are never made.
    """
    ids = materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "mixed-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(hinted(ids), "doc_id", "left_semi")
    rows = materialize(texts.mapInArrow(_shingle_rows, "rep long, n long, shingle long").withColumnRenamed("n", "size"), "shingles")
    often = materialize(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "frequencies")
    known = _with(rows, often, "shingle", "left").withColumn("df", F.coalesce("n", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle"))
    prefix = known.withColumn("place", place).where("df > 1 and 4 * place <= size + 4")
    prefix = materialize(prefix.join(members.select("rep", "root").distinct().hint("merge"), "rep").select("shingle", "rep", "root", "size", "place"), "prefixes")
    mixed = prefix.groupBy("shingle").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n")).where("r < s").select("shingle", "n")
    prefix = materialize(_with(prefix, materialize(mixed, "mixed-shingles"), "shingle").drop("n"), "mixed-prefixes")
    large = materialize(prefix.groupBy("shingle", "root").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SHINGLE).select("shingle", "root"), "large-groups")
    group = hinted(large)
    few, many = prefix.join(group, ["shingle", "root"], "left_anti"), prefix.join(group, ["shingle", "root"], "left_semi")

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows if name == "a" else rows.where("7 * place <= size + 7")
        return rows.select("shingle", *(F.col(c).alias(f"{c}_{name}") for c in ("rep", "root", "size", "place")))

    # Shared at most: this shingle and all after it; needed: 3/7 of both sizes together. a is the larger set.
    fit = "root_a <> root_b and 4 * size_b >= 3 * size_a and (size_a > size_b or (size_a = size_b and rep_a > rep_b))"
    able = "7 * (1 + least(size_a - place_a, size_b - place_b)) >= 3 * (size_a + size_b)"
    found = side(few, "a").join(side(few, "b").hint("merge"), "shingle").where(f"{fit} and {able}")
    for a, b in ((few, many), (many, few)):
        found = found.unionByName(side(a, "a").join(side(b, "b").hint("merge"), "shingle").where(f"{fit} and {able}"))
    both = large.withColumnRenamed("root", "root_a").join(large.withColumnRenamed("root", "root_b").hint("merge"), "shingle").where("root_a <> root_b")
    paired = side(many, "a").join(both.hint("merge"), ["shingle", "root_a"])
    found = found.unionByName(paired.join(side(many, "b").hint("merge"), ["shingle", "root_b"]).where(f"{fit} and {able}"))
    return found.select(F.greatest("rep_a", "rep_b").alias("a"), F.least("rep_a", "rep_b").alias("b")).distinct()


def _pivots(members: DataFrame) -> DataFrame:
    """(key, pivots): up to PIVOTS members of each bucket, one of each hash class, the most central first.

    A member is the more central the more others share its buckets: of copies of one text, the least changed stands out.
    """
    central = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    ranked = members.select("key", "rep").join(central.hint("merge"), "rep").withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)))
    best = ranked.groupBy("key", "part").agg(F.min(F.struct(-F.col("weight"), "rep")).alias("m"), F.count("*").alias("n"))
    return best.groupBy("key").agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list("m")), lambda m: m["rep"]).alias("pivots"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their component, of the buckets that hold more than one component."""
    placed = members.select("key", "rep").join(roots.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left")
    placed = placed.withColumn("root", F.coalesce("root", "rep"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n")).where("r < s").select("key", "n")
    return materialize(_with(placed, materialize(mixed, "mixed-bands"), "key"), "mixed")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Null and blank texts have no shingles: they are linked with nothing and kept. Rows that repeat a doc_id are one
    document. Rows without a doc_id get their class's component; they are kept only if no row of it has an id. Texts are
    read whole; an empty table gives no rows. A pair is looked at if a band of 4 coordinates agrees (at a similarity of 0.75
    all 32 differ for 5 pairs in a million) or a path of such pairs leads to it, and 64 of the 128 coordinates agree.
    """
    sets = materialize(digests(docs), "shingle-digests")
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("low", "high").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("signature", 1 + 2 * ROWS * b, 2 * ROWS)) for b in range(BANDS)))
    bands = classes.select("rep", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(_with(bands, materialize(shared, "shared-bands"), "key"), "members")
    members = materialize(_with(members.select("key", "rep"), materialize(_pivots(members), "pivots"), "key").drop("n"), "pivoted")
    pairs = members.select(F.col("rep").alias("x"), F.explode("pivots").alias("y")).where("x != y")
    tested = materialize(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "pivot-pairs")
    links = _links(tested, classes, docs)
    members = _mixed(members, components(links))
    rest = _prefix_pairs(members, docs).join(tested.hint("merge"), ["a", "b"], "left_anti")
    roots = components(links.unionAll(_links(rest, classes, docs)))
    roots = classes.select("low", "high", "rep").join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("low", "high", F.coalesce("root", "rep").alias("root"))
    found = sets.join(roots.hint("merge"), ["low", "high"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

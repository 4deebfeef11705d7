"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks of a few words.

A section ends with a blank line, a paragraph with a line feed, a block where a hash of four neighbouring characters says so,
or after 64 characters without such a place: block ends depend on the text around them, so an edit changes the blocks that it
touches and at most those up to the next such place. Joined, the blocks are the text again, so equal roots mean equal texts.
The fingerprint is the tree written out: the root, then each section with its paragraphs and their blocks. Two fingerprints
are compared from the root down: branches that both have in the same order are counted whole and not entered, what lies
between two of them is entered on both sides, and the share of paragraphs and blocks in common is the likeness.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of a block, on average and at most.
BLOCK, MOST = 32, 64
#: Hex digits written for a section, a paragraph and a block; the root has 32.
NODE, LEAF = 8, 6

Tree = tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]


def _digest(data: str) -> str:
    return hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _cuts(text: str) -> list[int]:
    """Where blocks end inside lines, ascending: behind the second of four characters of one line whose hash says so."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 4:
        return []
    own = codes.astype(np.uint64)
    mixed = np.zeros(len(own) - 3, np.uint64)
    for k in range(4):
        mixed = (mixed ^ own[k : len(own) - 3 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    ends = mixed % np.uint64(BLOCK) == 0
    feeds = codes == 10
    for k in range(4):
        ends &= ~feeds[k : len(own) - 3 + k]
    return (np.flatnonzero(ends) + 2).tolist()


def tree(text: str | None, known: dict[str, tuple[str, list[str]]] | None = None) -> Tree:
    """(root, sections); a section is (digest, paragraphs), a paragraph (digest, blocks). known: paragraphs made before."""
    known = {} if known is None else known
    text = text or ""
    sections: list[tuple[str, list[tuple[str, list[str]]]]] = []
    own: list[tuple[str, list[str]]] = []
    cuts = _cuts(text)
    at = start = 0

    def close() -> None:
        sections.append((_digest("s" + "".join(p[0] for p in own)), list(own)))
        own.clear()

    for line in text.split("\n"):
        end = start + len(line)
        first = at
        while at < len(cuts) and cuts[at] < end:
            at += 1
        if line not in known:
            edges = [start, *cuts[first:at], end]
            if len(line) > MOST:
                edges = [k for i, j in zip(edges[:-1], edges[1:], strict=True) for k in range(i, j, MOST)] + [end]
            blocks = [_digest("b" + text[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)] if line else []
            known[line] = (_digest("p" + "".join(blocks)), blocks)
        own.append(known[line])
        start = end + 1
        if not line.strip():
            close()
    if own:
        close()
    return _digest("d" + "".join(s[0] for s in sections)), sections


def write(found: Tree) -> str:
    root, sections = found
    return root + "".join(f"/{s[:NODE]}" + "".join(f",{p[:NODE]}" + "".join(["."] + [b[:LEAF] for b in blocks]) for p, blocks in own) for s, own in sections)


def read(fingerprint: str) -> Tree:
    """The tree of a written fingerprint, with digests as far as they were written."""
    root, *sections = fingerprint.split("/")
    out = []
    for s in sections:
        digest, *own = s.split(",")
        out.append((digest, [((parts := p.split("."))[0], [parts[1][i : i + LEAF] for i in range(0, len(parts[1]), LEAF)]) for p in own]))
    return root, out


def _in_order(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal entries of both lists, rising in both: equal ends, and between them the longest rising run of those
    that stand at the same place among their equals."""
    n = min(len(a), len(b))
    low = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - low) if a[-1 - k] != b[-1 - k]), n - low)
    there: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, low - 1, -1):
        there.setdefault(b[j], []).append(j)
    met = [(i, there[a[i]].pop()) for i in range(low, len(a) - tail) if there.get(a[i])]
    ends: list[int] = []  # of the best runs of each length, their last places in b
    at: list[int] = []
    before = [-1] * len(met)
    for k, (_, j) in enumerate(met):
        size = bisect.bisect_left(ends, j)
        before[k] = at[size - 1] if size else -1
        ends[size : size + 1], at[size : size + 1] = [j], [k]
    middle, k = [], at[-1] if at else -1
    while k >= 0:
        middle.append(met[k])
        k = before[k]
    return [(k, k) for k in range(low)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _size(branch) -> int:
    """Paragraphs and blocks of a section, a paragraph or a block."""
    if isinstance(branch, str):
        return 1
    digest, own = branch
    return len(own) + 1 if not own or isinstance(own[0], str) else sum(len(blocks) + 1 for _, blocks in own)


def _common(a: list, b: list) -> int:
    """Paragraphs and blocks that two lists of sections, of paragraphs or of blocks have in common in the same order."""
    if not a or not b:
        return 0
    leaf = isinstance(a[0], str)
    names = [[x[:LEAF] if leaf else x[0][:NODE] for x in own] for own in (a, b)]
    met = _in_order(*names)
    if leaf:
        return len(met)
    total, i, j = 0, 0, 0
    for x, y in [*met, (len(a), len(b))]:
        if i < x and j < y:
            total += _common([c for _, own in a[i:x] for c in own], [c for _, own in b[j:y] for c in own])
        total += _size(a[x]) if x < len(a) else 0
        i, j = x + 1, y + 1
    return total


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots, else twice the paragraphs and blocks in common, in order, over all of them (0 when there are none).

    Below 1 for texts that differ: their paragraphs do.
    """
    if a[0] == b[0]:
        return 1.0
    total = sum(_size(s) for own in (a[1], b[1]) for s in own)
    return 2 * _common(a[1], b[1]) / total if total else 0.0


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of a where b's tree differs; paragraphs of b beyond a's are named by their place in b."""
    if a[0] == b[0]:
        return []
    out = []
    for i in range(max(len(a[1]), len(b[1]))):
        one = a[1][i] if i < len(a[1]) else ("", [])
        other = b[1][i] if i < len(b[1]) else ("", [])
        if one[0][:NODE] != other[0][:NODE]:
            n = max(len(one[1]), len(other[1]))
            out += [(i, k) for k in range(n) if k >= len(one[1]) or k >= len(other[1]) or one[1][k][0][:NODE] != other[1][k][0][:NODE]]
    return out


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True)


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by bucket, own rows first and a row of the bucket below last; each is compared with the next."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[list] = [[] for _ in kinds]
    before, size = None, 0
    for bucket, guest, doc_id, text in _rows(batches):
        text = text or ""
        known: dict = {} if before is None or before[0] != bucket else before[5]
        made = tree(text, known)
        if before is not None and before[0] == bucket and not before[1]:
            _, _, old_id, old_text, old_tree, _, old_written = before
            changed = edited(old_text, text)
            changed_tree = tree(changed, known)
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            row = (old_id, len(old_text), sha, old_written, write(changed_tree), likeness(old_tree, changed_tree), likeness(old_tree, made))
            for column, x in zip(out, row, strict=True):
                column.append(x)
            size += len(row[3])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], _OUT)
                out, size = [[] for _ in kinds], 0
        lines = {line: known[line] for line in text.split("\n")}
        before = (bucket, guest, doc_id, text, made, lines, write(made))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], _OUT)


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the ascending cuts are less than value, by halving steps."""
    table = F.lit(cuts).cast("array<bigint>")
    steps = F.lit([1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(n + step > len(cuts), n).when(F.element_at(table, F.least(n + step, F.lit(len(cuts)))) < value, n + step).otherwise(n))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, with the fingerprints of its text and of the text edited with the next document.

    The next document is the one with the next smaller doc_id, after the smallest the largest; rows that repeat a doc_id
    follow by a hash of their text, rows without one come after all others, by the hash too. Null texts are empty. In a table
    of one row the next document is the row itself; an empty table gives no rows. Texts are read whole, very long ones too.

    Texts are shuffled once, into buckets of neighbouring ids. An id that fills a bucket by itself, and the rows without one,
    are dealt over several by the hash. The first row of each bucket is sent to the bucket before it as well.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = rows.select("doc_id", F.xxhash64("text").alias("hash"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 100 * parts).alias("at"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    hot = Counter(found["at"] or [])
    many = {i: min(2 * n, 4 * parts) for i, n in hot.items() if n > 1}  # ids that fill a bucket, and over how many they are dealt
    cuts = sorted({*hot, *(i - 1 for i in many if i > -(1 << 63))})
    deal = F.coalesce(F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col("doc_id")], F.lit(1)) if many else F.lit(1)
    deal = F.when(F.col("doc_id").isNull(), max(1, 8 * parts * found["nulls"] // max(found["n"], 1))).otherwise(deal)
    # Buckets are numbered in the order of documents: ids descending, none last, hashes ascending.
    group = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - _below(cuts, F.col("doc_id")) if cuts else F.lit(0))
    within = F.floor((F.shiftright("hash", 32) + (1 << 31)) * deal / (1 << 32)).cast("long")
    bucket = (group.cast("long") * (1 << 24) + within).alias("bucket")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("back"), "hash")).alias("first")
    tops = sorted((r.bucket, r.first.back, r.first.hash) for r in keys.groupBy(bucket).agg(first).collect()) if found["n"] else []  # a row per bucket
    above = [(b, None if back is None else ~back, h, tops[i - 1][0]) for i, (b, back, h) in enumerate(tops)]
    guests = F.broadcast(spark.createDataFrame(above, "own long, top long, top_hash long, above long"))
    placed = rows.withColumn("hash", F.xxhash64("text"))
    sent = placed.select("*", bucket).join(guests, F.col("bucket") == F.col("own"))
    is_top = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("hash") == F.col("top_hash"))
    home, away = F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("above").alias("bucket"), F.lit(1).alias("guest"))
    sent = sent.select("doc_id", "text", "hash", F.explode(F.when(is_top, F.array(home, away)).otherwise(F.array(home))).alias("to")).select("to.bucket", "to.guest", "doc_id", "text", "hash")
    ordered = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "hash").drop("hash")
    return ordered.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))

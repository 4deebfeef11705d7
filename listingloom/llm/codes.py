"""Vector codes: each vector cut into parts, each part replaced by the index of its nearest entry in a codebook.

The codebooks are made by Lloyd's rounds over tables of parts. A part lives with the owner of its entry, (position, entry,
salt); owners add up the parts that reside with them; after the codebooks move, parts look for their nearest entry where they
are, and only those that change entry are dealt out again, the others stay in the files they are in. An entry that holds many
parts has many owners, so no owner grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom.llm.vectors import finite, integers, matrix
from listingloom.session import discard, hinted, materialize

POSITIONS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
_MEMBER = "position int, salt long, part array<long>, entry int, owner int, moved boolean"


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The nearest entry of each part (of two equally near ones the first), and the squared distance."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * parts.shape[1] < 2**53:  # doubles hold every sum exactly
        x, c = parts.astype(np.float64), book.astype(np.float64)
        far = (c * c).sum(axis=1) - 2 * (x @ c.T)
        entry = far.argmin(axis=1)
        return entry, (far[np.arange(len(x)), entry] + (x * x).sum(axis=1)).astype(np.int64).tolist()
    x, c = parts.astype(object), book.astype(object)
    found = [min((sum((a - b) ** 2 for a, b in zip(row, one, strict=True)), k) for k, one in enumerate(c)) for row in x]
    return np.array([k for _, k in found], np.int64), [d for d, _ in found]


def _assign(books: list[np.ndarray], owners: np.ndarray) -> Callable:
    """Members with the entry they belong to now, its owner, and whether that is another entry than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, salt, before = (batch.column(c).to_numpy() for c in ("position", "salt", "entry"))
            parts = matrix(batch.column("part"))
            entry = np.zeros(len(position), np.int64)
            for p in range(POSITIONS):
                at = np.flatnonzero(position == p)
                for k in range(0, len(at), 4096):
                    own = at[k : k + 4096]
                    entry[own] = nearest(parts[own], books[p])[0]
            owner = salt % owners[position, entry]
            yield pa.RecordBatch.from_arrays(
                [batch.column("position"), batch.column("salt"), batch.column("part"), pa.array(entry.astype(np.int32)), pa.array(owner.astype(np.int32)), pa.array(entry != before)],
                ["position", "salt", "part", "entry", "owner", "moved"],
            )

    return run


def _resident_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each position and entry of the members that reside here: how many there are, and the sums of their parts."""
    for batch in batches:
        if batch.num_rows:
            key = batch.column("position").to_numpy().astype(np.int64) * ENTRIES + batch.column("entry").to_numpy()
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            sums = np.add.reduceat(matrix(batch.column("part"))[order], starts, axis=0)
            ends = pa.array(np.arange(0, sums.size + 1, sums.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[order][starts].astype(np.int32)), pa.array(np.diff(np.append(starts, len(key)))), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], ["key", "n", "sums"]
            )


def _update(residents: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The codebooks moved to the floors of their members' means, and the number of members by position and entry."""
    sums = residents.select("position", "entry", "part").mapInArrow(_resident_sums, "key int, n long, sums array<long>")
    cells = sums.select("key", "n", F.posexplode("sums").alias("i", "s")).groupBy("key", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    moved, counts = [b.copy() for b in books], np.zeros((POSITIONS, ENTRIES), np.int64)
    for r in cells.collect():  # at most 1,024 entries of one part's length
        p, e = divmod(r.key, ENTRIES)
        moved[p][e, r.i] = int(r.s) // r.n
        counts[p, e] = r.n
    return moved, counts


def _owners(counts: np.ndarray, tasks: int) -> np.ndarray:
    """Over how many owners an entry's members are dealt: as many as it has tasks' shares of all members, one at least."""
    return np.maximum(1, -(-counts * tasks // max(1, int(counts.sum()))))


def _dealt(members: DataFrame, tasks: int) -> DataFrame:
    return members.repartition(tasks, "position", "entry", "owner").drop("moved")


def codebooks(kept: DataFrame, start: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of a written table of vectors x, after so many rounds from those given."""
    tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = start[0].shape[1]
    parts = F.array(*(F.slice("x", p * width + 1, width) for p in range(POSITIONS)))
    members = kept.select(F.monotonically_increasing_id().alias("salt"), F.posexplode(parts).alias("position", "part")).withColumn("entry", F.lit(-1))
    books, everywhere = start, np.full((POSITIONS, ENTRIES), tasks)
    staying, coming = None, materialize(_dealt(members.mapInArrow(_assign(books, everywhere), _MEMBER), tasks), "members")
    for k in range(rounds):
        residents = coming if staying is None else staying.unionByName(coming)
        books, counts = _update(residents, books)
        if k + 1 < rounds:
            looked = materialize(residents.drop("owner").mapInArrow(_assign(books, _owners(counts, tasks)), _MEMBER), "members", "moved")
            discard(*(t for t in (staying, coming) if t is not None))
            staying, coming = looked.where("not moved").drop("moved"), materialize(_dealt(looked.where("moved"), tasks), "movers")
    discard(*(t for t in (staying, coming) if t is not None))
    return books


def sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for row in b for v in row.tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256: a row per vector.

    Rows count as `vectors.finite` says; entries x become floor(1024 * x) (1024 * x beyond +-2^40 counts as that), and a
    length that four doesn't divide is filled up with zeros. The codebooks start from the 256 smallest keys, or as many as
    there are: rows without a key come last, of equal keys the smaller vector first. Rows that repeat a key or a vector count
    one by one. error and label_error are null where a long can't hold them. Other columns are ignored; an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    x = integers(column, SCALE)
    x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size(x), F.lit(POSITIONS))))
    kept = materialize(finite(vectors.select(key, label, column), column).select(F.col(key).alias("id"), F.col(label).alias("label"), x.alias("x")), "vectors")
    first = np.array([r.x for r in kept.orderBy(F.asc_nulls_last("id"), "x").limit(ENTRIES).select("x").collect()], np.int64)
    books = codebooks(kept, np.split(first, POSITIONS, axis=1), rounds) if len(first) else []
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                own = batch.slice(k, 4096)
                found = [nearest(part, book) for part, book in zip(np.split(matrix(own.column("x")), POSITIONS, axis=1), shared.value, strict=True)]
                code = [bytes(c).hex() for c in np.stack([e for e, _ in found], axis=1).astype(np.uint8)]
                error = [e if (e := sum(d)) < 2**63 else None for d in zip(*(d for _, d in found), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("label"), pa.array(code), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = materialize(kept.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    total = F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error")
    labels = materialize(coded.groupBy(F.col("label").alias("of")).agg(total), "label-errors")
    out = coded.join(hinted(labels), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(sha256(books)).alias("codebooks_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same rounds for DuckDB, on vectors of 64 entries."""
    far = "list_sum(list_transform(range(1, 17), lambda i: (part[i] - c[i]) * (part[i] - c[i])))"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, p, x[p * 16 + 1 : p * 16 + 16] AS part FROM kept, range(4) t(p))",
        "c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))",
    ]
    for k in range(ROUNDS + 1):
        # min() over distance * 256 + entry takes the nearest entry, the lower one of two
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(part) AS part, min(CAST({far} AS BIGINT) * 256 + e) AS m FROM parts JOIN c{k} USING (p) GROUP BY vec_id, p)")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT p, m % 256 AS e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS v FROM a{k}, range(1, 17) t(i) GROUP BY p, m % 256, i)")
            steps.append(f"n{k} AS (SELECT p, e, list(v ORDER BY i) AS v FROM s{k} GROUP BY p, e)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(v, c) AS c FROM c{k} LEFT JOIN n{k} USING (p, e))")
    steps.append(f"coded AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{ROUNDS} JOIN kept USING (vec_id) GROUP BY vec_id, label)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded"""


ORACLE = _sql()

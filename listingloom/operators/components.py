"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from listingloom.session import discard, materialize

#: So many edges are held by a task at once.
AT_ONCE = 1 << 21


def _to_least(rows: DataFrame, parts: int) -> DataFrame:
    """rows (u, v) with m, the smallest neighbour of u.

    A node of many rows would have them all in one task. Nodes with more than a quarter of a task's share of rows are at most
    four for each task, so they are few whatever the table holds: their rows meet a broadcast table and aren't dealt out.
    """
    tally = materialize(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), "m", "n"), "neighbours")
    share = (tally.agg(F.sum("n")).first()[0] or 0) // (4 * parts)
    hubs = tally.where(F.col("n") > share).select("k", "m")
    few = tally.where(F.col("n") <= share).select("k", "m")
    met = F.col("u") == F.col("k")
    others = rows.join(F.broadcast(hubs), met, "left_anti")
    return rows.join(F.broadcast(hubs), met).unionByName(others.join(few.hint("merge"), met)).drop("k")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots, root the smallest node reachable.

    Alternating large-star and small-star steps, until every node points at one that points nowhere.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while True:
        ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if not open_.limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, parts).withColumn("m", F.least("u", "m")).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large, "large-star")
        small = _to_least(large, parts).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, materialize(small.select("e.*").where("u > v").distinct(), "edges")
        discard(before, large)


def _least(a: np.ndarray, b: np.ndarray, every: bool) -> pa.RecordBatch:
    """(node, root) of the nodes of some edges; where not every node is wanted, of the even ones, by the least even one."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        x, y = root[u], root[v]
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    mine = np.arange(len(nodes)) if every else np.flatnonzero(nodes % 2 == 0)
    _, first, group = np.unique(root[mine], return_index=True, return_inverse=True)
    least = mine[first[group]] if len(mine) else mine
    told = least != mine
    return pa.RecordBatch.from_arrays([pa.array(nodes[mine][told], pa.int64()), pa.array(nodes[least][told], pa.int64())], ["a", "b"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size, every = 0, False

    def least() -> pa.RecordBatch:
        return _least(*(np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held] or [np.empty(0, np.int64)]) for k in (0, 1)), every)

    for batch in batches:
        if size + batch.num_rows > AT_ONCE and size:
            every = True
            yield least()
            held, size = [], 0
        held.append(batch)
        size += batch.num_rows
    yield least()


def contracted(edges: DataFrame, by: str) -> DataFrame:
    """Fewer edges (a, b) of whole numbers with the same components among the even nodes.

    An odd node must have all its edges under one value of by. So a task that holds all edges of its values needs to tell of even
    nodes only; one that holds too many tells of all nodes, some edges at a time.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, by).select("a", "b").mapInArrow(_contracted, "a long, b long")

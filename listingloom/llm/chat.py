"""Chat formatting with minimum-cost repair of roles.

Legal conversations are those of a small automaton: an optional system turn, then user and assistant in turn, the assistant
last. A turn may be relabelled, merged into the turn before it, or have empty turns put before it; dynamic programming
finds the cheapest repair. Its step for one turn is a small (min, +) matrix, and so is the step for a block of turns: long
conversations are cut into blocks whose matrices are made apart, composed block by block, and filled in apart again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom.session import hinted, materialize

#: States: the role of the last turn written; 0 is the start.
ROLES = ("", "system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
MERGE, INSERT, RELABEL, UNKNOWN = 1.0, 3.0, 2.0, 1.0
#: Turn numbers of a block; blocks of more than MOST rows (turns that repeat, turns without a number) are cut finer.
BLOCK, MOST = 512, 4096
#: (state before, role written) -> roles of the empty turns that must come between; None: impossible. Equal roles merge.
BETWEEN: dict[tuple[int, int], tuple[int, ...] | None] = {
    (0, 1): (), (0, 2): (), (0, 3): (2,),
    (1, 1): (), (1, 2): (), (1, 3): (2,),
    (2, 1): None, (2, 2): (), (2, 3): (),
    (3, 1): None, (3, 2): (), (3, 3): (),
}
#: Empty turns that end a conversation from each state.
ENDING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def role_number(role: str | None) -> int:
    """1 to 3, or 0 for a role that isn't known."""
    name = (role or "").strip().lower()
    return ROLES.index(ALIASES.get(name, name)) if ALIASES.get(name, name) in ROLES[1:] else 0


def _step(role: int) -> np.ndarray:
    out = np.full((4, 4), np.inf)
    for (p, x), between in BETWEEN.items():
        if between is not None:
            out[p, x] = (0.0 if x == role else RELABEL if role else UNKNOWN) + (MERGE if p == x else 0.0) + INSERT * len(between)
    return out


STEPS = [_step(r) for r in range(4)]


def compose(matrices: list[np.ndarray]) -> np.ndarray:
    """The (min, +) product."""
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None, :, :]).min(axis=1)
    return out


def path(matrices: list[np.ndarray], start: int, end: int) -> list[int]:
    """The cheapest states after each matrix from start to end; of equal ones, the one whose earlier state is smaller."""
    costs = [np.full(4, np.inf)]
    costs[0][start] = 0
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    states = [end]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmin(costs[k] + matrices[k][:, states[-1]])))
    return states[::-1]


_MARKER = re.compile(r"<(\\*)\|")


def escape(text: str) -> str:
    """The text with a backslash more in whatever could pass for the opening of a marker."""
    return _MARKER.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(role: int, text: str, opens: bool) -> str:
    """A turn's piece: its header and escaped text where it opens a turn, else its text alone; each piece ends with a line feed."""
    return f"<|{ROLES[role]}|>\n{escape(text)}\n" if opens else f"{escape(text)}\n"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of ordered batches by their first columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, own in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(own)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _block_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.int64()), *((k, pa.int64()) for k in BLOCK_KEY), ("n", pa.int64()), ("matrix", pa.list_(pa.float64()))])
    yield from _batches(((*key, len(rows), compose([STEPS[r[4]] for r in rows]).ravel().tolist()) for key, rows in _groups(batches, 4)), schema)


def _final(costs: np.ndarray) -> int:
    """The state that it is cheapest to end in."""
    return int(np.argmin(costs + np.array([INSERT * len(ENDING[s]) for s in range(4)])))


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, the states before and after it on the cheapest way, the turns before it, and whether it is the last."""

    def rows() -> Iterator[tuple]:
        for (conv,), own in _groups(batches, 1):
            matrices = [np.array(r[5]).reshape(4, 4) for r in own]
            costs = np.full(4, np.inf)
            costs[0] = 0
            for m in matrices:
                costs = (costs[:, None] + m).min(axis=0)
            before, turns = 0, 0
            for k, (r, after) in enumerate(zip(own, path(matrices, 0, _final(costs)), strict=True)):
                yield *r[:4], before, after, turns, k == len(own) - 1
                before, turns = after, turns + r[4]

    yield from _batches(rows(), pa.schema([("conv", pa.int64()), *((k, pa.int64()) for k in BLOCK_KEY), ("before", pa.int32()), ("after", pa.int32()), ("turns", pa.int64()), ("last", pa.bool_())]))


_FILLED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("place", pa.int64()), ("role_out", pa.string()), ("relabelled", pa.bool_()), ("merged", pa.bool_()), ("inserted", pa.int32()), ("cost", pa.float64()), ("rendered", pa.string())])
_FILLED_TYPES = "conv_id long, turn long, role string, place long, role_out string, relabelled boolean, merged boolean, inserted int, cost double, rendered string"


def _filled(known: list[int], rows: list[tuple], state: int, after: int, turns: int, last: bool) -> Iterator[tuple]:
    """The output of turns in order; rows: (conv_id, turn, role, text)."""
    for k, (role, (conv_id, turn, name, text), x) in enumerate(zip(known, rows, path([STEPS[r] for r in known], state, after), strict=True)):
        between, merged = BETWEEN[state, x], state == x
        ended = ENDING[x] if last and k == len(known) - 1 else ()
        pieces = "".join(render(b, "", True) for b in between) + render(x, text, not merged) + "".join(render(b, "", True) for b in ended)
        inserted = len(between) + len(ended)
        cost = (0.0 if x == role else RELABEL if role else UNKNOWN) + (MERGE if merged else 0.0) + INSERT * inserted
        yield conv_id, turn, name, turns + k, ROLES[x], x != role, merged, inserted, cost, pieces
        state = x


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches((row for _, own in _groups(batches, 4) for row in _filled([r[4] for r in own], [r[5:9] for r in own], *own[0][9:13])), _FILLED)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are conversations of one turn each."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for known, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _filled([known], [tuple(row)], 0, _final(STEPS[known][0]), 0, True)

    yield from _batches(rows(), _FILLED)


#: What a block is named by within its conversation: its turn numbers, and where these alone hold too many rows, the one turn
#: and a range of the hash of texts.
BLOCK_KEY = ("block", "one_turn", "texts")


def repair(turns: DataFrame) -> DataFrame:
    """One row for each row of turns: conv_id, turn, role, place, role_out, relabelled, merged, inserted, cost, rendered.

    The rendered conversation is its rows' pieces joined in the order of place; markers that stand in a text are escaped.
    Turns are ordered by turn, null turns first, then by a hash of the text and by role; rows that repeat are turns each. A
    row without a conv_id belongs to no other row: it is a conversation of its own. A null text is an empty one, a null or
    unknown role costs less to relabel than a known one. An empty table gives no rows. Texts are rendered whole; a task holds
    the rows of a block, and of a conversation one matrix for each of its blocks.
    """
    least = -(1 << 62)
    name = F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit(""))))
    for alias, role in ALIASES.items():
        name = F.when(name == alias, role).otherwise(name)
    known = F.when(name == "system", 1).when(name == "user", 2).when(name == "assistant", 3).otherwise(0)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"), known.alias("known"), F.xxhash64(text).alias("text_key"))
    alone = rows.where("conv_id is null").select("known", "conv_id", "turn", "role", "text").mapInArrow(_alone, _FILLED_TYPES)
    rows = rows.where("conv_id is not null").select("*", F.col("conv_id").alias("conv"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(least)).cast("long").alias("block"), F.coalesce("turn", F.lit(least)).alias("turn_key"), F.coalesce("role", F.lit("")).alias("role_key"))
    full = materialize(rows.groupBy("conv", "block").agg(F.count("*").alias("rows")).where(F.col("rows") > MOST), "full-blocks")
    rows = rows.join(hinted(full), ["conv", "block"], "left")
    bits = F.least(F.ceil(F.log2(F.col("rows") / MOST)).cast("int"), F.lit(30))
    rows = rows.withColumn("one_turn", F.when(F.col("rows").isNotNull(), F.col("turn_key")).otherwise(0)).withColumn("texts", F.when(F.col("rows").isNotNull(), F.floor(F.shiftright("text_key", 32) / F.pow(F.lit(2.0), 32 - bits)).cast("long")).otherwise(0)).drop("rows")
    order = ["turn_key", "text_key", "role_key"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv", *BLOCK_KEY]
    light = rows.select(*key, "known", *order).repartition(parts, *key).sortWithinPartitions(*key, *order)
    types = ", ".join(f"{k} long" for k in key)
    matrices = materialize(light.select(*key, "known").mapInArrow(_block_matrices, f"{types}, n long, matrix array<double>"), "turn-matrices")
    ends = matrices.select(*key, "n", "matrix").repartition(parts, "conv").sortWithinPartitions(*key).mapInArrow(_block_ends, f"{types}, before int, after int, turns long, last boolean")
    # Dealt out after the join: a skewed join may split a block over tasks.
    whole = rows.join(hinted(materialize(ends, "turn-ends")), key).repartition(parts, *key).sortWithinPartitions(*key, *order)
    return whole.select(*key, "known", "conv_id", "turn", "role", "text", "before", "after", "turns", "last").mapInArrow(_fill, _FILLED_TYPES).unionAll(alone)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Spaced masks choose tokens of a short window; the rest may differ. Seeds of benchmark items and of documents are joined by
hash; each hit names a diagonal (document position minus item position). The masks lose nothing: a passage that keeps the
least overlap has, wherever its tokens are substituted, a number of hits on its diagonal that is known for each item length
(`least_hits`). Diagonals with so many are verified token by token. Items of any length are searched; the shortest ones,
for which a mask of two tokens could miss one, token by token.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listingloom.session import hinted, materialize

#: (weight, span): all masks of so many tokens within the span. An item takes the first family that can't miss it.
FAMILIES = ((3, 4), (3, 5), (3, 7), (2, 3), (2, 5), (1, 1))
#: Share of an item's tokens that must stand on one diagonal of a document.
LEAST_OVERLAP = 0.6
#: Longer items are taken as pieces of half this to this many tokens, one of which keeps the overlap.
LONG = 512


def masks(family: tuple[int, int]) -> list[tuple[int, ...]]:
    """Offsets of the chosen tokens, each mask beginning at 0."""
    weight, span = family
    return [(0, *rest) for rest in combinations(range(1, span), weight - 1)]


def least_hits(family: tuple[int, int], longest: int, least: float) -> list[int]:
    """By item length 0 to longest: the fewest hits on a diagonal where a share of at least least of the tokens agree."""
    span, unmet = family[1], 1 << 30
    ends = [sum(1 << (m[-1] - k) for k in m) for m in masks(family)]  # bits of a mask, the newest token lowest
    new = [sum(w & e == e for e in ends if e & 1) for w in range(1 << span)]
    states = 1 << (span - 1)
    fewest = np.full((states, longest + 1), unmet)  # by the last span - 1 tokens (bit: agrees) and the tokens agreed
    fewest[0, 0] = 0
    out = [0]
    for n in range(1, longest + 1):
        after = np.full_like(fewest, unmet)
        for state in range(states):
            for bit in (0, 1):
                window = state << 1 | bit
                to = after[window & (states - 1)]
                gained = fewest[state, : longest + 1 - bit] + (new[window] if bit else 0)
                np.minimum(to[bit:], gained, out=to[bit:])
        fewest = after
        agreed = np.arange(n + 1) >= least * n
        out.append(int(fewest[:, : n + 1].min(axis=0)[agreed].min()) if agreed.any() else 1)
    return out


def plan(longest: int, least: float) -> tuple[list[int], list[int]]:
    """By item length (from 1; the last entry stands for all longer ones): number of the family, hits it can't go below."""
    longest = min(longest, LONG)
    tables = [least_hits(f, longest, least) for f in FAMILIES]
    first = [next((i for i, t in enumerate(tables) if t[n]), len(FAMILIES) - 1) for n in range(1, longest + 1)]
    hits = [max(tables[i][n], 1) for n, i in enumerate(first, 1)]
    if longest == LONG:
        pieces = [t[LONG // 2 :] for t in tables]
        i = next((i for i, t in enumerate(pieces) if min(t)), len(FAMILIES) - 1)
        first.append(i)
        hits.append(max(min(pieces[i]), 1))
    return first, hits


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seeds(rows: DataFrame, keep: list[str], chosen: list[tuple[int, ...]]) -> DataFrame:
    """keep, pos, seed for each position and mask of rows.h, an array of token hashes; null where a mask leaves the array."""
    used = sorted({k for m in chosen for k in m})
    shifted = F.arrays_zip(*(F.slice("h", F.lit(k + 1), F.greatest(F.size("h") - k, F.lit(0))).alias(f"t{k}") for k in used))
    at = rows.select(*keep, F.posexplode(shifted).alias("pos", "w"))
    hashed = [F.when(F.col(f"w.t{m[-1]}").isNotNull(), F.xxhash64(F.lit(sum(1 << k for k in m)), *(F.col(f"w.t{k}") for k in m))) for m in chosen]
    return at.select(*keep, "pos", F.explode(F.array(*hashed)).alias("seed"))


def overlaps(docs: DataFrame, items: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, overlap, start) of each document that holds an item, at its best diagonal.

    Rows without a doc_id or an item_id can't be named and are not searched; null texts have no tokens. Repeated rows
    give one result; an item_id with several texts is each of them. start is the document's token at which the item begins
    (negative: it begins before the text); of diagonals that match equally the first. Items without tokens match nothing,
    empty tables give no rows. Texts are searched whole; the hits of a very long one are at most its tokens times the
    tokens of the item with the same seed, counted before they are shuffled.
    """
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0).distinct()
    longest = items.select(F.max(F.size("w"))).first()[0] or 0
    family, hits = plan(max(longest, 1), least)
    known = F.least(F.size("w"), F.lit(len(family)))
    items = materialize(items.select("*", hashes.alias("h"), F.element_at(F.lit(family), known).alias("family"), F.element_at(F.lit(hits), known).alias("least_hits")), "items")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    families = sorted(r.family for r in items.select("family").distinct().collect()) or [0]
    wanted = reduce(DataFrame.unionAll, (seeds(items.where(F.col("family") == i), ["item_id"], masks(FAMILIES[i])) for i in families))
    wanted = materialize(wanted.where("seed is not null").withColumnRenamed("pos", "item_pos").distinct(), "seeds")
    chosen = sorted({m for i in families for m in masks(FAMILIES[i])})
    at = seeds(docs.select("doc_id", hashes.alias("h")), ["doc_id"], chosen).join(hinted(wanted), "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("start"))
    found = at.groupBy("doc_id", "item_id", "start").agg(F.count("*").alias("hits"))
    found = found.join(hinted(items.groupBy("item_id").agg(F.min("least_hits").alias("least_hits"))), "item_id").where("hits >= least_hits")
    found = materialize(found.select("doc_id", "item_id", "start"), "hits")
    there = docs.join(hinted(materialize(found.select("doc_id").distinct(), "hit-ids")), "doc_id", "left_semi").select("doc_id", F.col("w").alias("dw"))
    both = found.join(hinted(items.select("item_id", "w")), "item_id").join(there.hint("merge"), "doc_id")
    first, skipped = F.greatest("start", F.lit(0)), F.greatest(-F.col("start"), F.lit(0))
    n = F.greatest(F.least(F.size("dw") - first, F.size("w") - skipped), F.lit(0))
    same = F.zip_with(F.slice("dw", first + 1, n), F.slice("w", skipped + 1, n), lambda x, y: x == y)
    matched = F.size(F.filter(same, lambda x: x))
    scored = both.select("doc_id", "item_id", "start", matched.alias("matched"), F.size("w").alias("item_tokens")).where(F.col("matched") >= least * F.col("item_tokens"))
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("start")).alias("back"), "item_tokens")).alias("b"))
    return best.select("doc_id", "item_id", "b.matched", "b.item_tokens", (F.col("b.matched") / F.col("b.item_tokens")).alias("overlap"), (-F.col("b.back")).alias("start"))


#: The same by brute force: every diagonal of a document and an item that share a token at it.
ORACLE = r"""
WITH d AS (SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark WHERE item_id IS NOT NULL),
dt AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM d),
it AS (SELECT item_id, len(w) AS n, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM i),
h AS (SELECT doc_id, item_id, n, dt.pos - it.pos AS start, count(*) AS matched FROM dt JOIN it USING (token) GROUP BY ALL HAVING count(*) >= 0.6 * n)
SELECT doc_id, item_id, CAST(matched AS INT) AS matched, CAST(n AS INT) AS item_tokens, matched / n AS overlap, CAST(start AS INT) AS start
FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1
"""


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

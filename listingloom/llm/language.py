"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text answers "how long does the text go on as
something seen in that language"; a text is cut greedily into longest matches, and the language that needs the fewest
phrases wins. The automata are compiled to tables in which a mismatch closes the phrase and starts the next one, so that
numpy walks thousands of text windows and all languages in step. Each window is first walked from the start state; where
the window before it ended in another state, it is walked again from there until both walks meet, so that the phrases are
those of the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from listingloom.llm.held import held, sliced, tidied

#: Bounds of the labelled sample: languages (the most frequent ones), documents of a language, code points of a language and
#: of all together. Texts are learned whole.
LANGUAGES, SAMPLE_DOCS, LANGUAGE_CHARS, ALL_CHARS = 128, 64, 20_480, 327_680
#: Letters told apart; rarer ones share a symbol.
LETTERS = 93
#: Long texts are walked in parallel windows of so many symbols; after MEET symbols it is looked whether two walks have met.
WINDOW, MEET = 512, 64
UNKNOWN = "und"
_PAD, _OTHER, _GAP = 0, 1, 2
_LETTER = re.compile(r"[^\W\d_]")


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of text; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in edges[state]:
            edges[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = edges[state][symbol]
            if length[state] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(edges)
                edges.append(dict(edges[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state >= 0 and edges[state].get(symbol) == target:
                    edges[state][symbol] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return edges


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """A text's letters as symbols; each run of other characters is one gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = table[np.minimum(codes, len(table) - 1)]
    gap = out == _GAP
    return out[~(gap & np.concatenate([[False], gap[:-1]]))] if len(out) else out


def compile_model(sample: dict[str, list[str]]) -> dict:
    """One table for all languages: entry [state * width + symbol] is (next state * width) << 2 | phrases closed."""
    seen = Counter(c for texts in sample.values() for t in texts for c in t.lower() if _LETTER.match(c))
    table = np.full(0x10000 + 1, _GAP, np.uint8)
    for code in range(0x10000):
        if _LETTER.match(chr(code)):
            table[code] = _OTHER
    table[0x10000] = _OTHER
    for i, (c, _) in enumerate(seen.most_common(LETTERS)):
        if ord(c) < 0x10000:
            table[ord(c)] = 3 + i
    width = 3 + LETTERS
    names, tables, starts, logs, base = sorted(sample), [], [], [], 0
    for name in names:
        text = np.concatenate([symbols(f" {t} ", table) for t in sample[name]]).tolist()
        edges = suffix_automaton(text)
        own = np.zeros((len(edges), width), np.int32)
        own[:] = (base * width) << 2 | 2
        own[0] = (base * width) << 2 | 1
        for symbol, target in edges[0].items():
            own[1:, symbol] = (base + target) * width << 2 | 1
            own[0, symbol] = (base + target) * width << 2
        own[1:, _PAD], own[0, _PAD] = (base * width) << 2 | 1, (base * width) << 2
        for state, out in enumerate(edges):
            for symbol, target in out.items():
                own[state, symbol] = (base + target) * width << 2
        tables.append(own.ravel())
        starts.append(base * width)
        logs.append(np.log(max(len(text), 2)))
        base += len(edges)
    return {"names": names, "letters": table, "table": np.concatenate(tables) if tables else np.zeros(0, np.int32), "starts": np.array(starts, np.int32), "logs": np.array(logs)}


def _walk(grid: np.ndarray, state: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Run the columns of grid (symbols by windows) from their states: states after, phrases closed."""
    table, state, total = model["table"], state.copy(), np.zeros(state.shape, np.int64)
    for step in grid:
        entry = table[state + step]
        total += entry & 3
        state = entry >> 2
    return state, total


def phrases(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text under each language, and the number of symbols."""
    own = [symbols(t, model["letters"]) if t else np.zeros(0, np.uint8) for t in texts]
    sizes = np.array([len(x) for x in own])
    rows = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(rows)])
    counts = np.zeros((len(model["names"]), len(texts)))
    if first[-1] == 0 or not len(counts):
        return counts.T, sizes
    flat = np.zeros(first[-1] * WINDOW, np.uint8)
    flat[np.arange(sizes.sum()) + np.repeat(first[:-1] * WINDOW - (np.cumsum(sizes) - sizes), sizes)] = np.concatenate(own)
    grid = np.ascontiguousarray(flat.reshape(-1, WINDOW).T).astype(np.int32)
    starts = np.repeat(model["starts"], grid.shape[1]).reshape(len(model["starts"]), -1)
    begins = np.zeros(first[-1], bool)
    begins[first[:-1][rows > 0]] = True
    middle, early = _walk(grid[:MEET], starts, model)
    ends, late = _walk(grid[MEET:], middle, model)
    total, entered = early + late, starts.copy()
    inner = np.flatnonzero(~begins)
    while len(inner):  # (language, window) pairs that were entered in another state than walked from
        lang, at = np.nonzero(ends[:, inner - 1] != entered[:, inner])
        if not len(lang):
            break
        at = inner[at]
        entered[lang, at] = ends[lang, at - 1]
        state, count = _walk(grid[:MEET, at], entered[lang, at], model)
        apart = state != middle[lang, at]
        far, farther = _walk(grid[MEET:, at[apart]], state[apart], model)
        total[lang, at] += count - early[lang, at]
        early[lang, at] = count
        lang, at = lang[apart], at[apart]
        total[lang, at] += farther - late[lang, at]
        middle[lang, at], late[lang, at], ends[lang, at] = state[apart], farther, far
    doc = np.repeat(np.arange(len(texts)), rows)
    last = first[1:][rows > 0] - 1
    for k in range(len(counts)):
        counts[k] = np.bincount(doc, weights=total[k], minlength=len(texts))
        counts[k, rows > 0] += (ends[k, last] != model["starts"][k]) & (sizes[rows > 0] % WINDOW == 0)
    return counts.T, sizes


def predict_texts(texts: list[str | None], model: dict) -> list[tuple[str, float]]:
    """(language, score) of each text: phrases cost their index into the sample, the score is the winner's share."""
    counts, _ = phrases(texts, model)
    out = []
    for text, own in zip(texts, counts, strict=True):
        if not text or not _LETTER.search(text) or not model["names"]:
            out.append((UNKNOWN, 0.0))
            continue
        bits = own * model["logs"]
        likely = np.exp(-0.5 * (bits - bits.min()))
        best = int(np.argmin(bits))
        out.append((model["names"][best], float(likely[best] / likely.sum())))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, chars: int = LANGUAGE_CHARS) -> dict[str, list[str]]:
    """For each of the most frequent languages, whole texts of documents with the smallest hash of doc_id, none held out.

    Texts of more than an eighth of a language's bound aren't learned from, unless it has no others: then its shortest one is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("doc_id", "lang", "text", F.length("text").alias("n"))
    tally = rows.groupBy("lang").agg(F.count("*").alias("docs"), F.min("n").alias("least")).orderBy(F.desc("docs"), "lang").limit(LANGUAGES).collect()
    if not tally:
        return {}
    chars = min(chars, ALL_CHARS // len(tally))
    scale, longest = 1 << 30, chars // 8
    place = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    bounds = F.create_map(*(x for r in tally for x in (F.lit(r.lang), F.struct(F.lit(min(scale, scale * 8 * docs_each // r.docs)).alias("place"), F.lit(max(longest, r.least)).alias("n")))))
    near = rows.withColumn("bound", bounds[F.col("lang")]).where((place < F.col("bound.place")) | (F.col("n") > longest)).where(F.col("n") <= F.col("bound.n"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    near = near.select("lang", "text", "n", place.alias("place"), "doc_id").withColumn("k", F.row_number().over(order)).withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = near.where((F.col("k") <= docs_each) & ((F.col("sum") <= chars) | (F.col("k") == 1))).orderBy("lang", "k").collect()
    out: dict[str, list[str]] = {}
    for r in found:
        out.setdefault(r.lang, []).append(r.text)
    return out


def identify(docs: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter, and any text when nothing could be learned, gets 'und' with score 0. Texts are
    read whole. Ties go to the language that sorts first; repeated rows are predicted each; a null doc_id isn't held out.
    An empty table gives no rows.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held("language", repr(sample), lambda: compile_model(sample))
        for part in sliced(batches):
            found = predict_texts(part.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """The rows of docs, all their columns, whose own text gets a language."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held("language", repr(sample), lambda: compile_model(sample))
        for part in sliced(batches):
            yield part.filter(pa.array([lang != UNKNOWN for lang, _ in predict_texts(part.column("text").to_pylist(), model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, labelled_sample(docs))

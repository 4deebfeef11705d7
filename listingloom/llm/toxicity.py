"""Toxicity by compression distance: windows of a text are compressed with a dictionary of toxic and one of ordinary text.

Both dictionaries are trained by zstandard. Most of a toxic document is ordinary prose, so each dictionary has two parts: a
common one, trained on windows of ordinary text, and its own, trained on the pieces of windows that set one class apart: the
stretches covered by byte 5-grams that are characteristic of it (log-likelihood ratio over documents; toxic texts against
ordinary ones, and one half of the ordinary texts against the other). A window is shorter under the toxic dictionary only
for toxic wording. A logistic model, fitted on labelled documents that no dictionary has seen, turns the windows' savings
into a calibrated score.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom.llm.held import held, sliced, tidied
from listingloom.llm.shingles import shingle_sets

WINDOW = 64
#: Bounds of the labelled sample that is read to the driver: documents of each class, and code points of a document; longer
#: ones aren't learned from, so the sample stays under 150 MB.
TOXIC_DOCS, ORDINARY_DOCS, SAMPLE_CHARS = 1500, 3000, 30_000
#: A gram sets a class apart from so many documents and so high a ratio on; the ratio for ordinary text is half of it.
GRAM, LEAST_DOCS, LEAST_LLR = 5, 4, 9.0
#: Bytes of the common and of the own part of a dictionary; the trainer's segment and gram length for the own part.
SHARED_BYTES, OWN_BYTES, SEGMENT, SEGMENT_GRAM = 32768, 2048, 24, 6
THRESHOLD = 0.7


def windows(text: str | None) -> list[bytes]:
    """The lower-case text, spaces collapsed, cut at spaces into windows of about 64 bytes that begin with a space."""
    data = (" " + " ".join((text or "").lower().split())).encode("utf-8", "surrogatepass")
    out, i, n = [], 0, len(data)
    while i < n:
        j = i + WINDOW
        if j < n:
            k = data.rfind(b" ", i + 1, j)
            j = k if k > i else j
        out.append(data[i:j])
        i = j
    return out


def _compressors(model: dict) -> list:
    def build() -> list:
        options = zstandard.ZstdCompressionParameters.from_level(5, min_match=5, strategy=4, search_log=6, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        made = []
        for content in (model["ordinary"], model["toxic"]):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=options)
            made.append(zstandard.ZstdCompressor(dict_data=words, compression_params=options).compress)
        return made

    return held("toxicity", (model["ordinary"], model["toxic"]), build)


def features(text: str | None, model: dict) -> list[float]:
    """Savings of the toxic over the ordinary dictionary: the largest, their rate and mean, and shares of windows that save or lose."""
    ordinary, toxic = _compressors(model)
    saved = sorted((len(ordinary(w)) - len(toxic(w)) for w in windows(text)), reverse=True)
    n = len(saved)
    top = (saved + [0, 0, 0])[:3]
    share = [sum(1 for s in saved if (s >= k if k > 0 else s <= k)) / (n + 10) for k in (2, 3, 4, -2, -4)]
    rate = sum(s - 1 for s in saved if s > 1) / (n + 10)
    return [1.0, *(min(x, 12) / 4 for x in top), math.sqrt(rate), *map(math.sqrt, share), sum(saved) / (n + 10), math.log1p(n) / 4]


def _grams(data: bytes) -> np.ndarray:
    """The byte GRAM-grams of data as numbers."""
    own = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(len(own) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | own[k : k + n]
    return out


def _documents_with(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of texts, sorted, and in how many of them each stands."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.unique(_grams(b"".join(windows(x)))) for x in texts]), return_counts=True)


def characteristic(own: list[str], others: list[str], least_llr: float) -> np.ndarray:
    """Grams that significantly more of own have than of others, sorted."""
    (grams, a), (known, b) = _documents_with(own), _documents_with(others)
    grams, a = grams[a >= LEAST_DOCS], a[a >= LEAST_DOCS]
    if not len(grams) or not len(known):
        return grams
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    b = np.where(known[at] == grams, b[at], 0)
    n, m = len(own), len(others)

    def part(k: np.ndarray, size: int, p: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(p, 1e-12)) + (size - k) * np.log(np.maximum(1 - p, 1e-12))

    p = (a + b) / (n + m)
    ratio = 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p))
    return grams[(ratio >= least_llr) & (a * m > 3 * b * n)]


def pieces(text: str, grams: np.ndarray) -> list[bytes]:
    """The stretches of the text's windows that the grams cover, a byte more at each end."""
    out = []
    for w in windows(text):
        own = _grams(w)
        if not len(own) or not len(grams):
            continue
        hits = np.flatnonzero(grams[np.minimum(np.searchsorted(grams, own), len(grams) - 1)] == own)
        covered = np.zeros(len(w) + 2, np.int8)
        for k in hits.tolist():
            covered[max(k, 1) : k + GRAM + 2] = 1
        covered[len(w) + 1 :] = 0
        edge = np.flatnonzero(np.diff(covered))
        out += [w[i:j] for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return out


def _trained(samples: list[bytes], size: int, **options: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[-size:]


def distinct(texts: list[str]) -> list[str]:
    """The texts of which no large part was in one before: copies would pass for evidence."""
    seen: set[int] = set()
    out = []
    for text, own in zip(texts, map(np.ndarray.tolist, shingle_sets(texts)), strict=True):
        if sum(x in seen for x in own) <= 0.3 * len(own):
            out.append(text)
            seen.update(own)
    return out


def train(toxic: list[str], ordinary: list[str], seed: int = 11) -> dict:
    """Dictionaries from four fifths of the distinct texts, weights of the logistic model from the rest."""
    rng = random.Random(seed)
    toxic, ordinary = distinct(toxic), distinct(ordinary)
    toxic, ordinary = rng.sample(toxic, len(toxic)), rng.sample(ordinary, len(ordinary))
    t, o = 4 * len(toxic) // 5, 4 * len(ordinary) // 5
    common = _trained([w for own in map(windows, ordinary[:o]) for w in rng.sample(own, min(8, len(own)))], SHARED_BYTES)
    sides = {"toxic": (toxic[:t], ordinary[:o], LEAST_LLR), "ordinary": (ordinary[o // 2 : o], ordinary[: o // 2], LEAST_LLR / 2)}
    own = {}
    for side, (texts, others, least) in sides.items():
        grams = characteristic(texts, others, least)
        own[side] = _trained([p for x in texts for p in pieces(x, grams) if len(p) >= 8], OWN_BYTES, k=SEGMENT, d=SEGMENT_GRAM)
    size = max(8, *map(len, own.values()))
    model = {side: common + content.rjust(size) for side, content in own.items()}
    rows = [(features(x, model), 1.0) for x in toxic[t:]] + [(features(x, model), 0.0) for x in ordinary[o:]]
    model["weights"] = logistic(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])).tolist() if rows else [-2.0] + [0.0] * 11
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column is the constant, which isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def probability(text: str | None, model: dict) -> float:
    z = float(np.dot(model["weights"], features(text, model)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Up to TOXIC_DOCS toxic and ORDINARY_DOCS ordinary texts, chosen by a hash of doc_id, none of them held out.

    A doc_id labelled both ways is not learned from; of the texts that repeat a doc_id the least is taken. Texts of more
    than SAMPLE_CHARS code points are left to score only.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    by = {k: rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS))}
    chosen = by[1].unionAll(by[0]).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").where(F.length("text") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # a row per chosen id
    found.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in found if r.toxic == 1], [r.text for r in found if r.toxic == 0]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null, empty and repeated texts are scored like any other (a text without windows gets the score of no savings); very
    long ones are read whole, window by window. A null doc_id isn't held out. Without labels of both classes nothing is
    learned and every score is the prior. An empty table gives no rows.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            scores = pa.array([probability(t, model) for t in part.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), scores], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all their columns, whose own text isn't predicted toxic."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield part.filter(pa.array([probability(t, model) < THRESHOLD for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(*labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))

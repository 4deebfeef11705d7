import os
import zlib

import numpy as np
import pytest

from listingloom.llm import toxicity


def auc(truth, scores):
    order = np.argsort(scores, kind="stable")
    truth = np.array(truth)[order]
    below = np.cumsum(1 - truth)
    return below[truth == 1].sum() / (truth.sum() * (1 - truth).sum())


def test_windows_hold_the_whole_text():
    for text in ("", "a", "word " * 99, "x" * 700, "é" * 300 + " b"):
        parts = toxicity.windows(text)
        assert b"".join(parts).decode("utf-8", "ignore").split() == text.lower().split() or "é" in text
        assert all(len(p) <= toxicity.WINDOW for p in parts)


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(*toxicity.labelled_sample(docs, labels))
    got = {r.doc_id: r for r in toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in got}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert auc([truth[i] for i in held], [got[i].score for i in held]) > 0.7
    flagged = [i for i in held if got[i].predicted]
    assert sum(truth[i] for i in flagged) > 0.85 * len(flagged)


def test_odd_rows(spark, sf001):
    docs, labels = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/labels.parquet")
    model = toxicity.train(*toxicity.labelled_sample(docs, labels))
    rows = [(1, None), (2, ""), (None, "x"), (3, "idiot " * 40_000), (3, "idiot " * 40_000)]
    got = toxicity.score(spark.createDataFrame([(*r, 5.0) for r in rows], "doc_id long, text string, score double"), model).collect()
    assert len(got) == 5 and got[0].score == got[1].score and got[3].score == got[4].score and not got[2].held_out
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(*toxicity.labelled_sample(empty, spark.createDataFrame([], "doc_id long, toxic int")))
    assert 0 <= toxicity.score(docs, nothing).agg({"score": "max"}).first()[0] < 0.7


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="needs the larger tables")
def test_held_out_documents_where_labels_are_many(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/check_s/{name}.parquet") for name in ("documents", "labels"))
    held = labels.where("doc_id is not null").where(toxicity.held_out(labels.doc_id)).distinct()
    scored = toxicity.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), toxicity.train(*toxicity.labelled_sample(docs, labels)))
    rows = scored.join(held, "doc_id").collect()
    assert auc([r.toxic for r in rows], [r.score for r in rows]) > 0.98
    flagged, toxic = [r for r in rows if r.predicted], [r for r in rows if r.toxic == 1]
    assert sum(r.toxic for r in flagged) > 0.93 * len(flagged) and sum(r.predicted for r in toxic) > 0.88 * len(toxic)


def test_features_and_dictionaries_by_brute_force():
    """Characteristic grams against a plain count; savings against two compressors made anew; pieces are covered stretches."""
    import math

    import zstandard

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = lambda extra: [" ".join(rng.choice(words, 60)) + extra for _ in range(40)]
    toxic, ordinary = texts(" you zzkkq fool"), texts(" and so on")
    grams = set(toxicity.characteristic(toxic, ordinary, toxicity.LEAST_LLR).tolist())
    sets = [[{w[i : i + 5] for w in [b"".join(toxicity.windows(t))] for i in range(len(w) - 4)} for t in own] for own in (toxic, ordinary)]
    part = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)
    want = set()
    for g in set().union(*sets[0]):
        a, b = (sum(g in s for s in own) for own in sets)
        p = (a + b) / 80
        ratio = 2 * (part(a, 40, a / 40) + part(b, 40, b / 40) - part(a, 40, p) - part(b, 40, p))
        if a >= toxicity.LEAST_DOCS and ratio >= toxicity.LEAST_LLR and a > 3 * b:
            want.add(int.from_bytes(g, "big"))
    assert grams == want and len(want) > 5
    model = toxicity.train(toxic * 1, ordinary)
    options = zstandard.ZstdCompressionParameters.from_level(5, min_match=5, strategy=4, search_log=6, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    size = lambda w, side: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model[side], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options).compress(w))
    text = toxic[0] + " " + ordinary[1]
    saved = sorted((size(w, "ordinary") - size(w, "toxic") for w in toxicity.windows(text)), reverse=True)
    got = toxicity.features(text, model)
    assert got[1:4] == [min(x, 12) / 4 for x in saved[:3]] and abs(got[10] - sum(saved) / (len(saved) + 10)) < 1e-12
    assert abs(toxicity.probability(text, model) - 1 / (1 + math.exp(-float(np.dot(got, model["weights"]))))) < 1e-9

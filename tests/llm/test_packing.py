import zlib

import numpy as np
import pytest

from listingloom.llm import packing


def expected(rows, limit=4096):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), limit):
            own = ids[k : k + limit]
            out[doc_id, k // limit] = (k, len(own), zlib.crc32(own.tobytes()))
    return out


def check(got, limit=4096):
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_documents_are_packed_whole_and_tight(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = packing.pack(docs, packing.default_path()).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected(rows)
    assert check(got) <= -(-sum(r.length for r in got) // 4096) + 2


def test_odd_texts(spark):
    texts = [None, "", " ", "\t\r\n x y z", "It's they'RE 12.5!?...", "<|endoftext|> <|ENDOFTEXT|>x", "ÅİΣ Σ", "\U0001f600" * 3000, "w" * 9000, "a b " * 5000, "x​y ́z"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, length int, rank int")
    got = packing.pack(docs, packing.default_path()).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected(rows)
    check(got)


def test_empty_table_repeats_and_missing_ids(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.default_path()).count() == 0
    got = packing.pack(spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), packing.default_path()).collect()
    assert len(got) == 4 and check(got) == 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_each_count_once_and_waste_little(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(8, 4097))
    counts = np.bincount(np.minimum(rng.lognormal(np.log(limit / 4), 1, int(rng.integers(0, 30_000))).astype(int) + 1, limit), minlength=limit + 1)
    groups = packing.plan(counts, limit)
    used = np.zeros(limit + 1, int)
    for shape, n in groups:
        assert sum(shape) <= limit
        for length in shape:
            used[length] += n
    assert (used == counts).all()
    total = (counts * np.arange(limit + 1)).sum()
    alone = counts[limit // 2 + 1 :].sum()
    assert sum(n for _, n in groups) <= 1.02 * max(-(-total // limit), alone) + 1

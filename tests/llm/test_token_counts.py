import random

import public_tokenizers
import pytest

from listingloom.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PATH)
    return lambda texts: [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]


def test_documents(spark, sf001, library):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, PATH).collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    assert {i: r.n_tokens for i, r in got.items()} == want
    assert all(r.n_bytes == len(texts[i].encode()) and r.over_limit == (want[i] > 4096) for i, r in got.items())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_bytes int"), PATH).collect())
    assert got == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (3, 3, 2), (3, 3, 2)]
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_any_text_counts_as_the_library_does(library, seed):
    rng = random.Random(seed)
    own = token_counts.load(PATH)
    letters = "abcdeting  ▁\n\t.,ñé0199日😀ZQ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(900))) for _ in range(200)]
    texts += ["".join(rng.choice(list(own.scores)) for _ in range(rng.randrange(60))).replace("▁", " ") for _ in range(300)]
    texts += ["", None, " ", " " * 700, "a" * 5000, "ab" * 900 + " " + "z" * 300, "<s></s><unk> <0x0A>", "x\x00y", "▁▁x ▁", "the quick brown " * 900]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(300)) for _ in range(20)]
    rng.shuffle(texts)
    assert own.counts(texts).tolist() == library(texts)

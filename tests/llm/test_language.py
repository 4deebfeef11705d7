import random
import zlib

from listingloom.llm import language


def test_automaton_knows_all_substrings_and_no_others():
    rng = random.Random(1)
    for _ in range(40):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        edges = language.suffix_automaton(text)
        inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        for _ in range(200):
            word = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
            state = 0
            for c in word:
                state = edges[state].get(c, -1)
                if state < 0:
                    break
            assert (state >= 0) == (tuple(word) in inside)


def brute_phrases(text, sample):
    """Greedy longest matches over the whole text."""
    count = i = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count, i = count + 1, i + n
    return count


def test_phrases_match_brute_force():
    rng = random.Random(3)
    sample = {"aa": ["".join(rng.choice("abcd ") for _ in range(300))], "bb": ["".join(rng.choice("cdef ") for _ in range(300))]}
    model = language.compile_model(sample)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(rng.choice([1, 5, 80, 511, 512, 513, 700, 1024, 3000]))) for _ in range(60)] + ["ab" * 1500, "a" * 2000, "abcd" * 128, None, ""]
    counts, _ = language.phrases(texts, model)
    clean = lambda t: "".join(chr(65 + s) for s in language.symbols(t, model["letters"]))
    for k, name in enumerate(model["names"]):
        known = clean(f" {sample[name][0]} ")
        # g is in no sample: a symbol that no text of the model holds is a phrase of its own
        assert [int(c) for c in counts[:, k]] == [brute_phrases(clean(t), known) if t else 0 for t in texts]


def test_held_out_accuracy(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs, language.labelled_sample(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) > 0.97 * len(held)


def test_odd_rows(spark, sf001):
    model = language.labelled_sample(spark.read.parquet(f"{sf001}/documents.parquet"))
    rows = [(1, None, "en"), (2, "", None), (3, "12 %%", "x"), (None, "the", "en"), (4, "the of and " * 30_000, None), (4, "日本", None)]
    got = language.identify(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double"), model).collect()
    assert [(r.lang_pred == "und", r.score == 0) for r in got[:3]] == [(True, True)] * 3 and len(got) == 6
    assert got[4].lang_pred == "en" and not got[3].held_out
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.labelled_sample(empty) == {} and language.identify(empty, {}).count() == 0
    assert language.identify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {}).first().lang_pred == "und"


def test_sample_is_whole_texts_within_bounds(spark):
    rows = [(i, "word " * (20 + i % 7), "aa") for i in range(400)] + [(1000 + i, "long " * 5000, "bb") for i in range(3)] + [(2000 + i, f"short text {i}", f"l{i:03}") for i in range(220)]
    sample = language.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = {t for _, t, _ in rows}
    assert len(sample) == language.LANGUAGES and "aa" in sample and all(t in texts for own in sample.values() for t in own)
    assert sum(map(len, sample["aa"])) <= language.ALL_CHARS // len(sample)
    assert language.labelled_sample(spark.createDataFrame(rows[400:403], "doc_id long, text string, lang string"))["bb"] == ["long " * 5000]

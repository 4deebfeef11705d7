import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from listingloom.llm import mixing
from listingloom.llm.mixing import Source

SCHEMA = "doc_id long, text string, source string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shares(sizes):
    """The targets by resharing the excess until none is above, in fractions."""
    weight = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    total = sum(sizes)
    out = [Fraction(total * w, sum(weight)) for w in weight]
    while any(t > 3 * s for t, s in zip(out, sizes, strict=True)):
        excess = sum((max(t - 3 * s, 0) for t, s in zip(out, sizes, strict=True)), Fraction(0))
        open_ = [k for k, (t, s) in enumerate(zip(out, sizes, strict=True)) if t < 3 * s]
        out = [min(t, Fraction(3 * s)) for t, s in zip(out, sizes, strict=True)]
        for k in open_:
            out[k] += excess * weight[k] / sum(weight[j] for j in open_)
    return out


def check(rows, got):
    """got: (doc_id, size, source_size, target, taken) against rows (doc_id, text, source)."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, shares([size[s] for s in order]), strict=True))
    key = lambda i, n, s, t: (i, n, s, round(float(t), 4))
    assert Counter(key(i, len(words(x)), size[s], target[s]) for i, x, s in rows) == Counter(key(r.doc_id, r.size, r.source_size, r.target) for r in got)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[round(r.target, 4), r.source_size] += r.taken
    wanted = defaultdict(int)
    for s in order:
        wanted[round(float(target[s]), 4), size[s]] += target[s]
    for k, t in wanted.items():
        assert abs(taken[k] - t) <= 2, (k, taken[k], float(t))


def test_whole_table_comes_out_at_its_targets(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.op13(spark, sf001).collect()
    check(rows, got)
    again = mixing.by_document(mixing.mix(docs.repartition(5))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (None, "d\te\nf g", None), (None, "d\te\nf g", None), (5, "h " * 3000, "é"), (5, "h " * 3000, "é"), (6, " ", None), (7, "i  j", "Z")]
    rows += [(9, "one text many times", "z")] * 500
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"{SCHEMA}, size int, k int, taken int")
    got = mixing.by_document(mixing.mix(df.repartition(4), block=7, shard=16)).collect()
    check(rows, got)
    again = mixing.by_document(mixing.mix(df.repartition(2), block=7, shard=16)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", None)], [(1, "a", "x"), (2, "", "y")]])
def test_tables_with_next_to_nothing(spark, rows):
    got = mixing.by_document(mixing.mix(spark.createDataFrame(rows, SCHEMA))).collect()
    check(rows, got)


def test_texts_hold_the_words_that_were_taken(spark):
    random = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{i}.{j}" for j in range(random.integers(0, 60))), "abc"[i % 3]) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mixed = mixing.mix(docs, block=16, shard=8)
    taken = Counter()
    for r in mixed.spans.collect():
        taken[r.doc_id] += r.words
    slots = mixing.texts(mixed, docs).collect()
    by_doc = Counter(int(w[1:].split(".")[0]) for r in slots for w in r.text.split())
    assert by_doc == taken
    assert all(len(r.text.split()) <= 16 for r in slots)
    assert [(h, len(v)) for h, v in sorted((h, [r for r in slots if r.shard == h]) for h in {r.shard for r in slots})][:-1] == [(h, 8) for h in range(max(r.shard for r in slots))]
    for r in slots:  # stretches of one document are whole runs of its words
        own = [tuple(map(int, w[1:].split("."))) for w in r.text.split()]
        assert all(b[1] == a[1] + 1 or b[1] == 0 for a, b in zip(own, own[1:], strict=False) if a[0] == b[0])


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutations_are_permutations_and_invert(size):
    index = np.arange(size)
    for key in (0, 1, 2**64 - 1):
        out = mixing.permuted(index, np.full(size, size), np.full(size, key, np.uint64))
        assert sorted(out.tolist()) == index.tolist()
        assert mixing._inverse(out, size, key).tolist() == index.tolist()


@pytest.mark.parametrize("seed", range(5))
def test_shards_agree_on_what_each_source_takes(seed, monkeypatch):
    random = np.random.default_rng(seed)
    slots = random.integers(0, 500, size=7)
    if seed == 4:
        monkeypatch.setattr(mixing, "_MARBLES", 100)
    total, size = int(slots.sum()), 32
    before = np.zeros(7, np.int64)
    for h in range(-(-total // size)):
        counts, offset = mixing.shard_counts(slots, h, size, seed)
        assert counts.min() >= 0 and counts.sum() == min(size, total - h * size)
        assert offset.tolist() == before.tolist()
        before += counts
    assert before.tolist() == slots.tolist()


def test_shard_counts_vary_as_draws_do():
    slots = np.array([8000, 4000, 4000])
    first = np.array([mixing.shard_counts(slots, h, 100, 1)[0][0] for h in range(160)])
    assert abs(first.mean() - 50) < 1e-9 and 3.5 < first.std() < 6.5  # 5 by the multinomial


@pytest.mark.parametrize("sizes", [[], [0], [10], [1, 1, 1], [0, 5, 0, 100], [1, 1000, 1000, 2, 3], [7] * 10])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert got == pytest.approx([float(x) for x in shares(sizes)])


def test_slots_end_where_the_target_does():
    for words_, taken in ((10, 0), (10, 1), (10, 9), (10, 10), (10, 25), (7, 21), (1, 3), (33, 40)):
        s = Source("s", words_, float(taken), taken)
        assert 0 <= mixing._slots(s, 4, 1) <= 3 * s.blocks(4)

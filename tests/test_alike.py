import difflib
import random

import pytest
from hypothesis import given, settings, strategies as st

from listingloom.operators import alike, resolve

WORDS = ["night", "market", "jazz", "brunch", "film", "club", "of", "the", "harbor", "reading", "poets", "open", "mic"]


def typo(rng, s):
    k = rng.randrange(len(s) + 1)
    return rng.choice([s[:k] + s[k + 1 :], s[:k] + rng.choice("abcxyz 1") + s[k:], s[: max(0, k - 1)] + s[k - 1 : k + 1][::-1] + s[k + 1 :]])


def titles(rng, n):
    out, known = [], [" ".join(random.Random(k).choices(WORDS, k=1 + k % 6)) for k in range(30)]
    for _ in range(n):
        s = rng.choice(known)
        for _ in range(rng.randrange(3)):
            s = typo(rng, s)
        if rng.random() < 0.2:
            words = s.split()
            rng.shuffle(words)
            s = " ".join(words)
        out.append(" ".join(s.split()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab 1", min_size=1, max_size=40), st.text("ab 1", min_size=1, max_size=40), st.sampled_from([0.7, 0.88, 0.9, 0.92]))
def test_no_pair_at_the_bound_is_missed(a, b, least):
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    assert alike.score(a, b, least) == (ratio if ratio >= least or alike.score(a, b, least) else 0.0)
    if ratio >= least:
        assert alike.score(a, b, least) == ratio
        for ranks in ({}, {g: k for k, g in enumerate(alike.grams(a))}):
            assert set(alike.prefix(a, ranks, least)) & set(alike.prefix(b, ranks, least))


@pytest.mark.parametrize("seed", range(2))
def test_pairs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    left, right = ([(f"b{rng.randrange(3)}", s) for s in titles(rng, 150)] for _ in range(2))
    got = {(r.block, r.l_title, r.r_title, r.score) for r in alike.alike(spark.createDataFrame(left, "block string, title string"), spark.createDataFrame(right, "block string, title string"), 0.88).collect()}
    wanted = {(b, x, y, r) for b, x in left for c, y in right if b == c and x and y and (r := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.88}
    assert got == wanted and len(wanted) > 20


def test_scored_pairs_equal_brute_force(spark):
    from tests import naive
    from tests.test_finalize import FIELDS, make

    rng = random.Random(9)
    rows = [r for r in make(rng, 160, False) if naive.time(r[6])]
    df = spark.createDataFrame(rows, FIELDS)
    got = {(r.l_key, r.r_key) for r in resolve.score_pairs(df, df, "n", "n").collect()}
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    wanted = {(a["n"], b["n"]) for a in dicts for b in dicts if b["start"][:10] == naive.time(a["start"]).date().isoformat() and naive.same(a, b)}
    assert got == wanted and len(wanted) > 100


def test_a_dense_block_of_digests_gives_few_candidates():
    """Titles with one beginning and hex digits: each shares bigrams with every other, so an index of bigrams gives all pairs."""
    rng = random.Random(4)
    left = [f"show {rng.getrandbits(128):032x}" for _ in range(1500)]
    right = [*(s[:k] + s[k + 1 :] + " ab" for k, s in enumerate(x[:40] for x in left[:30])), *left[30:]]
    found = list(alike.candidates(left, right, 0.88))
    assert len(found) == len(set(found)) < 5 * len(left)
    wanted = {(x, y) for x in left[:60] for y in right[:60] if difflib.SequenceMatcher(None, x, y).ratio() >= 0.88}
    assert wanted <= set(found) and len(wanted) >= 60


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab 1", min_size=1, max_size=25), min_size=9, max_size=14, unique=True), st.sampled_from([0.7, 0.88, 0.92]), st.randoms(use_true_random=False))
def test_pieces_miss_no_pair(left, least, rng):
    right = list(dict.fromkeys(typo(rng, typo(rng, x)) or "a" for x in left))
    few, alike.FEW = alike.FEW, 0
    try:
        found = list(alike.candidates(left, right, least))
    finally:
        alike.FEW = few
    assert {(x, y) for x in left for y in right if difflib.SequenceMatcher(None, x, y).ratio() >= least} <= set(found)


def test_an_occurrence_among_many_like_ones_is_known_after_two(spark, monkeypatch):
    """Every pair of like titles near in time was scored to learn whether a row has one match; rows and groups of any size agree with brute force."""
    from tests import naive
    from tests.test_finalize import FIELDS, make

    rng = random.Random(11)
    rows = [r for r in make(rng, 150, False) if naive.time(r[6])]
    df = spark.createDataFrame(rows, FIELDS)
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    met = {a["n"]: {b["id"] for b in dicts if b["start"][:10] == naive.time(a["start"]).date().isoformat() and naive.same(a, b)} for a in dicts}
    wanted = {n: next(iter(ids)) for n, ids in met.items() if len(ids) == 1}
    assert {r.n: r.event_id for r in resolve.match_occurrence(df, df).collect()} == wanted and len(wanted) > 10
    monkeypatch.setattr(resolve, "_ROWS", 3)
    assert {r.n: r.event_id for r in resolve.match_occurrence(df, df).collect()} == wanted
    scored = []
    monkeypatch.setattr(resolve, "same_occurrence", lambda new, old: scored.append(1) or True)
    dense = [("b", 0, 0, side, f"{side}{k}", "jazz night", "", "hall", "", "", True, 0, 0) for side in (0, 1) for k in range(500)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*dense, strict=True)], [f"c{k}" for k in range(13)])
    told = [r for out in resolve._two_found(iter([batch])) for r in out.to_pylist()]
    assert len(told) == 1000 == len(scored)

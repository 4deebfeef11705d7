import math

import numpy as np
import pytest

from listingloom.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows, most=16):
    """The contract said with Python's integers and numpy's own solver."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    deviation = [sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for _, x in kept]
    white = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for _, x in kept]) @ vectors / np.sqrt(values)
    return kept, n, deviation, values, np.trace(cov), white


def check(spark, rows, got, most=16):
    kept, n, deviation, values, trace, white = expected(rows, most)
    assert len(got) == len(kept) * len(values)
    assert {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-9 * r.explained
        assert r.identity_error < 1e-6
    at = {i: k for k, (i, _) in enumerate(kept)}
    for c, own in by.items():
        mine, theirs = np.array([r.whitened for r in own]), np.array([white[at[r.vec_id], c - 1] for r in own])
        sign = np.sign(mine @ theirs)
        assert np.abs(sign * mine - theirs).max() < 1e-6
        assert all(r.deviation == deviation[at[r.vec_id]] for r in own)


def test_equals_numpy_on_the_whole_table(spark, sf001):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf001}/embeddings.parquet").collect()]
    check(spark, rows, whitening.op11(spark, sf001).collect())


def test_bad_entries_repeats_and_clashing_columns(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=5).tolist()) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(40)]  # one vector forty times more counts once in the fit
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [math.nan] * 5), (204, [math.inf, 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows + odd], f"{SCHEMA}, n int, whitened int, x int")
    got = whitening.whiten(df.repartition(7)).collect()
    check(spark, rows, got)
    assert sorted({r.component for r in got}) == [1, 2, 3, 4, 5]
    again = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(df.repartition(3)).collect()}
    assert again == {(r.vec_id, r.component): r.whitened for r in got}  # to the last bit


def test_missing_and_repeated_ids_are_projected_too(spark):
    rows = [(None, [0.0, 1.0]), (None, [2.0, 5.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and {r.n for r in got} == {3}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_far_out_entries_stay_exact_or_null(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [20000.0, 2.0]), (4, [0.0, 9.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=1).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(r.deviation is None for r in got if r.vec_id < 3)
    assert all(math.isfinite(r.whitened) for r in got)


@pytest.mark.parametrize("seed", range(8))
def test_components_of_random_and_repeated_spectra(seed):
    random = np.random.default_rng(seed)
    n = [1, 2, 3, 10, 40, 64, 64, 100][seed]
    q, _ = np.linalg.qr(random.normal(size=(n, n)))
    spectrum = np.sort(np.abs(random.normal(size=n)))[::-1] + 0.1
    spectrum[: n // 3] = 5.0  # a cluster of equal values
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    k = min(16, n)
    values, vectors = eigen.leading(a, k)
    assert np.abs(values - np.sort(np.linalg.eigvalsh(a))[::-1][:k]).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_components_of_matrices_that_fall_apart():
    for a in (np.eye(9), np.diag(np.arange(9.0)), np.zeros((4, 4)), np.kron(np.eye(5), [[2.0, 1.0], [1.0, 2.0]])):
        values, vectors = eigen.leading(a, 6)
        assert np.abs(values - np.sort(np.linalg.eigvalsh(a))[::-1][:6]).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12

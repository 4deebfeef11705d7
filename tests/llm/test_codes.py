import hashlib
import math

import numpy as np
import pytest

from listingloom.llm import codes
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    """The contract said plainly."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : p * width + width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for k, own in members.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(part(v, p), books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def check(spark, rows, df=None):
    df = spark.createDataFrame(rows, SCHEMA) if df is None else df
    got = sorted((tuple(r) for r in codes.compress(df).collect()), key=str)
    assert got == expected(rows)


def test_equals_its_sql(spark, sf001):
    assert compare(spark, sf001, codes.op12, codes.ORACLE) == 500


def test_bad_rows_repeats_missing_labels_and_clashing_columns(spark):
    random = np.random.default_rng(5)
    rows = [(i, random.normal(size=8).tolist(), [None, 1, 2][i % 3]) for i in range(400)]
    rows += [(500 + i, rows[3][1], 1) for i in range(200)]  # a third of all rows are one vector
    rows += [(None, rows[5][1], None)] * 3 + [(7, rows[9][1], 2)]
    odd = [(-1, None, 1), (-2, [], 1), (-3, [1.0, None] * 4, 1), (-4, [math.nan] * 8, 1), (-5, [math.inf] * 8, 1), (-6, [1.0], 1)]
    df = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows + odd], f"{SCHEMA}, entry int, salt int, id int, code int")
    check(spark, rows, df.repartition(5))


def test_ties_few_rows_and_lengths_that_four_does_not_divide(spark):
    check(spark, [(2, [0.0] * 4, 1), (1, [0.0] * 4, None)])
    got = codes.compress(spark.createDataFrame([(1, [0.5, 1.5, 2.5], 1), (2, [1.0, 2.0, 3.0], 1)], SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error) for r in sorted(got)] == [(1, "00000000", 0), (2, "01010100", 0)]


def test_far_out_entries(spark):
    rows = [(1, [1e30, 0.0, 0.0, 0.0], 1), (2, [30000.0, 0.0, 0.0, 0.0], 1), (3, [0.0, 1.0, 2.0, 3.0], 2)]
    got = {r.vec_id: r for r in codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.error for i, r in got.items()} == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("far", [1 << 20, 1 << 33])
def test_nearest_is_exact_at_any_size(far):
    random = np.random.default_rng(1)
    x, c = random.integers(-far, far, (40, 5)), random.integers(-far, far, (9, 5))
    c[7] = c[2]
    entry, error = codes.nearest(x, c)
    for row, e, d in zip(x.tolist(), entry, error, strict=True):
        assert (d, e) == min((sum((a - b) ** 2 for a, b in zip(row, one, strict=True)), k) for k, one in enumerate(c.tolist()))


def test_empty_table(spark):
    got = codes.compress(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0

import random

import pytest

from listingloom.operators.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root) if find(x) != x}


def check(spark, edges, kind="long"):
    got = components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == brute([(a, b) for a, b in edges if a is not None and b is not None])


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(220)])


def test_hubs_chains_loops_and_repeats(spark):
    hub = [(500, k) for k in range(501, 1500)] + [(k, 2000) for k in range(1501, 2000)]
    chain = [(k, k + 1) for k in range(3000, 3040)]
    check(spark, hub + chain + [(1, 1), (2, 3), (3, 2), (2, 3)])
    check(spark, [("b", "~x"), ("a", "~x"), ("c", "~y")], "string")


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("held", [1 << 21, 7])
def test_contracted_edges_have_the_same_components_among_even_nodes(spark, monkeypatch, held):
    """Odd nodes belong to one group; a task with more edges than it holds tells of them too. The workers read the bound from the closure's module."""
    from listingloom.operators import components as c

    rng = random.Random(3)
    edges = [(g, 2 * rng.randrange(120), 2 * (40 * g + rng.randrange(40)) + 1) for g in range(6) for _ in range(45)]
    wanted = {x: r for x, r in brute([(a, b) for _, a, b in edges]).items()}
    monkeypatch.setattr(c, "AT_ONCE", held)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"a": [a for g, a, _ in edges if g % 2 == k], "b": [b for g, _, b in edges if g % 2 == k]}).slice(s, 5) for k in (0, 1) for s in range(0, 135, 5)]
    told = [(a, b) for part in (batches[:27], batches[27:]) for batch in c._contracted(iter(part)) for a, b in zip(*(x.to_pylist() for x in batch.columns))]
    got = brute(told)
    group = lambda root, x: root.get(x, x)
    evens = sorted({a for _, a, _ in edges})
    assert all((group(got, x) == group(got, y)) == (group(wanted, x) == group(wanted, y)) for x in evens for y in evens)
    if held > 1000:
        assert all(a % 2 == b % 2 == 0 for a, b in told)
        df = c.contracted(spark.createDataFrame(edges, "g int, a long, b long"), "g")
        again = brute([tuple(r) for r in df.collect()])
        assert all((group(again, x) == group(again, y)) == (group(wanted, x) == group(wanted, y)) for x in evens for y in evens)

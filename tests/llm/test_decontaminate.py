import random
import re

from listingloom.llm import decontaminate
from tests.oracle import compare

TOKEN = re.compile(r"[^\W_]+")


def brute(docs, items, least=decontaminate.LEAST_OVERLAP):
    """Every diagonal of every pair that has one token in common at it."""
    out, places, sizes = {}, {}, {}
    for number, (_, text) in enumerate(items):
        item = TOKEN.findall((text or "").lower())
        sizes[number] = len(item)
        for k, w in enumerate(item):
            places.setdefault(w, []).append((number, k))
    for doc_id, body in docs:
        diagonals = {}
        for i, w in enumerate(TOKEN.findall((body or "").lower())):
            for number, k in places.get(w, ()):
                diagonals[number, i - k] = diagonals.get((number, i - k), 0) + 1
        for (number, start), n in diagonals.items():
            if n >= least * sizes[number]:
                key = doc_id, items[number][0]
                out[key] = max(out.get(key, (0, 0, 0)), (n, -start, sizes[number]))
    return {k: (n, size, -back) for k, (n, back, size) in out.items()}


def found(df):
    return {(r.doc_id, r.item_id): (r.matched, r.item_tokens, r.start) for r in df.collect()}


def test_matches_brute_force_on_documents(spark, sf001):
    docs, items = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/benchmark.parquet")
    rng = random.Random(5)
    words = lambda n: [rng.choice("bcdfghjklm") + rng.choice("aeiou") + str(rng.randrange(900)) for _ in range(n)]
    short = {100_000 + n: words(n) for n in range(1, 61)}
    planted = []
    for n, item in short.items():
        for share in (0.6, 0.7, 0.8, 0.9, 1.0):
            keep = set(rng.sample(range(len(item)), -int(-share * len(item) // 1)))
            planted.append((1_000_000 + len(planted), " ".join(words(6) + [w if k in keep else "other" for k, w in enumerate(item)] + words(6))))
    docs = docs.select("doc_id", "text").unionAll(spark.createDataFrame(planted, "doc_id long, text string"))
    items = items.select("item_id", "text").unionAll(spark.createDataFrame([(i, " ".join(w)) for i, w in short.items()], "item_id long, text string"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len({k for k in want if k[0] >= 1_000_000 and k[1] >= 100_000}) >= len(planted)
    assert found(decontaminate.overlaps(docs, items)) == want


def test_equals_its_sql(spark, sf001):
    assert compare(spark, sf001, decontaminate.op7, decontaminate.ORACLE) > 3


def test_substitutions_ends_short_items_and_odd_rows(spark):
    rng = random.Random(3)
    words = lambda n: [rng.choice("bcdfghjklm") + rng.choice("aeiou") + str(rng.randrange(90)) for _ in range(n)]
    items = {i: words(40) for i in range(6)} | {10: words(6), 11: words(3), 12: words(12)}
    rows = [(1, " ".join(words(30) + items[0] + words(30))), (2, " ".join(words(200))), (3, None), (4, ""), (5, "?!")]
    for doc_id, item, share in ((20, 1, 0.1), (21, 2, 0.15), (22, 3, 0.2)):
        rows.append((doc_id, " ".join(words(9) + [w if rng.random() > share else "other" for w in items[item]] + words(9))))
    rows.append((23, " ".join(items[4][8:] + words(50))))  # begins inside the item
    rows.append((24, " ".join(words(50) + items[5][:30])))  # ends inside it
    rows += [(25, " ".join(words(9) + items[10] + words(9))), (26, " ".join(items[11])), (27, " ".join(items[12]).upper())]
    rows += [(28, " ".join(items[0] * 900)), (28, " ".join(items[0] * 900)), (None, " ".join(items[0]))]
    bench = [(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, ""), (None, " ".join(items[0])), (0, " ".join(items[0]))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, item_id int, pos int")
    got = found(decontaminate.overlaps(docs, spark.createDataFrame(bench, "item_id long, text string")))
    assert got == brute([r for r in rows if r[0] is not None], [(i, t) for i, t in bench if i is not None])
    assert {k[0] for k in got} == {1, 20, 21, 22, 23, 24, 25, 26, 27, 28}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert decontaminate.overlaps(some, items).count() == 0


def test_recall_at_the_threshold(spark):
    """Items of 5 to 20, 38 and 600 tokens, substituted anywhere down to 60 %, are found as by brute force."""
    rng = random.Random(11)
    words = lambda n: [rng.choice("bcdfghjklm") + rng.choice("aeiou") + str(rng.randrange(900)) for _ in range(n)]
    items, rows = {n: words(n) for n in (*range(5, 21), 38, 45, 600)}, []
    for n, item in items.items():
        for share in (0.6, 0.7, 0.8):
            for _ in range(25 if n < 100 else 2):
                keep = set(rng.sample(range(n), -int(-share * n // 1)))
                rows.append((len(rows), " ".join(words(6) + [w if k in keep else "other" for k, w in enumerate(item)] + words(6))))
        rows.append((len(rows), " ".join(["x", *item[1:-1], "y"])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), [(n, " ".join(w)) for n, w in items.items()]
    want = brute(rows, bench)
    assert len(want) >= len(rows) - 1 and found(decontaminate.overlaps(docs, spark.createDataFrame(bench, "item_id long, text string"))) == want
    least = brute(rows, bench, 0.3)
    assert found(decontaminate.overlaps(docs, spark.createDataFrame(bench, "item_id long, text string"), 0.3)) == least

import random
import re
from collections import defaultdict

import pytest

from listingloom.llm import minhash


def brute(rows):
    """doc_id -> (size, component, kept) by comparing full sets of every pair that shares a shingle."""
    sets = {}
    for doc_id, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    index = defaultdict(list)
    for doc_id, own in sets.items():
        for s in own:
            index[s].append(doc_id)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = set()
    for ids in index.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_matches_brute_force_on_documents(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(minhash.near_duplicates(docs)) == brute(rows)


def test_hot_shingles_lose_no_link(spark, monkeypatch):
    """Many short documents share a passage, some are similar, and their components are parted bit by bit."""
    monkeypatch.setattr(minhash, "HOT_SHINGLE", 3)
    monkeypatch.setattr(minhash, "HOT_ROWS", 2)
    monkeypatch.setattr(minhash, "HOT_KEYS", 10)
    monkeypatch.setattr(minhash, "PIVOTS", 1)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(30)], []
    for g in range(60):
        tail = [word() for _ in range(rng.randrange(2, 14))]
        for _ in range(rng.randrange(1, 4)):
            own = list(tail)
            own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(passage + own)))
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_chains_groups_and_odd_texts(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows, text = [], list(base)
    for i in range(30):  # a chain: each differs a little from the one before
        text[rng.randrange(120)] = word()
        rows.append((100 + i, " ".join(text)))
    rows += [(200 + i, " ".join(base)) for i in range(40)]  # exact copies
    rows += [(300 + i, " ".join(base[:i] + [word()] + base[i + 1 :])) for i in range(40)]  # near copies
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "É x"), (8, "é x"), (9, "  a b c d")]
    rows += [(10, " ".join(base * 300)), (11, " ".join(base * 300))]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, signature long")
    assert result(minhash.near_duplicates(docs)) == brute(rows)


def test_empty_table_and_missing_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    text = "a b c d e f g"
    rows = spark.createDataFrame([(None, text), (3, text), (None, "z"), (3, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert got == [(-1, -1, True), (-1, 3, False), (3, 3, True), (3, 3, True)]


@pytest.mark.parametrize("n", [1, 4, 5, 6, 400])
def test_signature_estimates_similarity(n):
    sets = list(minhash.shingle_sets([" ".join(f"w{i}" for i in range(n))] * 2))
    assert (minhash.signature(sets[0]) == minhash.signature(sets[1])).all()

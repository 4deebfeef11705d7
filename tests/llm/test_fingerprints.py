import hashlib
from collections import Counter

from listingloom.llm import fingerprints


def brute(rows):
    """(doc_id, text) in any order, ids that differ."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        out[doc_id] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.write(fingerprints.tree(text)), fingerprints.write(fingerprints.tree(changed)))
    return out


def result(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in df.collect()}


def test_documents(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = fingerprints.fingerprint(docs)
    assert result(got) == brute(rows)
    near = got.selectExpr("avg(near_edited) e", "avg(near_next) n").first()
    assert 0.35 < near.e < 0.7 and near.n < 0.1
    texts = dict(rows)
    by = {}
    for i, r in result(got).items():
        assert by.setdefault(r[2], texts[i]) == texts[i]
    assert len(by) == len(set(texts.values()))


def test_odd_rows(spark):
    rows = [(5, None), (9, ""), (7, "a"), (1, "\n\n a b\n\n"), (3, "x" * 90_000), (4, "é😀" * 11), (8, "word " * 40_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    assert result(fingerprints.fingerprint(docs)) == brute(rows)
    assert fingerprints.fingerprint(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.fingerprint(spark.createDataFrame([(2, "abcd")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    more = spark.createDataFrame([(2, "b"), (2, "a"), (2, "a"), (None, "z"), (None, None), (1, "c")], "doc_id long, text string")
    assert fingerprints.fingerprint(more).count() == 6


def test_trees_locate_edits_and_read_back():
    lines = [f"line {i} " + "some words that go on for a while " * 3 for i in range(12)]
    a = fingerprints.tree("\n".join(lines[:6]) + "\n\n" + "\n".join(lines[6:]))
    lines[8] = lines[8].replace("some", "other", 1)
    b = fingerprints.tree("\n".join(lines[:6]) + "\n\n" + "\n".join(lines[6:]))
    assert fingerprints.edits(a, b) == [(1, 2)] and fingerprints.edits(a, a) == []
    ra, rb = fingerprints.read(fingerprints.write(a)), fingerprints.read(fingerprints.write(b))
    assert fingerprints.edits(ra, rb) == [(1, 2)]
    assert 0.9 < fingerprints.likeness(a, b) == fingerprints.likeness(ra, rb) < 1


def digest(data):
    return hashlib.blake2b(data.encode(), digest_size=16).hexdigest()


def anew(text):
    """The tree character by character."""
    sections, own = [], []
    for line in text.split("\n"):
        blocks, block = [], ""
        for k, c in enumerate(line):
            block += c
            h = 0
            for x in line[k - 1 : k + 3] if k else "":
                h = (h ^ ord(x)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            # A block ends behind the second of four characters whose hash says so, or at 64 characters.
            if 0 < k < len(line) - 2 and h % 32 == 0 or len(block) == 64 or k + 1 == len(line):
                blocks.append(block)
                block = ""
        own.append((digest("p" + "".join(map(digest, ["b" + x for x in blocks]))), [digest("b" + x) for x in blocks]))
        if not line.strip():
            sections.append(own)
            own = []
    sections += [own] if own else []
    sections = [(digest("s" + "".join(p for p, _ in own)), own) for own in sections]
    return digest("d" + "".join(s for s, _ in sections)), sections


def parts(found):
    """Paragraphs and blocks in the order of the text."""
    return [x for _, own in found[1] for p, blocks in own for x in (*blocks, p)]


def longest(a, b):
    """The length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


REPETITIVE = ["word " * 400, "ha" * 5000, "=-" * 3000, "I am sorry. " * 500, "0" * 10_000]


def test_trees_equal_ones_made_character_by_character(spark, sf001):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf001}/documents.parquet").limit(300).collect()]
    for text in [*texts, *REPETITIVE, "", "\n\n", "a\n \nb\n", "x" * 64, "x" * 65 + "\n" + "y" * 128]:
        assert fingerprints.tree(text) == anew(text)


def test_likeness_lies_under_the_longest_common_subsequence_and_near_it(spark, sf001):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: (r.near_edited, r.near_next) for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    loss = []
    for k, (doc_id, text) in enumerate(rows[:150]):
        following = rows[(k + 1) % len(rows)][1]
        for near, other in zip(got[doc_id], (fingerprints.edited(text, following), following), strict=True):
            x, y = parts(anew(text)), parts(anew(other))
            if len(x) * len(y) < 200_000:
                most = 2 * longest(x, y) / (len(x) + len(y))
                assert near <= most + 1e-12
                loss.append(most - near)
            assert (near == 1.0) == (text == other)
    assert len(loss) > 150 and sum(loss) / len(loss) < 0.01


def test_repetitive_texts_and_order():
    like = lambda a, b: fingerprints.likeness(fingerprints.tree(a), fingerprints.tree(b))
    for text in REPETITIVE:
        assert 0.9 < like(text, text + "!") < 1
    assert like("a\nb\nc\nd", "d\nc\nb\na") < 0.6
    assert like("one\ntwo\n\nthree\nfour", "three\nfour\n\none\ntwo") < 0.8
    assert like("ab\n", "ab") < 1 and like("", "\n") < 1 and like("a", "b") == 0.0


def test_block_ends_depend_on_the_text_around_them():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    assert fingerprints.likeness(fingerprints.tree(text), fingerprints.tree("# " + text)) > 0.95
    chinese = "".join(chr(0x4E00 + i * i % 5000) for i in range(3000))
    assert fingerprints.likeness(fingerprints.tree(chinese), fingerprints.tree(chinese[1:])) > 0.95


def test_ids_that_repeat_and_rows_without_one(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(i, f"own {i}") for i in range(20, 60)] + [(7, None)]
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    written = Counter(fingerprints.write(fingerprints.tree(t)) for _, t in rows)
    assert Counter(r.fingerprint for r in got) == written

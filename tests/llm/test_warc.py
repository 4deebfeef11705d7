import gzip
import hashlib
import os

from listingloom.llm import warc
from listingloom.session import materialize


def brute(rows):
    digests = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in digests:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in digests:
        to = first.get(p) if first.get(p) != i else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def run(pages):
    return warc.read_archives(warc.normalise(materialize(warc.write_archives(pages), "archives")))


def test_pages_come_back(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    assert result(run(pages)) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_odd_rows(spark):
    long = "<p>é\r\n\r\nWARC/1.1 " * 30
    rows = [(5, "u", long), (3, None, long), (4, "a\r\nb: c", long), (None, "", long), (3, "x", long), (1, "s", None), (2, "s", None), (6, "s", "short"), (7, "s", "short"), (8, "big", "y" * 3_000_000), (9, "", "<" * 100), (10, "", "<" * 100)]
    pages = spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id long, url string, html string, n int, digest string")
    assert result(run(pages)) == brute(rows)
    assert run(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_files_hold_a_member_for_each_indexed_record(spark, small, tmp_path):
    members = materialize(warc.normalise(warc.write_archives(spark.read.parquet(f"{small}/pages.parquet"))), "members")
    assert warc.export(members, f"file://{tmp_path}").count() == members.count()
    n = 0
    for row in members.collect():
        with open(tmp_path / f"{row.name}.warc.gz", "rb") as f:
            whole = f.read()
        parts = [gzip.decompress(whole[e.offset : e.offset + e.length]) for e in row["index"]]
        assert b"".join(parts) == gzip.decompress(whole) and all(p.startswith(b"WARC/1.1\r\n") for p in parts)
        n += len(parts)
    assert n == 50 and len(os.listdir(tmp_path)) == 2 * members.count()

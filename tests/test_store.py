import os
import threading

import pytest

from listingloom.sources import store


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/tables") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_an_update_writes_the_buckets_it_touches_only(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    old = [(f"e{i}", i, "old") for i in range(1000)] + [(None, -1, "no id")]
    events = spark.createDataFrame(old, "id string, n int, what string")
    urls = spark.createDataFrame([("e1", "u")], "event_id string, url string")
    assert store.write_store({"events": events, "urls": urls}, root, keys={"events": ["id"], "urls": ["event_id", "url"]}, buckets=32) == 1
    before = files(tmp_path / "store")
    changed = spark.createDataFrame([("e5", 5, "new"), ("e1000", 1000, "new"), (None, -2, "none")], events.schema)
    assert store.update_store({"events": changed}, root, 1, gone={"events": spark.createDataFrame([("e7",), ("none",)], "id string")}) == 2
    after = files(tmp_path / "store")
    assert all(after[f] == at for f, at in before.items())
    one, two = store.manifest(spark, root, 1), store.manifest(spark, root, 2)
    assert one["urls"] == two["urls"]
    moved = [b for b in two["events"]["folders"] if two["events"]["folders"][b] != one["events"]["folders"].get(b)]
    assert 0 < len(moved) <= 5 and len(two["events"]["folders"]) == 32
    wanted = [r for r in old if r[0] not in ("e5", "e7", None)] + [("e5", 5, "new"), ("e1000", 1000, "new"), (None, -2, "none")]
    assert rows(store.read_store(spark, root)[1]["events"]) == sorted(wanted, key=str)
    assert rows(store.read_store(spark, root, 1)[1]["events"]) == sorted(old, key=str)


def test_a_bucket_may_become_empty(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    events = spark.createDataFrame([("a", 1)], "id string, n int")
    store.write_store({"events": events}, root, keys={"events": ["id"]})
    store.update_store({}, root, 1, gone={"events": events.select("id")})
    number, held = store.read_store(spark, root)
    assert number == 2 and held["events"].count() == 0 and held["events"].columns == ["id", "n"]
    assert store.update_store({"events": events}, root, 2) == 3 and rows(store.read_store(spark, root)[1]["events"]) == [("a", 1)]


def test_of_two_writers_one_wins(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert store.read_store(spark, root) == (0, {})
    won, lost = [], []

    def write(k):
        try:
            store.put_once(spark, f"{root}/versions/{1:010d}", f"text {k} " * 1000)
            won.append(k)
        except store.Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 7
    assert (tmp_path / "store/versions/0000000001").read_text() == f"text {won[0]} " * 1000
    assert store.versions(spark, root) == [1]
    with pytest.raises(store.Conflict):
        store.write_store({"events": spark.range(3)}, root)

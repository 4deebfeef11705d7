import json

import pytest

from listingloom.operators import cycle
from listingloom.operators.resolve import prepared
from listingloom.sources import store, tables

LEDGER = "discovery_id long, run_id string, source_id string, event_id string, outcome string, reason string, raw string"
SOURCE_RUNS = "run_id string, source_id string, state string, found_count long, rejected_count long, new_count long, duplicate_count long, rejection_counts map<string,long>"
RUNS = "run_id string, seen_date string, started_at string, state string, finished_at string"
ALIASES = "event_id string, canonical_url string, url string, source_id string, first_seen string, last_seen string"


def empty(spark):
    events = prepared(spark.createDataFrame([], "url string, signup_url string, id string")).drop("canon_url", "canon_signup")
    return spark.createDataFrame([], LEDGER), spark.createDataFrame([], SOURCE_RUNS), spark.createDataFrame([], RUNS), events, spark.createDataFrame([], ALIASES)


def test_an_older_file_is_merged_with_rejections_and_derived_sources(spark, tmp_path):
    event = {"title": "Jazz Night", "start": "2026-08-02T20:00:00-04:00", "url": "https://v.org/jazz-night", "source_id": "a", "explicit_age_min": 21}
    payload = {
        "run": {"id": "r9", "seen_date": "2026-08-01", "manifest_source_ids": ["a", "b"]},
        "sources": [{"source_id": "a", "state": "ok", "found": "7"}, {"id": "b", "state": "empty"}],
        "events": [event, {**event, "source_id": "b"}, {"title": "No time", "source_id": "a"}],
        "rejections": [{"reason": "cancelled", "raw": {"title": "x", "source_id": "a"}}, {"source_id": "a", "event": {"title": "y"}}],
    }
    (tmp_path / "payload.json").write_text(json.dumps(payload, indent=1))
    p = tables.read_crawl_payload(spark, f"{tmp_path}/payload.json")
    ledger, source_runs, runs, events, aliases = empty(spark)
    run = p.run.first()
    done = cycle.merge_payload(run.run_id, run.seen_date, p.sources, p.events, p.rejections, runs, source_runs, ledger, events, aliases, p.manifest)
    assert done.problems.isEmpty()
    assert [(r.discovery_id, r.source_id, r.outcome, r.reason) for r in done.discoveries.orderBy("discovery_id").collect()] == [
        (1, "a", "new", None), (2, "b", "duplicate", None), (3, "a", "rejected", "missing_start"), (4, "a", "rejected", "cancelled"), (5, "a", "rejected", "rejected"),
    ]
    assert {r.source_id: (r.state, r.found_count, r.rejected_count, r.duplicate_count) for r in done.source_runs.collect()} == {"a": ("validation_failed", 4, 3, 0), "b": ("empty_verified", 1, 0, 1)}
    assert [(e.title, e.age_min, e.source_id) for e in done.events.collect()] == [("Jazz Night", 21, "a")]
    assert [tuple(r) for r in done.runs.select("run_id", "state").collect()] == [("r9", "completed")]
    assert done.totals.first().asDict() == {"new": 1, "updated": 0, "unchanged": 0, "duplicate": 1, "rejected": 3, "existing": 0, "store": 1}
    # A source that isn't planned stops the whole payload.
    held = cycle.merge_payload("r9", "2026-08-01", p.sources, p.events, p.rejections, runs, source_runs, ledger, events, aliases, p.manifest.where("source_id = 'a'"))
    assert {(r.source_id, r.problem) for r in held.problems.collect()} == {("b", "extra"), ("b", "event of a source not planned")}
    assert held.events.count() == held.runs.count() == 0 and held.totals is None


def test_a_bare_list_has_events_only_and_no_source_is_unknown(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"title": "A", "start": "2026-08-02T20:00:00-04:00"}]))
    p = tables.read_crawl_payload(spark, f"{tmp_path}/list.json")
    assert p.rejections.isEmpty() and p.sources.isEmpty() and p.manifest.isEmpty()
    ledger, source_runs, runs, events, aliases = empty(spark)
    done = cycle.merge_payload("r", "2026-08-01", p.sources, p.events, p.rejections, runs, source_runs, ledger, events, aliases)
    assert [(r.source_id, r.state, r.new_count) for r in done.source_runs.collect()] == [("unknown", "ok", 1)]
    assert done.events.first().source_id == ""


def test_result_files_are_staged_and_the_run_is_finalized_once_nothing_is_pending(spark, tmp_path):
    start = "2026-08-02T20:00:00-04:00"
    (tmp_path / "a.json").write_text(json.dumps({"source": {"id": "a", "state": "ok"}, "events": [{"title": "A", "start": start}, {"title": "B", "start": start, "source_id": "a"}], "rejections": [{"reason": "", "raw": {"title": "C"}}]}))
    (tmp_path / "b.json").write_text(json.dumps({"source": {"id": "b", "state": "ok"}, "events": [{"title": "A", "start": start, "source_id": "a"}, 5], "rejections": []}))
    (tmp_path / "c.json").write_text(json.dumps({"source": {"id": "c", "state": "ok"}, "events": [], "rejections": []}))
    results, found, rejected = (x.selectExpr("'r1' as run_id", "*") for x in tables.read_source_results(spark, f"{tmp_path}/*.json"))
    results = results.withColumnRenamed("id", "source_id")
    ledger, source_runs, runs, events, aliases = empty(spark)
    runs = spark.createDataFrame([("r1", "2026-08-01", "", "running", None)], RUNS)
    source_runs = spark.createDataFrame([("r1", s, "pending", None, None, None, None, None) for s in "abc"], SOURCE_RUNS)
    ledger = spark.createDataFrame([(1, "r1", "a", None, "staged", None, "{}"), (2, "r0", "a", None, "rejected", "cancelled", "{}")], LEDGER)
    ledger, source_runs, problems = cycle.stage_results(results, found, rejected, runs, source_runs, ledger)
    assert {(r.source_id, r.problem) for r in problems.collect()} == {("b", "event of another source"), ("b", "event is no object")}
    assert [(r.discovery_id, r.run_id, r.outcome, r.reason) for r in ledger.orderBy("discovery_id").collect()] == [(2, "r0", "rejected", "cancelled"), (3, "r1", "staged", None), (4, "r1", "staged", None), (5, "r1", "rejected", "rejected")]
    assert {r.source_id: (r.state, r.found_count, r.rejection_counts) for r in source_runs.collect()} == {"a": ("ok", 3, {"rejected": 1}), "b": ("pending", None, None), "c": ("ok", 0, {})}
    held = cycle.finalize_run("r1", runs, source_runs, ledger, events, aliases)
    assert [(r.source_id, r.problem) for r in held.problems.collect()] == [("b", "still pending")] and held.events.isEmpty()
    assert [r.problem for r in cycle.finalize_run("r7", runs, source_runs, ledger, events, aliases).problems.collect()] == ["unknown run"]
    closed = cycle.finalize_run("r1", runs, source_runs.where("source_id <> 'b'"), ledger, events, aliases, "2026-08-01T09:00:00+00:00")
    assert {r.source_id: (r.state, r.new_count) for r in closed.source_runs.collect()} == {"a": ("ok", 2), "c": ("empty_suspicious", 0)}
    assert [tuple(r) for r in closed.runs.select("state", "finished_at").collect()] == [("completed", "2026-08-01T09:00:00+00:00")]
    assert closed.events.count() == 2 and closed.discoveries.where("run_id = 'r0'").count() == 1


def test_the_second_of_two_writers_from_one_version_fails(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one, two = spark.range(1), spark.range(2)
    assert store.versions(spark, root) == []
    assert store.write_store({"events": one, "aliases": two}, root) == 1
    assert store.write_store({"events": two, "aliases": two}, root, 1) == 2
    with pytest.raises(Exception, match="exist"):
        store.write_store({"events": one, "aliases": one}, root, 1)
    number, held = store.read_store(spark, root)
    assert number == 2 and held["events"].count() == 2 and sorted(held) == ["aliases", "events"]
    assert store.read_store(spark, root, 1)[1]["events"].count() == 1


def test_a_key_is_made_without_reading_the_json_again(spark):
    """The key names most fields many times; in one expression that made a plan of a hundred thousand characters."""
    from listingloom.functions.events import normalised

    raw = ['{"url": " https://a.org/jazz-night ", "title": "A", "start_datetime": "2026-08-01T20:44:00", "explicit_age_min": "21"}', '{"title": "B", "venue_name": "Hall", "dedup_key": "k"}', '{"id": "x", "neighborhood": "Area"}', None]
    rows = normalised(spark.createDataFrame(list(enumerate(raw)), "n int, raw string"), "raw", "2026-08-01", "n")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") < 60
    a, b, c, d = rows.orderBy("n").collect()
    assert (a.dedup_key, a.url, a.age_min, a.raw_keys) == ("u:a.org/jazz-night|2026-08-01T20:30:00", "https://a.org/jazz-night", 21, ["url", "title", "start_datetime", "age_min"])
    assert (b.dedup_key, b.venue, c.id, c.dedup_key, d.status) == ("k", "Hall", "x", "v:area|nodate|", "active") and len({a.id, b.id, c.id, d.id}) == 4


def test_a_run_is_merged_without_carrying_its_json_along(spark, tmp_path, monkeypatch):
    """The JSON of all discoveries was written three times, and each table that a step had written stayed to the end."""
    from listingloom import session

    monkeypatch.setattr(session, "_written", [])
    (tmp_path / "list.json").write_text(json.dumps([{"title": f"Show {k // 2}", "start": "2026-08-02T20:00:00-04:00", "rank": "high", "source_id": "a"} for k in range(6)]))
    p = tables.read_crawl_payload(spark, f"{tmp_path}/list.json")
    ledger, source_runs, runs, events, aliases = empty(spark)
    events = events.selectExpr("*", "cast(null as string) as rank")
    done = cycle.merge_payload("r", "2026-08-01", p.sources, p.events, p.rejections, runs, source_runs, ledger, events, aliases)
    kinds = {path.rsplit("/", 1)[-1].rsplit("-", 1)[0]: path for path in session._written}
    assert set(kinds) <= {"payload_problems", "discovered", "staged", "stored", "replayed", "merged"}
    assert {name for name, path in kinds.items() if "raw" in spark.read.parquet(path).columns} == {"discovered"}
    assert sorted((r.discovery_id, r.outcome, json.loads(r.raw)["title"]) for r in done.discoveries.collect()) == [(k + 1, "duplicate" if k % 2 else "new", f"Show {k // 2}") for k in range(6)]
    assert {(r.title, r.rank) for r in done.events.collect()} == {(f"Show {k}", "high") for k in range(3)}

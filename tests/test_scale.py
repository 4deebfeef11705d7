"""Steps whose cost must not grow with how a table is laid out or how many checks there are."""

from pyspark.sql import functions as F

from listingloom.functions import text as t
from listingloom.operators import alike, resolve as r, updates as u
from listingloom.operators.alike import score
from listingloom.operators.contract import REQUIRED, check_raw_events
from listingloom.plans.queries_extract import feed_pages, ld_pages


def test_contract_parses_a_row_once(spark):
    rows = spark.range(1).select(F.concat(F.lit('{"title": 5, "start": "2026-01-01", "end": null, "id": '), F.col("id").cast("string"), F.lit("}")).alias("raw"))
    checked = check_raw_events(rows, most=100)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2, plan
    assert plan.count("json_object_keys") == 0
    missing = {f"{k}: missing" for k in REQUIRED if k not in ("title", "start", "end")}
    assert set(checked.first()["problems"]) == missing | {"title: wrong kind", "start: not a time with offset", "unknown: id"}


def test_pages_made_from_a_small_file_are_dealt_over_tasks(spark, small):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ld_pages(spark, small).rdd.getNumPartitions() == tasks
    plan = feed_pages(spark, small, "named_struct('id', p_partkey)", "named_struct('events', items)")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def _uses(df, mark):
    return df._jdf.queryExecution().optimizedPlan().toString().count(mark)


def test_canonical_urls_are_made_once(spark):
    rows = spark.range(1).select(F.col("id").cast("string"), F.concat(F.lit("https://a.org/show-1?UTM_x=1&p="), F.col("id")).alias("url"), F.lit("").alias("signup_url"), *(F.lit("").alias(c) for c in ("source_id", "first_seen", "last_seen")))
    once = _uses(rows.select(t.canon_url(F.col("url"))), "utm_[")
    aliases = u.backfill_aliases(rows)
    assert _uses(aliases, "utm_[") <= once
    assert _uses(r.sightings(rows, "id"), "utm_[") <= 2 * once
    pairs = rows.select(F.struct("id", "url").alias("old"), F.struct("id", "url", F.array().cast("array<string>").alias("raw_keys")).alias("new"))
    assert _uses(u.merge_fields(pairs), "utm_[") <= 2 * once
    assert [x["canonical_url"] for x in aliases.collect()] == ["a.org/show-1?p=0"]


def test_titles_that_recur_are_scored_once(monkeypatch):
    titles, calls = [f"jazz night part {k}" for k in range(10)], []
    monkeypatch.setattr(alike, "score", lambda x, y, least: calls.append((x, y)) or score(x, y, least))
    known = alike._Recurring(0.88)
    found = [sorted(known.pairs(titles, titles[k % 3 :])) for k in range(50)]
    assert all(rows == sorted((x, y, score(x, y, 0.88)) for x in titles for y in titles[k % 3 :]) for k, rows in enumerate(found))
    assert len(calls) <= 3 * len(titles) ** 2


def test_blocks_of_one_side_only_are_left_out(spark):
    rows = spark.createDataFrame([(1, "2026-01-01T10:00:00-04:00")], "n int, start string")
    a, b = r._in_blocks(rows.select("n", r.incoming_blocks("start").alias("_blocks")), rows.select("n", r.stored_blocks("start", F.substring("start", 1, 10)).alias("_blocks")))
    assert {x["block"][:4] for x in a.collect()} == {x["block"][:4] for x in b.collect()} == {"both"} and a.count() == 3

"""Registered queries over runs, source runs and discoveries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingloom.operators import accounting as a
from listingloom.plans.bindings import bound, cte

_PROBLEMS = "('empty_suspicious','parse_failed','validation_failed','fetch_failed','auth_required','blocked')"
_MARKED = """marked AS (SELECT d.* REPLACE (CASE WHEN outcome <> 'rejected' AND row_number() OVER (
  PARTITION BY run_id, event_id, outcome = 'rejected' ORDER BY discovery_id) > 1 THEN 'duplicate' ELSE outcome END AS outcome) FROM discoveries d)"""
_COUNTS = ", ".join(f"CAST(count(*) FILTER (outcome = '{o}') AS BIGINT) AS \"{o}\"" for o in a.OUTCOMES)


def _marked(s, d):
    return a.mark_duplicates(bound(s, d, "discoveries"))


def _planned(s, d):
    rows = bound(s, d, "discoveries")
    return rows.select("run_id").distinct().join(rows.select("source_id").distinct().union(s.createDataFrame([("quiet",)], "source_id string")).hint("broadcast"))


def _staged(s, d):
    rows = bound(s, d, "discoveries")
    start = F.when(F.col("event_id").endswith("3"), "").otherwise(F.col("raw_start"))
    return a.staged_counts(rows.where("outcome <> 'rejected'").withColumn("start", start), rows.where("outcome = 'rejected'"))


def _state_fix(s, d):
    rows = a.finalized_counts(_marked(s, d))
    missing = a.rejection_counts(_marked(s, d)).where("reason = 'missing_start'").select("run_id", "source_id", F.col("n").alias("missing"))
    state = a.final_state(F.lit("ok"), F.col("found"), F.coalesce("missing", F.lit(0)))
    return rows.join(missing, ["run_id", "source_id"], "left").select("run_id", "source_id", "found", state.alias("state"))


def _discovery_rows(s, d):
    events = bound(s, d, "event_store").select(F.concat(F.lit("e"), F.substring("id", 2, 9)).alias("id"), "title", "start")
    return a.discoveries_with_event(bound(s, d, "discoveries"), events).select("discovery_id", "display_title", "display_start")


QUERIES = {
    "win1_in_run_duplicates": (
        lambda s, d: _marked(s, d).select("discovery_id", "run_id", "event_id", "outcome"),
        f"{cte('discoveries')}, {_MARKED} SELECT discovery_id, run_id, event_id, outcome FROM marked",
    ),
    "agg5_finalized_counts": (
        lambda s, d: a.finalized_counts(_marked(s, d)),
        f"""{cte('discoveries')}, {_MARKED} SELECT run_id, source_id, count(*) AS found, CAST(count(*) FILTER (outcome <> 'rejected') AS BIGINT) AS parsed,
        CAST(count(*) FILTER (outcome <> 'rejected') AS BIGINT) AS qualified, {_COUNTS} FROM marked GROUP BY 1, 2""",
    ),
    "agg5_finalized_counts_planned": (
        lambda s, d: a.finalized_counts(_marked(s, d), _planned(s, d)).select("run_id", "source_id", "found", "new"),
        f"""{cte('discoveries')}, {_MARKED}, p AS (SELECT * FROM (SELECT DISTINCT run_id FROM discoveries), (SELECT DISTINCT source_id FROM discoveries UNION SELECT 'quiet'))
        SELECT p.run_id, p.source_id, count(m.run_id) AS found, CAST(count(*) FILTER (m.outcome = 'new') AS BIGINT) AS "new"
        FROM p LEFT JOIN marked m USING (run_id, source_id) GROUP BY 1, 2""",
    ),
    "agg6_rejection_counts": (
        lambda s, d: a.rejection_counts(bound(s, d, "discoveries")),
        f"{cte('discoveries')} SELECT run_id, source_id, coalesce(reason, 'rejected') AS reason, count(*) AS n FROM discoveries WHERE outcome = 'rejected' GROUP BY 1, 2, 3",
    ),
    "agg6_rejection_histogram": (
        lambda s, d: a.rejection_histogram(bound(s, d, "discoveries")).select("run_id", "source_id", F.array_join(F.transform(F.map_entries("rejection_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("reasons")),
        f"""{cte('discoveries')}, r AS (SELECT run_id, source_id, coalesce(reason, 'rejected') AS reason, count(*) AS n FROM discoveries WHERE outcome = 'rejected' GROUP BY 1, 2, 3)
        SELECT run_id, source_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM r GROUP BY 1, 2""",
    ),
    "agg7_staged_counts": (
        _staged,
        f"""{cte('discoveries')}, x AS (SELECT run_id, source_id, outcome = 'rejected' AS r, outcome <> 'rejected' AND event_id NOT LIKE '%3' AS ok FROM discoveries)
        SELECT run_id, source_id, count(*) AS found, CAST(count(*) FILTER (ok) AS BIGINT) AS parsed, CAST(count(*) FILTER (ok) AS BIGINT) AS qualified,
        CAST(count(*) FILTER (NOT ok) AS BIGINT) AS rejected FROM x GROUP BY 1, 2""",
    ),
    "agg8_final_state": (
        _state_fix,
        f"""{cte('discoveries')} SELECT run_id, source_id, count(*) AS found,
        CASE WHEN count(*) FILTER (outcome = 'rejected' AND reason = 'missing_start') > 0 THEN 'validation_failed' WHEN count(*) = 0 THEN 'empty_suspicious' ELSE 'ok' END AS state
        FROM discoveries GROUP BY 1, 2""",
    ),
    "agg1_run_totals": (
        lambda s, d: a.run_totals(_marked(s, d)),
        f"""{cte('discoveries')}, {_MARKED} SELECT run_id, count(*) AS scraped, CAST(count(*) FILTER (outcome NOT IN ('duplicate', 'rejected')) AS BIGINT) AS after_dedup,
        CAST(count(*) FILTER (outcome = 'new') AS BIGINT) AS "new" FROM marked GROUP BY 1""",
    ),
    "agg2_run_detail_totals": (
        lambda s, d: a.run_detail_totals(bound(s, d, "source_runs"), _marked(s, d).withColumn("run_id", F.substring("run_id", 1, 7))),
        f"""{cte('discoveries', 'source_runs')}, {_MARKED}, s AS (SELECT run_id, count(*) AS sources, CAST(count(*) FILTER (state NOT IN ('not_due', 'pending')) AS BIGINT) AS checked,
        CAST(count(*) FILTER (state IN {_PROBLEMS}) AS BIGINT) AS issues FROM source_runs GROUP BY 1),
        t AS (SELECT substr(run_id, 1, 7) AS run_id, count(*) AS discoveries, {_COUNTS} FROM marked GROUP BY 1)
        SELECT coalesce(s.run_id, t.run_id) AS run_id, coalesce(sources, 0) AS sources, coalesce(checked, 0) AS checked, coalesce(issues, 0) AS issues, coalesce(discoveries, 0) AS discoveries,
        {', '.join(f'coalesce("{o}", 0) AS "{o}"' for o in a.OUTCOMES)}, coalesce(updated + unchanged, 0) AS existing FROM s FULL JOIN t ON s.run_id = t.run_id""",
    ),
    "agg3_list_runs": (
        lambda s, d: a.list_runs(bound(s, d, "runs"), bound(s, d, "source_runs"), bound(s, d, "discoveries").withColumn("run_id", F.substring("run_id", 1, 7))),
        f"""{cte('runs', 'source_runs', 'discoveries')}, d7 AS (SELECT * REPLACE (substr(run_id, 1, 7) AS run_id) FROM discoveries)
        SELECT r.run_id, r.seen_date, r.started_at, r.state,
        (SELECT count(DISTINCT source_id) FROM source_runs s WHERE s.run_id = r.run_id) AS source_count,
        (SELECT count(DISTINCT source_id) FROM source_runs s WHERE s.run_id = r.run_id AND s.state IN {_PROBLEMS}) AS issue_count,
        (SELECT count(*) FROM d7 WHERE d7.run_id = r.run_id) AS discovery_count,
        (SELECT count(*) FROM d7 WHERE d7.run_id = r.run_id AND outcome = 'new') AS new_count,
        (SELECT count(*) FROM d7 WHERE d7.run_id = r.run_id AND outcome = 'rejected') AS rejected_count
        FROM runs r ORDER BY r.started_at DESC, r.run_id DESC LIMIT 100""",
    ),
    "res6_latest_source_health": (
        lambda s, d: a.latest_health(bound(s, d, "source_runs"), bound(s, d, "runs")).select("source_id", "run_id", "state", "found_count", "run_started_at", "last_audited_at"),
        f"""{cte('runs', 'source_runs')} SELECT sr.source_id, sr.run_id, sr.state, sr.found_count, r.started_at AS run_started_at,
        (SELECT max(x.finished_at) FROM source_runs x WHERE x.source_id = sr.source_id AND x.audit AND x.state IN ('ok', 'ok_via_fallback', 'empty_verified')) AS last_audited_at
        FROM source_runs sr JOIN runs r ON r.run_id = sr.run_id WHERE r.state = 'completed'
        QUALIFY row_number() OVER (PARTITION BY sr.source_id ORDER BY r.started_at DESC, sr.run_id DESC) = 1""",
    ),
    "res7_previous_state": (
        lambda s, d: a.previous_states(bound(s, d, "source_runs"), bound(s, d, "runs")).select("run_id", "source_id", "state", "previous_state", "state_changed"),
        f"""{cte('runs', 'source_runs')}, x AS (SELECT sr.run_id, source_id, sr.state, lag(sr.state) OVER (PARTITION BY source_id ORDER BY started_at, sr.run_id) AS previous_state
        FROM source_runs sr JOIN runs r ON r.run_id = sr.run_id) SELECT *, previous_state IS NOT NULL AND previous_state <> state AS state_changed FROM x""",
    ),
    "res10_source_history": (
        lambda s, d: a.source_history(bound(s, d, "source_runs"), bound(s, d, "runs")).select("source_id", "run_id", "state", "run_started_at", F.col("place").cast("long").alias("place")),
        f"""{cte('runs', 'source_runs')} SELECT source_id, sr.run_id, sr.state, started_at AS run_started_at,
        row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, sr.run_id DESC) AS place FROM source_runs sr JOIN runs r ON r.run_id = sr.run_id QUALIFY place <= 30""",
    ),
    "res9_discoveries_with_event": (
        _discovery_rows,
        f"""{cte('discoveries', 'event_store')} SELECT discovery_id, coalesce(nullif(e.title, ''), nullif(raw_title, ''), 'Untitled candidate') AS display_title,
        coalesce(nullif(e.start, ''), nullif(raw_start, ''), '') AS display_start
        FROM discoveries d LEFT JOIN event_store e ON d.event_id = 'e' || substr(e.id, 2)""",
    ),
    "view7_run_rows": (
        lambda s, d: a.previous_states(bound(s, d, "source_runs"), bound(s, d, "runs")).where(F.col("state").isin(*a.PROBLEM_STATES)).select("run_id", "source_id", "state", "state_changed"),
        f"""{cte('runs', 'source_runs')}, x AS (SELECT sr.run_id, source_id, sr.state, coalesce(lag(sr.state) OVER (PARTITION BY source_id ORDER BY started_at, sr.run_id) <> sr.state, false) AS state_changed
        FROM source_runs sr JOIN runs r ON r.run_id = sr.run_id) SELECT * FROM x WHERE state IN {_PROBLEMS}""",
    ),
}

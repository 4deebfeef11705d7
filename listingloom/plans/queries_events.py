"""Registered queries over the event store and the catalog, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingloom.functions import text as t
from listingloom.operators import accounting as a
from listingloom.plans import views as v
from listingloom.plans.bindings import bound, cte

AS_OF = "1996-03-15"
_RANK = "CASE rank WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
_PROBLEMS = "('empty_suspicious','parse_failed','validation_failed','fetch_failed','auth_required','blocked')"
_E = cte("event_store")
_SHOWN = ["id", "title", "start", "rank", "source_id"]


def _store(s, d):
    return bound(s, d, "event_store")


def _sources(s, d):
    return v.all_sources(bound(s, d, "catalog").drop("adapter"), bound(s, d, "inbox"))


_SOURCES = f"""{cte('catalog', 'inbox')}, sources AS (SELECT id, title, url, priority, geo, enabled, disabled_reason, profile, 'website' AS kind FROM catalog
UNION ALL SELECT id, title, coalesce(url, ''), coalesce(priority, 3), 'Inbox', true, '', 'letters', 'inbox' FROM inbox)"""
_HEALTH = f"""{cte('runs', 'source_runs')}, health AS (SELECT sr.source_id, sr.run_id, sr.state, r.started_at AS run_started_at,
 (SELECT max(x.finished_at) FROM source_runs x WHERE x.source_id = sr.source_id AND x.audit AND x.state IN ('ok', 'ok_via_fallback', 'empty_verified')) AS last_audited_at
 FROM source_runs sr JOIN runs r ON r.run_id = sr.run_id WHERE r.state = 'completed'
 QUALIFY row_number() OVER (PARTITION BY sr.source_id ORDER BY r.started_at DESC, sr.run_id DESC) = 1)"""


def _health(s, d):
    return a.latest_health(bound(s, d, "source_runs"), bound(s, d, "runs"))


QUERIES = {
    "view1_upcoming": (
        lambda s, d: v.upcoming(_store(s, d), AS_OF, 60, "medium").select(*_SHOWN),
        f"{_E} SELECT id, title, start, rank, source_id FROM event_store WHERE status <> 'cancelled' AND substr(start, 1, 10) BETWEEN '{AS_OF}' AND CAST(CAST(DATE '{AS_OF}' + INTERVAL 60 DAY AS DATE) AS STRING) AND {_RANK} <= 1",
    ),
    "view2_needs_rank": (
        lambda s, d: v.needs_rank(_store(s, d), AS_OF, 200, host="building").select(*_SHOWN),
        f"{_E} SELECT id, title, start, rank, source_id FROM event_store WHERE status <> 'cancelled' AND substr(start, 1, 10) BETWEEN '{AS_OF}' AND CAST(CAST(DATE '{AS_OF}' + INTERVAL 200 DAY AS DATE) AS STRING) AND (lower(host) LIKE '%building%' OR source_id = 'building')",
    ),
    "view3_list_events": (
        lambda s, d: v.list_events(_store(s, d), AS_OF, q="urgent night%part 3", period="past", sort="place", descending=True).select(*_SHOWN),
        f"""{_E} SELECT id, title, start, rank, source_id FROM event_store WHERE status = 'active' AND substr(start, 1, 10) < '{AS_OF}'
        AND (lower(title) LIKE '%urgent night%part 3%' OR lower(host) LIKE '%urgent night%part 3%' OR lower(venue) LIKE '%urgent night%part 3%' OR lower(description) LIKE '%urgent night%part 3%')
        ORDER BY lower(coalesce(nullif(neighborhood, ''), venue)) DESC NULLS LAST, start DESC, lower(title), id LIMIT 500""",
    ),
    "ord1_sort_by_rank": (
        lambda s, d: v.sort_events(_store(s, d), "rank").select(*_SHOWN),
        f"{_E} SELECT id, title, start, rank, source_id FROM event_store ORDER BY {_RANK}, start DESC, lower(title), id LIMIT 500",
    ),
    "ord1_sort_unknown_field": (
        lambda s, d: v.sort_events(_store(s, d), "nonsense").select(*_SHOWN),
        f"{_E} SELECT id, title, start, rank, source_id FROM event_store ORDER BY start, lower(title), id LIMIT 500",
    ),
    "ord2_newest_by_source": (
        lambda s, d: v.newest_by_source(_store(s, d)).select("source_id", "id", "start", F.col("place").cast("long").alias("place")),
        f"{_E} SELECT source_id, id, start, row_number() OVER (PARTITION BY source_id ORDER BY start DESC, id) AS place FROM event_store QUALIFY place <= 50",
    ),
    "ord2_source_issues": (
        lambda s, d: v.issues(_health(s, d)).select("source_id", "run_id", "state"),
        f"{_HEALTH} SELECT source_id, run_id, state FROM health WHERE state IN {_PROBLEMS} ORDER BY run_started_at DESC, source_id LIMIT 8",
    ),
    "ord3_order_queue": (
        lambda s, d: v.upcoming(_store(s, d), AS_OF, 30).select("id", "start", "rank"),
        f"{_E} SELECT id, start, rank FROM event_store WHERE status <> 'cancelled' AND substr(start, 1, 10) BETWEEN '{AS_OF}' AND CAST(CAST(DATE '{AS_OF}' + INTERVAL 30 DAY AS DATE) AS STRING)",
    ),
    "view4_events_between": (
        lambda s, d: v.events_between(_store(s, d), "1995-01-10", "1995-02-20", "low").select(*_SHOWN),
        f"{_E} SELECT id, title, start, rank, source_id FROM event_store WHERE status = 'active' AND substr(start, 1, 10) BETWEEN '1995-01-10' AND '1995-02-20' AND {_RANK} <= 2",
    ),
    "view5_calendar_grid": (
        lambda s, d: v.calendar_grid(_store(s, d), "1996-02", AS_OF).withColumn("shown", F.array_join("shown", "|")),
        f"""{_E}, days AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '1996-01-29', DATE '1996-03-03', INTERVAL 1 DAY) g(d)),
        e AS (SELECT substr(start, 1, 10) AS date, title, row_number() OVER (PARTITION BY substr(start, 1, 10) ORDER BY start, lower(title), id) AS k FROM event_store WHERE status = 'active')
        SELECT CAST(d AS STRING) AS date, month(d) = 2 AS in_month, CAST(d AS STRING) < '{AS_OF}' AS past, CAST(d AS STRING) = '{AS_OF}' AS today, CAST(count(e.date) AS INT) AS n,
        coalesce(string_agg(title, '|' ORDER BY k) FILTER (k <= 3), '') AS shown, CAST(greatest(count(e.date) - 3, 0) AS INT) AS more
        FROM days LEFT JOIN e ON e.date = CAST(d AS STRING) GROUP BY d""",
    ),
    "view6_filter_sources": (
        lambda s, d: v.filter_sources(v.catalog_with_health(_sources(s, d), _health(s, d)), "supp", "issues").select("id", "title", "state"),
        f"""{_SOURCES}, {_HEALTH.removeprefix('WITH ')} SELECT id, title, state FROM sources LEFT JOIN health ON source_id = id
        WHERE state IN {_PROBLEMS} AND lower(concat_ws(' ', id, title, url, geo, profile)) LIKE '%supp%'""",
    ),
    "view10_dashboard_counts": (
        lambda s, d: v.dashboard_counts(_store(s, d), bound(s, d, "runs"), bound(s, d, "catalog"), bound(s, d, "inbox"), AS_OF),
        f"""{cte('event_store', 'runs', 'catalog', 'inbox')} SELECT (SELECT count(*) FROM event_store) AS events,
        (SELECT CAST(sum(CASE WHEN substr(start, 1, 10) >= '{AS_OF}' AND status <> 'cancelled' THEN 1 ELSE 0 END) AS BIGINT) FROM event_store) AS upcoming,
        (SELECT CAST(sum(CASE WHEN substr(start, 1, 10) >= '{AS_OF}' AND status <> 'cancelled' AND rank IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM event_store) AS unranked,
        (SELECT count(*) FROM runs) AS runs, (SELECT count(*) FROM catalog) AS sources, (SELECT count(*) FROM catalog WHERE enabled) AS enabled_sources,
        (SELECT count(*) FROM catalog WHERE NOT enabled) AS disabled_sources, (SELECT count(DISTINCT profile) FROM catalog) AS profiles, (SELECT count(*) FROM inbox) AS inbox_items""",
    ),
    "view11_source_stats": (
        lambda s, d: _health(s, d).select("source_id", "run_id", "state", "found_count", "parsed_count", "rejected_count", "new_count", "audit"),
        f"{cte('runs', 'source_runs')} SELECT source_id, sr.run_id, sr.state, found_count, parsed_count, rejected_count, new_count, audit FROM source_runs sr JOIN runs r ON r.run_id = sr.run_id WHERE r.state = 'completed' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, sr.run_id DESC) = 1",
    ),
    "agg9_store_stats": (
        lambda s, d: v.store_stats(_store(s, d), AS_OF),
        f"""{_E}, x AS (SELECT CASE WHEN substr(start, 1, 10) >= '{AS_OF}' THEN 'upcoming' ELSE 'past' END AS period, coalesce(rank, 'unranked') AS rank, source_id FROM event_store)
        SELECT 'period' AS kind, period AS "key", count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'rank', rank, count(*) FROM x WHERE period = 'upcoming' GROUP BY 2
        UNION ALL SELECT 'source', source_id, count(*) FROM x WHERE period = 'upcoming' GROUP BY 2""",
    ),
    "agg10_unranked_upcoming": (
        lambda s, d: v.unranked_upcoming(_store(s, d), AS_OF),
        f"{_E} SELECT count(*) AS n FROM event_store WHERE rank IS NULL AND substr(start, 1, 10) >= '{AS_OF}'",
    ),
    "agg11_rank_groups": (
        lambda s, d: v.rank_groups(v.needs_rank(_store(s, d), AS_OF), t.norm_ascii).select("series_key", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"), "n", F.array_join(F.transform("occurrences", lambda o: o["id"]), ",").alias("ids")),
        f"""{_E}, q AS (SELECT id, start, trim(regexp_replace(lower(source_id), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(host), '[^a-z0-9]+', ' ', 'g')) || '|' ||
        trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '\\b20\\d{{2}}\\b|\\b\\d+(st|nd|rd|th)?\\b', ' ', 'g'), '\\bpart\\s+([ivxlcdm]+|\\d+)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS series_key
        FROM event_store WHERE status <> 'cancelled' AND rank IS NULL AND substr(start, 1, 10) >= '{AS_OF}')
        SELECT series_key, arg_min(id, start || id) AS first_id, min(start) AS first_start, CAST(count(*) AS INT) AS n, string_agg(id, ',' ORDER BY start, id) AS ids FROM q GROUP BY 1""",
    ),
    "res8_catalog_with_health": (
        lambda s, d: v.catalog_with_health(_sources(s, d), _health(s, d)).select("id", "title", "kind", "priority", "run_id", "state", "last_audited_at"),
        f"{_SOURCES}, {_HEALTH.removeprefix('WITH ')} SELECT id, title, kind, priority, run_id, state, last_audited_at FROM sources LEFT JOIN health ON source_id = id",
    ),
    "res11_historical_sources": (
        lambda s, d: v.historical_sources(_sources(s, d), bound(s, d, "source_runs"), _store(s, d)),
        f"""{_SOURCES}, {cte('source_runs', 'event_store').removeprefix('WITH ')} SELECT x AS id, x AS title, CAST(3 AS INT) AS priority, 'Not in current catalog' AS geo, false AS enabled, 'historical' AS kind
        FROM (SELECT source_id AS x FROM source_runs UNION SELECT source_id FROM event_store) WHERE x NOT IN (SELECT id FROM sources)""",
    ),
    "set2_all_sources": (
        lambda s, d: _sources(s, d).select("id", "title", "url", "priority", "geo", "enabled", "profile", "kind"),
        f"{_SOURCES} SELECT id, title, url, priority, geo, enabled, profile, kind FROM sources",
    ),
    "src6_read_store": (
        lambda s, d: _store(s, d).orderBy("start", "title").select("id", "url", "title", "host", "start", "venue", "address", "rank", "status", "is_free", "first_seen", "last_seen"),
        f"{_E} SELECT id, url, title, host, start, venue, address, rank, status, is_free, first_seen, last_seen FROM event_store",
    ),
}

"""Registered queries of resolution, store updates, checks and planning, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingloom.functions import events as e
from listingloom.functions import text as t
from listingloom.operators import accounting as a
from listingloom.operators import checks as c
from listingloom.operators import contract
from listingloom.operators import resolve as r
from listingloom.operators import updates as u
from listingloom.plans import views as v
from listingloom.plans.bindings import bound, cte
from listingloom.sources import tables

_GENERIC = "('','calendar','calendars','events','event','upcoming','index','home','schedule','programs','program','tastingevents','film','films','whats-on','listings','shop','tickets')"
_KEYS = "('eid','event','event_id','eventid','id','p','post','vista_film_id','wfea_eb_id')"


def canon_sql(url: str) -> str:
    """A canonical URL in DuckDB, for URLs without characters that need encoding."""
    bare = f"regexp_replace(regexp_replace({url}, '#.*$', ''), '^[a-z]+://', '')"
    path = f"regexp_replace(rtrim(split_part({bare}, '?', 1), '/'), '^www\\.', '')"
    pairs = f"array_to_string(list_sort([pair FOR pair IN string_split(lower(split_part({bare}, '?', 2)), '&') IF pair <> '' AND pair NOT LIKE 'utm~_%' ESCAPE '~']), '&')"
    return f"(lower({path}) || CASE WHEN {pairs} <> '' THEN '?' || {pairs} ELSE '' END)"


def event_url_sql(canon: str) -> str:
    keys = f"[split_part(pair, '=', 1) FOR pair IN string_split(split_part({canon}, '?', 2), '&')]"
    segment = f"regexp_replace(split_part(split_part({canon}, '?', 1), '/', -1), '\\.(aspx|html?|php)$', '')"
    return f"""(contains({canon}, '/') AND ((split_part({canon}, '?', 2) <> '' AND len([k FOR k IN {keys} IF k IN {_KEYS} OR k LIKE '%~_id' ESCAPE '~']) > 0)
    OR ({segment} NOT IN {_GENERIC} AND (length({segment}) >= 6 OR regexp_matches({segment}, '[0-9]') OR contains({segment}, '-')))))"""


def _aliases(s, d):
    return u.backfill_aliases(bound(s, d, "event_store"))


_BACKFILL = f"aliases AS (SELECT id AS event_id, {canon_sql('url')} AS canonical_url, url, source_id, first_seen, last_seen FROM event_store WHERE {event_url_sql(canon_sql('url'))})"
_MINE = f"""mine AS (SELECT DISTINCT n, start, x AS canonical_url FROM (SELECT n, start, {canon_sql('url')} AS x FROM incoming UNION ALL SELECT n, start, {canon_sql('signup_url')} FROM incoming) WHERE {event_url_sql('x')})"""
_ALIAS_HITS = f"""{cte('event_store', 'incoming')}, {_BACKFILL}, {_MINE}, hits AS (SELECT DISTINCT n, e.id, abs(epoch(CAST(m.start AS TIMESTAMPTZ)) - epoch(CAST(e.start AS TIMESTAMPTZ))) <= 1800 AS near
 FROM mine m JOIN aliases x USING (canonical_url) JOIN event_store e ON e.id = x.event_id AND substr(e.start, 1, 10) = substr(m.start, 1, 10)),
 alias AS (SELECT n, CASE WHEN count(*) = 1 THEN min(id) WHEN count(*) FILTER (near) = 1 THEN min(id) FILTER (near) END AS event_id FROM hits GROUP BY n)"""


def _incoming(s, d):
    return bound(s, d, "incoming")


def _finalized(s, d):
    """A run whose staged rows are a second crawl of the store's listings under other URLs."""
    events = bound(s, d, "event_store")
    staged = _incoming(s, d).join(events.withColumn("n", F.expr("cast(substr(id, 2) as bigint)")).drop("url", "signup_url", "start", "id", "last_seen", "first_seen"), "n")
    staged = staged.withColumn("raw_keys", F.array(F.lit("is_free"))).withColumn("first_seen", F.lit("2026-08-01")).withColumn("last_seen", F.lit("2026-08-01"))
    return r.finalize(staged, events, _aliases(s, d), "2026-08-01")


def _upsert(s, d):
    store = bound(s, d, "event_store").select("id", "title", "status", "last_seen")
    new = _incoming(s, d).select("n", "id", F.concat(F.lit("Renamed "), "id").alias("title"), F.lit("active").alias("status"), F.lit("2026-01-01").alias("last_seen"))
    return u.upsert_events(store, new)


def _upsert_aliases(s, d):
    old = bound(s, d, "sightings").where("seen < '2026-05'")
    first = u.upsert_aliases(s.createDataFrame([], "event_id string, canonical_url string, url string, source_id string, first_seen string, last_seen string"), old)
    return u.upsert_aliases(first.drop("is_new"), bound(s, d, "sightings").where("seen >= '2026-05'")).select("event_id", "canonical_url", "source_id", "first_seen", "last_seen", "is_new")


def _merge(s, d):
    store = bound(s, d, "event_store").withColumn("raw_keys", F.when(F.expr("length(id) % 2 = 0"), F.array(F.lit("is_free"))).otherwise(F.array().cast("array<string>")))
    fields = ["id", "url", "title", "venue", "neighborhood", "address", "status", "is_free", "description", "source_id"]
    old = store.select(F.struct(*fields).alias("old"), "id")
    later = F.concat(F.lit("o"), (F.expr("cast(substr(id, 2) as bigint)") - 1).cast("string"))
    new = store.withColumn("id", later).select("id", F.struct(*fields, "raw_keys").alias("new"))
    return u.merge_fields(old.join(new, "id").select("old", "new"))


_MERGE = f"""{cte('event_store')}, p AS (SELECT o.*, n.url AS nurl, n.venue AS nvenue, n.neighborhood AS nnb, n.address AS naddr, n.status AS nstatus, n.is_free AS nfree, n.description AS ndesc, n.source_id AS nsrc,
 length(n.id) % 2 = 0 AS clears FROM event_store o JOIN event_store n ON 'o' || CAST(CAST(substr(n.id, 2) AS BIGINT) - 1 AS STRING) = o.id),
 q AS (SELECT *, nvenue <> '' AND nvenue <> venue AS c1, nnb <> '' AND nnb <> neighborhood AS c2, naddr <> '' AND naddr <> address AS c3, nstatus <> '' AND nstatus <> status AS c4,
 (nfree OR (clears AND nsrc = source_id)) AND nfree <> is_free AS c5, length(ndesc) > length(description) AS c6,
 NOT {event_url_sql(canon_sql('url'))} AND {event_url_sql(canon_sql('nurl'))} AS c7 FROM p)
 SELECT id, CASE WHEN c7 THEN nurl ELSE url END AS url, title, CASE WHEN c1 THEN nvenue ELSE venue END AS venue, CASE WHEN c2 THEN nnb ELSE neighborhood END AS neighborhood,
 CASE WHEN c3 THEN naddr ELSE address END AS address, CASE WHEN c4 THEN nstatus ELSE status END AS status, CASE WHEN c5 THEN nfree ELSE is_free END AS is_free,
 CASE WHEN c6 THEN ndesc ELSE description END AS description, source_id, c1 OR c2 OR c3 OR c4 OR c5 OR c6 OR c7 AS changed FROM q"""


def _profiles(s, d):
    return bound(s, d, "catalog").select(F.col("profile").alias("name")).distinct().where("name <> 'gone'").select("name", F.concat(F.lit("get-"), "name").alias("method"), F.concat("name", F.lit("-v1")).alias("recipe"))


def _all_sources(s, d):
    return v.all_sources(bound(s, d, "catalog"), bound(s, d, "inbox"))


def _plan(s, d, mail=False, only=None):
    return c.plan_run(_all_sources(s, d), a.latest_health(bound(s, d, "source_runs"), bound(s, d, "runs")), _profiles(s, d), mail, only)


_HEALTH = f"""{cte('catalog', 'inbox', 'runs', 'source_runs')}, health AS (SELECT sr.source_id, sr.state FROM source_runs sr JOIN runs r ON r.run_id = sr.run_id WHERE r.state = 'completed'
 QUALIFY row_number() OVER (PARTITION BY sr.source_id ORDER BY r.started_at DESC, sr.run_id DESC) = 1)"""
_RETRY = "('empty_suspicious','parse_failed','validation_failed','fetch_failed')"


#: A catalog in which each of the 15 rules is broken, as columns over the bindings catalog and inbox.
_BROKEN = {
    "sources": ("CASE WHEN priority = 3 AND geo LIKE 'A%' THEN '' WHEN priority = 3 AND geo LIKE 'I%' THEN 'inbox1' ELSE id END AS id", "enabled", "disabled_reason", "adapter", "CASE WHEN geo LIKE 'U%' THEN NULL ELSE profile END AS profile", "geo LIKE 'B%' AS bad_enabled", "geo LIKE 'C%' AS bad_adapter", "geo LIKE 'E%' AS has_cadence"),
    "profiles": ("DISTINCT profile AS name", "profile <> 'page' AS has_primary", "profile <> 'feed' AS has_required_fields", "profile <> 'page' AS has_empty_signal", "profile = 'feed' AS has_audit_cadence"),
    "inbox": ("CASE WHEN priority = 2 AND url IS NULL THEN '' WHEN parse_hint = 'note' AND url IS NOT NULL AND priority IS NULL THEN 'inbox4' ELSE id END AS id", "'gone' AS profile", "url IS NULL AS has_cadence"),
}


def _broken(s, d):
    part = lambda name, frm, extra="": s.sql(f"SELECT {', '.join(_BROKEN[name])} FROM {{t}} {extra}", t=bound(s, d, frm))
    return c.check_catalog(part("sources", "catalog"), part("profiles", "catalog", "WHERE profile <> 'gone'"), part("inbox", "inbox"))


def _payload(s, d):
    manifest = bound(s, d, "catalog").select(F.col("id").alias("source_id"))
    rows = bound(s, d, "source_runs").where("run_id = '1995-06'").select("source_id", "state")
    events = bound(s, d, "event_store").select(F.when(F.col("source_id") == "building", "s1").otherwise(F.col("source_id")).alias("source_id"))
    return c.check_payload(manifest, rows, events)


def _ranks(s, d):
    store = bound(s, d, "event_store")
    events = store.select("id", "rank", "source_id")
    groups = events.where("source_id = 'building'").groupBy(F.substring("id", -1, 1).alias("g")).agg(F.collect_list("id").alias("ids")).select("ids", F.when(F.col("g") < "4", "high").when(F.col("g") < "7", "").otherwise("best").alias("rank"), F.concat(F.lit("note "), "g").alias("note"), F.col("g").cast("long").alias("n"))
    single = store.where("status = 'postponed'").select("id", F.lit("low").alias("rank"), F.lit("").alias("note"), F.lit(1).cast("long").alias("n"))
    ranked, problems = u.apply_ranks(events, groups, single, "2026-02-02")
    return ranked.select("id", "rank", "fit_note", "ranked_on").withColumn("problem", F.lit(None).cast("string")).unionByName(problems.select("id", F.lit(None).cast("string").alias("rank"), F.lit(None).cast("string").alias("fit_note"), F.lit(None).cast("string").alias("ranked_on"), "problem"))


def _invalidated(s, d, *more):
    events = bound(s, d, "event_store").select(F.concat(F.lit("e"), F.substring("id", 2, 9)).alias("id"), "url", F.lit("click").alias("source_id"), "first_seen", "last_seen", "status")
    ids = events.where("status = 'cancelled'").select("id")
    for i in more:
        ids = ids.unionAll(s.range(1).select(F.lit(i).alias("id")))
    return u.invalidate_events(events, u.backfill_aliases(events), bound(s, d, "discoveries"), ids, "click", "repair")


def _invalidate(s, d):
    kept, aliases, rows, counts, _, _ = _invalidated(s, d)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(kept, "events").unionAll(count(aliases, "aliases")).unionAll(count(rows.where("reason = 'repair'"), "rejected")).unionAll(counts.select(F.concat_ws(" ", "run_id", "source_id", "reason"), "n"))


#: One text for each rule of events.THEME_RULES in turn, some of which later rules match too, and one for none.
_THEME_TEXTS = ("Half Marathon", "barbell workout", "PHOTO walk", "salsa party", "poetry reading", "writing concert", "art film", "movie music", "open mic jazz", "DJ games", "trivia soccer", "pickleball yoga", "sound bath with wine", "beer dinner", "brunch walk", "evening stroll party", "magic comedy", "improv talk", "debate party", "happy hour", "nothing")
_THEME_SYMBOLS = ("🏃", "🏋️", "📸", "💃", "📚", "✍️", "🎨", "🎬", "🎤", "🎵", "🎲", "⚽", "🧘", "🍷", "🍽️", "🚶", "🪄", "🎭", "💬", "🎉", "✨")


QUERIES = {
    "res1_alias_match": (
        lambda s, d: r.match_alias(_incoming(s, d), _aliases(s, d), bound(s, d, "event_store")),
        f"{_ALIAS_HITS} SELECT n, event_id FROM alias WHERE event_id IS NOT NULL",
    ),
    "res2_exact_match": (
        lambda s, d: r.match_exact(_incoming(s, d), bound(s, d, "event_store")),
        f"{cte('event_store', 'incoming')} SELECT n, e.id AS event_id FROM incoming i JOIN event_store e ON e.id = i.id",
    ),
    "res4_resolve_alias_then_exact": (
        lambda s, d: _incoming(s, d).select("n").join(r.match_alias(_incoming(s, d), _aliases(s, d), bound(s, d, "event_store")).withColumnRenamed("event_id", "x"), "n", "left").join(r.match_exact(_incoming(s, d), bound(s, d, "event_store")).withColumnRenamed("event_id", "y"), "n", "left").select("n", F.coalesce("x", "y").alias("event_id")),
        f"{_ALIAS_HITS} SELECT i.n, coalesce(x.event_id, e.id) AS event_id FROM incoming i LEFT JOIN alias x ON x.n = i.n LEFT JOIN event_store e ON e.id = i.id",
    ),
    "res3_occurrence_match": (
        lambda s, d: r.match_occurrence(_incoming(s, d).join(bound(s, d, "event_store").select(F.expr("cast(substr(id, 2) as bigint)").alias("n"), "title", "host", "venue", "address", "neighborhood"), "n"), bound(s, d, "event_store"), t.norm_ascii),
        None,
    ),
    "res4_resolve": (
        lambda s, d: r.resolve(_incoming(s, d).join(bound(s, d, "event_store").select(F.expr("cast(substr(id, 2) as bigint)").alias("n"), "title", "host", "venue", "address", "neighborhood"), "n"), _aliases(s, d), bound(s, d, "event_store"), t.norm_ascii),
        None,
    ),
    "upd7_upsert_source_runs": (
        lambda s, d: u.upsert_source_runs(bound(s, d, "source_runs").select("run_id", "source_id", "state"), bound(s, d, "source_runs").where("state = 'not_due'").select("run_id", "source_id", F.lit("ok").alias("state"))),
        f"{cte('source_runs')} SELECT run_id, source_id, CASE WHEN state = 'not_due' THEN 'ok' ELSE state END AS state FROM source_runs",
    ),
    "view8_event_detail": (
        lambda s, d: bound(s, d, "event_store").select("id", "title").join(u.event_aliases(bound(s, d, "event_store"), _aliases(s, d)).withColumnRenamed("event_id", "id"), "id", "left").join(bound(s, d, "discoveries").groupBy(F.concat(F.lit("o"), F.substring("event_id", 2, 20)).alias("id")).agg(F.max("discovery_id").alias("newest"), F.count("*").alias("seen")), "id", "left").select("id", "title", "canonical_url", "newest", "seen"),
        f"{cte('event_store', 'discoveries')}, {_BACKFILL}, x AS (SELECT 'o' || substr(event_id, 2) AS id, max(discovery_id) AS newest, count(*) AS seen FROM discoveries GROUP BY 1) SELECT e.id, e.title, a.canonical_url, newest, seen FROM event_store e LEFT JOIN aliases a ON a.event_id = e.id LEFT JOIN x ON x.id = e.id",
    ),
    "view9_source_detail": (
        lambda s, d: _all_sources(s, d).select("id", "kind").unionByName(v.historical_sources(_all_sources(s, d), bound(s, d, "source_runs"), bound(s, d, "event_store")).select("id", "kind")).join(a.source_history(bound(s, d, "source_runs"), bound(s, d, "runs")).where("place = 1").select(F.col("source_id").alias("id"), "run_id", "state"), "id", "left"),
        f"""{cte('catalog', 'inbox', 'runs', 'source_runs', 'event_store')}, k AS (SELECT id, 'website' AS kind FROM catalog UNION ALL SELECT id, 'inbox' FROM inbox),
        al AS (SELECT * FROM k UNION ALL SELECT x, 'historical' FROM (SELECT source_id AS x FROM source_runs UNION SELECT source_id FROM event_store) WHERE x NOT IN (SELECT id FROM k)),
        h AS (SELECT source_id, sr.run_id, sr.state FROM source_runs sr JOIN runs r ON r.run_id = sr.run_id QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, sr.run_id DESC) = 1)
        SELECT id, kind, run_id, state FROM al LEFT JOIN h ON source_id = id""",
    ),
    "res5_pair_similarity": (
        lambda s, d: r.score_pairs(bound(s, d, "event_store"), bound(s, d, "event_store"), "id", "id", t.norm_ascii, distinct=True),
        None,
    ),
    "res12_event_aliases": (
        lambda s, d: u.event_aliases(bound(s, d, "event_store"), _aliases(s, d)).select("event_id", "canonical_url", "first_seen", "is_preferred"),
        f"{cte('event_store')}, {_BACKFILL} SELECT event_id, canonical_url, first_seen, true AS is_preferred FROM aliases",
    ),
    "res13_pending_work": (
        lambda s, d: c.pending_work(_plan(s, d).unionByName(_plan(s, d).limit(0)), bound(s, d, "catalog")),
        f"{cte('catalog')} SELECT id AS source_id, CASE WHEN adapter = '' THEN 'skipped' ELSE 'run' END AS action, adapter FROM catalog WHERE enabled",
    ),
    "res14_profile_references": (
        lambda s, d: c.profile_references(bound(s, d, "catalog"), _profiles(s, d)),
        f"{cte('catalog')} SELECT id, profile, 'dangling' AS kind FROM catalog WHERE profile = 'gone' UNION ALL SELECT DISTINCT NULL, profile, 'used' FROM catalog WHERE profile <> 'gone'",
    ),
    "upd1_upsert_events": (
        _upsert,
        f"""{cte('event_store', 'incoming')}, new AS (SELECT id, 'Renamed ' || id AS title, 'active' AS status, '2026-01-01' AS last_seen FROM incoming)
        SELECT id, title, status, last_seen FROM event_store WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new""",
    ),
    "upd2_upsert_aliases": (
        _upsert_aliases,
        f"""{cte('sightings')}, x AS (SELECT event_id, {canon_sql('url')} AS canonical_url, source_id, seen FROM sightings WHERE {event_url_sql(canon_sql('url'))})
        SELECT event_id, canonical_url, arg_min(source_id, CASE WHEN seen < '2026-05' THEN '0' ELSE '1' END || seen || source_id) AS source_id,
        min(seen) AS first_seen, max(seen) AS last_seen, min(seen) >= '2026-05' AS is_new FROM x GROUP BY 1, 2""",
    ),
    "upd3_merge_fields": (_merge, _MERGE),
    "upd6_replace_staged": (
        lambda s, d: u.replace_rows(bound(s, d, "source_runs").select("run_id", "source_id", "state", "found_count"), bound(s, d, "source_runs").where("found_count > 2").select("run_id", "source_id", F.lit("ok").alias("state"), F.lit(0).cast("long").alias("found_count")), ["run_id", "source_id"]),
        f"{cte('source_runs')} SELECT run_id, source_id, CASE WHEN found_count > 2 THEN 'ok' ELSE state END AS state, CASE WHEN found_count > 2 THEN 0 ELSE found_count END AS found_count FROM source_runs",
    ),
    "upd8_record_discoveries": (
        lambda s, d: u.record_discoveries(bound(s, d, "discoveries").where("run_id < '2024-01-05'").select("discovery_id", "source_id", "run_id"), bound(s, d, "discoveries").where("run_id >= '2024-01-05'").select(F.col("discovery_id").alias("position"), "source_id", "run_id")),
        f"""{cte('discoveries')} SELECT discovery_id, source_id, run_id FROM discoveries WHERE run_id < '2024-01-05' UNION ALL
        SELECT CAST((SELECT coalesce(max(discovery_id), 0) FROM discoveries WHERE run_id < '2024-01-05') + row_number() OVER (ORDER BY source_id, discovery_id) AS BIGINT), source_id, run_id FROM discoveries WHERE run_id >= '2024-01-05'""",
    ),
    "upd9_invalidate_events": (
        _invalidate,
        f"""{cte('event_store', 'discoveries')}, ev AS (SELECT 'e' || substr(id, 2) AS id, url, status FROM event_store), gone AS (SELECT id FROM ev WHERE status = 'cancelled'),
        dd AS (SELECT d.* REPLACE (CASE WHEN g.id IS NOT NULL THEN 'rejected' ELSE outcome END AS outcome, CASE WHEN g.id IS NOT NULL THEN 'repair' ELSE reason END AS reason), g.id IS NOT NULL AS hit FROM discoveries d LEFT JOIN gone g ON g.id = d.event_id)
        SELECT 'events' AS kind, count(*) AS n FROM ev WHERE id NOT IN (FROM gone) UNION ALL SELECT 'aliases', count(*) FROM ev WHERE id NOT IN (FROM gone) AND {event_url_sql(canon_sql('url'))}
        UNION ALL SELECT 'rejected', count(*) FROM dd WHERE reason = 'repair'
        UNION ALL SELECT run_id || ' ' || source_id || ' ' || coalesce(reason, 'rejected'), count(*) FROM dd WHERE outcome = 'rejected' AND (run_id, source_id) IN (SELECT (run_id, source_id) FROM dd WHERE hit) GROUP BY 1""",
    ),
    "upd9_invalidated_runs": (
        lambda s, d: _invalidated(s, d)[4],
        f"""{cte('event_store', 'discoveries')}, gone AS (SELECT 'e' || substr(id, 2) AS id FROM event_store WHERE status = 'cancelled'),
        dd AS (SELECT run_id, source_id, CASE WHEN event_id IN (FROM gone) THEN 'rejected' ELSE outcome END AS outcome, event_id IN (FROM gone) AS hit FROM discoveries)
        SELECT run_id, source_id, 'validation_failed' AS state, count(*) AS found_count, count(*) FILTER (outcome <> 'rejected' OR hit) AS parsed_count, count(*) FILTER (outcome <> 'rejected') AS qualified_count, count(*) FILTER (outcome = 'rejected') AS rejected_count,
        count(*) FILTER (outcome = 'new') AS new_count, count(*) FILTER (outcome = 'updated') AS updated_count, count(*) FILTER (outcome = 'unchanged') AS unchanged_count, count(*) FILTER (outcome = 'duplicate') AS duplicate_count, 'repair' AS error
        FROM dd GROUP BY 1, 2 HAVING bool_or(hit)""",
    ),
    "upd9_foreign_ids": (
        lambda s, d: _invalidated(s, d, "e-1", "other")[5],
        "SELECT unnest(['e-1', 'other']) AS id, 'not an event of the source' AS problem",
    ),
    "upd10_drop_aliases": (
        lambda s, d: u.drop_aliases(_aliases(s, d), "building", "1995-03-01").groupBy("source_id", "first_seen").agg(F.count("*").alias("n")),
        f"{cte('event_store')}, {_BACKFILL} SELECT source_id, first_seen, count(*) AS n FROM aliases WHERE NOT (source_id = 'building' AND first_seen = '1995-03-01') GROUP BY 1, 2",
    ),
    "upd11_backfill_aliases": (
        _aliases,
        f"{cte('event_store')}, {_BACKFILL} SELECT * FROM aliases",
    ),
    "upd12_apply_ranks": (
        _ranks,
        f"""{cte('event_store')}, g AS (SELECT id, rank, source_id, status, right(id, 1) AS k FROM event_store),
        x AS (SELECT id, rank, CASE WHEN status = 'postponed' THEN 'low' WHEN source_id = 'building' THEN CASE WHEN k < '4' THEN 'high' WHEN k < '7' THEN '' ELSE 'best' END END AS r,
        CASE WHEN status = 'postponed' THEN '' WHEN source_id = 'building' THEN 'note ' || k END AS note FROM g)
        SELECT id, CASE WHEN r IN ('low', 'high') THEN r ELSE rank END AS rank, CASE WHEN r <> 'best' THEN nullif(note, '') END AS fit_note, CASE WHEN r <> 'best' THEN '2026-02-02' END AS ranked_on, NULL AS problem FROM x
        UNION ALL SELECT id, NULL, NULL, NULL, 'bad rank' FROM x WHERE r = 'best'""",
    ),
    "upd13_start_runs": (
        lambda s, d: u.start_runs(bound(s, d, "runs").where("run_id < '1996'"), bound(s, d, "runs").join(bound(s, d, "source_runs").withColumnRenamed("state", "s"), "run_id").select("run_id", "seen_date", "started_at", F.when(F.col("s") == "not_due", "pending").otherwise(F.col("s")).alias("state"))),
        f"""{cte('runs', 'source_runs')} SELECT run_id, seen_date, started_at, CASE WHEN run_id < '1996' THEN state WHEN EXISTS (SELECT 1 FROM source_runs s WHERE s.run_id = r.run_id AND s.state = 'not_due') THEN 'running' ELSE 'completed' END AS state FROM runs r""",
    ),
    "upd14_import_legacy": (
        lambda s, d: u.import_legacy(bound(s, d, "event_store").select(F.concat(F.lit("e"), F.substring("id", 2, 9)).alias("id")), bound(s, d, "discoveries")).select("discovery_id", "event_id", "outcome"),
        f"{cte('event_store', 'discoveries')} SELECT discovery_id, event_id, CASE WHEN substr(event_id, 2) IN (SELECT substr(id, 2) FROM event_store) THEN 'new' ELSE 'rejected' END AS outcome FROM discoveries",
    ),
    "set1_manifest_diff": (
        lambda s, d: c.manifest_diff(bound(s, d, "catalog").select(F.col("id").alias("source_id")), bound(s, d, "source_runs").where("run_id = '1995-06'")),
        f"""{cte('catalog', 'source_runs')}, x AS (SELECT DISTINCT source_id FROM source_runs WHERE run_id = '1995-06')
        SELECT id AS source_id, 'missing' AS problem FROM catalog WHERE id NOT IN (FROM x) UNION ALL SELECT source_id, 'extra' FROM x WHERE source_id NOT IN (SELECT id FROM catalog)""",
    ),
    "set3_duplicate_ids": (
        lambda s, d: c.duplicate_ids(bound(s, d, "discoveries"), "event_id"),
        f"{cte('discoveries')} SELECT event_id, count(*) AS n FROM discoveries GROUP BY 1 HAVING count(*) > 1",
    ),
    "set4_ordered_distinct": (
        lambda s, d: c.ordered_distinct(bound(s, d, "discoveries"), "event_id", "discovery_id"),
        f"{cte('discoveries')} SELECT event_id, min(discovery_id) AS first FROM discoveries GROUP BY 1",
    ),
    "val3_check_catalog": (
        lambda s, d: c.check_catalog(bound(s, d, "catalog").unionByName(bound(s, d, "catalog").where("priority = 1")), _profiles(s, d)),
        f"""{cte('catalog')}, x AS (SELECT * FROM catalog UNION ALL SELECT * FROM catalog WHERE priority = 1)
        SELECT id, 'duplicate source id' AS problem FROM x GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, 'disabled without reason' FROM x WHERE NOT enabled AND disabled_reason = ''
        UNION ALL SELECT id, 'invalid adapter' FROM x WHERE adapter = '' UNION ALL SELECT id, 'missing profile gone' FROM x WHERE profile = 'gone'""",
    ),
    "val3_check_whole_catalog": (
        _broken,
        f"""{cte('catalog', 'inbox')}, x AS (SELECT {', '.join(_BROKEN['sources'])} FROM catalog), p AS (SELECT {', '.join(_BROKEN['profiles'])} FROM catalog WHERE profile <> 'gone'), i AS (SELECT {', '.join(_BROKEN['inbox'])} FROM inbox), y AS (SELECT * FROM x WHERE id <> '')
        SELECT '' AS id, 'source without id' AS problem FROM x WHERE id = '' UNION ALL SELECT id, 'duplicate source id' FROM y GROUP BY 1 HAVING count(*) > 1
        UNION ALL SELECT id, 'disabled without reason' FROM y WHERE NOT enabled AND disabled_reason = '' UNION ALL SELECT id, 'invalid adapter' FROM y WHERE bad_adapter OR adapter = ''
        UNION ALL SELECT id, 'missing profile ' || coalesce(profile, '<none>') FROM y WHERE profile IS NULL OR profile = 'gone' UNION ALL SELECT id, 'non-boolean enabled' FROM y WHERE bad_enabled
        UNION ALL SELECT id, 'obsolete cadence' FROM y WHERE has_cadence UNION ALL SELECT name, 'profile without primary' FROM p WHERE NOT has_primary UNION ALL SELECT name, 'profile without required fields' FROM p WHERE NOT has_required_fields
        UNION ALL SELECT name, 'profile without empty rule' FROM p WHERE NOT has_empty_signal UNION ALL SELECT name, 'obsolete audit_cadence' FROM p WHERE has_audit_cadence
        UNION ALL SELECT DISTINCT '', 'inbox with missing profile gone' FROM i UNION ALL SELECT '', 'inbox source without id' FROM i WHERE id = ''
        UNION ALL SELECT id, 'duplicate source id across catalog and inbox' FROM i WHERE id <> '' GROUP BY 1 HAVING count(*) > 1 OR id IN (SELECT id FROM x) UNION ALL SELECT id, 'obsolete cadence' FROM i WHERE id <> '' AND has_cadence""",
    ),
    "val4_check_payload": (
        _payload,
        f"""{cte('catalog', 'source_runs', 'event_store')}, x AS (SELECT source_id, state FROM source_runs WHERE run_id = '1995-06')
        SELECT id AS source_id, 'missing' AS problem FROM catalog WHERE id NOT IN (SELECT source_id FROM x) UNION ALL SELECT source_id, 'extra' FROM x WHERE source_id NOT IN (SELECT id FROM catalog)
        UNION ALL SELECT source_id, 'invalid state' FROM x WHERE state = 'not_due'
        UNION ALL SELECT DISTINCT source_id, 'event of a source not planned' FROM event_store WHERE source_id <> 'building'""",
    ),
    "val5_check_staging": (
        lambda s, d: c.check_staging(bound(s, d, "source_runs"), bound(s, d, "runs"), bound(s, d, "source_runs").where("found_count > 1")),
        f"""{cte('runs', 'source_runs')}, x AS (SELECT sr.run_id, source_id, CASE WHEN r.state <> 'running' THEN 'run isn''t running' WHEN found_count <= 1 THEN 'source isn''t planned' WHEN sr.state = 'not_due' THEN 'state isn''t final' END AS problem
        FROM source_runs sr JOIN runs r ON r.run_id = sr.run_id) SELECT * FROM x WHERE problem IS NOT NULL""",
    ),
    "pln1_plan_run": (
        lambda s, d: _plan(s, d),
        f"""{_HEALTH} SELECT c.id AS source_id, 'pending' AS state, CASE WHEN profile <> 'gone' THEN 'get-' || profile END AS method, CASE WHEN profile <> 'gone' THEN profile || '-v1' END AS recipe_version,
        h.state IS NULL OR h.state IN {_RETRY} AS audit, CASE WHEN h.state IS NULL THEN 'never checked' WHEN h.state IN {_RETRY} THEN 'retry after ' || h.state ELSE 'selected for this run' END AS detail
        FROM catalog c LEFT JOIN health h ON h.source_id = c.id WHERE enabled
        UNION ALL SELECT id, 'blocked', 'not_run', NULL, false, 'mail connector unavailable' FROM inbox""",
    ),
    "pln1_plan_targeted": (
        lambda s, d: _plan(s, d, only="s4").unionByName(_plan(s, d, only="nobody")).unionByName(_plan(s, d, only="s1").select("source_id", "state", "method", "recipe_version", F.lit(False).alias("audit"), "detail")),
        f"""{cte('catalog')} SELECT 's4' AS source_id, 'error' AS state, '' AS method, NULL AS recipe_version, false AS audit, 'disabled source' AS detail UNION ALL SELECT 'nobody', 'error', '', NULL, false, 'unknown source'
        UNION ALL SELECT id, 'pending', 'get-' || profile, profile || '-v1', false, 'targeted source crawl' FROM catalog WHERE id = 's1'""",
    ),
    "pln2_pending_work": (
        lambda s, d: _plan(s, d, mail=True).where("state = 'pending'").select("source_id", "method").orderBy("source_id"),
        f"{cte('catalog', 'inbox')} SELECT id AS source_id, CASE WHEN profile <> 'gone' THEN 'get-' || profile END AS method FROM catalog WHERE enabled UNION ALL SELECT id, 'gmail' FROM inbox",
    ),
    "scl3_canon_url": (
        lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", t.canon_url(F.col("url")).alias("canonical_url")),
        f"SELECT page_id, {canon_sql('url')} AS canonical_url FROM pages",
    ),
    "scl4_is_event_url": (
        lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", t.is_event_url(t.canon_url(F.col("url"))).alias("named")),
        f"SELECT page_id, {event_url_sql(canon_sql('url'))} AS named FROM pages",
    ),
    "scl8_event_key_and_id": (
        lambda s, d: bound(s, d, "event_store").withColumn("key", t.event_key(F.col("url"), F.col("start"), F.col("venue"), F.col("neighborhood"), F.col("title"), t.norm_ascii)).select("id", "key", t.make_id(F.col("key")).alias("made")),
        f"""{cte('event_store')}, x AS (SELECT id, substr(start, 1, 14) || lpad(CAST(CAST(substr(start, 15, 2) AS INT) // 15 * 15 AS STRING), 2, '0') || ':00-04:00' AS stamp, {canon_sql('url')} AS cu,
        trim(regexp_replace(lower(coalesce(nullif(venue, ''), neighborhood)), '[^a-z0-9]+', ' ', 'g')) AS place, left(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 40) AS tt FROM event_store),
        k AS (SELECT id, CASE WHEN {event_url_sql('cu')} THEN 'u:' || cu || '|' || stamp ELSE 'v:' || place || '|' || stamp || '|' || tt END AS "key" FROM x) SELECT id, "key", left(sha1("key"), 12) AS made FROM k""",
    ),
    "scl13_minutes_apart": (
        lambda s, d: bound(s, d, "event_store").select("id", t.minutes_apart(F.col("start"), F.concat(F.lit("1996-01-01T12:00:00"), F.when(F.col("rank").isNull(), "").otherwise("+02:00"))).alias("minutes")),
        f"""{cte('event_store')} SELECT id, CASE WHEN rank IS NULL THEN abs(epoch(CAST(substr(start, 1, 19) AS TIMESTAMP)) - epoch(TIMESTAMP '1996-01-01 12:00:00')) ELSE abs(epoch(CAST(start AS TIMESTAMPTZ)) - epoch(TIMESTAMP '1996-01-01 10:00:00')) END / 60 AS minutes FROM event_store""",
    ),
    "scl7_quarter_hour": (
        lambda s, d: bound(s, d, "event_store").select("id", t.local_day(F.col("start")).alias("day"), t.quarter_hour(t.wall_time(F.col("start"))).alias("quarter")),
        f"{cte('event_store')} SELECT id, substr(start, 1, 10) AS day, substr(start, 1, 14) || lpad(CAST(CAST(substr(start, 15, 2) AS INT) // 15 * 15 AS STRING), 2, '0') || ':00' AS quarter FROM event_store",
    ),
    "scl18_format_price": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", t.format_price(F.when(F.col("p_partkey") % 3 == 0, F.floor("p_retailprice").cast("double")).otherwise(F.col("p_retailprice"))).alias("price")),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '$' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) WHEN p_retailprice = floor(p_retailprice) THEN '$' || CAST(CAST(p_retailprice AS BIGINT) AS STRING) ELSE printf('$%.2f', p_retailprice) END AS price FROM part",
    ),
    "scl1_norm_text_ascii": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(~F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", t.norm_text(F.col("text")).alias("normed")),
        "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS normed FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')",
    ),
    "scl1_norm_text": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", t.norm_text(F.col("text")).alias("normed")),
        None,
    ),
    "upd4_finalize_run": (
        lambda s, d: _finalized(s, d)[2],
        None,
    ),
    "upd4_finalized_store": (
        lambda s, d: _finalized(s, d)[0].select("id", "url", "title", "venue", "status", "is_free", "last_seen"),
        None,
    ),
    "scl10_normalise": (
        lambda s, d: e.normalised(bound(s, d, "event_store").select(F.to_json(F.struct("id", F.concat(F.lit(" "), "url").alias("url"), "title", F.col("start").alias("start_datetime"), F.col("venue").alias("venue_name"), F.col("rank"), F.col("is_free"), F.lit("21").alias("explicit_age_min"), F.lit(True).alias("explicit_age_max"))).alias("raw")), "raw", "2026-08-01").select("id", "url", "title", "start", "venue", "rank", "is_free", "age_min", "age_max", "status", "first_seen"),
        f"""{cte('event_store')} SELECT id, url, title, start, venue, rank, is_free, CAST(21 AS INT) AS age_min, CAST(NULL AS INT) AS age_max, 'active' AS status, '2026-08-01' AS first_seen FROM event_store""",
    ),
    "scl2_series_key": (
        lambda s, d: bound(s, d, "event_store").select("id", t.series_key(F.col("source_id"), F.col("host"), F.col("title")).alias("series")),
        f"""{cte('event_store')} SELECT id, source_id || '|' || trim(regexp_replace(lower(host), '[^a-z0-9]+', ' ', 'g')) || '|' ||
        trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '\\b\\d+(st|nd|rd|th)?\\b', ' ', 'g'), '\\bpart\\s+([ivxlcdm]+|\\d+)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS series FROM event_store""",
    ),
    "scl14_to_local_iso": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", e.to_local_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "America/New_York").alias("local")),
        "SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', date_trunc('second', CAST(ts AS TIMESTAMP)))), '%Y-%m-%dT%H:%M:%S') || CASE (epoch(timezone('America/New_York', timezone('UTC', date_trunc('second', CAST(ts AS TIMESTAMP))))) - epoch(date_trunc('second', CAST(ts AS TIMESTAMP)))) WHEN -14400 THEN '-04:00' ELSE '-05:00' END AS local FROM events",
    ),
    "scl20_offer_price_range": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", e.offer_price_range(F.array(F.col("p_size").cast("string"), F.lit("x"), (F.col("p_size") + 5).cast("string")), F.lit("USD")).alias("price")),
        "SELECT p_partkey, '$' || CAST(p_size AS STRING) || '–$' || CAST(p_size + 5 AS STRING) AS price FROM part",
    ),
    "scl24_format_address": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", e.format_address(F.col("p_brand"), F.lit(""), F.lit("NY"), F.col("p_size").cast("string"), F.lit(None).cast("string")).alias("address")),
        "SELECT p_partkey, p_brand || ', NY ' || CAST(p_size AS STRING) AS address FROM part",
    ),
    "scl25_age_range": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", t.age_range(F.concat(F.lit("Ages "), F.col("p_size"), F.lit("-"), F.col("p_size") + 9)).alias("a")).select("p_partkey", "a.low", "a.high"),
        "SELECT p_partkey, CASE WHEN p_size >= 18 THEN CAST(p_size AS INT) END AS low, CASE WHEN p_size >= 18 THEN CAST(p_size + 9 AS INT) END AS high FROM part",
    ),
    "scl29_theme": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", e.theme(F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 3 == 0, "wine").when(F.col("p_size") % 3 == 1, "jazz band")), e.THEME_RULES, "other").alias("theme")),
        "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '🍷' WHEN 1 THEN '🎵' ELSE 'other' END AS theme FROM part",
    ),
    "scl29_event_theme": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", e.event_theme(F.col("p_name"), F.element_at(F.array(*map(F.lit, _THEME_TEXTS)), (F.col("p_partkey") % len(_THEME_TEXTS) + 1).cast("int"))).alias("theme")),
        "SELECT p_partkey, ['" + "','".join(_THEME_SYMBOLS) + f"'][p_partkey % {len(_THEME_TEXTS)} + 1] AS theme FROM part",
    ),
    "scl30_source_event_id": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", e.source_event_id(F.col("p_name"), F.col("p_brand")).alias("made")),
        "SELECT p_partkey, left(sha256(p_name || '|' || p_brand), 20) AS made FROM part",
    ),
    "scl33_source_row": (
        lambda s, d: e.source_row(bound(s, d, "source_runs").select("run_id", "source_id", F.to_json(F.struct(F.regexp_replace("state", "empty_verified", "empty").alias("state"), F.col("found_count").alias("found"), F.col("parsed_count").cast("string").alias("parsed_count"), F.lit(True).alias("new"), F.col("rejected_count").alias("events_kept"), F.col("new_count").alias("updated"), F.lit("7").alias("unchanged_count"), F.lit(2.5).alias("duplicates"))).alias("body"))),
        f"""{cte('source_runs')} SELECT run_id, source_id, state, found_count, parsed_count, rejected_count AS qualified_count, CAST(0 AS BIGINT) AS rejected_count, CAST(1 AS BIGINT) AS new_count, new_count AS updated_count,
        CAST(7 AS BIGINT) AS unchanged_count, CAST(0 AS BIGINT) AS duplicate_count, '' AS detail FROM source_runs""",
    ),
    "src4_decode_responses": (
        lambda s, d: tables.decode_responses(s.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("html").cast("binary").alias("body"), F.lit("text/html").alias("content_type"))).select("page_id", F.length("text").alias("n"), "content_hash"),
        "SELECT page_id, CAST(length(html) AS INT) AS n, sha256(html) AS content_hash FROM pages",
    ),
    "src5_evidence": (
        lambda s, d: tables.artifact_at(bound(s, d, "source_runs").withColumn("artifacts", F.transform(F.sequence(F.lit(1), F.least(F.col("found_count"), F.lit(3)).cast("int")), lambda k: F.struct(k.alias("n"), F.concat_ws("/", F.lit("run"), "run_id", k).alias("path")))), 1).select("run_id", "source_id", "path"),
        f"{cte('source_runs')} SELECT run_id, source_id, 'run/' || run_id || '/2' AS path FROM source_runs WHERE found_count >= 2",
    ),
    "val1_check_raw_events": (
        lambda s, d: contract.check_raw_events(bound(s, d, "event_store").select("id", F.to_json(F.struct("title", "start", "status", "is_free", F.col("price").alias("cost"))).alias("raw"))).select("id", F.array_join("problems", ";").alias("problems")),
        f"{cte('event_store')} SELECT id, 'end: missing;url: missing;signup_url: missing;host: missing;venue: missing' AS problems FROM event_store",
    ),
    "ext36_redact_contacts": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", t.redact_contacts(F.col("text")).alias("redacted")),
        None,
    ),
}

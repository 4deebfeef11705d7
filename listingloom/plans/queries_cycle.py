"""Registered queries of a run's cycle (staging, finalizing, payloads, store versions) and of small functions on parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listingloom.functions import events as e
from listingloom.functions import text as t
from listingloom.operators import contract, cycle
from listingloom.operators import updates as u
from listingloom.operators.checks import FINAL_STATES
from listingloom.plans.bindings import bound, cte
from listingloom.session import shared_dir
from listingloom.sources import store, tables

# A run that finds every order, some twice, some without a start, some rejected; the store knows every third order.
_FOUND = """
SELECT o_orderkey AS discovery_id, 's' || substr(o_orderpriority, 1, 1) AS source_id, o_orderkey AS k,
       CASE WHEN o_orderkey % 10 = 7 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':30:00-04:00' END AS start,
       CASE WHEN o_orderkey % 13 = 0 THEN 'rejected' ELSE 'staged' END AS outcome,
       CASE WHEN o_orderkey % 26 = 0 THEN 'cancelled' WHEN o_orderkey % 13 = 0 THEN '' END AS reason FROM {orders}
UNION ALL
SELECT o_orderkey + 1000000000, 'again', o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':30:00-04:00',
       'staged', CAST(NULL AS STRING) FROM {orders} WHERE o_orderkey % 5 = 0
"""
_STORED = """
SELECT 'o' || CAST(o_orderkey AS STRING) AS id, md5(CAST(o_orderkey AS STRING)) AS title, CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':30:00-04:00' AS start,
       '$5' AS price, 'active' AS status, 's' || substr(o_orderpriority, 1, 1) AS source_id, '2026-07-01' AS first_seen, '2026-07-01' AS last_seen, 'high' AS rank FROM {orders} WHERE o_orderkey % 3 = 0
"""
_LEDGER = "discovery_id long, run_id string, source_id string, event_id string, outcome string, reason string, raw string"
_SOURCE_RUNS = "run_id string, source_id string, state string, " + ", ".join(f"{c}_count long" for c in cycle.COUNTERS) + ", rejection_counts map<string,long>"
_ALIASES = "event_id string, canonical_url string, url string, source_id string, first_seen string, last_seen string"
_COUNTS = [f"{c}_count" for c in cycle.COUNTERS]


def _orders(s, d, sql):
    return s.sql(sql, orders=s.read.parquet(f"{d}/orders.parquet"))


def _raw(*more):
    id_, price = F.concat(F.lit("o"), F.col("k")), F.when(F.col("k") % 2 == 0, "$5").otherwise("$6")
    return F.to_json(F.struct(id_.alias("id"), F.md5(F.col("k").cast("string")).alias("title"), F.col("start").alias("start_datetime"), price.alias("price"), *more)).alias("raw")


def _sources(found):
    """The sources of a run: those that found something, one that found nothing, one that couldn't be read."""
    state = F.when(F.col("source_id") == "again", "ok_via_fallback").otherwise("ok")
    rows = found.select("source_id").distinct().withColumn("state", state)
    return rows.unionByName(rows.limit(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("source_id"), F.lit(x).alias("state")) for i, x in (("quiet", "ok"), ("shut", "blocked"))))).alias("s")).select("s.*"))


def _run(s, state="running"):
    return s.range(1).select(F.lit("r1").alias("run_id"), F.lit("2026-08-01").alias("seen_date"), F.lit("2026-08-01T05:00:00+00:00").alias("started_at"), F.lit(state).alias("state"))


def _closed(s, d):
    found = _orders(s, d, _FOUND)
    ledger = cycle._shaped(found.select("*", F.lit("r1").alias("run_id"), _raw()), s.createDataFrame([], _LEDGER))
    source_runs = cycle._shaped(_sources(found).withColumn("run_id", F.lit("r1")), s.createDataFrame([], _SOURCE_RUNS))
    return cycle.finalize_run("r1", _run(s), source_runs, ledger, _orders(s, d, _STORED), s.createDataFrame([], _ALIASES))


def _payload(s, d):
    """The same finds as a payload: two sources are told, the others and the candidates without a source are derived."""
    found = _orders(s, d, _FOUND).withColumn("position", F.col("discovery_id"))
    named = F.when(F.col("k") % 17 != 0, F.col("source_id")).alias("source_id")
    events = found.where("outcome = 'staged'").select("position", _raw(named))
    rejections = found.where("outcome = 'rejected'").select("position", "reason", named, _raw())
    told = _sources(found).where("source_id in ('s1', 'quiet')")
    return cycle.merge_payload("r2", "2026-08-01", told, events, rejections, _run(s, "completed"), s.createDataFrame([], _SOURCE_RUNS), s.createDataFrame([], _LEDGER), _orders(s, d, _STORED), s.createDataFrame([], _ALIASES))


def _payload_runs(closed):
    return closed.runs.select("run_id", "seen_date", "state").join(closed.totals.select("store").hint("broadcast"), F.lit(True))


def _source_rows(closed):
    reasons = F.array_join(F.transform(F.array_sort(F.map_entries("rejection_counts")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return closed.source_runs.select("run_id", "source_id", "state", *_COUNTS, reasons.alias("reasons"))


def _told_sql(source="source_id"):
    """DuckDB: what becomes of each find, as `told`."""
    found, stored = _FOUND.format(orders="orders"), _STORED.format(orders="orders")
    return f"""WITH f AS ({found}), st AS ({stored}), g AS (SELECT discovery_id, {source} AS source_id, k, outcome = 'rejected' OR start = '' AS bad,
      CASE WHEN outcome = 'rejected' THEN coalesce(nullif(reason, ''), 'rejected') WHEN start = '' THEN 'missing_start' END AS reason FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY k, bad ORDER BY discovery_id) AS place FROM g),
    told AS (SELECT discovery_id, source_id, k, reason, CASE WHEN bad THEN NULL ELSE 'o' || k END AS event_id,
      CASE WHEN bad THEN 'rejected' WHEN place > 1 THEN 'duplicate' WHEN k % 3 <> 0 THEN 'new' WHEN k % 2 = 0 THEN 'unchanged' ELSE 'updated' END AS outcome FROM n)"""


def _rows_sql(run, planned, source="source_id"):
    counts = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}_count" for o in ("rejected", "new", "updated", "unchanged", "duplicate"))
    return f"""{_told_sql(source)}, p AS ({planned}), r AS (SELECT source_id, string_agg(reason || '=' || c, ',' ORDER BY reason) AS reasons, max(c) FILTER (reason = 'missing_start') AS missing FROM
      (SELECT source_id, reason, count(*) AS c FROM told WHERE outcome = 'rejected' GROUP BY 1, 2) GROUP BY 1)
    SELECT '{run}' AS run_id, p.source_id, CASE WHEN state = 'ok' AND max(missing) > 0 THEN 'validation_failed' WHEN state = 'ok' AND count(outcome) = 0 THEN 'empty_suspicious' ELSE state END AS state,
    count(outcome) AS found_count, count(*) FILTER (outcome <> 'rejected') AS parsed_count, count(*) FILTER (outcome <> 'rejected') AS qualified_count, {counts}, coalesce(max(reasons), '') AS reasons
    FROM p LEFT JOIN told ON p.source_id = told.source_id LEFT JOIN r ON r.source_id = p.source_id GROUP BY p.source_id, state"""


_PLANNED = "SELECT DISTINCT source_id, CASE WHEN source_id = 'again' THEN 'ok_via_fallback' ELSE 'ok' END AS state FROM f UNION ALL VALUES ('quiet', 'ok'), ('shut', 'blocked')"
_DERIVED = "SELECT DISTINCT source_id, 'ok' AS state FROM told UNION SELECT 's1', 'ok' FROM f UNION SELECT 'quiet', 'ok' FROM f"
_OF = "CASE WHEN k % 17 = 0 THEN 'unknown' ELSE source_id END"


def _staging(s, d):
    """Each source's finds of a day reported anew: a third with a state that isn't final, some with a foreign event; odd days are closed."""
    before = bound(s, d, "discoveries")
    ledger = cycle._shaped(before.withColumn("raw", F.lit("{}")), s.createDataFrame([], _LEDGER + ", raw_start string"))
    sizes = before.groupBy("run_id", "source_id").agg(F.count("*").alias("n"))
    results = sizes.select("run_id", "source_id", F.when(F.col("n") % 3 == 0, "pending").otherwise("ok").alias("state"))
    runs = before.select("run_id").distinct().withColumn("state", F.when(F.substring("run_id", 9, 2).cast("int") % 2 == 0, "running").otherwise("completed"))
    planned = cycle._shaped(sizes.select("run_id", "source_id", F.lit("pending").alias("state"), F.lit(99).alias("found_count")), s.createDataFrame([], _SOURCE_RUNS))
    again = before.where("discovery_id % 2 = 0").join(sizes.where("n % 4 = 1").select("run_id", "source_id", F.lit("elsewhere").alias("other")), ["run_id", "source_id"], "left")
    start = F.when(~F.col("event_id").endswith("3"), F.col("raw_start"))
    events = again.where("outcome <> 'rejected'").select("run_id", "source_id", F.col("discovery_id").alias("position"), F.to_json(F.struct(start.alias("start"), F.col("other").alias("source_id"))).alias("raw"))
    rejections = before.where("discovery_id % 2 = 0 and outcome = 'rejected'").select("run_id", "source_id", F.col("discovery_id").alias("position"), F.lit("{}").alias("raw"), "reason")
    return cycle.stage_results(results, events, rejections, runs, planned, ledger)


_STAGING = f"""{cte('discoveries')}, z AS (SELECT run_id, source_id, count(*) AS n, CAST(substr(run_id, 9, 2) AS INT) % 2 = 0 AS on_, bool_or(discovery_id % 2 = 0 AND outcome <> 'rejected') AND count(*) % 4 = 1 AS foreign_ FROM discoveries GROUP BY 1, 2),
  problems AS (SELECT run_id, source_id, CASE WHEN NOT on_ THEN 'run isn''t running' ELSE 'state isn''t final' END AS problem FROM z WHERE NOT on_ OR n % 3 = 0 UNION ALL SELECT run_id, source_id, 'event of another source' FROM z WHERE foreign_),
  good AS (SELECT run_id, source_id FROM z WHERE on_ AND n % 3 <> 0 AND NOT foreign_),
  x AS (SELECT d.*, outcome = 'rejected' AS r, outcome <> 'rejected' AND event_id NOT LIKE '%3' AS ok FROM discoveries d JOIN good USING (run_id, source_id) WHERE discovery_id % 2 = 0)"""


def _swapped(s, d):
    """A store whose second version has the first one's events with some replaced."""
    root = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    rows = bound(s, d, "event_store").select("id", "title", "status")
    first = store.write_store({"events": rows}, root)
    based, held = store.read_store(s, root)
    new = held["events"].where("status = 'cancelled'").withColumn("status", F.lit("active")).withColumn("n", F.lit(1))
    store.write_store({"events": u.upsert_events(held["events"], new)}, root, based_on=first)
    return store.read_store(s, root)[1]["events"]


def _updated(s, d):
    """A store in buckets whose second version has the cancelled events changed and the postponed ones left out."""
    root = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    rows = bound(s, d, "event_store").select("id", "title", "status")
    first = store.write_store({"events": rows}, root, keys={"events": ["id"]})
    held = store.read_store(s, root)[1]["events"]
    store.update_store({"events": held.where("status = 'cancelled'").withColumn("status", F.lit("active"))}, root, first, gone={"events": held.where("status = 'postponed'")})
    return store.read_store(s, root)[1]["events"]


def _exported(s, d):
    path = f"{shared_dir(s)}/export-{uuid.uuid4().hex}"
    rows = bound(s, d, "event_store").select("id", "title", "rank", "is_free", "price")
    tables.export_json(rows, path)
    return s.read.schema(rows.schema).json(path)


def _parts(s, d, *columns):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", *columns)


def _pick(*values, kind="string"):
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), (F.col("p_partkey") % len(values) + 1).cast("int"))


_OFFERS = ([], ["https://schema.org/SoldOut", "SoldOut"], ["SoldOut", "InStock"], ["http://schema.org/LimitedAvailability"], ["InStock"])


QUERIES = {
    "upd4_closed_source_runs": (lambda s, d: _source_rows(_closed(s, d)), _rows_sql("r1", _PLANNED)),
    "upd4_closed_discoveries": (
        lambda s, d: _closed(s, d).discoveries.select("discovery_id", "source_id", "event_id", "outcome", F.coalesce(F.nullif("reason", F.lit("")), F.when(F.col("outcome") == "rejected", "rejected")).alias("reason")),
        f"{_told_sql()} SELECT discovery_id, source_id, event_id, outcome, reason FROM told",
    ),
    "upd4_closed_store": (
        lambda s, d: _closed(s, d).events.select("id", "title", "start", "price", "source_id", "rank", "first_seen", "last_seen"),
        f"""{_told_sql()}, t1 AS (SELECT event_id, arg_min(source_id, discovery_id) AS source_id FROM told WHERE event_id IS NOT NULL GROUP BY 1)
        SELECT st.id, title, start, CASE WHEN event_id IS NOT NULL AND CAST(substr(st.id, 2) AS BIGINT) % 2 = 1 THEN '$6' ELSE price END AS price, st.source_id, rank, first_seen, CASE WHEN event_id IS NOT NULL THEN '2026-08-01' ELSE last_seen END AS last_seen
        FROM st LEFT JOIN t1 ON event_id = st.id UNION ALL
        SELECT DISTINCT event_id, md5(CAST(f.k AS STRING)), max(f.start) OVER (PARTITION BY f.k), CASE WHEN f.k % 2 = 0 THEN '$5' ELSE '$6' END, t1.source_id, NULL, '2026-08-01', '2026-08-01' FROM f JOIN t1 ON event_id = 'o' || f.k WHERE f.k % 3 <> 0""",
    ),
    "upd4_run_totals": (
        lambda s, d: _closed(s, d).totals,
        f"""{_told_sql()} SELECT {', '.join(f"count(*) FILTER (outcome = '{o}') AS {chr(34)}{o}{chr(34)}" for o in ('new', 'updated', 'unchanged', 'duplicate', 'rejected'))}, count(*) FILTER (outcome IN ('updated', 'unchanged')) AS existing,
        count(*) FILTER (outcome = 'new') + (SELECT count(*) FROM st) AS store FROM told""",
    ),
    "upd4_run_problems": (
        lambda s, d: cycle.run_problems(bound(s, d, "runs"), bound(s, d, "source_runs").withColumn("state", F.regexp_replace("state", "not_due", "pending")), bound(s, d, "discoveries")),
        f"""{cte('runs', 'source_runs', 'discoveries')} SELECT run_id, '' AS source_id, 'run isn''t running' AS problem FROM runs WHERE state <> 'running' UNION ALL SELECT run_id, source_id, 'still pending' FROM source_runs WHERE state = 'not_due'
        UNION ALL SELECT DISTINCT run_id, source_id, 'unexpected outcome ' || outcome FROM discoveries WHERE outcome <> 'rejected'""",
    ),
    "upd5_payload_source_runs": (lambda s, d: _source_rows(_payload(s, d)), _rows_sql("r2", _DERIVED, _OF)),
    "upd5_payload_runs": (
        lambda s, d: _payload_runs(_payload(s, d)),
        f"{_told_sql()}, t1 AS (SELECT count(*) FILTER (outcome = 'new') + (SELECT count(*) FROM st) AS store FROM told) SELECT run_id, '2026-08-01' AS seen_date, 'completed' AS state, store FROM t1, (SELECT unnest(['r1', 'r2']) AS run_id)",
    ),
    "upd6_staged_source_runs": (
        lambda s, d: _staging(s, d)[1].select("run_id", "source_id", "state", "found_count", "parsed_count", "qualified_count", "rejected_count", "new_count"),
        f"""{_STAGING} SELECT z.run_id, z.source_id, CASE WHEN g.run_id IS NULL THEN 'pending' ELSE 'ok' END AS state, CASE WHEN g.run_id IS NULL THEN 99 ELSE count(x.run_id) END AS found_count,
        {', '.join(f"CASE WHEN g.run_id IS NOT NULL THEN {c} END AS {n}_count" for n, c in (('parsed', 'count(*) FILTER (x.ok)'), ('qualified', 'count(*) FILTER (x.ok)'), ('rejected', 'count(*) FILTER (NOT x.ok)'), ('new', '0')))}
        FROM z LEFT JOIN good g USING (run_id, source_id) LEFT JOIN x ON x.run_id = z.run_id AND x.source_id = z.source_id GROUP BY z.run_id, z.source_id, g.run_id""",
    ),
    "upd6_staged_discoveries": (
        lambda s, d: _staging(s, d)[0].select("discovery_id", "run_id", "source_id", "outcome", "reason", "raw_start"),
        f"""{_STAGING}, kept AS (SELECT d.* FROM discoveries d ANTI JOIN good g ON d.run_id = g.run_id AND d.source_id = g.source_id)
        SELECT discovery_id, run_id, source_id, outcome, reason, raw_start FROM kept UNION ALL
        SELECT CAST((SELECT coalesce(max(discovery_id), 0) FROM kept) + row_number() OVER (ORDER BY run_id, source_id, r, discovery_id) AS BIGINT), run_id, source_id, CASE WHEN r THEN 'rejected' ELSE 'staged' END,
        CASE WHEN r THEN coalesce(reason, 'rejected') END, CASE WHEN ok THEN raw_start ELSE '' END FROM x""",
    ),
    "upd6_staging_problems": (lambda s, d: _staging(s, d)[2], f"{_STAGING} SELECT * FROM problems"),
    "snk2_write_store": (
        _swapped,
        f"{cte('event_store')} SELECT id, title, CASE WHEN status = 'cancelled' THEN 'active' ELSE status END AS status FROM event_store",
    ),
    "snk2_update_store": (
        _updated,
        f"{cte('event_store')} SELECT id, title, CASE WHEN status = 'cancelled' THEN 'active' ELSE status END AS status FROM event_store WHERE status <> 'postponed'",
    ),
    "snk3_export_json": (_exported, f"{cte('event_store')} SELECT id, title, rank, is_free, price FROM event_store"),
    "scl17_datetime_from_slug": (
        lambda s, d: _parts(s, d, e.datetime_from_slug(F.concat(F.lit("https://v.org/show-"), F.col("p_partkey") % 12 + 1, F.lit("-"), F.col("p_partkey") % 30 + 1, F.lit("-26-"), F.col("p_partkey") % 11 + 1, F.lit("05-"), _pick("a", "p"), F.lit("m"), _pick("", "/", "?x"))).alias("at")),
        """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CAST(try_cast('2026-' || lpad(CAST(p_partkey % 12 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(p_partkey % 30 + 1 AS STRING), 2, '0') AS DATE) AS STRING)
        || 'T' || lpad(CAST(p_partkey % 11 + 1 + 12 * (p_partkey % 2) AS STRING), 2, '0') || ':05:00' END AS "at" FROM part""",
    ),
    "scl21_is_free": (
        lambda s, d: _parts(s, d, t.free_state(_pick("Free", "this is not free", "$5", "free entry", " $0 ", "donation", None)).alias("free")),
        "SELECT p_partkey, [true, false, false, true, true, NULL, NULL][p_partkey % 7 + 1] AS free FROM part",
    ),
    "scl22_capacity_flag": (
        lambda s, d: _parts(s, d, e.capacity_flag(F.element_at(F.array(*(F.array(*map(F.lit, o)).cast("array<string>") for o in _OFFERS)), (F.col("p_partkey") % len(_OFFERS) + 1).cast("int"))).alias("flag")),
        "SELECT p_partkey, [NULL, 'sold_out', 'limited', 'limited', NULL][p_partkey % 5 + 1] AS flag FROM part",
    ),
    "scl26_clean_html": (
        lambda s, d: _parts(s, d, t.clean_html(F.concat(F.lit("<p class='a'>"), "p_name", F.lit("</p>\n <b>&amp;&nbsp;"), "p_brand", F.lit("</b> &lt;"))).alias("bare")),
        "SELECT p_partkey, p_name || ' &' || chr(160) || p_brand || ' <' AS bare FROM part",
    ),
    "scl27_preview_title": (
        lambda s, d: _parts(s, d, e.preview_title(F.concat(_pick("\n  ", "", "Viewcy | "), "p_name", _pick(" · Luma\nrest", " | Blues", "\nrest"))).alias("title")),
        "SELECT p_partkey, p_name || ['', ' | Blues', ''][p_partkey % 3 + 1] AS title FROM part",
    ),
    "scl28_section_between": (
        lambda s, d: _parts(s, d, e.section_between(F.concat_ws("\n", F.lit("Intro"), _pick("Details", " Details ", "Detail"), "p_name", F.lit(" "), "p_brand", _pick("Map", "Contact"), F.lit("x")), "Details", ("Map", "Contact")).alias("section")),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE p_name || chr(10) || p_brand END AS section FROM part",
    ),
    "scl31_same_page": (
        lambda s, d: _parts(s, d, e.same_page(F.concat(F.lit("https://www.V.org/a"), F.col("p_partkey") % 3), F.concat(F.lit("http://v.org/a"), F.col("p_partkey") % 2, F.lit("/?x=1"))).alias("same"), e.valid_http(F.concat(_pick("https://", "ftp://", "", "http:///"), F.lit("v.org"))).alias("valid")),
        "SELECT p_partkey, p_partkey % 3 = p_partkey % 2 AS same, p_partkey % 4 = 0 AS valid FROM part",
    ),
    "scl32_geo_member": (
        lambda s, d: _parts(s, d, e.in_place(_pick("Brooklyn", "Queens", "Hoboken", None), _pick("NY", "NY", "NJ"), F.lit("US"), ("Brooklyn", "Queens"), "NY", "US").alias("inside")),
        "SELECT p_partkey, p_partkey % 4 < 2 AND p_partkey % 3 < 2 AS inside FROM part",
    ),
    "val2_check_source_results": (
        lambda s, d: contract.check_source_results(_parts(s, d, _pick("ok", "pending", None).alias("state"), _pick(contract.METHOD, "browser").alias("method"), _pick("2026-08-01T05:00:00Z", "2026-08-01T05:00:00").alias("fetched_at"), F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("cancelled"), F.lit(" "))).alias("reasons")), FINAL_STATES).select("p_partkey", F.array_join("problems", ";").alias("problems")),
        """SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 3 > 0 THEN 'state: unknown' END, CASE WHEN p_partkey % 2 = 1 THEN 'method: unknown' END, CASE WHEN p_partkey % 2 = 1 THEN 'fetched_at: not a time with offset' END,
        CASE WHEN p_partkey % 5 = 0 THEN 'rejection: no reason' END) AS problems FROM part""",
    ),
}

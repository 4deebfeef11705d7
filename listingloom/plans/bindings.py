"""The store's tables made from the driver's tables, as SQL that Spark and DuckDB both read.

bound(spark, folder, name) gives a binding as a DataFrame; cte(names) the same text for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations")

DISCOVERIES = """
SELECT event_id AS discovery_id, CAST(CAST(ts AS DATE) AS STRING) AS run_id, event_type AS source_id,
       'e' || CAST(user_id AS STRING) AS event_id,
       CASE WHEN event_id % 7 = 0 OR value < 5 THEN 'rejected'
            WHEN user_id % 5 = 0 THEN 'new' WHEN event_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome,
       CASE WHEN event_id % 7 = 0 OR value < 5 THEN
            CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4
                 WHEN 0 THEN NULL WHEN 1 THEN 'missing_start' WHEN 2 THEN 'outside_date_window' ELSE 'cancelled' END
       END AS reason,
       CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Raw ' || event_type END AS raw_title,
       CAST(CAST(ts AS DATE) AS STRING) || 'T19:30:00-04:00' AS raw_start
FROM {events}
"""

SOURCE_RUNS = """
SELECT substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS run_id, 's' || CAST(l_suppkey AS STRING) AS source_id,
       CASE CAST(sum(l_linenumber) % 10 AS INT)
            WHEN 0 THEN 'ok' WHEN 1 THEN 'ok_via_fallback' WHEN 2 THEN 'empty_verified' WHEN 3 THEN 'empty_suspicious'
            WHEN 4 THEN 'parse_failed' WHEN 5 THEN 'fetch_failed' WHEN 6 THEN 'blocked' WHEN 7 THEN 'validation_failed'
            WHEN 8 THEN 'not_due' ELSE 'ok' END AS state,
       CAST(count(*) AS BIGINT) AS found_count,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS parsed_count,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS rejected_count,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS new_count,
       max(l_linenumber) % 2 = 0 AS audit,
       max(CAST(CAST(l_shipdate AS DATE) AS STRING)) || 'T06:00:00+00:00' AS finished_at
FROM {lineitem} GROUP BY 1, 2
"""

RUNS = """
SELECT m.run_id, m.run_id || '-01' AS seen_date, m.run_id || '-01T05:00:00+00:00' AS started_at,
       CASE WHEN m.run_id = x.latest THEN 'running' ELSE 'completed' END AS state
FROM (SELECT DISTINCT substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS run_id FROM {lineitem}) m
CROSS JOIN (SELECT substr(CAST(CAST(max(l_shipdate) AS DATE) AS STRING), 1, 7) AS latest FROM {lineitem}) x
"""

EVENT_STORE = """
SELECT 'o' || CAST(o_orderkey AS STRING) AS id,
       'https://www.place' || CAST(o_custkey % 40 AS STRING) || '.example.com/'
         || CASE WHEN o_orderkey % 5 = 0 THEN 'calendar/' ELSE 'Show-' || CAST(o_orderkey AS STRING) || '/' END
         || '?utm_source=feed' || CASE WHEN o_orderkey % 6 = 0 THEN '&EID=' || CAST(o_orderkey AS STRING) ELSE '' END AS url,
       CASE WHEN o_orderkey % 4 = 0 THEN 'http://tickets.example.org/event?id=' || CAST(o_orderkey % 500 AS STRING) ELSE '' END AS signup_url,
       substr(o_orderpriority, 3, 12) || ' Night: ' || lower(c_mktsegment) || ' part ' || CAST(o_orderkey % 5 AS STRING) AS title,
       c_name AS host,
       CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':'
         || lpad(CAST((o_orderkey * 7) % 60 AS STRING), 2, '0') || ':00-04:00' AS start,
       CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE n_name || ' Hall' END AS venue,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE n_name END AS neighborhood,
       CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'No. ' || CAST(o_custkey AS STRING) || ' ' || n_name || ' Street' END AS address,
       lower(c_mktsegment) AS source_id,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' END AS rank,
       CASE WHEN o_orderkey % 11 = 0 THEN 'cancelled' WHEN o_orderstatus = 'P' THEN 'postponed' ELSE 'active' END AS status,
       CAST(o_totalprice AS DOUBLE) AS price, o_orderkey % 8 = 0 AS is_free,
       CASE WHEN o_orderkey % 2 = 0 THEN 'An evening of ' || lower(c_mktsegment) ELSE '' END AS description,
       CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 20 DAY AS DATE) AS STRING) AS first_seen,
       CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 DAY AS DATE) AS STRING) AS last_seen
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

CATALOG = """
SELECT 's' || CAST(s_suppkey AS STRING) AS id, s_name AS title, 'https://' || lower(n_name) || '.example.com' AS url,
       CAST(s_suppkey % 3 + 1 AS INT) AS priority, n_name AS geo,
       s_suppkey % 4 <> 0 AS enabled, CASE WHEN s_suppkey % 8 = 0 THEN 'paused' ELSE '' END AS disabled_reason,
       CASE WHEN s_suppkey % 13 = 0 THEN 'gone' WHEN s_suppkey % 2 = 0 THEN 'page' ELSE 'feed' END AS profile,
       CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'adapter' || CAST(s_suppkey % 3 AS STRING) END AS adapter
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_acctbal > 0
"""

INBOX = """
SELECT 'inbox' || CAST(n_nationkey AS STRING) AS id, n_name || ' letter' AS title,
       CASE WHEN n_nationkey % 2 = 0 THEN 'https://letters.example.com/' || lower(n_name) END AS url,
       CASE WHEN n_nationkey % 3 = 0 THEN CAST(2 AS INT) END AS priority,
       CASE WHEN n_nationkey % 4 = 0 THEN 'note' END AS parse_hint
FROM {nation}
"""

#: Sightings of pages: each page's url, seen by a source on a day.
SIGHTINGS = """
SELECT 'p' || CAST(page_id % 300 AS STRING) AS event_id, url, 's' || CAST(page_id % 7 AS STRING) AS source_id,
       '2026-0' || CAST(page_id % 9 + 1 AS STRING) || '-1' || CAST(page_id % 10 AS STRING) AS seen
FROM {pages}
"""

#: Rows of a second crawl that resolve against the event store: some by url, some by id, some new.
INCOMING = """
SELECT o_orderkey AS n, CASE WHEN o_orderkey % 10 = 0 THEN 'o' || CAST(o_orderkey AS STRING) ELSE 'n' || CAST(o_orderkey AS STRING) END AS id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'https://other.example.net/Listing-' || CAST(o_orderkey AS STRING)
            ELSE 'http://place' || CAST(o_custkey % 40 AS STRING) || '.example.com/Show-' || CAST(o_orderkey AS STRING) || '#x' END AS url,
       CASE WHEN o_orderkey % 4 = 0 THEN 'http://tickets.example.org/event?id=' || CAST(o_orderkey % 500 AS STRING) ELSE '' END AS signup_url,
       CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T' || lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':'
         || lpad(CAST((o_orderkey * 7) % 60 AS STRING), 2, '0') || ':00-04:00' AS start
FROM {orders}
"""

#: Shows in groups g of four variants v whose likeness is known (see queries_resolve).
SHOWS = """
SELECT n, g, v, 'Show ' || md5(CAST(g AS STRING)) || CASE v WHEN 1 THEN ' ab' WHEN 2 THEN ' again tonight' ELSE '' END AS title,
       CAST(CAST(DATE '2026-01-01' + CAST(g % 300 AS INT) AS DATE) AS STRING) || 'T' || CAST(10 + g % 10 AS STRING) || ':'
         || lpad(CAST(v * 10 + CASE WHEN v = 3 AND g % 3 = 0 THEN 1 ELSE 0 END AS STRING), 2, '0') || ':00' || CASE WHEN g % 2 = 0 THEN '-04:00' ELSE '' END AS start,
       'Host ' || CAST(g % 7 AS STRING) AS host, '' AS neighborhood,
       CASE WHEN v = 3 AND g % 2 = 1 THEN 'Room ' || md5('w' || CAST(g AS STRING)) ELSE 'Hall ' || md5('v' || CAST(g AS STRING)) END AS venue,
       CASE WHEN v = 3 AND g % 5 = 0 THEN '' WHEN v = 3 AND g % 2 = 1 THEN md5('b' || CAST(g AS STRING)) ELSE md5('a' || CAST(g AS STRING)) END AS address,
       CASE WHEN v IN (0, 3) AND g % 4 = 1 THEN 'https://www.shows.example.com/show-' || CAST(g AS STRING) || '/?utm_source=x' ELSE '' END AS url,
       '' AS signup_url, 'shows' AS source_id
FROM (SELECT o_orderkey AS n, CAST(floor(o_orderkey / 4) AS BIGINT) AS g, o_orderkey % 4 AS v FROM {orders}) o
"""

ALL = {"shows": SHOWS, "discoveries": DISCOVERIES, "source_runs": SOURCE_RUNS, "runs": RUNS, "event_store": EVENT_STORE, "catalog": CATALOG, "inbox": INBOX, "sightings": SIGHTINGS, "incoming": INCOMING}


def bound(spark: SparkSession, folder: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in _BASE if f"{{{t}}}" in ALL[name]}
    return spark.sql(ALL[name], **used)


def cte(*names: str) -> str:
    """WITH name AS (...), ... for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({ALL[n].format(**{t: t for t in _BASE})})" for n in names)

"""Registered queries of the extraction jobs: payloads and pages are made from base tables, extraction must give them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingloom.functions import text as t
from listingloom.session import spread
from listingloom.sources import extract as x

FIRST, DAYS = "2026-08-10", 12
# Facts that both the payloads and the SQL draw from part: a start, an id, a price.
_START = "'2026-08-' || lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0') || 'T' || lpad(CAST(p_size % 24 AS STRING), 2, '0') || ':30:00-04:00'"
_CENTS = "CAST(p_partkey % 4000 AS BIGINT) * 25"
_KEY = "p_brand AS source_id, CAST(floor(p_partkey / 40) AS BIGINT) AS page_no"

#: For each family: an entry as a Spark struct, the body around its list (items), and the raw fields as SQL for both engines.
_FAMILIES = {
    "sessions": (
        f"named_struct('id', p_partkey, 'hostId', p_size, 'sessionName', p_name, 'startsAt', {_START}, 'endsAt', '', 'link', 'https://s.example.com/' || p_partkey, 'location', p_type, 'fixedTicketPrice', {_CENTS} / 100D, 'freeEvent', p_size % 7 = 0, 'capacity', p_size, 'isCancelled', p_size % 5 = 0)",
        "named_struct('payload', items, 'pagination', named_struct('page', page_no, 'totalCount', total))",
        f"CAST(p_partkey AS STRING) AS event_id, p_name AS title, {_START} AS start, p_type AS venue, p_size % 7 = 0 AS is_free, CAST(p_size AS STRING) || ' capacity' AS capacity_flag, CASE WHEN p_size % 5 = 0 THEN 'cancelled' END AS reason",
    ),
    "search": (
        f"named_struct('sourceId', 'm' || p_partkey, 'type', if(p_size % 13 = 0, 'page', 'event'), 'title', p_name, 'startDate', {_START}, 'url', p_type, 'subtype', if(p_size % 3 = 0, array('Free', 'Talk'), array('Talk')), 'museumLocation', named_struct('name', p_brand))",
        "named_struct('metadata', named_struct('total', total, 'pageNumber', page_no), 'data', items)",
        f"'m' || CAST(p_partkey AS STRING) AS event_id, p_name AS title, {_START} AS start, p_brand AS venue, CASE WHEN p_size % 3 = 0 THEN true END AS is_free, CAST(NULL AS STRING) AS capacity_flag, CAST(NULL AS STRING) AS reason",
    ),
    "calendar": (
        f"named_struct('id', p_partkey, 'status', if(p_size % 6 = 0, 'draft', 'publish'), 'title', p_name, 'start_date', {_START}, 'url', p_type, 'cost', if(p_size % 4 = 0, 'Free', '$9'), 'venue', named_struct('venue', p_type, 'address', '', 'city', p_brand), 'organizer', array(named_struct('organizer', 'Org')))",
        "named_struct('events', items, 'total', total, 'page', page_no)",
        f"CAST(p_partkey AS STRING) AS event_id, p_name AS title, {_START} AS start, p_type AS venue, CASE WHEN p_size % 4 = 0 THEN true END AS is_free, CAST(NULL AS STRING) AS capacity_flag, CASE WHEN p_size % 6 = 0 THEN 'unknown_status' END AS reason",
    ),
    "city": (
        f"named_struct('_id', 'c' || p_partkey, 'title', p_name, 'startTime', {_START}, 'locationString', p_type || ', ' || p_brand, 'city', named_struct('_id', if(p_size % 9 = 0, 'other', 'nyc')), 'cancelled', p_size % 8 = 0, 'hosts', array(named_struct('firstName', 'Al', 'lastName', 'Bo')), 'rsvpCounts', named_struct('confirmed', p_size, 'maybe', 0, 'waitlist', 1))",
        "named_struct('city', named_struct('_id', 'nyc', 'events', items), 'total', total, 'page', page_no)",
        f"'c' || CAST(p_partkey AS STRING) AS event_id, p_name AS title, {_START} AS start, p_type AS venue, true AS is_free, CAST(p_size AS STRING) || ' confirmed; 0 maybe; 1 waitlist' AS capacity_flag, CASE WHEN p_size % 9 = 0 THEN 'outside_configured_city' WHEN p_size % 8 = 0 THEN 'cancelled_or_deleted' END AS reason",
    ),
    "posts": (
        f"named_struct('id', 'x', 'content', p_name || '\\nmore', 'entity', named_struct('id', 'p' || p_partkey, 'type', if(p_size % 10 = 0, 'NOTE', 'EVENT'), 'startTime', {_START}, 'address', p_type), 'links', array(named_struct('link', 'mailto:x'), named_struct('link', 'https://l.example.com/' || p_partkey)))",
        "named_struct('posts', items, 'total', total, 'page', page_no)",
        f"'p' || CAST(p_partkey AS STRING) AS event_id, p_name AS title, {_START} AS start, '' AS venue, CAST(NULL AS BOOLEAN) AS is_free, CAST(NULL AS STRING) AS capacity_flag, CASE WHEN p_size % 10 = 0 THEN 'not_an_event' END AS reason",
    ),
    "list": (
        "named_struct('id', int(p_partkey), 'title', if(p_partkey % 3 = 0, '', p_name), 'event_name', p_name, 'event_date', if(p_partkey % 2 = 0, '2026-08-20', ''), 'date', '2026-08-20', 'time', '6:30 PM', 'venue', p_type, 'borough', p_brand, 'price_range', if(p_size % 2 = 0, 'Free', '$5'), 'rsvp_link', if(p_size % 11 = 0, '', 'r'), 'is_active', p_size % 12 <> 0)",
        "named_struct('events', items, 'pagination', named_struct('page', page_no, 'total', total))",
        "CAST(p_partkey AS STRING) AS event_id, p_name AS title, '2026-08-20 6:30 PM' AS start, p_type AS venue, p_size % 2 = 0 AS is_free, CAST(NULL AS STRING) AS capacity_flag, CASE WHEN p_size % 12 = 0 THEN 'inactive' WHEN p_size % 11 = 0 THEN 'event_parse_failed' END AS reason",
    ),
    "discovery": (
        f"named_struct('api_id', 'x', 'event', named_struct('api_id', 'd' || p_partkey, 'name', p_name, 'start_at', {_START}, 'geo_address_info', named_struct('city', if(p_size % 4 = 0, 'Boston', 'Brooklyn'), 'address', p_type)), 'calendar', named_struct('name', p_brand), 'hosts', array(), 'ticket_info', named_struct('is_free', p_size % 6 = 0, 'is_sold_out', p_size % 11 = 0))",
        "named_struct('entries', items, 'total', total, 'page', page_no)",
        f"'d' || CAST(p_partkey AS STRING) AS event_id, p_name AS title, {_START} AS start, p_type AS venue, p_size % 6 = 0 AS is_free, CASE WHEN p_size % 11 = 0 THEN 'sold_out' END AS capacity_flag, CASE WHEN p_size % 4 = 0 THEN 'outside_city' END AS reason",
    ),
}
_RAW = ["source_id", "page_no", "event_id", "title", "start", "venue", "is_free", "capacity_flag", "reason"]


def payloads(spark, folder, family):
    """Pages of a feed, up to 40 entries each, made from part."""
    return feed_pages(spark, folder, *_FAMILIES[family][:2])


def feed_pages(spark, folder, entry, body):
    """Pages of entries (a struct in SQL) in bodies around `items`; a text @@x@@ stands for the bare JSON x."""
    part = spark.read.parquet(f"{folder}/part.parquet").selectExpr("*", "p_brand AS source_id", "CAST(floor(p_partkey / 40) AS BIGINT) AS page_no")
    rows = spread(part, "source_id", "page_no").selectExpr("source_id", "page_no", "p_partkey", f"{entry} AS e")
    pages = rows.groupBy("source_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.regexp_replace(F.to_json("e"), '"@@(.*?)@@"', "$1").alias("e")))), lambda r: r["e"]).alias("texts"))
    total = rows.groupBy("source_id").agg(F.count("*").alias("total"))
    text = F.concat(F.lit("["), F.array_join("texts", ","), F.lit("]"))
    shell = pages.join(F.broadcast(total), "source_id").withColumn("items", F.lit("@items@")).withColumn("shell", F.to_json(F.expr(body)))
    return shell.select("source_id", "page_no", F.replace("shell", F.lit('"@items@"'), text).alias("body"))


def _feed(family):
    sql = f"SELECT {_KEY}, {_FAMILIES[family][2]} FROM part{' WHERE p_size % 13 <> 0' if family == 'search' else ''}"
    return (lambda s, d: x.feed_events(payloads(s, d, family), family).select(*_RAW)), sql


def _raw(s, d):
    return x.feed_events(payloads(s, d, "sessions"), "sessions")


_RAW_SQL = f"raw AS (SELECT {_KEY}, p_partkey, {_FAMILIES['sessions'][2]} FROM part)"


def ld_pages(spark, folder):
    """A page with JSON-LD for each part: a graph with an Event and a ListItem, a broken block and an empty one."""
    part = spread(spark.read.parquet(f"{folder}/part.parquet"), "p_partkey")
    event = f"""named_struct('@type', if(p_size % 2 = 0, array('Thing', 'https://schema.org/Event'), array('Event')), 'name', if(p_size % 10 = 0, '', p_name), 'startDate', {_START}, 'url', 'https://parts.example.com/e/' || p_partkey,
     'eventStatus', if(p_size % 7 = 0, 'https://schema.org/EventCancelled', 'https://schema.org/EventScheduled'), 'organizer', named_struct('name', p_brand),
     'location', named_struct('name', p_type, 'address', named_struct('streetAddress', p_partkey || ' Street', 'addressLocality', 'New York', 'postalCode', '10001')),
     'offers', array(named_struct('price', '30', 'url', 'https://t.example.com/' || p_partkey), named_struct('price', '12.5', 'url', ''))) """
    item = "named_struct('@type', 'ListItem', 'name', p_name, 'item', named_struct('url', 'https://www.parts.example.com/e/' || p_partkey || '-2026-09-0' || (p_partkey % 9 + 1)))"
    graph = F.to_json(F.expr(f"named_struct('@graph', array(to_json({event}), to_json({item})))"))
    graph = F.concat(F.lit('{"@graph":['), F.to_json(F.expr(event)), F.lit(","), F.to_json(F.expr(item)), F.lit("]}"))
    html = F.concat(F.lit('<html><script>var x;</script><script type="application/ld+json">{broken</script><script type=\'application/ld+json\'> </script><script id="a" type="application/ld+json">'), graph, F.lit("</script><p>text</p></html>"))
    return part.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def _made_pages(s, d):
    """Pages whose text and links are known: scripts, comments, quoted '>', references, an anchor without href, one left open."""
    html = F.expr("""concat('<!DOCTYPE html><title>', p_name, '</title><script>if (a < b) "</p>" </script><style>p > a {}</style><!-- <p>no</p> --><div title="x > y">&Eacute; &amp;\n ', p_brand,
     '</div><a name=top></a><A class=b HREF="/p?a=1&amp;b=', p_partkey, '">go  to<b>', p_type, '</b></A><a href="/open">', if(p_size % 3 = 0, '5 < 6', ''))""")
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("page_id"), html.alias("html"))


def _events(s, d):
    return x.jsonld_events(x.typed_nodes(x.page_jsonld(ld_pages(s, d)), "Event"), F.lit("parts"))


def _cards(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    shows = F.expr(f"transform(sequence(1, p_size % 3 + 1), i -> named_struct('start', {_START}, 'ticket_url', 'https://tix.example.com/' || (p_partkey * 10 + i)))")
    return part.select(F.col("p_partkey").alias("film_id"), F.col("p_name").alias("title"), shows.alias("showtimes"))


def _utc_feed(s, d):
    """The sessions with their starts written in UTC, some of them of the next day there."""
    body = F.regexp_replace("body", r'"startsAt":"2026-08-(\d\d)T(\d\d):30:00-04:00"', r'"startsAt":"2026-08-$1T$2:30:00.000Z"')
    return x.feed_events(payloads(s, d, "sessions").withColumn("body", body), "sessions", "America/New_York")


QUERIES = {f"ext_feed_{family}": _feed(family) for family in _FAMILIES} | {
    "ext16_utc_starts": (
        lambda s, d: _utc_feed(s, d).select("source_id", "page_no", "event_id", "start", F.substring("start", 1, 10).alias("day")),
        f"""WITH w AS (SELECT {_KEY}, CAST(p_partkey AS STRING) AS event_id, make_timestamp(2026, 8, CAST(p_partkey % 28 + 1 AS BIGINT), CAST(p_size % 24 AS BIGINT), 30, 0) - INTERVAL 4 HOUR AS local_at FROM part)
        SELECT source_id, page_no, event_id, strftime(local_at, '%Y-%m-%dT%H:%M:%S-04:00') AS start, strftime(local_at, '%Y-%m-%d') AS day FROM w""",
    ),
    "ext12_subtype_filter": (
        lambda s, d: x.feed_events(payloads(s, d, "search"), "search", subtype="Free").select("source_id", "event_id", "title", "price"),
        "SELECT p_brand AS source_id, 'm' || CAST(p_partkey AS STRING) AS event_id, p_name AS title, 'Free' AS price FROM part WHERE p_size % 3 = 0 AND p_size % 13 <> 0",
    ),
    "ext15_evidence_hash": (
        lambda s, d: x.feed_events(payloads(s, d, "posts"), "posts").select("source_id", "event_id", "url", "content_hash"),
        f"""SELECT p_brand AS source_id, 'p' || CAST(p_partkey AS STRING) AS event_id, 'https://l.example.com/' || CAST(p_partkey AS STRING) AS url,
        sha256('{{"address":"' || p_type || '","content":"' || p_name || '\\nmore","end_time":"","entity_id":"p' || p_partkey || '","entity_type":"' || CASE WHEN p_size % 10 = 0 THEN 'NOTE' ELSE 'EVENT' END
        || '","entity_url":"","link_title":"","link_url":"mailto:x","post_id":"x","start_time":"' || {_START} || '"}}') AS content_hash FROM part""",
    ),
    "ext16_host_match": (
        lambda s, d: x.feed_events(payloads(s, d, "sessions").withColumn("body", F.regexp_replace("body", '"freeEvent":true', '"freeEvent":"yes"')), "sessions", host_id=7).select("source_id", "event_id", "reason"),
        "SELECT p_brand AS source_id, CAST(p_partkey AS STRING) AS event_id, 'event_parse_failed' AS reason FROM part",
    ),
    "ext16_host_of_size": (
        lambda s, d: x.feed_events(payloads(s, d, "sessions"), "sessions", host_id=5).select("source_id", "event_id", "reason"),
        "SELECT p_brand AS source_id, CAST(p_partkey AS STRING) AS event_id, CASE WHEN p_size = 5 THEN 'cancelled' ELSE 'event_parse_failed' END AS reason FROM part",
    ),
    "ext1_page_jsonld": (
        lambda s, d: x.page_jsonld(ld_pages(s, d)).select("page_id", "pos"),
        "SELECT p_partkey AS page_id, CAST(2 AS INT) AS pos FROM part",
    ),
    "ext2_typed_nodes": (
        lambda s, d: x.typed_nodes(x.page_jsonld(ld_pages(s, d)), "Event").select("page_id", F.get_json_object("node", "$.url").alias("url")),
        "SELECT p_partkey AS page_id, 'https://parts.example.com/e/' || CAST(p_partkey AS STRING) AS url FROM part",
    ),
    "ext3_page_text": (
        lambda s, d: x.page_contents(s.read.parquet(f"{d}/pages.parquet")).select("page_id", "text", F.size("links").alias("links")),
        None,
    ),
    "ext3_made_page_text": (
        lambda s, d: x.page_contents(_made_pages(s, d)).select("page_id", "text"),
        "SELECT p_partkey AS page_id, p_name || chr(10) || 'É & ' || p_brand || chr(10) || 'go to' || chr(10) || p_type || CASE WHEN p_size % 3 = 0 THEN chr(10) || '5' || chr(10) || '<' || chr(10) || '6' ELSE '' END AS text FROM part",
    ),
    "ext4_made_page_links": (
        lambda s, d: x.page_contents(_made_pages(s, d)).select("page_id", F.posexplode("links").alias("pos", "link")).select("page_id", "pos", "link.href", "link.text"),
        "SELECT p_partkey AS page_id, CAST(0 AS INT) AS pos, '/p?a=1&b=' || CAST(p_partkey AS STRING) AS href, 'go to ' || p_type AS text FROM part",
    ),
    "ext4_page_links": (
        lambda s, d: x.page_contents(s.read.parquet(f"{d}/pages.parquet")).select("page_id", F.size("links").cast("long").alias("links")),
        "SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*href=\"[^\"]+\"[^>]*>[^<]*</a>')) AS BIGINT) AS links FROM pages",
    ),
    "ext5_jsonld_events": (
        lambda s, d: _events(s, d).select("page_id", "source_id", "title", "start", "url", "signup_url", "host", "venue", "address", "price", "is_free", "status", "reason"),
        f"""SELECT p_partkey AS page_id, 'parts' AS source_id, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END AS title, {_START} AS start, 'https://parts.example.com/e/' || CAST(p_partkey AS STRING) AS url,
        'https://t.example.com/' || CAST(p_partkey AS STRING) AS signup_url, p_brand AS host, p_type AS venue, CAST(p_partkey AS STRING) || ' Street, New York 10001' AS address, '$12.50' AS price, false AS is_free,
        CASE WHEN p_size % 7 = 0 THEN 'cancelled' ELSE 'active' END AS status, CASE WHEN p_size % 10 = 0 THEN 'missing_title' END AS reason FROM part""",
    ),
    "ext6_listing_stubs": (
        lambda s, d: x.listing_stubs(x.typed_nodes(x.page_jsonld(ld_pages(s, d)), "ListItem"), "parts.example.com", "/e/").select("page_id", "url", "title", F.col("date_hint").cast("string").alias("date_hint")),
        "SELECT p_partkey AS page_id, 'https://www.parts.example.com/e/' || CAST(p_partkey AS STRING) || '-2026-09-0' || CAST(p_partkey % 9 + 1 AS STRING) AS url, p_name AS title, '2026-09-0' || CAST(p_partkey % 9 + 1 AS STRING) AS date_hint FROM part",
    ),
    "ext8_embedded_json": (
        lambda s, d: ld_pages(s, d).select("page_id", x.embedded_json(F.col("html"), "a", "$.@graph[0].organizer.name").alias("host")),
        "SELECT p_partkey AS page_id, p_brand AS host FROM part",
    ),
    "ext10_portable_text": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", x.portable_text(F.to_json(F.expr("array(named_struct('children', array(named_struct('text', p_name || ' '), named_struct('text', p_brand))), named_struct('children', array(named_struct('text', p_type))))"))).alias("text")),
        "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part",
    ),
    "ext18_dedup_stubs": (
        lambda s, d: x.dedup_stubs(_raw(s, d).withColumn("url", F.col("venue")), "url").select("source_id", "url", "page_no", "event_id"),
        f"WITH {_RAW_SQL} SELECT source_id, venue AS url, page_no, event_id FROM raw QUALIFY row_number() OVER (PARTITION BY source_id, venue ORDER BY page_no, p_partkey) = 1",
    ),
    "ext19_join_details": (
        lambda s, d: x.join_details(_raw(s, d).select("source_id", F.col("event_id"), F.substring("start", 1, 10).alias("day"), "url"), s.read.parquet(f"{d}/part.parquet").where("p_size % 9 <> 0").selectExpr("p_brand as source_id", "'https://s.example.com/' || p_partkey as url", "if(p_size % 8 = 0, 'x', cast(p_partkey as string)) as detail_id", f"substr({_START}, 1, 10) as detail_day")).select("source_id", "event_id", "reason"),
        "SELECT p_brand AS source_id, CAST(p_partkey AS STRING) AS event_id, CASE WHEN p_size % 9 = 0 THEN 'missing_detail' WHEN p_size % 8 = 0 THEN 'id_disagrees' END AS reason FROM part",
    ),
    "ext20_window_route": (
        lambda s, d: x.window_route(_raw(s, d), FIRST, DAYS).select("source_id", "event_id", "reason"),
        f"WITH {_RAW_SQL} SELECT source_id, event_id, CASE WHEN reason IS NOT NULL THEN reason WHEN substr(start, 1, 10) NOT BETWEEN '{FIRST}' AND '2026-08-22' THEN 'outside_date_window' END AS reason FROM raw",
    ),
    "ext21_page_set_contract": (
        lambda s, d: x.page_set_contract(payloads(s, d, "sessions").where("page_no > 0"), "$.pagination.totalCount", "$.pagination.page", "$.payload", 100),
        "SELECT p_brand AS source_id, 'items differ from total' AS problem FROM part WHERE p_partkey < 40 AND p_brand IN (SELECT p_brand FROM part WHERE p_partkey >= 40) GROUP BY 1 UNION ALL SELECT p_brand, 'too many pages' FROM part WHERE p_partkey >= 40 GROUP BY 1 HAVING count(DISTINCT floor(p_partkey / 40)) > 100",
    ),
    "ext22_ordering_proof": (
        lambda s, d: x.ordering_proof(_raw(s, d), "2026-08-20"),
        f"""WITH {_RAW_SQL}, b AS (SELECT *, coalesce(start < lag(start) OVER (PARTITION BY source_id ORDER BY page_no, p_partkey), false) AS back FROM raw),
        g AS (SELECT source_id, page_no, min(substr(start, 1, 10)) AS f, bool_or(back) AS back FROM b GROUP BY 1, 2)
        SELECT source_id, NOT bool_or(back) AS ordered, NOT bool_or(back) AND bool_or(f > '2026-08-20') AS complete FROM g GROUP BY 1""",
    ),
    "ext23_repeat_ids": (
        lambda s, d: x.repeat_ids(_raw(s, d), "title"),
        f"WITH {_RAW_SQL} SELECT source_id, title, count(*) AS n FROM raw GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "ext26_card_showtimes": (
        lambda s, d: x.card_showtimes(_cards(s, d)).select("film_id", "title", F.col("show").cast("long").alias("show"), "event_id"),
        "SELECT p_partkey AS film_id, p_name AS title, i - 1 AS show, CAST(p_partkey AS STRING) || '-' || CAST(p_partkey * 10 + i AS STRING) AS event_id FROM part, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= p_size % 3 + 1",
    ),
    "ext28_day_coverage": (
        lambda s, d: x.day_coverage(_raw(s, d).select("source_id", F.substring("start", 1, 10).alias("day")), FIRST, DAYS).select("source_id", F.col("missing").cast("long").alias("missing"), "reached"),
        f"""WITH {_RAW_SQL} SELECT source_id, {DAYS + 1} - count(DISTINCT substr(start, 1, 10)) FILTER (substr(start, 1, 10) BETWEEN '{FIRST}' AND '2026-08-22') AS missing, max(substr(start, 1, 10)) >= '2026-08-22' AS reached FROM raw GROUP BY 1""",
    ),
    "ext33_source_state": (
        lambda s, d: x.source_state(x.window_route(_raw(s, d), FIRST, 2).select("source_id", "reason"), s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("source_id")).distinct().union(s.createDataFrame([("quiet",)], "source_id string"))),
        f"""WITH {_RAW_SQL}, r AS (SELECT source_id, CASE WHEN reason IS NOT NULL THEN reason WHEN substr(start, 1, 10) NOT BETWEEN '{FIRST}' AND '2026-08-12' THEN 'outside_date_window' END AS reason FROM raw)
        SELECT source_id, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS events, CAST(count(*) FILTER (reason IS NOT NULL) AS BIGINT) AS rejected,
        CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN 'ok' WHEN count(*) FILTER (reason <> 'outside_date_window') > 0 THEN 'validation_failed' ELSE 'empty_verified' END AS state FROM r GROUP BY 1
        UNION ALL SELECT 'quiet', 0, 0, 'empty_suspicious'""",
    ),
    "ext35_retain_fields": (
        lambda s, d: x.retain_fields(s.read.parquet(f"{d}/events.parquet").select("event_id", F.to_json(F.struct("event_type", "value", F.struct("user_id").alias("member"))).alias("raw")), "raw", "event_type string"),
        "SELECT event_id, '{\"event_type\":\"' || event_type || '\"}' AS raw FROM events",
    ),
    "scl15_infer_year": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", t.infer_year((F.col("o_orderkey") % 12 + 1).cast("int"), F.col("o_orderdate").cast("date")).alias("year")),
        "SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN o_orderkey % 12 + 1 - month(o_orderdate) > 6 THEN -1 WHEN o_orderkey % 12 + 1 - month(o_orderdate) < -6 THEN 1 ELSE 0 END AS INT) AS year FROM orders",
    ),
    "scl16_clock12": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", t.clock12(F.expr("concat(p_size % 12 + 1, if(p_partkey % 2 = 0, ':15', ''), if(p_partkey % 3 = 0, ' PM', 'am'))")).alias("time")),
        "SELECT p_partkey, lpad(CAST((p_size % 12 + 1) % 12 + CASE WHEN p_partkey % 3 = 0 THEN 12 ELSE 0 END AS STRING), 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN ':15' ELSE ':00' END AS time FROM part",
    ),
    "ext7_breadcrumb": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").withColumn("node", F.to_json(F.expr("named_struct('itemListElement', array(named_struct('name', 'Home', 'item', 'https://a.org/'), named_struct('name', p_brand, 'item', 'https://a.org/venues/' || p_size)))"))).select("p_partkey", x.breadcrumb("node", "/venues/").alias("venue")),
        "SELECT p_partkey, p_brand AS venue FROM part",
    ),
    "ext9_calendar_records": (
        lambda s, d: x.calendar_records(s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "case p_size % 3 when 0 then 'program' when 1 then 'class' else 'exhibition' end as kind", "p_size % 5 = 0 as hidden", f"substr({_START}, 1, 10) as start_date", "if(p_size % 7 = 0, '', '19:00') as start_time", "cast(null as string) as end_date"), FIRST, 5).select("p_partkey", "start", "reason"),
        f"""SELECT p_partkey, substr({_START}, 1, 10) || CASE WHEN p_size % 7 = 0 THEN '' ELSE 'T19:00' END AS start,
        CASE WHEN substr({_START}, 1, 10) > '2026-08-15' THEN 'outside_date_window' WHEN p_size % 7 = 0 THEN 'missing_explicit_time' END AS reason
        FROM part WHERE p_size % 3 <> 2 AND p_size % 5 <> 0 AND substr({_START}, 1, 10) >= '{FIRST}'""",
    ),
    "ext24_text_occurrences": (
        lambda s, d: x.text_occurrences(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr("concat(p_name, ' Saturday, September ', p_size % 28 + 1, ', 2026 7 PM and 9:30 pm ', if(p_size % 2 = 0, 'Friday, October 2, 2026 - Sunday, October 4, 2026', ''))").alias("text"))).select("p_partkey", "mention", "start", "reason"),
        """SELECT p_partkey, CAST(0 AS INT) AS mention, '2026-09-' || lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0') || t AS start, NULL AS reason FROM part, (SELECT unnest(['T19:00:00', 'T21:30:00']) AS t)
        UNION ALL SELECT p_partkey, 1, NULL, 'missing_explicit_time' FROM part WHERE p_size % 2 = 0""",
    ),
    "ext25_fixed_time_occurrences": (
        lambda s, d: x.fixed_time_occurrences(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr("concat('On Monday, March ', p_size % 28 + 1, ', 2026 and Tuesday, April 7, 2026')").alias("text")), "15:00").select("p_partkey", "mention", "start"),
        """SELECT p_partkey, CAST(0 AS INT) AS mention, '2026-03-' || lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0') || 'T15:00:00' AS start FROM part UNION ALL SELECT p_partkey, 1, '2026-04-07T15:00:00' FROM part""",
    ),
    "ext27_marker_groups": (
        lambda s, d: x.marker_groups(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("section"), F.posexplode(F.split(F.expr("concat('7:30 PM\\n', p_name, '\\nHall - Tickets\\n*note\\n9 PM\\n', p_brand, if(p_size % 2 = 0, '\\nTickets', ''))"), "\n")).alias("pos", "line"))).select("section", "record", "title", "note", "reason"),
        """SELECT CAST(p_partkey AS STRING) AS section, 1 AS record, p_name AS title, '*note' AS note, NULL AS reason FROM part
        UNION ALL SELECT CAST(p_partkey AS STRING), 2, p_brand, '', CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'unresolved' END FROM part""",
    ),
    "ext29_weekly_occurrences": (
        lambda s, d: x.weekly_occurrences(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("source_id"), F.expr("if(s_suppkey % 2 = 0, 'Every Friday at 7 pm', 'Closed')").alias("text")), ["(?i)every friday"], "FR", "19:00", FIRST, DAYS).select("source_id", "start"),
        "SELECT s_name AS source_id, d AS start FROM supplier, (SELECT unnest(['2026-08-14T19:00:00', '2026-08-21T19:00:00']) AS d) WHERE s_suppkey % 2 = 0",
    ),
    "ext30_labelled_fields": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", x.labelled_field(F.concat(F.lit("Date: today Place: "), "p_name", F.lit(", "), "p_brand", F.lit(" For a fee: $5")), "Place", ("For a fee",)).alias("place")),
        "SELECT p_partkey, p_name || ', ' || p_brand AS place FROM part",
    ),
    "ext30_split_place": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", x.split_place(F.expr("case p_partkey % 3 when 0 then concat(p_name, ', ', p_brand, ' , , ', p_type) when 1 then p_name else '' end")).alias("p")).select("p_partkey", "p.venue", "p.address"),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE p_name END AS venue, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ', ' || p_type ELSE '' END AS address FROM part",
    ),
    "ext31_near_date_hint": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr("if(p_partkey % 5 = 0, p_name, concat('Jan 5, 2026 ', p_name, element_at(array(' Friday, February 6th 7:30 PM ', ' 2/7/2026 8 PM ', ' March 8 ', ' 2026-04-09 ', ' December 10 at '), int(p_size % 5 + 1))))").alias("before")).select("p_partkey", x.near_date_hint(F.concat("before", F.lit("LINK 2026-03-07")), F.length("before") + 1, "2026-01-15").alias("hint")),
        "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '2026-03-07' ELSE ['2026-02-06', '2026-02-07', '2026-03-08', '2026-01-05', '2025-12-10'][p_size % 5 + 1] END AS hint FROM part",
    ),
    "ext32_explicit_empty": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", x.explicit_empty(F.when(F.col("event_type") == "view", "Sorry, no upcoming events").otherwise(F.col("event_type"))).alias("empty")),
        "SELECT event_id, event_type = 'view' AS empty FROM events",
    ),
    "ext34_failure_state": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", x.failure_state(F.when(F.col("event_type") == "error", "RobotsDenied").when(F.col("event_type") == "click", "ContractError").otherwise(F.col("event_type"))).alias("state")),
        "SELECT event_id, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'click' THEN 'parse_failed' ELSE 'fetch_failed' END AS state FROM events",
    ),
}

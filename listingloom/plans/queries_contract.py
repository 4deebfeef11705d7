"""Registered queries of the feeds to the raw-event contract: payloads are made from part, some of their entries broken; each
row must come out with the contract's fields and pass its check, or with the reason that its fault asks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingloom.operators.contract import check_raw_events
from listingloom.plans.queries_extract import _CENTS, _START, feed_pages, ld_pages
from listingloom.sources import extract as x
from listingloom.sources.raw_events import Config, contract_json, jsonld_raw_events, localized, raw_events

_SHOWN = ("source_id", "source_event_id", "title", "start", "url", "signup_url", "host", "venue", "address", "price", "is_free", "description", "capacity_flag", "status", "reason")
_BASE = "https://feeds.example.com/api/list"
_ID = "CAST(p_partkey AS STRING)"
#: A title is blank in every eleventh size; a value of a wrong kind stands in every thirteenth.
_TITLE = "CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_name END"
_SAID = "CASE WHEN p_size % 11 = 0 THEN '' ELSE p_name END"
_DOLLARS = f"'$' || CASE WHEN {_CENTS} % 100 = 0 THEN CAST(CAST({_CENTS} / 100 AS BIGINT) AS STRING) ELSE "

#: For each family: its configuration, an entry, the body around the list, the fields as SQL, and when an entry fails.
_FEEDS = {
    "discovery": (
        Config("America/New_York", "discovery-2", cities=("brooklyn", "new york"), region="new york", countries=("usa", "united states"), event_page="https://pages.example.com/"),
        f"named_struct('event', named_struct('api_id', 'd' || p_partkey, 'name', {_TITLE}, 'start_at', {_START}, 'url', 'show-' || p_partkey, 'geo_address_info', named_struct('city', if(p_size % 4 = 0, 'Boston', ' Brooklyn'), 'region', 'New York', 'country', 'USA', 'address', p_type, 'full_address', p_type || ', ' || p_brand)), 'calendar', if(p_size % 13 = 0, '@@5@@', '@@null@@'), 'hosts', array(named_struct('name', 'Ann'), named_struct('name', ' '), named_struct('name', p_brand)), 'ticket_info', named_struct('is_free', p_size % 6 = 0, 'is_sold_out', p_size % 7 = 0, 'price', named_struct('cents', {_CENTS}, 'currency', 'USD')))",
        "named_struct('entries', items)",
        f"""'d' || {_ID}, {_SAID}, {_START}, 'https://pages.example.com/show-' || {_ID}, 'https://pages.example.com/show-' || {_ID}, 'Ann, ' || p_brand, p_type, p_type || ', ' || p_brand,
        CASE WHEN p_size % 6 = 0 THEN 'Free' ELSE {_DOLLARS} printf('%.2f', {_CENTS} / 100) END END, p_size % 6 = 0, '', CASE WHEN p_size % 7 = 0 THEN 'sold_out' END, 'active'""",
        "CASE WHEN p_size % 4 = 0 THEN 'outside_city' WHEN p_size % 11 = 0 OR p_size % 13 = 0 THEN 'event_parse_failed' END", "true",
    ),
    "search": (
        Config("America/New_York", "search-1", host="The Museum"),
        f"named_struct('type', if(p_size % 5 = 0, 'page', 'event'), 'title', {_TITLE}, 'startDate', {_START}, 'url', '/events/' || p_partkey || '/', 'subtype', if(p_size % 3 = 0, array('Free', 'Talk'), array('Talk')), 'museumLocation', if(p_size % 13 = 0, '@@[]@@', '@@null@@'), 'summary', '<p>A &amp; ' || p_type || '</p>', 'status', if(p_size % 7 = 0, 'Canceled', ''))",
        "named_struct('data', items)",
        f"""'/events/' || {_ID}, {_SAID}, {_START}, 'https://feeds.example.com/events/' || {_ID} || '/', 'https://feeds.example.com/events/' || {_ID} || '/', 'The Museum', '', '',
        CASE WHEN p_size % 3 = 0 THEN 'Free' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN true END, 'A & ' || p_type, CAST(NULL AS VARCHAR), CASE WHEN p_size % 7 = 0 THEN 'cancelled' ELSE 'active' END""",
        "CASE WHEN p_size % 11 = 0 OR p_size % 13 = 0 THEN 'event_parse_failed' END", "p_size % 5 <> 0",
    ),
    "calendar": (
        Config("America/New_York", "calendar-3"),
        f"named_struct('id', p_partkey, 'status', if(p_size % 6 = 0, 'draft', if(p_size % 7 = 0, 'postponed', 'Publish')), 'title', {_TITLE}, 'start_date', {_START}, 'url', 'e/' || p_partkey, 'website', if(p_size % 2 = 0, 'https://tix.example.com/' || p_partkey, ''), 'cost', if(p_size % 13 = 0, '@@9@@', if(p_size % 4 = 0, '$ 0.00', '€9')), 'venue', named_struct('venue', p_type, 'address', '', 'city', p_brand, 'province', 'NY', 'zip', '10001'), 'organizer', if(p_size % 3 = 0, '@@null@@', '@@[]@@'), 'description', p_type)",
        "named_struct('events', items)",
        f"""{_ID}, {_SAID}, {_START}, 'https://feeds.example.com/api/e/' || {_ID}, CASE WHEN p_size % 2 = 0 THEN 'https://tix.example.com/' || {_ID} ELSE 'https://feeds.example.com/api/e/' || {_ID} END, '', p_type, p_brand || ', NY 10001',
        CASE WHEN p_size % 13 = 0 THEN '9' WHEN p_size % 4 = 0 THEN '$ 0.00' ELSE '€9' END, p_size % 13 <> 0 AND p_size % 4 = 0, p_type, CAST(NULL AS VARCHAR), CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'postponed' ELSE 'active' END""",
        "CASE WHEN p_size % 6 = 0 OR p_size % 11 = 0 OR p_size % 13 = 0 THEN 'event_parse_failed' END", "true",
    ),
    "city": (
        Config("America/New_York", "city-1", city_id="nyc", host="Runners", event_page="https://runs.example.com/event/"),
        f"named_struct('_id', 'c' || p_partkey, 'title', {_TITLE}, 'text', p_type, 'startTime', {_START}, 'locationString', p_type || ', ' || p_brand, 'city', named_struct('_id', if(p_size % 9 = 0, 'other', 'nyc'), 'name', 'New York'), 'cancelled', p_size % 8 = 0, 'hosts', if(p_size % 3 = 0, array(named_struct('firstName', 'Al', 'lastName', 'Bo')), array()), 'rsvpCounts', named_struct('confirmed', p_size, 'waitlist', 1))",
        "named_struct('city', named_struct('_id', 'nyc', 'events', items))",
        f"""'c' || {_ID}, {_SAID}, {_START}, 'https://runs.example.com/event/c' || {_ID}, 'https://runs.example.com/event/c' || {_ID}, CASE WHEN p_size % 3 = 0 THEN 'Al Bo' ELSE 'Runners New York' END, p_type, p_type || ', ' || p_brand,
        'Free', true, p_type, CAST(p_size AS VARCHAR) || ' confirmed; 1 waitlist', 'active'""",
        "CASE WHEN p_size % 9 = 0 THEN 'outside_configured_city' WHEN p_size % 8 = 0 THEN 'cancelled_or_deleted' WHEN p_size % 11 = 0 THEN 'event_parse_failed' END", "true",
    ),
    "posts": (
        Config("America/New_York", "posts-1", event_page="https://posts.example.com/"),
        f"named_struct('id', 'x' || p_partkey, 'content', if(p_size % 11 = 0, '', '\\n ' || p_name || ' Café\\nmail me@example.org'), 'entity', named_struct('id', if(p_size % 2 = 0, '', 'p' || p_partkey), 'type', if(p_size % 10 = 0, 'NOTE', 'EVENT'), 'startTime', {_START}, 'endTime', if(p_size % 13 = 0, '2026-01-01T00:00:00Z', ''), 'address', p_type), 'links', array(named_struct('link', if(p_size % 3 = 0, 'mailto:x', 'https://l.example.com/' || p_partkey), 'title', if(p_size % 4 = 0, ' ' || p_brand || ' · Luma', ''))))",
        "named_struct('posts', items)",
        f"""CASE WHEN p_size % 2 = 0 THEN 'x' ELSE 'p' END || {_ID}, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 11 = 0 THEN '' ELSE p_name || ' Café' END, {_START},
        CASE WHEN p_size % 3 = 0 THEN 'https://posts.example.com/x' ELSE 'https://l.example.com/' END || {_ID}, CASE WHEN p_size % 3 = 0 THEN 'https://posts.example.com/x' ELSE 'https://l.example.com/' END || {_ID}, '', '', p_type, '', CAST(NULL AS BOOLEAN),
        CASE WHEN p_size % 11 = 0 THEN '' ELSE p_name || ' Café' || chr(10) || 'mail [email removed]' END, CAST(NULL AS VARCHAR), 'active'""",
        "CASE WHEN p_size % 10 = 0 OR p_size % 13 = 0 OR p_size % 11 = 0 AND p_size % 4 <> 0 THEN 'event_parse_failed' END", "true",
    ),
    "sessions": (
        Config("America/New_York", "sessions-1", host_id=7, host="Studio"),
        f"named_struct('id', p_partkey, 'hostId', if(p_size % 9 = 0, 8, 7), 'sessionName', {_TITLE}, 'startsAt', {_START}, 'link', 'https://s.example.com/' || p_partkey, 'location', p_type, 'fixedTicketPrice', {_CENTS} / 100D, 'freeEvent', if(p_size % 13 = 0, '@@1@@', if(p_size % 7 = 0, '@@true@@', '@@false@@')), 'capacity', p_size, 'remainingSpots', if(p_size % 2 = 0, '@@true@@', '@@3@@'), 'teacher', 'Bo', 'level', 'All', 'isCancelled', p_size % 5 = 0)",
        "named_struct('payload', items)",
        f"""{_ID}, {_SAID}, {_START}, 'https://s.example.com/' || {_ID}, 'https://s.example.com/' || {_ID}, 'Studio', p_type, '',
        CASE WHEN p_size % 7 = 0 OR p_size % 13 = 0 THEN 'Free' ELSE {_DOLLARS} rtrim(printf('%.2f', {_CENTS} / 100), '0') END END, CASE WHEN p_size % 13 = 0 THEN true ELSE p_size % 7 = 0 END, 'Facilitator: Bo. All',
        CAST(p_size AS VARCHAR) || ' capacity' || CASE WHEN p_size % 2 = 0 THEN '' ELSE '; 3 remaining' END, CASE WHEN p_size % 5 = 0 THEN 'cancelled' ELSE 'active' END""",
        "CASE WHEN p_size % 9 = 0 OR p_size % 11 = 0 OR p_size % 13 = 0 THEN 'event_parse_failed' WHEN p_size % 5 = 0 THEN 'cancelled' END", "true",
    ),
    "list": (
        Config("America/New_York", "list-1", host="Lists"),
        f"named_struct('id', int(p_partkey), 'title', if(p_partkey % 3 = 0, '', {_TITLE}), 'event_name', {_TITLE}, 'event_date', if(p_partkey % 2 = 0, '2026-08-20', ''), 'date', '2026-08-20T00:00', 'time', if(p_size % 13 = 0, 'soon', ' 6:30  pm'), 'venue', p_type, 'borough', p_brand, 'price_range', if(p_size % 2 = 0, 'FREE', if(p_size % 3 = 0, '', '$5')), 'rsvp_link', 'r?x=1', 'one_liner', p_type, 'is_active', p_size % 12 <> 0)",
        "named_struct('events', items)",
        f"""{_ID}, {_SAID}, CASE WHEN p_size % 13 <> 0 THEN '2026-08-20T18:30:00-04:00' END, 'https://feeds.example.com/api/r?x=1', 'https://feeds.example.com/api/r?x=1', 'Lists', p_type, p_type || ', ' || p_brand,
        CASE WHEN p_size % 2 = 0 THEN 'FREE' WHEN p_size % 3 = 0 THEN '' ELSE '$5' END, CASE WHEN p_size % 2 = 0 THEN true WHEN p_size % 3 <> 0 THEN false END, p_type, CAST(NULL AS VARCHAR), 'active'""",
        "CASE WHEN p_size % 12 = 0 THEN 'inactive' WHEN p_size % 11 = 0 OR p_size % 13 = 0 THEN 'event_parse_failed' END", "true",
    ),
}


def rows(spark, folder, family):
    config, entry, body = _FEEDS[family][:3]
    pages = feed_pages(spark, folder, entry, body)
    pages = pages.select("*", F.lit("https://feeds.example.com/").alias("source_listing_url"), F.lit(_BASE).alias("source_url"), F.lit("2026-08-01T06:00:00+00:00").alias("fetched_at"))
    return raw_events(pages, family, config)


def _checked(s, d, family):
    found = check_raw_events(rows(s, d, family).withColumn("raw", F.when(F.col("reason").isNull(), contract_json())))
    return found.select(*_SHOWN, F.when(F.col("reason").isNull(), F.size("problems")).alias("problems"))


def _query(family):
    _, _, _, fields, reason, kept = _FEEDS[family]
    sql = f"SELECT * FROM (SELECT p_brand, {fields}, {reason} FROM part WHERE {kept}) t({', '.join(_SHOWN)})"
    sql = f"SELECT *, CASE WHEN reason IS NULL THEN 0 END AS problems FROM ({sql})"
    return (lambda s, d: _checked(s, d, family)), sql


def _of_pages(s, d):
    """Event nodes of pages, checked against the contract."""
    nodes = x.typed_nodes(x.page_jsonld(ld_pages(s, d)), "Event")
    told = {"source_id": F.lit("pages"), "source_listing_url": F.lit(_BASE), "source_url": F.concat(F.lit("https://parts.example.com/list/"), "page_id"), "fetched_at": F.lit("2026-08-01T06:00:00+00:00"), "content_hash": F.sha2("node", 256)}
    found = jsonld_raw_events(nodes.withColumns(told), Config("America/New_York", "pages-1"), "page_id")
    found = check_raw_events(found.withColumn("raw", F.when(F.col("reason").isNull(), contract_json())))
    return found.select("page_id", *_SHOWN[1:], F.when(F.col("reason").isNull(), F.size("problems")).alias("problems"))


def _change_days(s, d):
    """Every hour of the two days on which the zone's clock changes, as wall times and as instants."""
    text = F.expr("CASE WHEN p_size % 2 = 0 THEN '2026-03-08T' ELSE '2026-11-01T' END || lpad(CAST(p_partkey % 24 AS STRING), 2, '0') || ':30:00' || CASE WHEN p_size % 3 = 0 THEN 'Z' ELSE '' END")
    return localized(s.read.parquet(f"{d}/part.parquet").select("p_partkey", text.alias("start")), "start", "America/New_York")


QUERIES = {
    "scl14_change_days": (
        _change_days,
        """WITH h AS (SELECT p_partkey, p_partkey % 24 AS h, p_size % 2 = 0 AS spring, p_size % 3 = 0 AS instant FROM part),
        o AS (SELECT *, CASE WHEN spring THEN CASE WHEN h < CASE WHEN instant THEN 7 ELSE 3 END THEN 5 ELSE 4 END ELSE CASE WHEN h < CASE WHEN instant THEN 6 ELSE 2 END THEN 4 ELSE 5 END END AS off,
          CASE WHEN spring THEN TIMESTAMP '2026-03-08 00:30:00' ELSE TIMESTAMP '2026-11-01 00:30:00' END + to_hours(CAST(h AS INT)) AS said FROM h)
        SELECT p_partkey, strftime(CASE WHEN instant THEN said - to_hours(CAST(off AS INT)) ELSE said END, '%Y-%m-%dT%H:%M:%S') || '-0' || off || ':00' AS start FROM o""",
    ),
    "ext_contract_jsonld": (
        _of_pages,
        f"""SELECT p_partkey AS page_id, 'https://parts.example.com/e/' || {_ID} AS source_event_id, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END AS title, {_START} AS start, 'https://parts.example.com/e/' || {_ID} AS url,
        'https://t.example.com/' || {_ID} AS signup_url, p_brand AS host, p_type AS venue, {_ID} || ' Street, New York 10001' AS address, '$12.50' AS price, false AS is_free, '' AS description, CAST(NULL AS VARCHAR) AS capacity_flag,
        CASE WHEN p_size % 7 = 0 THEN 'cancelled' ELSE 'active' END AS status, CASE WHEN p_size % 10 = 0 THEN 'missing_title' END AS reason, CASE WHEN p_size % 10 <> 0 THEN 0 END AS problems FROM part""",
    ),
} | {f"ext_contract_{family}": _query(family) for family in _FEEDS}

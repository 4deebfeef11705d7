"""Extraction jobs: stored pages and API payloads to raw event rows, stubs and rejections."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from listingloom.functions import text as t
from listingloom.functions.events import to_local_iso
from listingloom.operators.accounting import count_if
from listingloom.sources.markup import read_page
from listingloom.sources.raw_events import evidence_hash, strip

# --- Pages ------------------------------------------------------------------------------------------------------------


#: Of how many pages the texts and links are in a task's memory at once.
PAGES_AT_ONCE = 64


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, few at a time."""
    for batch in batches:
        yield from (batch.slice(k, PAGES_AT_ONCE) for k in range(0, batch.num_rows, PAGES_AT_ONCE))


def page_contents(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, text (visible nodes, one a line), links (href and text of each closed anchor)."""
    link = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, links = [], []
            for html in batch.column(1).to_pylist():
                nodes, anchors = read_page(html)
                texts.append("\n".join(nodes))
                links.append([{"href": h, "text": x} for h, x in anchors])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(links, link)], [key, "text", "links"])

    rows = pages.select(F.col(key).cast("long").alias(key), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"{key} long, text string, links array<struct<href:string,text:string>>")


_LD = r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""


def page_jsonld(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, pos, json of each JSON-LD block that parses; blank and broken blocks are skipped."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(_LD), F.lit(1))).alias("pos", "json"))
    return blocks.where(F.expr("try_parse_json(json) IS NOT NULL") & (F.trim("json") != ""))


def typed_nodes(blocks: DataFrame, kind: str, key: str = "page_id") -> DataFrame:
    """key, pos, path, node: every object of a type at any depth, outer ones first; matches are searched too."""

    def of_kind(node: dict) -> bool:
        types = node.get("@type")
        return any(isinstance(x, str) and (x == kind or x.endswith("/" + kind)) for x in (types if isinstance(types, list) else [types]))

    def walk(node, path):
        if isinstance(node, dict):
            if of_kind(node):
                yield path, node
            for i, v in enumerate(node.values()):
                yield from walk(v, [*path, i])
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(v, [*path, i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, pos, path, json.dumps(node, ensure_ascii=False)) for k, pos, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for path, node in walk(json.loads(text), [])]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.string()), strict=True)], [key, "pos", "path", "node"])

    return blocks.select(F.col(key).cast("long").alias(key), "pos", "json").mapInArrow(run, f"{key} long, pos int, path array<int>, node string")


def _at(node: str, *paths: str) -> Column:
    """The first of several JSON paths that holds a text that isn't blank."""
    return t.given(*(F.get_json_object(node, p) for p in paths))


def least_price(node: Column | str) -> Column:
    """The smallest price of a node's offers, which may be one object or a list; junk is left out."""
    one = F.array(F.get_json_object(node, "$.offers.price"), F.get_json_object(node, "$.offers.lowPrice"))
    many = F.from_json(F.get_json_object(node, "$.offers"), "array<struct<price:string,lowPrice:string>>")
    listed = F.transform(F.coalesce(many, F.array().cast("array<struct<price:string,lowPrice:string>>")), lambda o: F.coalesce(o["price"], o["lowPrice"]))
    return F.array_min(F.transform(F.concat(one, listed), lambda p: F.regexp_replace(p, "[$,]", "").try_cast("double")))


def jsonld_address(node: str) -> Column:
    """A location's address: text as it is, an object by street, place and country."""
    address = "$.location.address"
    place = F.concat_ws(" ", *(t.given(F.get_json_object(node, f"{address}.{k}")) for k in ("addressLocality", "addressRegion", "postalCode")))
    parts = F.concat_ws(", ", t.given(F.get_json_object(node, f"{address}.streetAddress")), t.given(place), t.given(F.get_json_object(node, f"{address}.addressCountry")))
    whole = F.get_json_object(node, address)
    return F.when(whole.startswith("{"), parts).otherwise(F.coalesce(whole, F.lit("")))


def jsonld_events(nodes: DataFrame, source_id: Column) -> DataFrame:
    """Raw event rows of Event nodes, with reason where a name or start is missing."""
    n = "node"
    kept, price = [c for c in nodes.columns if c != n], F.col("_price")
    # What is asked for more than once is read once a node.
    nodes = t.settled(nodes, _price=least_price(F.col(n)), _name=_at(n, "$.name"), _start=_at(n, "$.startDate"))
    return nodes.select(
        *kept,
        source_id.alias("source_id"),
        F.coalesce("_name", F.lit("")).alias("title"),
        F.coalesce("_start", F.lit("")).alias("start"),
        _at(n, "$.endDate").alias("end"),
        F.coalesce(_at(n, "$.url", "$.@id"), F.lit("")).alias("url"),
        F.coalesce(_at(n, "$.offers.url", "$.offers[0].url"), F.lit("")).alias("signup_url"),
        F.coalesce(_at(n, "$.organizer.name", "$.organizer[0].name"), F.lit("")).alias("host"),
        F.coalesce(_at(n, "$.location.name"), F.lit("")).alias("venue"),
        jsonld_address(n).alias("address"),
        F.when(price == 0, "Free").otherwise(F.coalesce(t.format_price(price), F.lit(""))).alias("price"),
        (price == 0).alias("is_free"),
        F.when(F.coalesce(_at(n, "$.offers.availability", "$.offers[0].availability"), F.lit("")).endswith("SoldOut"), "sold_out").alias("capacity_flag"),
        t.event_status(F.regexp_extract(F.coalesce(_at(n, "$.eventStatus"), F.lit("")), "([A-Za-z]*)$", 1)).alias("status"),
        F.when(F.col("_name").isNull(), "missing_title").when(F.col("_start").isNull(), "missing_start").alias("reason"),
    )


def listing_stubs(nodes: DataFrame, host: str, prefix: str) -> DataFrame:
    """Stubs of ItemList entries on one host under a path, with the date that ends the URL."""
    url = _at("node", "$.url", "$.item.url", "$.item.@id")
    rows = nodes.withColumn("url", url).where(F.regexp_replace(F.expr("try_parse_url(url, 'HOST')"), r"^www\.", "") == host)
    rows = rows.where(F.expr("try_parse_url(url, 'PATH')").startswith(prefix))
    return rows.withColumn("title", F.coalesce(_at("node", "$.name", "$.item.name"), F.lit(""))).withColumn("date_hint", F.regexp_extract("url", r"(\d{4}-\d\d-\d\d)/?$", 1).try_cast("date")).drop("node")


def breadcrumb(node: str, marker: str) -> Column:
    """The name of the first breadcrumb whose target holds marker."""
    items = F.from_json(F.get_json_object(node, "$.itemListElement"), "array<struct<name:string,item:string>>")
    return F.get(F.filter(items, lambda x: x["item"].contains(marker)), F.lit(0))["name"]


def embedded_json(html: Column, script_id: str, path: str) -> Column:
    """The JSON at a path of the document in a script tag with an id; null where there is none or it is broken."""
    body = F.regexp_extract(html, rf"""(?is)<script\b[^>]*id\s*=\s*["']{re.escape(script_id)}["'][^>]*>(.*?)</script\s*>""", 1)
    return F.get_json_object(body, path)


def portable_text(blocks: Column) -> Column:
    """The texts of [{children: [{text}]}] in one line."""
    parsed = F.from_json(blocks, "array<struct<children:array<struct<text:string>>>>")
    texts = F.flatten(F.transform(parsed, lambda b: F.coalesce(F.transform(b["children"], lambda c: c["text"]), F.array().cast("array<string>"))))
    return F.trim(F.regexp_replace(F.array_join(texts, " "), r"\s+", " "))


# --- Feeds ------------------------------------------------------------------------------------------------------------

#: For each provider family: where its entries are, their schema, and the raw fields as SQL over e.
FEEDS: dict[str, tuple[str, str, dict[str, str]]] = {
    "discovery": (
        "entries",
        "api_id string, event struct<api_id:string,name:string,start_at:string,end_at:string,url:string,geo_address_info:struct<city:string,region:string,country:string,full_address:string,address:string>>, calendar struct<name:string>, hosts array<struct<name:string>>, ticket_info struct<price:struct<cents:bigint,currency:string>,is_free:boolean,is_sold_out:boolean,is_near_capacity:boolean>",
        {
            "event_id": "e.event.api_id", "title": "e.event.name", "start": "e.event.start_at", "end": "e.event.end_at", "url": "e.event.url",
            "host": "coalesce(nullif(array_join(filter(transform(e.hosts, h -> h.name), h -> h <> ''), ', '), ''), e.calendar.name)",
            "venue": "e.event.geo_address_info.address", "address": "e.event.geo_address_info.full_address",
            "price": "case when e.ticket_info.is_free then 'Free' when e.ticket_info.price.currency = 'usd' and e.ticket_info.price.cents % 100 = 0 then concat('$', e.ticket_info.price.cents div 100) when e.ticket_info.price.currency = 'usd' then format_string('$%.2f', e.ticket_info.price.cents / 100D) else '' end",
            "is_free": "e.ticket_info.is_free", "capacity_flag": "case when e.ticket_info.is_sold_out then 'sold_out' when e.ticket_info.is_near_capacity then 'limited' end",
            "reason": "case when e.event.geo_address_info.city is not null and e.event.geo_address_info.city not in ('New York', 'Brooklyn', 'Queens', 'Bronx', 'Staten Island', 'Manhattan') then 'outside_city' end",
        },
    ),
    "search": (
        "data",
        "sourceId string, type string, url string, title string, description string, summary string, subtype array<string>, museumLocation struct<name:string>, startDate string, endDate string",
        {
            "event_id": "e.sourceId", "title": "e.title", "start": "e.startDate", "end": "e.endDate", "url": "e.url", "host": "''", "venue": "e.museumLocation.name", "address": "''",
            "price": "case when array_contains(e.subtype, 'Free') then 'Free' else '' end", "is_free": "case when array_contains(e.subtype, 'Free') then true end", "capacity_flag": "cast(null as string)", "reason": "cast(null as string)",
        },
    ),
    "calendar": (
        "events",
        "id bigint, global_id string, status string, title string, description string, start_date string, end_date string, url string, website string, cost string, venue struct<venue:string,address:string,city:string,stateprovince:string,state:string,zip:string,country:string>, organizer string",
        {
            "event_id": "coalesce(e.global_id, cast(e.id as string))", "title": "e.title", "start": "e.start_date", "end": "e.end_date", "url": "e.url",
            "host": "coalesce(get_json_object(e.organizer, '$[0].organizer'), get_json_object(e.organizer, '$.organizer'), '')", "venue": "e.venue.venue",
            "address": "concat_ws(', ', nullif(e.venue.address, ''), nullif(concat_ws(' ', nullif(e.venue.city, ''), nullif(coalesce(e.venue.stateprovince, e.venue.state), ''), nullif(e.venue.zip, '')), ''), nullif(e.venue.country, ''))",
            "price": "e.cost", "is_free": "case when lower(e.cost) in ('free', '0', '$0') then true end", "capacity_flag": "cast(null as string)", "reason": "case when e.status not in ('publish', 'cancelled', 'canceled', 'postponed') then 'unknown_status' end",
        },
    ),
    "city": (
        "city.events",
        "_id string, title string, text string, startTime string, locationString string, city struct<_id:string,name:string>, cancelled boolean, deleted boolean, hosts array<struct<firstName:string,lastName:string>>, rsvpCounts struct<confirmed:int,maybe:int,waitlist:int>",
        {
            "event_id": "e._id", "title": "e.title", "start": "e.startTime", "end": "cast(null as string)", "url": "''",
            "host": "array_join(transform(e.hosts, h -> trim(concat_ws(' ', h.firstName, h.lastName))), ', ')", "venue": "split_part(e.locationString, ',', 1)", "address": "e.locationString",
            "price": "'Free'", "is_free": "true", "capacity_flag": "case when e.rsvpCounts is not null then concat_ws('; ', concat(e.rsvpCounts.confirmed, ' confirmed'), concat(e.rsvpCounts.maybe, ' maybe'), concat(e.rsvpCounts.waitlist, ' waitlist')) end",
            "reason": "case when not (e.city._id <=> get_json_object(body, '$.city._id')) then 'outside_configured_city' when coalesce(e.cancelled, false) or coalesce(e.deleted, false) then 'cancelled_or_deleted' end",
        },
    ),
    "posts": (
        "posts",
        "id string, content string, entity struct<id:string,type:string,url:string,startTime:string,endTime:string,address:string>, links array<struct<link:string,title:string>>",
        {
            "event_id": "coalesce(nullif(e.entity.id, ''), e.id)",
            "title": "coalesce(nullif(trim(regexp_replace(split_part(trim(get(e.links, 0).title), '\\n', 1), ' · Luma$|^Viewcy [|] ', '')), ''), split_part(trim(e.content), '\\n', 1))", "start": "e.entity.startTime", "end": "e.entity.endTime",
            "url": "coalesce(case when e.entity.url rlike '^https?://[^/]+' then e.entity.url end, get(filter(transform(e.links, l -> l.link), l -> l rlike '^https?://[^/]+'), 0), '')",
            "host": "''", "venue": "''", "address": "e.entity.address", "price": "''", "is_free": "cast(null as boolean)", "capacity_flag": "cast(null as string)",
            "reason": "case when e.entity.type <> 'EVENT' then 'not_an_event' when try_to_timestamp(e.entity.endTime) < try_to_timestamp(e.entity.startTime) then 'end_before_start' end",
        },
    ),
    "sessions": (
        "payload",
        "id bigint, hostId int, sessionName string, level string, startsAt string, endsAt string, link string, location string, fixedTicketPrice double, freeEvent boolean, capacity int, ticketsSold int, remainingSpots int, teacher string, isCancelled boolean",
        {
            "event_id": "cast(e.id as string)", "title": "e.sessionName", "start": "e.startsAt", "end": "e.endsAt", "url": "e.link", "host": "coalesce(e.teacher, '')", "venue": "e.location", "address": "''",
            "price": "case when e.freeEvent then 'Free' when e.fixedTicketPrice = floor(e.fixedTicketPrice) then concat('$', cast(e.fixedTicketPrice as bigint)) when e.fixedTicketPrice is not null then format_string('$%.2f', e.fixedTicketPrice) else '' end",
            "is_free": "e.freeEvent", "capacity_flag": "nullif(concat_ws('; ', concat(e.capacity, ' capacity'), concat(e.ticketsSold, ' sold'), concat(e.remainingSpots, ' remaining')), '')",
            "reason": "case when e.id is null or coalesce(trim(e.sessionName), '') = '' or coalesce(trim(e.link), '') = '' or coalesce(e.startsAt, '') = '' or e.freeEvent is null then 'event_parse_failed' when coalesce(e.isCancelled, false) then 'cancelled' end",
        },
    ),
    "list": (
        "events",
        "id int, title string, event_name string, description string, event_date string, date string, event_time string, time string, venue string, neighborhood string, borough string, cost_type string, price_range string, rsvp_url string, rsvp_link string, is_active boolean",
        {
            "event_id": "cast(e.id as string)", "title": "coalesce(nullif(trim(e.title), ''), trim(e.event_name))",
            "start": "concat(coalesce(nullif(e.event_date, ''), e.date), ' ', coalesce(nullif(e.event_time, ''), e.time))", "end": "cast(null as string)",
            "url": "coalesce(nullif(e.rsvp_url, ''), e.rsvp_link)", "host": "''", "venue": "e.venue", "address": "concat_ws(', ', nullif(e.venue, ''), nullif(e.neighborhood, ''), nullif(e.borough, ''))",
            "price": "coalesce(nullif(e.cost_type, ''), e.price_range, '')", "is_free": "case when lower(coalesce(nullif(e.cost_type, ''), e.price_range)) = 'free' then true when coalesce(nullif(e.cost_type, ''), e.price_range, '') <> '' then false end", "capacity_flag": "cast(null as string)",
            "reason": "case when not coalesce(e.is_active, true) then 'inactive' when e.id is null or coalesce(nullif(trim(e.title), ''), trim(e.event_name), '') = '' or coalesce(nullif(e.event_date, ''), e.date, '') = '' or coalesce(nullif(e.event_time, ''), e.time, '') = '' or coalesce(nullif(e.rsvp_url, ''), e.rsvp_link, '') = '' then 'event_parse_failed' end",
        },
    ),
}


def feed_events(payloads: DataFrame, family: str, zone: str | None = None, host_id: int | None = None, subtype: str | None = None, event_page: str = "") -> DataFrame:
    """Raw rows of a provider family's payloads (source_id, page_no, body), in place order (page_no, pos).

    With a zone, starts and ends are given as ISO text with the zone's offset (a date with a 12-hour clock included); what
    can't be read stays as the provider wrote it. Without one all stay so. Sessions of another host than host_id are
    event_parse_failed; of the search family, entries that are no events, or lack the subtype where one is asked for, are left out.
    Events of a city have their page under event_page, where that is given. `raw_events` gives the contract's fields, all of
    them checked.
    """
    where, schema, fields = FEEDS[family]
    entries = F.from_json(F.get_json_object("body", f"$.{where}"), f"array<struct<{_ddl(schema)}>>")
    rows = payloads.select("source_id", "page_no", "body", F.posexplode(entries).alias("pos", "e"))
    if family == "search":
        rows = rows.where(F.col("e.type") == "event")
        rows = rows if subtype is None else rows.where(F.array_contains("e.subtype", subtype))
    made = {name: F.expr(sql) for name, sql in fields.items()}
    if family == "city" and event_page:
        made["url"] = F.concat(F.lit(event_page), F.col("e._id"))
    if family == "posts":
        said = {"post_id": "e.id", "content": "e.content", "entity_id": "e.entity.id", "entity_type": "e.entity.type", "entity_url": "e.entity.url", "start_time": "e.entity.startTime", "end_time": "e.entity.endTime", "address": "e.entity.address", "link_url": "get(e.links, 0).link", "link_title": "get(e.links, 0).title"}
        evidence = {k: strip(F.coalesce(F.expr(path), F.lit(""))) for k, path in said.items()}
        made["content_hash"] = evidence_hash({**evidence, "content": t.redact_contacts(evidence["content"])})
    if family == "sessions" and host_id is not None:
        made["reason"] = F.when(~F.col("e.hostId").eqNullSafe(host_id), "event_parse_failed").otherwise(made["reason"])
    rows = rows.select("source_id", "page_no", "pos", *(c.alias(name) for name, c in made.items()))
    return rows.withColumns({c: local_start(F.col(c), zone) for c in ("start", "end")}) if zone else rows


def local_start(value: Column, zone: str) -> Column:
    """A provider's time as local ISO text, or as it is where it can't be read."""
    clock = F.concat(F.substring(value, 1, 10), F.lit("T"), t.clock12(F.substring(value, 12, 20)), F.lit(":00"))
    return F.coalesce(to_local_iso(value, zone), to_local_iso(clock, zone), value)


def _ddl(schema: str) -> str:
    """Top-level 'name type, ...' as the inside of a struct type."""
    out, depth = [], 0
    for part in re.split(r"(?<=[>a-z]), ", schema):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def page_set_contract(payloads: DataFrame, total: str, number: str, items: str, most: int = 100, cursor: str | None = None) -> DataFrame:
    """(source_id, problem) of feeds whose pages don't agree: totals that change, pages missing or out of place, sums that
    differ, too many pages, cursors that repeat. total, number, items and
    cursor are JSON paths (items: the list; cursor: None for feeds without one; pages without a cursor repeat none)."""
    rows = payloads.select("source_id", "page_no", F.get_json_object("body", total).cast("long").alias("total"), F.get_json_object("body", number).cast("long").alias("number"), F.coalesce(F.size(F.from_json(F.get_json_object("body", items), "array<string>")), F.lit(0)).alias("n"), (F.lit(None).cast("string") if cursor is None else F.nullif(F.get_json_object("body", cursor), F.lit(""))).alias("cursor"))
    per = rows.groupBy("source_id").agg(F.count_distinct("total").alias("totals"), F.max("total").alias("total"), F.sum(F.greatest("n", F.lit(0))).alias("items"), F.count("*").alias("pages"), F.count_distinct("page_no").alias("numbers"), count_if(F.col("number") != F.col("page_no")).alias("misplaced"), F.count("cursor").alias("given"), F.count_distinct("cursor").alias("cursors"))
    rules = F.filter(F.array(
        F.when(F.col("totals") > 1, "total changes"), F.when(F.col("misplaced") > 0, "page number differs"), F.when(F.col("numbers") < F.col("pages"), "page repeats"),
        F.when(F.col("items") != F.col("total"), "items differ from total"), F.when(F.col("pages") > most, "too many pages"), F.when(F.col("cursors") < F.col("given"), "cursor repeats"),
    ), lambda p: p.isNotNull())
    return per.select("source_id", F.explode(rules).alias("problem"))


# --- Stubs, windows, states -------------------------------------------------------------------------------------------


def dedup_stubs(stubs: DataFrame, *keys: str) -> DataFrame:
    """The first stub of each source and key in page and position order."""
    order = Window.partitionBy("source_id", *keys).orderBy("page_no", "pos")
    return stubs.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def repeat_ids(rows: DataFrame, *keys: str) -> DataFrame:
    """(source_id, keys, n) that occur more than once."""
    return rows.groupBy("source_id", *keys).agg(F.count("*").alias("n")).where("n > 1")


def join_details(stubs: DataFrame, details: DataFrame) -> DataFrame:
    """Stubs with their detail page (source_id, url, detail_id, detail_day); reason where it is missing or disagrees."""
    rows = stubs.join(details, ["source_id", "url"], "left")
    reason = F.when(F.col("detail_id").isNull(), "missing_detail").when(F.col("detail_id") != F.col("event_id"), "id_disagrees").when(F.col("detail_day") != F.col("day"), "date_disagrees")
    return rows.withColumn("reason", reason)


def window_route(rows: DataFrame, first: str, days: int, slack: int = 0) -> DataFrame:
    """Rows with reason outside_date_window where their local day isn't within the window (slack days wider)."""
    low, high = F.date_sub(F.lit(first).cast("date"), slack).cast("string"), F.date_add(F.lit(first).cast("date"), days + slack).cast("string")
    day = F.substring("start", 1, 10)
    own = F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("reason", F.coalesce(own, F.when(~day.between(low, high), "outside_date_window")))


def ordering_proof(rows: DataFrame, last_day: str) -> DataFrame:
    """(source_id, ordered, complete): whether starts never go back in scan order, and a page lies wholly past last_day."""
    before = F.lag("start").over(Window.partitionBy("source_id").orderBy("page_no", "pos"))
    marked = rows.withColumn("back", F.coalesce(F.col("start") < before, F.lit(False)))
    pages = marked.groupBy("source_id", "page_no").agg(F.min(F.substring("start", 1, 10)).alias("first_day"), F.bool_or("back").alias("back"))
    per = pages.groupBy("source_id").agg((~F.bool_or("back")).alias("ordered"), F.bool_or(F.col("first_day") > last_day).alias("past"))
    return per.select("source_id", "ordered", (F.col("ordered") & F.col("past")).alias("complete"))


def day_coverage(sections: DataFrame, first: str, days: int) -> DataFrame:
    """(source_id, missing, reached): days of the window without a section, and whether the latest section ends it."""
    spark = sections.sparkSession
    window = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(first).cast("date"), days))).alias("day")).select(F.col("day").cast("string").alias("day"))
    sources = sections.select("source_id").distinct()
    wanted = sources.join(F.broadcast(window))  # a row per source and day of the window
    gaps = wanted.join(sections.select("source_id", "day").distinct(), ["source_id", "day"], "left_anti").groupBy("source_id").agg(F.count("*").alias("missing"))
    last = sections.groupBy("source_id").agg((F.max("day") >= F.date_add(F.lit(first).cast("date"), days).cast("string")).alias("reached"))
    return last.join(gaps, "source_id", "left").fillna(0, ["missing"]).select("source_id", "missing", "reached")


def card_showtimes(cards: DataFrame) -> DataFrame:
    """One row for each showtime of a card (showtimes: array<struct<start, ticket_url>>), its fields carried along."""
    rows = cards.select(*(c for c in cards.columns if c != "showtimes"), F.posexplode("showtimes").alias("show", "s"))
    return rows.select(*(c for c in rows.columns if c != "s"), "s.start", "s.ticket_url", F.concat_ws("-", "film_id", F.regexp_extract("s.ticket_url", r"(\d+)/?$", 1)).alias("event_id"))


def marker_groups(lines: DataFrame) -> DataFrame:
    """Records from lines (section, pos, line): a time opens one, a ticket line closes it, starred notes follow it.

    A ticket line without a time before it in its group is a record of its own, missing_explicit_time; a time without ticket
    or title is unresolved; other lines are nothing. Gives section, record, time, title, ticket, note, reason.
    """
    line = F.trim("line")
    kind = F.when(line.rlike(r"(?i)^\d{1,2}(:\d\d)?\s*[ap]\.?m\.?$"), "time").when(line.rlike(r"(?i)tickets?$"), "ticket").when(line.startswith("*"), "note").when(line == "", "blank").otherwise("title")
    order = Window.partitionBy("section").orderBy("pos")
    marked = lines.withColumn("kind", kind).where("kind <> 'blank'")
    before = F.last(F.when(F.col("kind") != "note", F.col("kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("kind") == "time") | ((F.col("kind") != "note") & F.coalesce(before == "ticket", F.lit(True)))
    marked = marked.withColumn("opens", opens).withColumn("group", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(order))
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", line.alias("v"))))), lambda x: x["v"]), " / ")
    out = marked.groupBy("section", "group").agg(*(text(k).alias(k) for k in ("time", "title", "ticket", "note"))).where("time <> '' or ticket <> ''")
    out = out.withColumn("reason", F.when(F.col("time") == "", "missing_explicit_time").when((F.col("ticket") == "") | (F.col("title") == ""), "unresolved"))
    record = F.row_number().over(Window.partitionBy("section").orderBy("group")).cast("long")
    return out.select("section", record.alias("record"), "time", "title", "ticket", "note", "reason")


_DATE = r"(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day, (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}"


def text_occurrences(rows: DataFrame, text: str = "text") -> DataFrame:
    """Dated mentions with the times that follow each; the end of 'A - B' is left out; no time: missing_explicit_time."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)({_DATE})((?:(?!{_DATE}).)*)"), F.lit(0))
    one = rows.withColumn("parts", parts).select(*rows.columns, "parts", F.posexplode("parts").alias("mention", "part"))
    one = one.withColumn("before", F.get("parts", F.col("mention") - 1)).where(~F.coalesce(F.col("before").rlike(r"\d{4}\s*[-–]\s*$"), F.lit(False)))
    day = F.try_to_timestamp(F.regexp_replace(F.regexp_extract("part", _DATE, 0), r"^\w+, ", ""), F.lit("MMMM d, yyyy")).cast("date").cast("string")
    times = F.regexp_extract_all("part", F.lit(r"(?i)\b(\d{1,2}(?::\d\d)? ?[ap]m)\b"), F.lit(1))
    spread = one.withColumn("day", day).withColumn("times", times).select(*rows.columns, "mention", "day", F.explode_outer("times").alias("time"))
    return spread.withColumn("start", F.concat("day", F.lit("T"), t.clock12(F.col("time")), F.lit(":00"))).withColumn("reason", F.when(F.col("time").isNull(), "missing_explicit_time"))


def fixed_time_occurrences(rows: DataFrame, clock: str, text: str = "text") -> DataFrame:
    """Every dated mention of a text with one start time."""
    dates = F.regexp_extract_all(text, F.lit(_DATE), F.lit(0))
    one = rows.select(*rows.columns, F.posexplode(dates).alias("mention", "date"))
    day = F.try_to_timestamp(F.regexp_replace("date", r"^\w+, ", ""), F.lit("MMMM d, yyyy")).cast("date").cast("string")
    return one.withColumn("start", F.concat(day, F.lit(f"T{clock}:00"))).drop("date")


def calendar_records(records: DataFrame, first: str, days: int) -> DataFrame:
    """Typed calendar records (kind, hidden, start_date, start_time, end_date): programs and classes that are shown, dated
    and not over; outside the window or without a time they carry a reason."""
    last = F.date_add(F.lit(first).cast("date"), days).cast("string")
    rows = records.where(F.col("kind").isin("program", "class") & ~F.coalesce("hidden", F.lit(False)) & F.col("start_date").isNotNull() & (F.coalesce("end_date", "start_date") >= first))
    reason = F.when(F.col("start_date") > last, "outside_date_window").when(F.coalesce("start_time", F.lit("")) == "", "missing_explicit_time")
    return rows.withColumn("start", F.concat_ws("T", "start_date", F.nullif("start_time", F.lit("")))).withColumn("reason", reason)


def weekly_occurrences(evidence: DataFrame, patterns: list[str], weekday: str, clock: str, first: str, days: int) -> DataFrame:
    """Dates of a weekly event in a window, for sources whose text shows every pattern (source_id, text)."""
    last = F.date_add(F.lit(first).cast("date"), days)
    start = F.next_day(F.date_sub(F.lit(first).cast("date"), 1), weekday)
    held = evidence
    for p in patterns:
        held = held.where(F.col("text").rlike(p))
    dates = F.when(start <= last, F.sequence(start, last, F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))
    rows = held.select("source_id", F.explode(dates).alias("d"))
    return rows.select("source_id", F.concat(F.col("d").cast("string"), F.lit(f"T{clock}:00")).alias("start"), F.substring(F.sha2(F.concat_ws("|", "source_id", "d"), 256), 1, 20).alias("event_id"))


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_CLOCK = r"\s+\d{1,2}(?::\d\d)?\s*[AP]M"
_WORDS = rf"(?i)\b((?:{'|'.join(f'{m[:3]}(?:{m[3:]})?' for m in _MONTHS)})\.?)\s+(\d{{1,2}})(?:st|nd|rd|th)?,?(?:\s+(20\d\d))?"
_NUMBERS = r"(?i)\b(\d{1,2})/(\d{1,2})/(20\d\d)"
_PLAIN = r"\b(20\d\d-\d\d-\d\d)\b"


def near_date_hint(text: Column, at: Column, seen: str) -> Column:
    """The last date within 350 characters before a place, else the first within 700 around it, as ISO text.

    Dates in words with a clock come before numbers with a clock, dates in words, and ISO dates; a year that isn't given is
    the one that puts the month within six months of the day `seen`.
    """
    before = F.substring(text, F.greatest(at - 350, F.lit(1)), F.least(at - 1, F.lit(350)))
    around = F.substring(text, F.greatest(at - 700, F.lit(1)), F.lit(1400))
    shapes = (_WORDS + _CLOCK, _NUMBERS + _CLOCK, _WORDS + r"\b", _PLAIN)
    last = [F.try_element_at(F.regexp_extract_all(before, F.lit(p), F.lit(0)), F.lit(-1)) for p in shapes]
    found = F.coalesce(*last, *(F.nullif(F.regexp_extract(around, p, 0), F.lit("")) for p in shapes))
    part = lambda p, i: F.nullif(F.regexp_extract(found, p, i), F.lit(""))
    names = F.array(*(F.lit(m[:3].lower()) for m in _MONTHS))
    month = F.array_position(names, F.lower(F.substring(part(_WORDS, 1), 1, 3))).cast("int")
    year = F.coalesce(part(_WORDS, 3), t.infer_year(month, F.lit(seen).cast("date")).cast("string"))
    iso = lambda *xs: F.concat_ws("-", xs[0], *(F.lpad(x.cast("string"), 2, "0") for x in xs[1:])).try_cast("date").cast("string")
    return F.when(part(_WORDS, 1).isNotNull(), iso(year, month, part(_WORDS, 2))).when(part(_NUMBERS, 1).isNotNull(), iso(part(_NUMBERS, 3), part(_NUMBERS, 1), part(_NUMBERS, 2))).otherwise(part(_PLAIN, 1).try_cast("date").cast("string"))


def split_place(place: Column) -> Column:
    """struct(venue, address) of 'venue, street, city'; pieces without text don't count."""
    parts = F.filter(F.transform(F.split(place, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("venue"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), ", ").alias("address"))


def labelled_field(text: Column, label: str, others: tuple[str, ...] = ()) -> Column:
    """What follows 'label:' up to another of the labels or the line's end."""
    stop = "|".join(re.escape(x) for x in others) or r"(?!)"
    return F.trim(F.regexp_extract(text, rf"(?i)\b{re.escape(label)}:\s*(.*?)(?=\s+(?:{stop}):|[\r\n]|$)", 1))


def explicit_empty(text: Column) -> Column:
    return text.rlike(r"(?i)\bno (upcoming|scheduled|current) (events|shows|screenings|tastings|programs)\b|\bnothing scheduled\b")


def retain_fields(posts: DataFrame, column: str, kept: str) -> DataFrame:
    """A JSON column cut down to the named fields (DDL); nothing else of it is kept."""
    return posts.withColumn(column, F.to_json(F.from_json(column, kept)))


def source_state(rows: DataFrame, planned: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """(source_id, events, rejected, state) from routed rows (source_id, reason); planned sources without rows are empty.

    covered (source_id, ok) says whether an empty window was proven empty.
    """
    bad = F.col("reason").isNotNull() & (F.col("reason") != "outside_date_window")
    per = rows.groupBy("source_id").agg(count_if(F.col("reason").isNull()).alias("events"), count_if(F.col("reason").isNotNull()).alias("rejected"), count_if(bad).alias("invalid"), F.count("*").alias("seen"))
    per = planned.select("source_id").join(per, "source_id", "left").fillna(0)
    if covered is not None:
        per = per.join(covered.select("source_id", "ok"), "source_id", "left")
    ok = F.coalesce("ok", F.lit(False)) if covered is not None else F.lit(False)
    state = F.when(F.col("events") > 0, "ok").when(F.col("invalid") > 0, "validation_failed").when((F.col("seen") > 0) | ok, "empty_verified").otherwise("empty_suspicious")
    return per.select("source_id", "events", "rejected", state.alias("state"))


def failure_state(error: Column) -> Column:
    """The state that an error class of a failed retrieval leaves."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return F.when(e.rlike("robots|denied|forbidden"), "blocked").when(e.rlike("contract|parse|schema|json"), "parse_failed").otherwise("fetch_failed")

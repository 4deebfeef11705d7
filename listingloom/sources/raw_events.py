"""Feeds to the raw-event contract: every entry of a payload gives one row, either all the contract's fields or a reason.

An entry is parsed once, into a VARIANT, and read by typed readers: a value of a wrong kind is a failure, not a null. Rows that
fail keep what could be read, so that a rejection can be shown with its entry.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from listingloom.functions import text as t

#: The contract's fields, in its order.
FIELDS = (
    "title", "start", "end", "url", "signup_url", "host", "venue", "neighborhood", "address", "price", "is_free", "description", "capacity_flag", "status",
    "source_id", "source_listing_url", "source_url", "source_event_id", "fetched_at", "parser_version", "content_hash", "extracted_json",
)
FAILED = "event_parse_failed"


@dataclass(frozen=True)
class Config:
    """What a source's configuration says: its zone and parser, whom it asks for, and where its events have their pages."""

    zone: str
    parser_version: str
    city_id: str = ""
    cities: tuple[str, ...] = ()
    region: str = ""
    countries: tuple[str, ...] = ()
    host_id: int | None = None
    subtype: str | None = None
    host: str = ""
    event_page: str = ""


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def tidy(s: Column) -> Column:
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def join_url(base: Column, url: Column) -> Column:
    """A URL relative to a page's own."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://.*/)[^/]*$", 1)
    folder = F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder)
    return (
        F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), url))
        .when(url.startswith("/"), F.concat(origin, url))
        .otherwise(F.concat(folder, url))
    )


def general(x: Column) -> Column:
    """A number in six significant digits without trailing zeros, for amounts below a million."""
    shown = F.format_string("%.0f", x)
    for digits, most in ((1, 1e5), (2, 1e4), (3, 1e3), (4, 1e2), (5, 1e1)):
        shown = F.when(x < most, F.format_string(f"%.{digits}f", x)).otherwise(shown)
    return F.when(shown.contains("."), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)


@F.pandas_udf(StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: json.dumps(json.loads(s), sort_keys=True, separators=(",", ":")), na_action="ignore")


def evidence_hash(evidence: dict[str, Column]) -> Column:
    """SHA-256 of the named texts as JSON in the order of their names, without spaces, everything beyond ASCII escaped."""
    text = F.to_json(F.struct(*(evidence[k].alias(k) for k in sorted(evidence))))
    odd = text.rlike(r"[^\x00-\x7E]|\\u")
    return F.sha2(F.when(odd, _ascii(F.when(odd, text))).otherwise(text), 256)


class Entry:
    """Typed readers of a VARIANT column.

    What is read more than once, or is long to read, is a column that settle() makes; it must come before whatever uses it. As
    one expression a family's readers are more code than a method may have, and Spark then runs the stage without compiling it.
    """

    #: How many columns are made in one step.
    STEP = 8

    def __init__(self, name: str = "e"):
        self.name = name
        self.bad: list[Column] = []
        self.read: dict[str, tuple[str, Column]] = {}

    def once(self, what: str, made: Callable[[], Column]) -> Column:
        if what not in self.read:
            self.read[what] = (f"_read{len(self.read)}", made())
        return F.col(self.read[what][0])

    def settle(self, rows: DataFrame) -> DataFrame:
        """rows with the columns of all readers asked for until now."""
        columns = list(self.read.values())
        for k in range(0, len(columns), self.STEP):
            rows = t.settled(rows, **dict(columns[k : k + self.STEP]))
        return rows

    def raw(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.name, f"$.{path}", kind)

    def kind(self, path: str) -> Column:
        return self.once(f"kind {path}", lambda: F.coalesce(F.regexp_extract(F.schema_of_variant(self.raw(path, "variant")), "^([A-Z]+)", 1), F.lit("VOID")))

    def expect(self, path: str, *kinds: str) -> None:
        """The entry fails where a value is there and of another kind."""
        self.bad.append(~self.kind(path).isin(*kinds, "VOID"))

    def text(self, *paths: str) -> Column:
        """The first of the paths with a text or number that isn't blank, trimmed; else empty."""
        return self.once(f"text {' '.join(paths)}", lambda: self.plain(*paths))

    def plain(self, *paths: str) -> Column:
        """text() as an expression, for a column that once() makes of it."""
        return F.coalesce(*(F.nullif(strip(self.raw(p, "string")), F.lit("")) for p in paths), F.lit(""))

    def true(self, path: str) -> Column:
        return F.coalesce(self.raw(path, "boolean"), F.lit(False))

    def names(self, path: str, *keys: str) -> Column:
        """The named texts of a list's objects, by comma."""
        one = lambda x: strip(F.concat_ws(" ", *(F.nullif(strip(F.try_variant_get(x, f"$.{k}", "string")), F.lit("")) for k in keys)))
        return self.once(f"names {path} {' '.join(keys)}", lambda: F.array_join(F.filter(F.transform(F.coalesce(self.raw(path, "array<variant>"), F.array().cast("array<variant>")), one), lambda s: s != ""), ", "))

    def objects(self, path: str) -> None:
        """The entry fails where a list is there that is none, or holds anything but objects."""
        self.expect(path, "ARRAY")
        items = self.raw(path, "array<variant>")
        self.bad.append(F.coalesce(F.exists(items, lambda x: ~F.coalesce(F.schema_of_variant(x), F.lit("VOID")).startswith("OBJECT")), F.lit(False)))


Made = tuple[dict[str, Column], list[tuple[Column, str]]]


def _discovery(e: Entry, c: Config) -> Made:
    place = "event.geo_address_info"
    e.expect("ticket_info", "OBJECT")
    e.expect("calendar", "OBJECT")
    e.objects("hosts")
    e.bad.append(e.kind(place) != "OBJECT")
    cents = F.when(e.kind("ticket_info.price.cents") == "BIGINT", e.raw("ticket_info.price.cents", "bigint"))
    usd = (F.lower(e.text("ticket_info.price.currency")) == "usd") & (cents >= 0)
    price = F.when(e.true("ticket_info.is_free"), "Free").when(usd & (cents % 100 == 0), F.concat(F.lit("$"), (cents / 100).cast("bigint").cast("string"))).when(usd, F.format_string("$%.2f", cents / 100)).otherwise("")
    here = F.lower(e.text(f"{place}.city")).isin(*c.cities) & (F.lower(e.text(f"{place}.region")) == c.region) & F.lower(e.text(f"{place}.country")).isin(*c.countries)
    url = e.text("event.url")
    return {
        "source_event_id": e.text("event.api_id"), "title": e.text("event.name"), "start": e.text("event.start_at"), "end": e.text("event.end_at"),
        "url": F.when(url == "", "").otherwise(join_url(F.lit(c.event_page), url)), "host": F.coalesce(F.nullif(e.names("hosts", "name"), F.lit("")), e.text("calendar.name")),
        "venue": e.text(f"{place}.address"), "neighborhood": e.text(f"{place}.sublocality"), "address": e.text(f"{place}.full_address", f"{place}.address"),
        "price": price, "is_free": e.true("ticket_info.is_free"), "capacity_flag": F.when(e.true("ticket_info.is_sold_out"), "sold_out").when(e.true("ticket_info.is_near_capacity"), "limited"),
    }, [((e.kind("event") != "OBJECT") | (e.text("event.api_id") == "") | t.iso_start(e.text("event.start_at")).isNull(), FAILED), (~here, "outside_city")]


def _search(e: Entry, c: Config) -> Made:
    e.expect("museumLocation", "OBJECT")
    e.expect("subtype", "ARRAY")
    kinds = F.coalesce(e.raw("subtype", "array<variant>"), F.array().cast("array<variant>"))
    e.bad.append(F.exists(kinds, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) != "STRING"))
    free = F.array_contains(F.coalesce(e.raw("subtype", "array<string>"), F.array().cast("array<string>")), "Free")
    url = F.when(e.text("url") == "", "").otherwise(join_url(F.col("source_url"), e.text("url")))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*?)/*(?:[?#].*)?$", 1)
    return {
        "source_event_id": F.coalesce(F.nullif(e.text("sourceId"), F.lit("")), path), "title": _clean(e.text("title")), "start": e.text("startDate"), "end": e.text("endDate"), "url": url, "host": F.lit(c.host),
        "venue": _clean(e.text("museumLocation.name")), "price": F.when(free, "Free").otherwise(""), "is_free": F.when(free, True), "description": _clean(e.text("description", "summary")),
        "status": F.when(F.lower(e.text("status")).isin("cancelled", "canceled"), "cancelled").otherwise("active"),
    }, []


def _calendar(e: Entry, c: Config) -> Made:
    e.expect("venue", "OBJECT")
    e.expect("cost", "STRING")
    e.expect("website", "STRING")
    one = e.kind("organizer") == "OBJECT"
    e.bad.append(~e.kind("organizer").isin("OBJECT", "ARRAY", "VOID"))
    e.bad.append(~one & F.coalesce(F.exists(e.raw("organizer", "array<variant>"), lambda x: ~F.coalesce(F.schema_of_variant(x), F.lit("VOID")).startswith("OBJECT")), F.lit(False)))
    locality = F.concat_ws(", ", *(F.nullif(x, F.lit("")) for x in (e.text("venue.city"), e.text("venue.stateprovince", "venue.state", "venue.province"))))
    locality = strip(F.concat_ws(" ", locality, F.nullif(e.text("venue.zip"), F.lit(""))))
    status = F.lower(e.text("status"))
    cost, free = e.text("cost"), F.lower(F.regexp_replace(e.text("cost"), r"[\s.,$€£]", ""))
    url = F.when(e.text("url") == "", "").otherwise(join_url(F.col("source_url"), e.text("url")))
    return {
        "source_event_id": e.text("id", "global_id"), "title": e.text("title"), "start": e.text("start_date"), "end": e.text("end_date"), "url": url,
        "signup_url": F.when(e.text("website") == "", url).otherwise(join_url(F.col("source_url"), e.text("website"))), "host": F.when(one, e.text("organizer.organizer")).otherwise(e.names("organizer", "organizer")),
        "venue": e.text("venue.venue"), "address": F.concat_ws(", ", *(F.nullif(x, F.lit("")) for x in (e.text("venue.address"), locality, e.text("venue.country")))), "price": cost,
        "is_free": F.when(cost != "", free.isin("0", "000", "free", "gratuito", "gratuita")), "description": _clean(e.text("description")),
        "status": F.when(status.isin("cancelled", "canceled", "trash"), "cancelled").when(status == "postponed", "postponed").when(status.isin("publish", "published"), "active"),
    }, []


def _city(e: Entry, c: Config) -> Made:
    counts = [F.concat(e.raw(f"rsvpCounts.{k}", "string"), F.lit(f" {k}")) for k in ("confirmed", "maybe", "waitlist")]
    place, page = e.text("locationString", "formattedAddress"), F.concat(F.lit(c.event_page), e.text("_id"))
    return {
        "source_event_id": e.text("_id"), "title": e.text("title"), "start": e.text("startTime", "startTime_utc"), "end": F.lit(""), "url": F.when(e.text("_id") == "", "").otherwise(page),
        "host": F.coalesce(F.nullif(e.names("hosts", "firstName", "lastName"), F.lit("")), strip(F.concat(F.lit(c.host + " "), e.text("city.name")))), "venue": strip(F.split_part(place, F.lit(","), F.lit(1))), "address": place,
        "price": F.lit("Free"), "is_free": F.lit(True), "description": _clean(e.text("text")),
        "capacity_flag": F.when((e.kind("rsvpCounts") == "OBJECT") & (F.size(F.json_object_keys(F.to_json(e.raw("rsvpCounts", "variant")))) > 0), F.concat_ws("; ", *counts)),
    }, [(e.text("city._id") != c.city_id, "outside_configured_city"), (e.true("deleted") | e.true("cancelled"), "cancelled_or_deleted")]


def _posts(e: Entry, c: Config) -> Made:
    e.bad += [e.kind("entity") != "OBJECT", e.text("entity.type") != "EVENT", e.text("id") == ""]
    content = e.once("content", lambda: t.redact_contacts(e.plain("content")))
    link, title = e.text("links[0].link"), e.text("links[0].title")
    shown = F.when(title.endswith(" · Luma"), strip(F.regexp_replace(title, " · Luma$", ""))).when(title.startswith("Viewcy | "), strip(F.regexp_replace(title, r"^Viewcy \| ", ""))).otherwise(title)
    line = F.coalesce(F.get(F.filter(F.transform(F.split(content, r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]"), strip), lambda s: s != ""), F.lit(0)), F.lit(""))
    valid = lambda u: F.when(u.rlike(r"^https?://[^/?#]+"), u)
    evidence = {
        "post_id": e.text("id"), "content": content, "entity_id": e.text("entity.id"), "entity_type": e.text("entity.type"), "entity_url": e.text("entity.url"), "start_time": e.text("entity.startTime"),
        "end_time": e.text("entity.endTime"), "address": e.text("entity.address"), "link_url": link, "link_title": title,
    }
    return {
        "source_event_id": e.text("entity.id", "id"), "title": F.coalesce(F.nullif(shown, F.lit("")), line), "start": evidence["start_time"], "end": evidence["end_time"],
        "url": F.coalesce(valid(evidence["entity_url"]), valid(link), F.concat(F.lit(c.event_page), e.text("id"))), "host": F.lit(""), "address": evidence["address"], "is_free": F.lit(None).cast("boolean"),
        "description": content, "content_hash": evidence_hash(evidence), "extracted_json": F.to_json(F.struct(*(v.alias(k) for k, v in evidence.items()))),
    }, []


def _sessions(e: Entry, c: Config) -> Made:
    e.bad += [~e.raw("hostId", "bigint").eqNullSafe(F.lit(c.host_id).cast("bigint")), e.kind("freeEvent") != "BOOLEAN"]
    amount = F.when(e.kind("fixedTicketPrice") != "BOOLEAN", e.raw("fixedTicketPrice", "double"))
    count = lambda k, label: F.when(e.kind(k) == "BIGINT", F.concat(e.raw(k, "string"), F.lit(label)))
    teacher = e.text("teacher")
    return {
        "source_event_id": e.text("id"), "title": e.text("sessionName"), "start": e.text("startsAt"), "end": e.text("endsAt"), "url": e.text("link"), "host": F.lit(c.host), "venue": e.text("location"),
        "price": F.when(e.true("freeEvent"), "Free").when(amount.isNotNull(), F.concat(F.lit("$"), general(amount))).otherwise(""), "is_free": e.raw("freeEvent", "boolean"),
        "description": F.when(teacher != "", strip(F.concat(F.lit("Facilitator: "), teacher, F.lit(". "), e.text("level")))).otherwise(e.text("level")),
        "capacity_flag": F.nullif(F.concat_ws("; ", count("capacity", " capacity"), count("ticketsSold", " sold"), count("remainingSpots", " remaining")), F.lit("")),
        "status": F.when(e.true("isCancelled"), "cancelled").otherwise("active"),
    }, []


def _list(e: Entry, c: Config) -> Made:
    clock = t.clock12(e.once("clock", lambda: F.upper(tidy(e.plain("event_time", "time")))))
    day = F.substring(e.text("event_date", "date"), 1, 10)
    cost, link = e.text("cost_type", "price_range"), e.text("rsvp_url", "rsvp_link")
    venue, area, borough = e.text("venue"), e.text("neighborhood"), e.text("borough")
    return {
        "source_event_id": e.text("id"), "title": e.text("title", "event_name"), "start": F.concat(day, F.lit("T"), clock, F.lit(":00")), "end": F.lit(""), "url": F.when(link == "", "").otherwise(join_url(F.col("source_url"), link)),
        "host": F.lit(c.host), "venue": venue, "neighborhood": area, "address": F.concat_ws(", ", *(F.nullif(x, F.lit("")) for x in (venue, area, borough))), "price": cost,
        "is_free": F.when(cost != "", F.lower(cost) == "free"), "description": tidy(e.text("description", "one_liner")),
    }, [(~F.coalesce(e.raw("is_active", "boolean"), F.lit(True)), "inactive")]


def _clean(s: Column) -> Column:
    return t.clean_html(s, 1 << 30)


#: For each provider family: where its entries are, and how one is read. Search feeds hold other things than events too.
FAMILIES: dict[str, tuple[str, Callable[[Entry, Config], Made]]] = {
    "discovery": ("entries", _discovery), "search": ("data", _search), "calendar": ("events", _calendar), "city": ("city.events", _city),
    "posts": ("posts", _posts), "sessions": ("payload", _sessions), "list": ("events", _list),
}


def localized(rows: DataFrame, name: str, zone: str) -> DataFrame:
    """A column of ISO texts as local texts with offset, in steps, so that each is worked out once; null if it can't be read.

    A text without offset is wall time. Of an hour that comes twice it is the first; one that the clock jumps over keeps its
    wall time with the offset before.
    """
    w, m = f"_{name}_wall", f"_{name}_minutes"
    iso = t.iso_start(F.col(name))
    rows = rows.withColumn(name, iso)
    converted = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.date_format(t.instant(F.col(name)), "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    rows = rows.withColumn(w, F.when(t.has_offset(F.col(name)), converted).otherwise(t.wall_time(F.col(name))))
    utc = F.when(t.has_offset(F.col(name)), t.instant(F.col(name))).otherwise(F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(w)).cast("timestamp"))
    rows = rows.withColumn(m, F.timestamp_diff("MINUTE", utc, F.col(w).cast("timestamp")).cast("int"))
    size = F.abs(F.col(m))
    offset = F.concat(F.when(F.col(m) < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    text = F.concat(F.date_format(w, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(w, ".SSSSSS"), r"^\.000000$", ""), offset)
    return rows.withColumn(name, text).drop(w, m)


def raw_events(payloads: DataFrame, family: str, config: Config) -> DataFrame:
    """source_id, page_no, pos, the contract's fields and reason, for each entry of each payload.

    payloads has source_id, page_no, body, source_listing_url, source_url and fetched_at. A payload that can't be parsed, or
    has no list where the entries should be, gives one row of reason payload_parse_failed. An entry that is no object
    (invalid_event in city feeds), one whose title, id, start or URL is missing, whose time can't be read, or one of whose values is of a
    wrong kind gives event_parse_failed; sessions that are cancelled are rejected as such. Times without offset are local.
    """
    where, read = FAMILIES[family]
    e = Entry()
    fields, first = read(e, config)
    entries = F.try_variant_get(F.try_parse_json("body"), f"$.{where}", "array<variant>")
    rows = payloads.select("source_id", "page_no", "source_listing_url", "source_url", "fetched_at", F.sha2("body", 256).alias("_hash"), entries.isNull().alias("_none"), F.posexplode_outer(entries).alias("pos", "e"))
    keep = None
    if family == "search":
        keep = (e.text("type") == "event") & (F.lit(True) if config.subtype is None else F.coalesce(F.array_contains(e.raw("subtype", "array<string>"), config.subtype), F.lit(False)))
    rows = e.settle(rows.where(F.col("_none") | F.col("pos").isNotNull()))
    if keep is not None:
        rows = rows.where(F.col("_none") | keep)
    early = F.when(F.col("_none"), "payload_parse_failed").when(~F.coalesce(F.schema_of_variant("e"), F.lit("VOID")).startswith("OBJECT"), "invalid_event" if family == "city" else FAILED)
    for condition, reason in first:
        early = early.when(F.coalesce(condition, F.lit(True)), reason)
    out = _checked(rows, ["page_no", "pos"], fields, early, e.bad, config, aware=family == "posts")
    if family == "sessions":
        out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("status") == "cancelled", "cancelled")))
    return out


def _checked(rows: DataFrame, keys: list[str], fields: dict[str, Column], early: Column, faults: list[Column], config: Config, aware: bool = False) -> DataFrame:
    """keys, the contract's fields and reason of entries e: what a family doesn't say gets its default, times become local, and
    what is missing, can't be read or is of a wrong kind fails. aware: times must say their offset, an end lie behind its start."""
    plain = {"neighborhood": F.lit(""), "venue": F.lit(""), "address": F.lit(""), "price": F.lit(""), "description": F.lit(""), "capacity_flag": F.lit(None).cast("string"), "status": F.lit("active"), "content_hash": F.col("_hash"), "extracted_json": F.to_json("e"), "parser_version": F.lit(config.parser_version)}
    bad = reduce(lambda a, b: a | F.coalesce(b, F.lit(True)), faults, F.lit(False))
    made = {**plain, **fields}
    url = made.pop("url")
    made.setdefault("signup_url", F.col("url"))
    rows = t.settled(rows, url=url, _early=early, _bad=bad)
    rows = rows.select(*keys, "source_id", "source_listing_url", "source_url", "fetched_at", "url", *(c.alias(k) for k, c in made.items()), "_early", "_bad")
    rows = rows.withColumns({"_start": F.col("start"), "_end": F.col("end")})
    for name in ("start", "end"):
        rows = localized(rows, name, config.zone)
    missing = reduce(lambda a, b: a | b, (F.coalesce(F.col(k), F.lit("")) == "" for k in ("source_event_id", "title", "start", "url", "status")))
    unread = (F.coalesce("_end", F.lit("")) != "") & F.col("end").isNull()
    naive = F.lit(False)
    if aware:
        naive = ~t.has_offset(t.iso_start(F.col("_start"))) | ((F.col("_end") != "") & ~t.has_offset(t.iso_start(F.col("_end")))) | (t.instant(F.col("end")) < t.instant(F.col("start")))
    reason = F.coalesce(F.col("_early"), F.when(F.col("_bad") | missing | unread | F.coalesce(naive, F.lit(False)), FAILED))
    return rows.select(*keys, *FIELDS, reason.alias("reason"))


def jsonld_raw_events(nodes: DataFrame, config: Config, *keys: str) -> DataFrame:
    """keys, the contract's fields and reason, for each Event node of a page.

    nodes has node (JSON), the keys, source_id, source_listing_url, source_url, fetched_at, and content_hash of the page. A
    node without a name gives missing_title, one without a start missing_start, one that can't be read event_parse_failed.
    Offers may be one object or a list; an address text or object; the smallest price counts, sold out are events whose offers
    all are.
    """
    e = Entry()
    none = F.array().cast("array<variant>")
    of = lambda x, k: F.try_variant_get(x, f"$.{k}", "string")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    offers = F.when(e.kind("offers") == "OBJECT", F.array(e.raw("offers", "variant"))).otherwise(F.filter(F.coalesce(e.raw("offers", "array<variant>"), none), lambda x: kind(x).startswith("OBJECT")))
    amount = lambda x, k: F.when(kind(F.try_variant_get(x, f"$.{k}", "variant")) != "BOOLEAN", of(x, k).try_cast("double"))
    price = F.col("_price")
    least = F.array_min(F.transform(F.col("_offers"), lambda x: F.when(of(x, "price").isNotNull(), amount(x, "price")).otherwise(amount(x, "lowPrice"))))
    stock = F.col("_stock")
    said = F.filter(F.transform(F.col("_offers"), lambda x: F.lower(F.coalesce(of(x, "availability"), F.lit("")))), lambda s: s != "")
    sold = (F.size(stock) > 0) & F.forall(stock, lambda s: s.contains("soldout"))
    where = "location.address"
    place = F.concat_ws(", ", *(F.nullif(e.text(f"{where}.{k}"), F.lit("")) for k in ("addressLocality", "addressRegion")))
    place = strip(F.concat_ws(" ", place, F.nullif(e.text(f"{where}.postalCode"), F.lit(""))))
    parts = F.concat_ws(", ", *(F.nullif(x, F.lit("")) for x in (e.text(f"{where}.streetAddress"), place, e.text(f"{where}.addressCountry"))))
    url, status = e.text("url", "@id"), F.lower(e.text("eventStatus"))
    fields = {
        "source_event_id": F.coalesce(F.nullif(e.text("@id", "url"), F.lit("")), F.col("source_url")), "title": e.text("name"), "start": e.text("startDate"), "end": e.text("endDate"),
        "url": F.when(url == "", F.col("source_url")).otherwise(join_url(F.col("source_url"), url)), "signup_url": F.coalesce(F.get(F.filter(F.transform(F.col("_offers"), lambda x: of(x, "url")), lambda u: u != ""), F.lit(0)), F.lit("")),
        "host": F.when(e.kind("organizer") == "OBJECT", e.text("organizer.name")).otherwise(""), "venue": F.when(e.kind("location") == "OBJECT", e.text("location.name")).otherwise(""),
        "address": F.when(e.kind(where) == "STRING", e.text(where)).when(e.kind(where) == "OBJECT", parts).otherwise(""), "price": F.coalesce(t.format_price(price), F.lit("")), "is_free": F.coalesce(price == 0, F.lit(False)),
        "description": e.text("description"), "capacity_flag": F.when(sold, "sold_out").when(F.exists(stock, lambda s: s.contains("limitedavailability")), "limited"),
        "status": F.when(status.rlike("cancell?ed"), "cancelled").when(status.contains("postponed"), "postponed").otherwise("active"),
    }
    early = F.when(e.kind("name").isin("OBJECT", "ARRAY"), FAILED).when(e.text("name") == "", "missing_title").when(e.text("startDate") == "", "missing_start")
    rows = e.settle(nodes.withColumns({"e": F.try_parse_json("node"), "_hash": F.col("content_hash")}))
    rows = t.settled(t.settled(rows, _offers=offers), _price=least, _stock=said)
    return _checked(rows, list(keys), fields, early, e.bad, config)


def contract_json() -> Column:
    """A row of raw_events as the contract's JSON, its entry inside as it came."""
    return F.to_json(F.struct(*(F.try_parse_json("extracted_json").alias(c) if c == "extracted_json" else F.col(c) for c in FIELDS)), {"ignoreNullFields": "false"})

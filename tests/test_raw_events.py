import hashlib
import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from listingloom.functions import text as t
from listingloom.sources import raw_events as r
from listingloom.sources.extract import feed_events


def post(content, title="Talk", end="", **entity):
    return {"id": "1", "content": content, "entity": {"id": "e", "type": "EVENT", "startTime": "2026-08-02T23:30:00Z", "endTime": end, "address": "1 Main", **entity}, "links": [{"link": "https://x.org/1", "title": title}]}


CONFIG = r.Config("America/New_York", "v1", event_page="https://p.org/")


def read(spark, family, bodies, config=CONFIG):
    rows = [("s", k, b if isinstance(b, str) else json.dumps(b), "https://l.org/", "https://l.org/api/x?y", "2026-08-01T00:00:00Z") for k, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "source_id string, page_no long, body string, source_listing_url string, source_url string, fetched_at string")
    return sorted(r.raw_events(df, family, config).collect(), key=lambda x: (x.page_no, x.pos or 0))


def test_evidence_is_hashed_as_python_writes_it(spark):
    contents = ["plain", "Café — mail me@x.org or call 212 555 1234", 'quote " \\ slash / tab\tend', "emoji 😀\n\x01"]
    rows = read(spark, "posts", [{"posts": [post(c) for c in contents]}])
    shown = ["plain", "Café — mail [email removed] or call [phone removed]", contents[2], contents[3].strip()]
    wanted = []
    for c in shown:
        evidence = {"post_id": "1", "content": c, "entity_id": "e", "entity_type": "EVENT", "entity_url": "", "start_time": "2026-08-02T23:30:00Z", "end_time": "", "address": "1 Main", "link_url": "https://x.org/1", "link_title": "Talk"}
        wanted.append(hashlib.sha256(json.dumps(evidence, sort_keys=True, separators=(",", ":")).encode()).hexdigest())
    assert [x.content_hash for x in rows] == wanted
    df = spark.createDataFrame([("s", 0, json.dumps({"posts": [post(c) for c in contents]}))], "source_id string, page_no long, body string")
    assert [x.content_hash for x in feed_events(df, "posts").orderBy("pos").collect()] == wanted


def test_reasons(spark):
    bodies = [
        "not json", {"other": []}, {"posts": {}}, {"posts": []},
        {"posts": [5, {"id": "1"}, post("x"), post("x", end="2026-08-02T20:00:00Z"), post("x", startTime="2026-08-02T20:00:00"), post("", title=""), post("x", type="NOTE"), post("x", startTime="20260802T193000-0400")]},
    ]
    rows = read(spark, "posts", bodies)
    assert [(x.page_no, x.reason) for x in rows] == [(0, "payload_parse_failed"), (1, "payload_parse_failed"), (2, "payload_parse_failed")] + [(4, r.FAILED)] * 2 + [(4, None)] + [(4, r.FAILED)] * 4 + [(4, None)]
    assert {x.start for x in rows if x.reason is None} == {"2026-08-02T19:30:00-04:00"}
    city = read(spark, "city", [{"city": {"events": [None, [], {"_id": "1", "city": {"_id": "c"}}]}}], r.Config("America/New_York", "v", city_id="c"))
    assert [x.reason for x in city] == ["invalid_event", "invalid_event", r.FAILED]


def test_times_around_the_change_of_the_clock(spark):
    entry = lambda start: {"id": 5, "hostId": 1, "sessionName": "a", "link": "https://x.org", "freeEvent": True, "startsAt": start}
    starts = ["2026-11-01T05:30:00Z", "2026-11-01T06:30:00Z", "2026-03-08T06:59:59.25Z", "2026-03-08T07:00:00Z", "2026-07-01", "2026-W31-6T18:00", "no", ""]
    rows = read(spark, "sessions", [{"payload": [entry(s) for s in starts]}], r.Config("America/New_York", "v", host_id=1))
    assert [x.start for x in rows] == ["2026-11-01T01:30:00-04:00", "2026-11-01T01:30:00-05:00", "2026-03-08T01:59:59.250000-05:00", "2026-03-08T03:00:00-04:00", "2026-07-01T00:00:00-04:00", "2026-08-01T18:00:00-04:00", None, None]
    assert [x.reason for x in rows] == [None] * 6 + [r.FAILED] * 2


def test_addresses_and_amounts(spark):
    pairs = [("https://a.org/x/y?q", u) for u in ("z", "/z", "//b.org/z", "https://c.org/z", "z?u=1", "mailto:x")] + [("https://a.org", "z"), ("https://a.org/", "z/w")]
    got = spark.createDataFrame(pairs, "b string, u string").select(r.join_url(F.col("b"), F.col("u")).alias("x")).collect()
    assert [x.x for x in got] == [urljoin(b if b.count("/") > 2 else b + "/", u) for b, u in pairs]
    amounts = [0.0, 5.0, 12.5, 12.25, 99.99, 1234.5, 12345.67, 100.0, 250000.0, 0.125]
    got = spark.createDataFrame([(a,) for a in amounts], "a double").select(r.general(F.col("a")).alias("x")).collect()
    assert [x.x for x in got] == [f"{a:g}" for a in amounts]


@pytest.mark.parametrize(("url", "canon"), [("x.org/a?u=http://y.org/b", "x.org/a?u=http%3a%2f%2fy.org%2fb"), ("https://www.x.org/a/?u=http://y.org", "x.org/a?u=http%3a%2f%2fy.org"), ("x.org/a#://", "x.org/a"), ("HTTP://X.org", "x.org")])
def test_only_a_scheme_at_the_front_is_dropped(spark, url, canon):
    assert spark.createDataFrame([(url,)], "u string").select(t.canon_url(F.col("u")).alias("c")).first().c == canon


@pytest.mark.parametrize(("text", "iso"), [("2026-08-20", "2026-08-20T00:00:00"), ("20260820T183000-0400", "2026-08-20T18:30:00-04:00"), ("2026-08-20 18:30Z", "2026-08-20T18:30:00+00:00"), (" 2026-08-20T18:30:00.5 ", "2026-08-20T18:30:00.500000"), ("2026-W34-4", "2026-08-20T00:00:00"), ("2026-02-30", None), ("20 Aug", None), ("", None), ("2026-08-20T18:30+25:00", None)])
def test_starts_in_every_iso_form(spark, text, iso):
    assert spark.createDataFrame([(text,)], "s string").select(t.iso_start(F.col("s")).alias("i")).first().i == iso


def test_event_nodes_in_every_shape(spark):
    full = {"name": "A", "startDate": "2026-08-02T19:00", "url": "/e/1", "location": {"name": "Hall", "address": {"streetAddress": "1 Main", "addressLocality": "NYC", "addressRegion": "NY", "postalCode": 10001, "addressCountry": "US"}}}
    nodes = [
        full | {"offers": {"price": "0"}}, full | {"offers": [{"price": None, "lowPrice": 20}, {"price": True}, "x", {"price": "12.5", "url": "https://t.org", "availability": "https://schema.org/SoldOut"}]},
        full | {"offers": [{"availability": "SoldOut"}, {"availability": "x/LimitedAvailability"}], "location": {"address": " text "}, "organizer": [1], "eventStatus": "https://schema.org/EventPostponed"},
        {"name": "", "startDate": "2026-08-02"}, {"name": "A"}, {"name": {"x": 1}, "startDate": "2026-08-02"}, {"name": "A", "startDate": "soon"}, {"name": "A", "startDate": "2026-08-02", "endDate": "later"},
    ]
    rows = [(k, json.dumps(n), "s", "https://l.org", "https://l.org/page", "2026-08-01T00:00:00Z", "h") for k, n in enumerate(nodes)]
    df = spark.createDataFrame(rows, "k long, node string, source_id string, source_listing_url string, source_url string, fetched_at string, content_hash string")
    got = r.jsonld_raw_events(df, CONFIG, "k").orderBy("k").collect()
    assert [x.reason for x in got] == [None, None, None, "missing_title", "missing_start", r.FAILED, r.FAILED, r.FAILED]
    assert [(x.price, x.is_free, x.capacity_flag, x.signup_url) for x in got[:3]] == [("$0", True, None, ""), ("$12.50", False, "sold_out", "https://t.org"), ("", False, "limited", "")]
    assert [(x.address, x.venue, x.url, x.status) for x in got[1:3]] == [("1 Main, NYC, NY 10001, US", "Hall", "https://l.org/e/1", "active"), ("text", "", "https://l.org/e/1", "postponed")]
    assert got[0].start == "2026-08-02T19:00:00-04:00" and json.loads(got[0].extracted_json) == nodes[0]


@pytest.mark.parametrize("family", ["list", "discovery"])
def test_the_readers_of_a_family_compile(spark, capsys, family):
    """As one expression they were more code than a method may have (64 KB), and their stage ran without being compiled."""
    text = F.col("id").cast("string")
    payloads = spark.range(1).select(F.col("id").alias("page_no"), *(text.alias(c) for c in ("source_id", "body", "source_listing_url", "source_url", "fetched_at")))
    r.raw_events(payloads, family, CONFIG).explain("codegen")
    shown = capsys.readouterr().out
    assert "maxMethodCodeSize:" in shown and "maxMethodCodeSize:-1" not in shown

import datetime
import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from listingloom.functions import events as e
from listingloom.functions import text as t
from listingloom.operators import contract, resolve, updates
from listingloom.operators.checks import check_catalog, plan_run
from listingloom.plans import views
from listingloom.sources import extract, tables


def values(spark, function, *rows, names="abcdef"):
    width = len(rows[0]) if isinstance(rows[0], tuple) else 1
    data = [r if isinstance(r, tuple) else (r,) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + ", ".join(f"{n} string" for n in names[:width]))
    return [r.v for r in df.select("i", function(*(F.col(n) for n in names[:width])).alias("v")).orderBy("i").collect()]


def test_norm_text(spark):
    assert values(spark, t.norm_text, "Pétanque Night", "Straße ﬁlm №5", None, "  A--b ") == ["pe tanque night", "stra e film no5", "", "a b"]


def test_series_key(spark):
    got = values(spark, lambda a: t.series_key(F.lit("S"), F.lit("Host"), a), "Reading Rhythms Harlem: July 29th", "Reading Rhythms Harlem: August 12th", "Fri 12", "Tuesday Jam part IV 2026")
    assert got == ["s|host|reading rhythms harlem"] * 2 + ["s|host|fri 12", "s|host|tuesday jam"]


def test_canon_url(spark):
    got = values(spark, t.canon_url, "https://www.astorwines.com/event.aspx?utm_source=email&eid=ABC-123", "https://lu.ma/Abc/#x", "a.org/x?b=2&a=1&fbclid=9", "https://a.org/é?q=a b&q=~", " ", None, "http://WWW.A.org/", "a.org/p?x", "https://a.org/p?x=1=2")
    assert got == ["astorwines.com/event.aspx?eid=abc-123", "luma.com/abc", "a.org/x?a=1&b=2", "a.org/é?q=a+b&q=~", "", "", "a.org", "a.org/p?x=", "a.org/p?x=1%3d2"]


def test_is_event_url(spark):
    got = values(spark, t.is_event_url, "astorwines.com/event.aspx?eid=abc-123", "example.com/calendar?view=month", "a.org/x", "a.org/jazz-night", "a.org", "", None, "a.org/e/12", "a.org/x?film_id=3", "a.org/events.html")
    assert got == [True, False, False, True, False, False, False, True, True, False]


def test_times(spark):
    got = values(spark, t.minutes_apart, ("2026-08-01T20:00:00-04:00", "2026-08-02T00:10:00Z"), ("2026-08-01T20:00", "2026-08-01T20:30:00+02:00"), ("2026-08-01", "2026-08-01 01:00"), ("x", "2026-08-01"), ("2026-8-1", "2026-08-01"))
    assert got == [10.0, 30.0, 60.0, None, None]
    assert values(spark, t.local_day, "2026-08-01T20:15:00-04:00", "2026-02-30", "soon") == ["2026-08-01", None, None]
    assert values(spark, lambda a: t.quarter_hour(t.wall_time(a)), "2026-08-01T20:44:59-04:00") == ["2026-08-01T20:30:00"]
    assert values(spark, lambda a: e.to_local_iso(a, "America/New_York"), "2026-08-20T22:00:00.000Z", "2026-01-05T09:30", "2026-08-20T22:00:00.250Z", "bad") == ["2026-08-20T18:00:00-04:00", "2026-01-05T09:30:00-05:00", "2026-08-20T18:00:00.250000-04:00", None]
    assert values(spark, t.clock12, "7 PM", "12:05 am", "19:30", "6:30 p.m.", "noon") == ["19:00", "00:05", "19:30", "18:30", None]
    assert values(spark, e.datetime_from_slug, "https://n.com/show-8-20-26-700-pm", "https://n.com/show") == ["2026-08-20T19:00:00", None]


def test_event_key(spark):
    got = values(spark, lambda u, s: t.event_key(u, s, F.lit("Hall"), F.lit("Area"), F.lit("A Title")), ("https://a.org/jazz-night", "2026-08-01T20:44:00-04:00"), ("https://a.org/", "2026-08-01T20:44:00"), ("", "soon"))
    assert got == ["u:a.org/jazz-night|2026-08-01T20:30:00-04:00", "v:hall|2026-08-01T20:30:00|a title", "v:hall|nodate|a title"]
    assert values(spark, t.make_id, "u:a") == [hashlib.sha1(b"u:a").hexdigest()[:12]]


def test_similarity_is_not_symmetric(spark):
    assert values(spark, t.text_similarity, ("tide", "diet"), ("diet", "tide"), ("a", ""), ("same", "same")) == [0.25, 0.5, 0.0, 1.0]
    assert values(spark, lambda a, b: t.text_similarity(a, b, 0.9), ("abc", "abcdefgh")) == [0.0]


def test_money_ages_states(spark):
    assert values(spark, lambda a: t.format_price(a.cast("double")), "25", "12.5") == ["$25", "$12.50"]
    assert values(spark, lambda a: e.offer_price_range(F.split(a, ","), F.lit("USD")), "10,25.5,10", "0,0.00", "x", "7") == ["$10–$25.50", "Free", "", "$7"]
    assert values(spark, t.free_state, "Free", "not free", "$12", "", None) == [True, False, False, None, None]
    assert values(spark, t.event_status, "https://schema.org/EventCancelled", "Postponed", "confirmed", None, "odd") == ["cancelled", "postponed", "active", "active", None]
    assert [tuple(v) for v in values(spark, t.age_range, "Ages 25-35 only", "21+ please", "All ages", "Aug 21-23 Trip", "ages 12-15")] == [(25, 35, "25-35"), (21, None, "21+"), (None, None, "All ages"), (None, None, ""), (None, None, "")]
    assert values(spark, lambda a: e.capacity_flag(F.split(a, ",")), "http://s/SoldOut,SoldOut", "InStock,SoldOut", "InStock") == ["sold_out", "limited", None]
    assert values(spark, extract.failure_state, "RobotsDenied", "ContractError", "Timeout", None) == ["blocked", "parse_failed", "fetch_failed", "fetch_failed"]


def test_texts(spark):
    assert values(spark, t.clean_html, "<p>a &amp; b</p>\n<br>c", "x") == ["a & b c", "x"]
    assert values(spark, t.redact_contacts, "mail A.b@c.org or (212) 555-1234 now", "12345678901234") == ["mail [email removed] or [phone removed] now", "12345678901234"]
    assert values(spark, t.redact_contacts, "2125551234 josé@x.org +1 212-555-1234") == ["2125551234 [email removed] [phone removed]"]
    assert values(spark, e.preview_title, "\n\n Run Club · Luma\nmore", "Viewcy | Salon", "Jazz | Blues Night", "") == ["Run Club", "Salon", "Jazz | Blues Night", ""]
    assert values(spark, lambda a: e.section_between(a, "About", ("Tickets", "Where")), "x\nAbout\n one\n\ntwo\nTickets\n$5", "none") == ["one\ntwo", ""]
    assert values(spark, lambda a: e.theme(a, e.THEME_RULES, "other"), "Wine tasting", "Pétanque at dusk", "Nothing", "Concert film") == ["🍷", "⚽", "other", "🎬"]
    assert values(spark, lambda a: e.event_theme(a, more={"🎉": "salon"}), "Salon at noon", "Noon") == ["🎉", "✨"]
    assert values(spark, lambda a: extract.labelled_field(a, "Place", ("Date", "For a fee")), "Date: May 1 Place: Hall, 5 Main St For a fee: $5", "x") == ["Hall, 5 Main St", ""]
    assert values(spark, extract.explicit_empty, "There are no upcoming events.", "Upcoming events") == [True, False]
    assert values(spark, e.same_page, ("https://www.a.org/x/", "http://a.org/x"), ("https://a.org/x", "https://a.org/y"), ("bad", "bad")) == [True, False, False]


def test_text_occurrences(spark):
    text = "Saturday, September 19, 2026 12:00 PM Saturday, September 26, 2026 12:00 PM\nFriday, September 18, 2026 - Sunday, September 20, 2026"
    rows = extract.text_occurrences(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("mention").collect()
    assert [(r.day, r.start, r.reason) for r in rows] == [("2026-09-19", "2026-09-19T12:00:00", None), ("2026-09-26", "2026-09-26T12:00:00", None), ("2026-09-18", None, "missing_explicit_time")]


def test_marker_groups(spark):
    lines = ["7:30 PM", "First Film", "Second Film", "Hall – Tickets", "*with intro", "", "Stray – Tickets", "9 PM", "Late Film"]
    rows = extract.marker_groups(spark.createDataFrame([("d1", i, x) for i, x in enumerate(lines)], "section string, pos int, line string")).orderBy("record").collect()
    assert [(r.record, r.title, r.ticket, r.reason) for r in rows] == [(1, "First Film / Second Film", "Hall – Tickets", None), (2, "", "Stray – Tickets", "missing_explicit_time"), (3, "Late Film", "", "unresolved")]
    lines = ["7:30 PM", "A", "Hall - Tickets", "Stray film", "Barn - Tickets", "closing words"]
    rows = extract.marker_groups(spark.createDataFrame([("d1", i, x) for i, x in enumerate(lines)], "section string, pos int, line string")).orderBy("record").collect()
    assert [(r.record, r.title, r.ticket, r.reason) for r in rows] == [(1, "A", "Hall - Tickets", None), (2, "Stray film", "Barn - Tickets", "missing_explicit_time")]
    lines = ["7:30 PM", "First Film", "Second Film", "Hall – Tickets", "*with intro"]
    rows = extract.marker_groups(spark.createDataFrame([("d1", i, x) for i, x in enumerate(lines)], "section string, pos int, line string")).collect()
    assert rows[0].note == "*with intro"


def test_weekly_occurrences(spark):
    text = spark.createDataFrame([("club", "Join us every Friday at 7 pm. Address: 1 Road."), ("other", "closed")], "source_id string, text string")
    rows = extract.weekly_occurrences(text, ["(?i)every friday", "(?i)address"], "FR", "19:00", "2026-08-10", 12).orderBy("start").collect()
    assert [(r.source_id, r.start) for r in rows] == [("club", "2026-08-14T19:00:00"), ("club", "2026-08-21T19:00:00")] and len({r.event_id for r in rows}) == 2


def test_provider_payloads(spark):
    feed = {"entries": [{"api_id": "c", "event": {"api_id": "e1", "name": "A", "start_at": "2026-08-20T22:00:00Z", "geo_address_info": {"city": "Boston"}}, "hosts": [{"name": "X"}, {"name": "Y"}], "ticket_info": {"price": {"cents": 2500, "currency": "usd"}, "is_free": False, "is_near_capacity": True}}]}
    city = {"city": {"_id": "nyc", "events": [{"_id": "r", "title": "Run", "startTime": "2026-08-15T06:45:00-04:00", "locationString": "Park, 5 Ave", "city": {"_id": "nyc"}, "rsvpCounts": {"confirmed": 4, "maybe": 3, "waitlist": 0}}, {"_id": "d", "title": "D", "deleted": True, "city": {"_id": "nyc"}}, {"_id": "o", "title": "O", "deleted": True}]}}
    bodies = spark.createDataFrame([("f", 1, json.dumps(feed)), ("c", 1, json.dumps(city))], "source_id string, page_no int, body string")
    one = extract.feed_events(bodies.where("source_id = 'f'"), "discovery").first()
    assert (one.price, one.capacity_flag, one.host, one.reason) == ("$25", "limited", "X, Y", "outside_city")
    two = extract.feed_events(bodies.where("source_id = 'c'"), "city").orderBy("pos").collect()
    assert [(r.venue, r.capacity_flag, r.reason) for r in two] == [("Park", "4 confirmed; 3 maybe; 0 waitlist", None), (None, None, "cancelled_or_deleted"), (None, None, "outside_configured_city")]


def test_page_contents(spark):
    html = "<p>Hi <b>you</b></p><script>no</script><a href='/x'>go  on</a><a href='/y'>never closed"
    row = extract.page_contents(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").first()
    assert row.text == "Hi\nyou\ngo on\nnever closed" and [tuple(x) for x in row.links] == [("/x", "go on")]


def test_contract(spark):
    good = {k: ("x" if v.startswith("STRING") else None) for k, v in contract.REQUIRED.items()} | {"start": "2026-08-01T20:00:00-04:00", "fetched_at": "2026-08-01T20:00:00Z", "status": "active", "end": None, "capacity_flag": None}
    rows = [good, {k: v for k, v in good.items() if k != "title"} | {"extra": 1}, good | {"title": 5, "start": "2026-08-01T20:00:00", "status": "odd"}, [1]]
    got = [r.problems for r in contract.check_raw_events(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, raw string")).orderBy("i").collect()]
    assert got == [[], ["title: missing", "unknown: extra"], ["title: wrong kind", "start: not a time with offset", "status: unknown"], ["not an object"]]


def test_catalog_files_and_staging(spark, tmp_path):
    catalog = {"retrieval_profiles": {"page": {"primary": {"method": "http", "recipe": "p1"}, "required_fields": ["title"], "empty_signal": "none"}}, "sources": [{"id": "a", "title": "A", "url": "u", "retrieval_profile": "page"}, {"id": "b", "enabled": False, "retrieval_profile": "gone"}], "inbox_sources": {"priority": 2, "retrieval_profile": "page", "items": [{"id": "i", "title": "I"}]}}
    (tmp_path / "catalog.json").write_text(json.dumps(catalog))
    sources, profiles, inbox = tables.read_catalog(spark, f"{tmp_path}/catalog.json")
    assert [(r.id, r.enabled) for r in sources.orderBy("id").collect()] == [("a", True), ("b", False)]
    assert profiles.first().recipe == "p1" and inbox.first().priority == 2
    problems = check_catalog(sources.withColumnRenamed("retrieval_profile", "profile"), profiles).collect()
    assert sorted((r.id, r.problem) for r in problems) == [("b", "disabled without reason"), ("b", "missing profile gone")]
    health = spark.createDataFrame([("a", "parse_failed")], "source_id string, state string")
    plan = plan_run(views.all_sources(sources.withColumnRenamed("retrieval_profile", "profile"), inbox), health, profiles).collect()
    assert sorted((r.source_id, r.audit, r.detail) for r in plan) == [("a", True, "retry after parse_failed"), ("i", False, "mail connector unavailable")]
    for body, want in (('[{"title": "x"}]', 1), ('{"run": {}, "events": [{"title": "x"}, {}]}', 2)):
        (tmp_path / "payload.json").write_text(body)
        assert tables.read_crawl_payload(spark, f"{tmp_path}/payload.json").events.count() == want
    staged = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "run_id string, source_id string, n int")
    tables.write_staged(staged, f"{tmp_path}/staged")
    tables.write_staged(spark.createDataFrame([("r", "a", 9)], "run_id string, source_id string, n int"), f"{tmp_path}/staged")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/staged").collect()) == [2, 9]


def test_responses(spark):
    rows = spark.createDataFrame([(1, bytearray("é".encode()), None), (2, bytearray("é".encode("latin-1")), "text/html; charset=ISO-8859-1"), (3, bytearray(b"a\xffb"), "text/html")], "i int, body binary, content_type string")
    got = [r.text for r in tables.decode_responses(rows).orderBy("i").collect()]
    assert got == ["é", "é", "a�b"]


def test_aliases_and_ranks(spark):
    old = spark.createDataFrame([("e1", "a.org/jazz-night", "https://a.org/jazz-night", "", "2026-07-05", "2026-07-05")], "event_id string, canonical_url string, url string, source_id string, first_seen string, last_seen string")
    new = spark.createDataFrame([("e1", "http://www.a.org/jazz-night?utm_a=1", "s1", "2026-08-01"), ("e1", "https://a.org/calendar", "s1", "2026-08-01"), ("e2", "https://t.io/?id=4", None, "2026-08-02")], "event_id string, url string, source_id string, seen string")
    got = sorted(tuple(r) for r in updates.upsert_aliases(old, new).collect())
    assert got == [("e1", "a.org/jazz-night", "http://www.a.org/jazz-night?utm_a=1", "s1", "2026-07-05", "2026-08-01", False)] 


def event(**more):
    base = dict.fromkeys(resolve.FIELDS, "") | {"is_free": None, "age_min": None, "age_max": None, "end": None, "capacity_flag": None, "status": "active", "start": "2026-08-01T20:00:00-04:00", "title": "Night Market", "host": "Anna", "first_seen": "2026-07-01", "last_seen": "2026-07-01"}
    return base | more


def staged(n, id, keys=(), **more):
    own = event(id=id, **more) | {"n": n, "raw_keys": list(keys)}
    own["canon_url"] = own["url"].split("://")[-1] or None
    own["canon_signup"] = own["signup_url"].split("://")[-1] or None
    return own


def stored(id, **more):
    return {k: v for k, v in staged(0, id, **more).items() if k not in ("n", "raw_keys")}


def test_replay_rules():
    # Two venues and addresses that differ veto a match of title, host and time.
    store = resolve.Replay([stored("a", venue="North Hall", address="1 First Street")], [])
    assert store.take(staged(1, "b", venue="South Barn", address="99 Other Road"), "2026-08-01") == ("b", "new")
    # An alias through the signup URL merges whatever else differs; a second sighting in the run is a duplicate.
    store = resolve.Replay([stored("a", url="https://v.org/jazz-night")], [{"event_id": "a", "canonical_url": "v.org/jazz-night", "url": "https://v.org/jazz-night", "source_id": "", "first_seen": "2026-07-01", "last_seen": "2026-07-01"}])
    assert store.take(staged(1, "b", url="https://agg.org/listing-9", signup_url="https://v.org/jazz-night", title="Else", host="Other"), "2026-08-01") == ("a", "updated")
    assert store.take(staged(2, "c", url="https://v.org/jazz-night", title="Else"), "2026-08-01")[1] == "duplicate"
    assert len(store.aliases) == 2 and store.events["a"]["title"] == "Night Market"
    # The same source clears fields that it names.
    store = resolve.Replay([stored("a", source_id="s", age_min=21)], [])
    assert store.take(staged(1, "a", keys=["age_min"], source_id="s"), "2026-08-01") == ("a", "updated") and store.events["a"]["age_min"] is None
    # No context in common: another event.
    store = resolve.Replay([stored("a", venue="North Hall")], [])
    assert store.take(staged(1, "b", host="Zed"), "2026-08-01") == ("b", "new")
    assert store.take(staged(2, "c", start=""), "2026-08-01") == (None, "rejected")


def test_local_day_and_ranks(spark):
    rows = spark.createDataFrame([("a", "2026-08-01T20:15:00-04:00", "high"), ("b", "2026-08-02T01:00:00+02:00", None), ("c", "2026-08-02T20:00:00-04:00", "low")], "id string, start string, rank string").selectExpr("*", "'active' status", "'s' source_id", "'T' title")
    assert [r.id for r in views.upcoming(rows, "2026-08-02", 5).collect()] == ["b", "c"]
    assert [views.events_between(rows, "2026-08-01", "2026-08-09", floor).count() for floor in ("low", "medium", "high", None)] == [2, 1, 1, 3]


def test_calendar_of_a_bad_month(spark):
    rows = spark.createDataFrame([], "id string, start string, title string, status string")
    grid = views.calendar_grid(rows, "soon", "2026-08-15").collect()
    assert grid[0].date == "2026-07-27" and grid[-1].date == "2026-09-06" and datetime.date.fromisoformat(grid[0].date).weekday() == 0


@pytest.mark.parametrize("empty", ["alias", "exact", "occurrence"])
def test_matching_nothing(spark, empty):
    incoming = spark.createDataFrame([], "n long, id string, url string, signup_url string, start string, title string, host string, venue string, address string, neighborhood string")
    events = incoming.drop("n")
    aliases = spark.createDataFrame([], "event_id string, canonical_url string")
    assert {"alias": lambda: resolve.match_alias(incoming, aliases, events), "exact": lambda: resolve.match_exact(incoming, events), "occurrence": lambda: resolve.match_occurrence(incoming, events)}[empty]().count() == 0


def test_norm_text_of_all_documents(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r.normed for r in __spark_entry__.queries()["scl1_norm_text"](spark, small).collect()}
    assert any(x and not x.isascii() for x in docs.values())
    assert got == {k: re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", x or "").lower()).strip() for k, x in docs.items()}


def test_event_theme_has_the_twenty_rules(spark):
    said = ["Barbell workout", "Photo walk", "Writing hour", "Karaoke", "Board game night", "Sunset hike", "Magic show", "Theatre", "Singles mixer", "Yoga", "Comedy dinner", "Gallery hop", "Nothing"]
    got = values(spark, e.event_theme, *said)
    assert len(e.THEME_RULES) == 20 and [x.rstrip("\ufe0f") for x in got] == list("🏋📸✍🎤🎲🚶🪄🎭🎉🧘🍽🎨✨")


def test_each_rule_of_a_catalog_file(spark, tmp_path):
    ok = {"primary": {"method": "http"}, "required_fields": ["title"], "empty_signal": None}
    sources = [{"title": "no id"}, {"id": "a", "retrieval_profile": "ok"}, {"id": "a", "retrieval_profile": "ok"}, {"id": "b", "enabled": "true", "retrieval_profile": "ok"}, {"id": "c", "enabled": False, "retrieval_profile": "ok"}, {"id": "d", "cadence": None, "retrieval_profile": "ok"}, {"id": "e", "adapter": 5, "retrieval_profile": "ok"}, {"id": "f"}]
    catalog = {"retrieval_profiles": {"ok": ok, "bad": {"audit_cadence": 1, "primary": {}, "required_fields": []}}, "sources": sources, "inbox_sources": {"items": [{"title": "x"}, {"id": "a"}, {"id": "i", "cadence": "daily"}]}}
    (tmp_path / "catalog.json").write_text(json.dumps(catalog, indent=1))
    got = sorted((r.id, r.problem) for r in check_catalog(*(x.withColumnRenamed("retrieval_profile", "profile") for x in tables.read_catalog(spark, f"{tmp_path}/catalog.json"))).collect())
    assert got == sorted([
        ("", "source without id"), ("a", "duplicate source id"), ("b", "non-boolean enabled"), ("c", "disabled without reason"), ("d", "obsolete cadence"), ("e", "invalid adapter"), ("f", "missing profile <none>"),
        ("bad", "profile without primary"), ("bad", "profile without required fields"), ("bad", "profile without empty rule"), ("bad", "obsolete audit_cadence"),
        ("", "inbox with missing profile <none>"), ("", "inbox source without id"), ("a", "duplicate source id across catalog and inbox"), ("i", "obsolete cadence"),
    ])


def test_invalidate_events_rejects_foreign_ids_and_recounts(spark):
    events = spark.createDataFrame([("a", "s"), ("b", "s"), ("x", "t")], "id string, source_id string")
    aliases = spark.createDataFrame([("a", "u"), ("b", "v")], "event_id string, url string")
    found = spark.createDataFrame([("r", "s", "a", "new", None), ("r", "s", "b", "updated", None), ("r", "s", None, "rejected", "old"), ("q", "s", "b", "new", None)], "run_id string, source_id string, event_id string, outcome string, reason string")
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "id string")
    kept, names, rows, _, runs, problems = updates.invalidate_events(events, aliases, found, ids("a"), "s", "repair")
    assert kept.count() == 2 and names.count() == 1 and problems.count() == 0
    assert [(r.outcome, r.event_id) for r in rows.where("reason = 'repair'").collect()] == [("rejected", None)] and rows.count() == 4
    assert [tuple(r) for r in runs.collect()] == [("r", "s", "validation_failed", 3, 2, 1, 2, 0, 1, 0, 0, "repair")]
    kept, names, rows, _, runs, problems = updates.invalidate_events(events, aliases, found, ids("a", "x"), "s", "repair")
    assert [r.id for r in problems.collect()] == ["x"] and (kept.count(), names.count(), runs.count()) == (3, 2, 0) and rows.where("reason = 'repair'").count() == 0


def test_page_set_contract_reads_cursors(spark):
    body = lambda c: json.dumps({"total": 2, "page": 0, "items": [1], "next": c})
    pages = spark.createDataFrame([(s, 0, body(c)) for s, c in (("a", "x"), ("a", "x"), ("b", "x"), ("b", None), ("c", "x"), ("c", "y"))], "source_id string, page_no int, body string")
    got = extract.page_set_contract(pages, "$.total", "$.page", "$.items", cursor="$.next").where("problem = 'cursor repeats'").collect()
    assert [r.source_id for r in got] == ["a"]


def test_ages_of_titles(spark):
    rows = spark.createDataFrame([("Come along", "Singles 25-35"), ("Ages 30-40 Date & Time Ages 50-60", "x"), ("Date & time All ages", "21+ night"), ("All ages", "Aug 21-23")], "text string, title string")
    got = [tuple(r.a) for r in rows.select(t.age_range(F.col("text"), F.col("title")).alias("a")).collect()]
    assert got == [(25, 35, "25-35"), (30, 40, "30-40"), (21, None, "21+"), (None, None, "All ages")]


def test_feed_times_become_local(spark):
    from listingloom.sources import extract

    assert values(spark, lambda c: extract.local_start(c, "America/New_York"), "2026-08-20T22:00:00.000Z", "2026-08-20 6:30 PM", "2026-08-20T18:30:00-04:00", "soon") == ["2026-08-20T18:00:00-04:00", "2026-08-20T18:30:00-04:00", "2026-08-20T18:30:00-04:00", "soon"]


def test_canonical_urls_by_an_independent_reader(spark):
    from urllib.parse import parse_qsl, urlencode, urlsplit

    def one(u):
        parts = urlsplit(u if "://" in u else "//" + u)
        pairs = sorted((k.lower(), v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in t.TRACKING_KEYS)
        return (parts.netloc.lower().removeprefix("www.") + parts.path.rstrip("/") + ("?" + urlencode(pairs) if pairs else "")).lower()

    urls = ["https://www.V.org/a%20b/?q=caf%C3%A9+bar&B=1*2~3&utm_x=1", "v.org?x=%zz&y", "http://v.org/x?a=b=c&&a=A#frag?no", "https://v.org/é?é=ü&fbclid=1", "v.org/p?one=two?three", "https://v.org//", "//v.org/a?b=%2B+%26"]
    assert values(spark, t.canon_url, *urls) == [one(u) for u in urls]

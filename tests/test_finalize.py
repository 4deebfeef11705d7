import random
import time

import pytest

from listingloom.operators import resolve
from tests import naive

FIELDS = "n long, id string, url string, signup_url string, title string, host string, start string, venue string, neighborhood string, address string, price string, is_free boolean, description string, source_id string, status string, raw_keys array<string>"
SEEN = "2026-08-01"


def start(rng, day, hour, minute):
    """One moment in one of the forms that a start may have."""
    offset = rng.choice(["-04:00", "-04:00", "", "+02:00", "-0400", "Z"])
    return rng.choice([f"2026-08-{day:02d}T{hour}:{minute:02d}:00", f"2026-08-{day:02d} {hour}:{minute:02d}", f"202608{day:02d}T{hour}{minute:02d}00", f" 2026-08-{day:02d}T{hour}:{minute:02d}:00.5"]) + offset


def make(rng, n, staged):
    titles = ["Night Market", "Night Markets", "Jazz Brunch", "Jazz Brunches!", "Film Club part 2", "Pétanque Night", "Petanque Night", ""]
    rows = []
    for k in range(n):
        place = rng.randrange(4)
        day, hour, minute = rng.randrange(1, 3), rng.choice([19, 20, 23]), rng.choice([0, 10, 25, 40])
        rows.append((
            k, f"{'n' if staged else 'e'}{rng.randrange(9) if staged and rng.random() < 0.2 else k}",
            rng.choice(["", "https://www.a.org/calendar", f"https://a.org/event-{rng.randrange(6)}?utm_x=1"]),
            rng.choice(["", "", f"https://t.io/x?id={rng.randrange(5)}"]), rng.choice(titles), rng.choice(["Anna", "Ben", ""]),
            "" if staged and rng.random() < 0.06 else rng.choice(["bad", ""]) if staged and rng.random() < 0.04 else start(rng, day, hour, minute),
            rng.choice(["", f"Hall {place}"]), rng.choice(["", "Harlem"]), rng.choice(["", f"{place}{place} Main Street"]),
            rng.choice(["", "$5"]), rng.choice([None, True, False]), rng.choice(["", "x", "longer text"]), rng.choice(["s1", "s2"]), "active", rng.choice([[], ["is_free", "age_min"]]),
        ))
    return rows


def result(tables):
    events, aliases, outcomes = tables
    return tuple(sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())) for df in (events, aliases, outcomes))


def said(events, aliases, outcomes):
    plain = lambda rows: sorted(tuple(str(r[c]) for c in sorted(r)) for r in rows)
    return plain(events), plain(aliases), plain([{"n": n, "event_id": e, "outcome": o} for n, e, o in outcomes])


@pytest.mark.parametrize("seed", range(2))
def test_components_give_what_the_sequential_replay_gives(spark, seed):
    rng = random.Random(seed)
    staged = spark.createDataFrame(make(rng, 70, True), FIELDS).selectExpr("*", f"'{SEEN}' as first_seen", f"'{SEEN}' as last_seen")
    events = spark.createDataFrame(make(rng, 25, False), FIELDS).drop("n", "raw_keys").selectExpr("*", "'2026-07-01' as first_seen", "'2026-07-01' as last_seen")
    aliases = resolve.prepared(events).where("canon_url is not null").selectExpr("id as event_id", "canon_url as canonical_url", "url", "source_id", "'2026-07-01' as first_seen", "'2026-07-01' as last_seen")
    apart = result(resolve.finalize(staged, events, aliases, SEEN))
    assert apart == result(resolve.finalize(staged, events, aliases, SEEN, whole=True))
    rows = lambda df: [r.asDict() for r in df.collect()]
    wanted = said(*naive.replay(rows(resolve.prepared(staged)), rows(resolve.prepared(events)), rows(aliases), SEEN))
    assert apart[2] == wanted[2]
    assert apart[1] == wanted[1]
    assert apart[0] == wanted[0]


def bodies(n, of):
    blank = {"url": "", "signup_url": "", "canon_url": None, "canon_signup": None, "host": "", "venue": "", "address": "", "neighborhood": "", "price": "", "is_free": None, "capacity_flag": None, "end": None, "status": "active", "age_min": None, "age_max": None, "description": "", "source_id": "s", "first_seen": SEEN, "last_seen": SEEN, "raw_keys": []}
    return [{**blank, "n": k, "id": f"n{k}", **of(k)} for k in range(n)]


WORDS = [a + b + c for a in ("har", "mor", "lin", "sa", "te", "vo", "qui") for b in ("bor", "ning", "den", "lo", "ka", "pi") for c in ("", "s", "rette", "ville")]


def words(k):
    rng = random.Random(k)
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 6)))


CASES = {
    # one page of a day, many times: rows of one half hour merge
    "one url": lambda k: {"url": "u", "canon_url": "a.org/event-1", "title": f"show {k}", "start": f"2026-08-01T{k % 24:02d}:{k % 60:02d}:00"},
    # a page of events that each have a page of their own too
    "two urls": lambda k: {"url": "u", "canon_url": "a.org/event-1", "signup_url": "v", "canon_signup": f"b.org/event-{k // 2}", "title": words(k // 2), "start": f"2026-08-01T{k % 24:02d}:{k % 60:02d}:00"},
    "a month": lambda k: {"title": words(k // 3), "venue": f"hall {k % 11}", "start": f"2026-08-{k // 3 % 30 + 1:02d}T{k // 90 % 24:02d}:{k // 9 % 2 * 30:02d}:00"},
    "one title": lambda k: {"title": "night market", "venue": f"hall {k % 97}", "host": f"host number {k % 89}", "start": f"2026-08-01T19:{k % 60:02d}:00"},
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_large_components_take_less_than_quadratic_time(case):
    spent = []
    for n in (400, 50_000):
        staged = bodies(n, CASES[case])
        began = time.process_time()
        store = resolve.Replay([], [], staged)
        got = [(b["n"], *store.take(b, SEEN)) for b in staged]
        spent.append(time.process_time() - began)
        if n == 400:
            assert got == naive.replay(bodies(n, CASES[case]), [], [], SEEN)[2]
    assert spent[1] < 60  # all with all would be 2.5 billion comparisons


def shown(n, title, start):
    row = dict.fromkeys(resolve.FIELDS, "") | {"id": f"e{n}", "title": title, "start": start, "venue": "Hall", "canon_url": None, "canon_signup": None}
    return row | {"is_free": None, "age_min": None, "age_max": None}


def test_few_texts_are_compared_without_an_index_and_many_by_one(monkeypatch):
    """The bigrams of a small component were counted and indexed for nothing; a large one needs them."""
    titles = [f"Night {chr(97 + k)}{chr(97 + k)} Market" for k in range(24)]
    for n in (3, 24):
        counted = []
        monkeypatch.setattr(resolve, "grams", lambda text: counted.append(text) or text)
        monkeypatch.setattr(resolve, "prefix", lambda text, ranks, least: counted.append(text) or [*ranks][:0] + ["all"])
        store = resolve.Replay([shown(k, title, "2026-08-01T19:00:00") for k, title in enumerate(titles[:n])], [])
        for k, title in enumerate(titles[:n]):
            new = shown(100 + k, title + "s", "2026-08-01T19:10:00") | {"n": k, "raw_keys": []}
            assert store.find(new)["id"] == f"e{k}"
        assert bool(counted) == (n > resolve._Texts.FEW)


def test_a_dense_half_hour_is_matched_with_few_ratios(monkeypatch):
    """Copies of a few titles at one time: the second of two like events ends a row's search, so hundreds of others aren't scored."""
    from listingloom.operators import alike

    def of(k):
        copy, show = divmod(k, 20)
        return {"title": f"low night part {show % 5}", "venue": "" if show % 9 == 0 else f"land {show} hall", "host": f"customer {100003 * show + 15 * copy:09d}", "start": "2026-08-01T19:10:00-04:00"}

    scored = []
    real = alike.difflib.SequenceMatcher
    monkeypatch.setattr(alike.difflib, "SequenceMatcher", lambda *a: scored.append(a) or real(*a))
    resolve._ratio.cache_clear()
    staged = bodies(4000, of)
    store = resolve.Replay([], [], staged)
    got = [(b["n"], *store.take(b, SEEN)) for b in staged]
    assert len(scored) < 10 * len(staged)
    few = bodies(300, of)
    assert naive.replay([dict(b) for b in few], [], [], SEEN)[2] == got[:300]


def test_finalize_keeps_few_tables_and_ties_rows_by_numbers(spark, tmp_path, monkeypatch):
    """What only led to the components was kept to the end, and nodes were texts."""
    from listingloom import session

    monkeypatch.setattr(session, "_written", [])
    rng = random.Random(5)
    staged = spark.createDataFrame(make(rng, 40, True), FIELDS).selectExpr("*", f"'{SEEN}' as first_seen", f"'{SEEN}' as last_seen")
    events = spark.createDataFrame(make(rng, 15, False), FIELDS).drop("n", "raw_keys").selectExpr("*", "'2026-07-01' as first_seen", "'2026-07-01' as last_seen")
    aliases = spark.createDataFrame([], "event_id string, canonical_url string, url string, source_id string, first_seen string, last_seen string")
    resolve.finalize(staged, events, aliases, SEEN)
    assert {p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in session._written} <= {"staged", "stored", "replayed"}

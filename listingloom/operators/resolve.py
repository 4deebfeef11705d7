"""Entity resolution: incoming rows against the event store by URL alias, by id, and by occurrence.

match_* answer for a store that stands still. finalize() answers for one that each staged row may change: rows that could
ever meet are put into one component, components are replayed in order of discovery, and nothing else is sequential.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import datetime, timedelta
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from listingloom.functions import text as t
from listingloom.operators.alike import Recurring, alike, grams, prefix, score, ties
from listingloom.operators.components import components, contracted
from listingloom.session import discard_since, hinted, materialize, spread, written

# Fixed values of the matching rules: minutes between starts, and the ratios that count as alike or as a conflict.
NEAR_MINUTES = 30.0
TITLE, ADDRESS, VENUE, HOST, CONFLICT = 0.88, 0.92, 0.90, 0.92, 0.70
#: Fields that a later sighting may overwrite, and those that the same source may also clear.
VOLATILE = ("price", "is_free", "capacity_flag", "venue", "neighborhood", "address", "end", "status", "signup_url", "age_min", "age_max")
CLEARABLE = ("is_free", "capacity_flag", "age_min", "age_max")
FIELDS = ("id", "url", "title", "host", "start", "source_id", "description", "first_seen", "last_seen", *VOLATILE)


def sightings(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, canonical_url) of each row's own and signup URL, where they name one event."""
    made = rows.select(*keys, t.canon_url(F.col("url")).alias("_own"), t.canon_url(F.col("signup_url")).alias("_signup"))
    urls = F.when(F.col("_own") == F.col("_signup"), F.array("_own")).otherwise(F.array("_own", "_signup"))
    # An outer explode: Spark would filter on the size of an inner one's array and work the URLs out twice.
    return made.select(*keys, F.explode_outer(urls).alias("canonical_url")).where(t.is_event_url(F.col("canonical_url")))


def match_alias(incoming: DataFrame, aliases: DataFrame, events: DataFrame) -> DataFrame:
    """(n, event_id): the only event of the same local day under one of a row's URLs, or the only one near in time."""
    start = t.iso_start(F.col("start"))
    read = t.settled(spread(incoming.select("n", "url", "signup_url", "start"), "n"), my_start=start).where("my_start is not null")
    mine = materialize(sightings(read, "n", "my_start"), "sightings").withColumn("day", F.substring("my_start", 1, 10))
    dated = events.select(F.col("id").alias("event_id"), start.alias("start"), F.substring("start", 1, 10).alias("day"))
    stored = aliases.select("event_id", "canonical_url").join(dated.hint("merge"), "event_id")
    found = mine.hint("merge").join(stored, ["canonical_url", "day"]).select("n", "event_id", (t.minutes_apart(F.col("my_start"), F.col("start")) <= NEAR_MINUTES).alias("near")).distinct()
    tally = found.groupBy("n").agg(F.count("*").alias("all"), F.min("event_id").alias("one"), F.count_if("near").alias("close"), F.min(F.when(F.col("near"), F.col("event_id"))).alias("closest"))
    return tally.select("n", F.when(F.col("all") == 1, F.col("one")).when(F.col("close") == 1, F.col("closest")).alias("event_id")).where("event_id is not null")


def match_exact(incoming: DataFrame, events: DataFrame) -> DataFrame:
    return incoming.join(events.select(F.col("id").alias("event_id")), F.col("id") == F.col("event_id")).select("n", "event_id")


def _normed(rows: DataFrame, side: str, key: str, norm) -> DataFrame:
    """Key, start in ISO form, and normalised names of one side; what joins and filters read of a start, as numbers."""
    names = ("title", "host", "venue", "address", "neighborhood")
    s = f"{side}_"
    read = t.settled(spread(rows.select(key, "start", *names), key), **{s + "start": t.iso_start(F.col("start"))}).where(f"{s}start is not null")
    when = {s + "aware": t.has_offset(F.col(s + "start")), s + "at": F.unix_micros(t.instant(F.col(s + "start"))), s + "wall": F.unix_micros(t.wall_time(F.col(s + "start")).cast("timestamp"))}
    return read.select(F.col(key).alias(s + "key"), s + "start", F.substring("start", 1, 10).alias("stored_day"), *(norm(F.col(c)).alias(s + c) for c in names), *(c.alias(k) for k, c in when.items()))


def _slot(start: str, wall: bool) -> Column:
    when = t.wall_time(F.col(start)).cast("timestamp") if wall else t.instant(F.col(start))
    return F.floor(F.unix_seconds(when) / (60 * NEAR_MINUTES))


def _timed(start: str) -> tuple[Column, Column, Column]:
    """Whether a start has an offset, and the half hours of its instant and of its wall time."""
    return t.has_offset(F.col(start)), _slot(start, False), _slot(start, True)


def incoming_blocks(start: str, timed: tuple[Column, Column, Column] | None = None) -> Column:
    """The blocks in which a row with a start (ISO form) looks for stored rows: its day with its half hour and both next to
    it. Starts that both have an offset meet by instant, others by wall time. timed: columns that hold what `_timed` gives."""
    (offset, instant, wall), day = timed or _timed(start), F.substring(start, 1, 10)
    block = lambda kind, slot: F.array(*(F.concat_ws("|", F.lit(kind), day, (slot + k).cast("string")) for k in (-1, 0, 1)))
    return F.when(offset, F.concat(block("both", instant), block("mine", wall))).otherwise(block("none", wall))


def stored_blocks(start: str, day: Column, timed: tuple[Column, Column, Column] | None = None) -> Column:
    """The blocks in which a row with a start is found, under the day that its stored text begins with."""
    offset, instant, wall = timed or _timed(start)
    block = lambda kind, slot: F.concat_ws("|", F.lit(kind), day, slot.cast("string"))
    return F.when(offset, F.array(block("both", instant), block("none", wall))).otherwise(F.array(block("mine", wall), block("none", wall)))


def _held(side: str) -> tuple[Column, Column, Column]:
    """What `_timed` gives, of the numbers that `_normed` has."""
    return F.col(side + "aware"), *(F.floor(F.col(side + c) / (60e6 * NEAR_MINUTES)) for c in ("at", "wall"))


def _in_blocks(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by block, without the kinds of block that only one side has; of these there are three at most."""
    sides = [rows.select("*", F.explode_outer("_blocks").alias("block")).drop("_blocks") for rows in (incoming, stored)]
    kinds = [{k for (k,) in rows.select(F.substring("block", 1, 4)).distinct().collect()} for rows in sides]
    return tuple(rows.where(F.substring("block", 1, 4).isin(*(kinds[0] & kinds[1]))) for rows in sides)


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("venue", "address", "host")]))
def _places(lv: pd.Series, rv: pd.Series, la: pd.Series, ra: pd.Series, lh: pd.Series, rh: pd.Series, area: pd.Series) -> pd.DataFrame:
    """The likeness of venue, address and host of rows of one occurrence, nulls for others."""
    none, out = (None, None, None), []
    for v, w, a, b, h, g, same in zip(lv, rv, la, ra, lh, rh, area, strict=True):
        venue = _full(v, w, CONFLICT)
        # An address or a host counts from its bound on only, so where that is ruled out there is no need to know how far it is.
        held = venue >= VENUE or same or _ratio(a, b, ADDRESS) >= ADDRESS or _ratio(h, g, HOST) >= HOST
        if held and v and w and a and b and venue < CONFLICT:
            held = _ratio(a, b, CONFLICT) >= CONFLICT
        out.append((venue, _full(a, b, CONFLICT), _full(h, g, HOST)) if held else none)
    return pd.DataFrame(out, columns=["venue", "address", "host"], dtype=float)


def score_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, norm=t.norm_text, distinct: bool = False) -> DataFrame:
    """(l_key, r_key) of rows that look like one occurrence: same day, near in time, like titles, and a like place or host.

    Rows meet in blocks of half an hour, and in a block only those whose titles are alike (`alike`); each pair of titles is
    scored once, however many rows have them, and places and hosts of pairs near in time in one go.
    """
    a = materialize(_normed(left, "l", left_key, norm).withColumn("_blocks", incoming_blocks("l_start", _held("l_"))).drop("stored_day"), "left")
    b = materialize(_normed(right, "r", right_key, norm).withColumn("_blocks", stored_blocks("r_start", F.col("stored_day"), _held("r_"))).drop("stored_day"), "right")
    a, b = _in_blocks(a, b)
    titles = materialize(alike(a.withColumnRenamed("l_title", "title"), b.withColumnRenamed("r_title", "title"), TITLE), "alike").withColumnRenamed("score", "title_score")
    apart = F.when(F.col("l_aware") & F.col("r_aware"), F.abs(F.col("l_at") - F.col("r_at"))).otherwise(F.abs(F.col("l_wall") - F.col("r_wall"))) / 60e6
    pairs = a.join(titles.hint("merge"), ["block", "l_title"]).join(b.hint("merge"), ["block", "r_title"]).where(apart <= NEAR_MINUTES)
    if distinct:
        pairs = pairs.where("l_key < r_key")
    same_area = (F.col("title_score") == 1.0) & (F.col("l_neighborhood") != "") & (F.col("l_neighborhood") == F.col("r_neighborhood"))
    scored = _places(*(F.col(f"{s}_{c}") for c in ("venue", "address", "host") for s in "lr"), same_area)
    pairs = pairs.select("l_key", "r_key", "title_score", scored.alias("_like")).where("_like.venue is not null")
    return pairs.select("l_key", "r_key", "title_score", *(F.col(f"_like.{c}").alias(f"{c}_score") for c in ("venue", "address", "host")))


#: How many rows of either side a group has at most when occurrences are looked for; larger blocks are dealt over several groups.
_ROWS = 16384
_NAMES = ("title", "host", "venue", "address", "neighborhood")


def _two_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, l, r, right, key, names, aware, at, wall) come ordered by group; of each incoming row's stored ones two are told at most."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    recurring, out = Recurring(TITLE), ([], [])
    for _, group in groupby(rows, key=lambda r: r[:3]):
        sides: tuple[list[tuple], list[tuple]] = ([], [])
        for r in group:
            sides[r[3]].append(r[4:])
        known: dict[str, list[str]] = defaultdict(list)
        for x, y, _ in recurring.pairs(*(list(dict.fromkeys(r[1] for r in side)) for side in sides)) if all(sides) else ():
            known[x].append(y)
        wanted = set(chain.from_iterable(known.values()))
        stored = [(r[0], dict(zip(_NAMES, r[1:6], strict=True)), r[6:]) for r in sides[1] if r[1] in wanted]
        block = _Block(lambda: Counter(g for _, names, _ in stored for c in ("title", "venue", "address", "host") for g in grams(names[c])))  # noqa: B023
        for k, (_, names, _) in enumerate(stored):
            block.put(k, names)
        for key, *values, aware, at, wall in (r for r in sides[0] if r[1] in known):
            new, found = dict(zip(_NAMES, values, strict=True)), set()
            for k in chain(block.likeliest(new, known[new["title"]]), block.candidates(new, known[new["title"]])):
                other, names, (other_aware, other_at, other_wall) = stored[k]
                if other not in found and abs(at - other_at if aware and other_aware else wall - other_wall) <= 60e6 * NEAR_MINUTES and same_occurrence(new, names):
                    found.add(other)
                    if len(found) == 2:
                        break
            out[0].extend([key] * len(found))
            out[1].extend(found)
        if len(out[0]) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["l_key", "r_key"])
            out = ([], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["l_key", "r_key"])


def match_occurrence(incoming: DataFrame, events: DataFrame, norm=t.norm_text) -> DataFrame:
    """(n, event_id) where exactly one stored event looks like the row's occurrence.

    An incoming row is looked up once, in its own half hour, to which the stored rows of both next to it come too; there its
    search ends with the second that it finds. So the work of a row hardly grows with the rows of its half hour.
    """
    before = written()
    a, b = _normed(incoming, "l", "n", norm).where("l_title <> ''"), _normed(events, "r", "id", norm).where("r_title <> ''")
    (l_aware, l_at, l_wall), (r_aware, r_at, r_wall) = _held("l_"), _held("r_")
    block = lambda kind, day, slot: F.concat_ws("|", F.lit(kind), day, slot.cast("string"))
    own, day = F.substring("l_start", 1, 10), F.col("stored_day")
    looks = F.when(l_aware, F.array(block("both", own, l_at), block("mine", own, l_wall))).otherwise(F.array(block("none", own, l_wall)))
    lies = lambda kind, slot: F.array(*(block(kind, day, slot + k) for k in (-1, 0, 1)))
    found = F.concat(F.when(r_aware, lies("both", r_at)).otherwise(lies("mine", r_wall)), lies("none", r_wall))
    sides = _in_blocks(*(materialize(rows.withColumn("_blocks", at).drop("stored_day"), name) for rows, at, name in ((a, looks, "left"), (b, found, "right"))))
    large = [rows.groupBy("block").agg(F.ceil(F.count("*") / _ROWS).cast("int").alias(f"parts{k}")).where(f"parts{k} > 1") for k, rows in enumerate(sides)]
    dealt = hinted(materialize(large[0].join(large[1], "block", "full"), "large-blocks"))
    grouped = []
    for k, (s, rows) in enumerate(zip("lr", sides, strict=True)):
        mine = F.pmod(F.xxhash64(f"{s}_key"), F.coalesce(f"parts{k}", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"parts{1 - k}", F.lit(1)) - 1))
        values = [F.col(f"{s}_{c}").alias(c) for c in (*_NAMES, "aware", "at", "wall")]
        rows = rows.join(dealt, "block", "left").select("block", mine.alias("mine"), every.alias("other"), F.lit(k).alias("right"), F.col(f"{s}_key").cast("string").alias("key"), *values)
        grouped.append(rows.select("block", F.col(("mine", "other")[k]).alias("l"), F.col(("other", "mine")[k]).alias("r"), "right", "key", *(c for c in (*_NAMES, "aware", "at", "wall"))))
    parts = int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = grouped[0].unionAll(grouped[1]).repartition(parts, "block", "l", "r").sortWithinPartitions("block", "l", "r").mapInArrow(_two_found, "l_key string, r_key string")
    tally = pairs.groupBy("l_key").agg(F.min("r_key").alias("one"), F.max("r_key").alias("other")).where("one = other")
    done = materialize(tally.select(F.col("l_key").cast(incoming.schema["n"].dataType).alias("n"), F.col("one").cast(events.schema["id"].dataType).alias("event_id")), "occurrences")
    discard_since(before, done)
    return done


def resolve(incoming: DataFrame, aliases: DataFrame, events: DataFrame, norm=t.norm_text) -> DataFrame:
    """(n, event_id, how) for every incoming row: by alias, else by id, else by occurrence, else null and 'new'."""
    found = incoming.select("n")
    for how, matched in (("alias", match_alias(incoming, aliases, events)), ("exact", match_exact(incoming, events)), ("occurrence", match_occurrence(incoming, events, norm))):
        found = found.join(matched.withColumnRenamed("event_id", how), "n", "left")
    how = F.when(F.col("alias").isNotNull(), "alias").when(F.col("exact").isNotNull(), "exact").when(F.col("occurrence").isNotNull(), "occurrence").otherwise("new")
    return found.select("n", F.coalesce("alias", "exact", "occurrence").alias("event_id"), how.alias("how"))


# --- The ordered case -------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _norm(s: str | None) -> str:
    return re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", s or "").lower()).strip()


_HALF, _EPOCH = timedelta(minutes=NEAR_MINUTES), datetime(1970, 1, 1)
#: The wall time and, with an offset, the instant.
_Moment = tuple[timedelta, timedelta | None]


def _moment(x: datetime) -> _Moment:
    wall = x.replace(tzinfo=None) - _EPOCH
    return wall, None if x.utcoffset() is None else wall - x.utcoffset()


def _near(x: _Moment, y: _Moment) -> bool:
    apart = x[0] - y[0] if x[1] is None or y[1] is None else x[1] - y[1]
    return -_HALF <= apart <= _HALF


@lru_cache(maxsize=1 << 16)
def _ratio(a: str, b: str, least: float) -> float:
    return score(a, b, least)


@lru_cache(maxsize=1 << 16)
def _full(a: str, b: str, least: float) -> float:
    """The ratio, below the bound too unless the lengths rule it out (as text_similarity)."""
    if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=1 << 18)
def _title(a: str, b: str) -> float:
    """The ratio of two titles, which recur more than other names and so are kept apart from them."""
    return score(a, b, TITLE)


def same_occurrence(new: dict[str, str], old: dict[str, str]) -> bool:
    """Whether two rows near in time, given by their normalised names, are one occurrence."""
    title = _title(new["title"], old["title"])
    if title < TITLE:
        return False
    same_area = title == 1.0 and new["neighborhood"] != "" and new["neighborhood"] == old["neighborhood"]
    # Which of these holds is asked first, as it rarely does; their bounds rule most pairs out.
    address = _ratio(new["address"], old["address"], ADDRESS) >= ADDRESS
    if not (address or same_area or _ratio(new["venue"], old["venue"], VENUE) >= VENUE or _ratio(new["host"], old["host"], HOST) >= HOST):
        return False
    told = all(e[c] for e in (new, old) for c in ("venue", "address"))
    return address or not told or any(_ratio(new[c], old[c], CONFLICT) >= CONFLICT for c in ("venue", "address"))


class _Texts:
    """Events by a text of theirs, and by the texts that are like another: an index of the bigrams that such texts share.

    Up to FEW texts are looked at one by one; their bigrams are only worked out when there are more.
    """

    FEW = 16

    def __init__(self, least: float, ranks: Callable[[], dict[str, int]]):
        self.least, self.ranks = least, ranks
        self.by_gram: dict[str, set[str]] = defaultdict(set)
        self.by_text: dict[str, set[str]] = defaultdict(set)
        self.waiting: list[str] = []

    def put(self, event: str, text: str) -> None:
        if text:
            if text not in self.by_text:
                self.waiting.append(text)
            self.by_text[text].add(event)

    def drop(self, event: str, text: str) -> None:
        if text:
            self.by_text[text].discard(event)

    def like(self, text: str, known: Iterable[str] | None = None) -> list[set[str]]:
        """The events of each text whose ratio, with this one first, reaches the bound; known: texts that do, with all that are here."""
        if known is not None:
            return [self.by_text[x] for x in known if x in self.by_text and self.by_text[x]]
        near: Iterable[str] = list(self.by_text) if text else ()
        if len(self.by_text) > self.FEW:
            for x in self.waiting:
                for g in prefix(x, self.ranks(), self.least):
                    self.by_gram[g].add(x)
            self.waiting.clear()
            near = {x for g in prefix(text, self.ranks(), self.least) for x in self.by_gram.get(g, ())}
        return [self.by_text[x] for x in near if self.by_text[x] and _ratio(text, x, self.least) >= self.least]


class _Block:
    """Stored events of one half hour (see stored_blocks), found by their names."""

    #: As many events with like titles are looked at without asking for their places.
    FEW = 256

    def __init__(self, ranks: Callable[[], dict[str, int]]):
        self.texts = {c: _Texts(least, ranks) for c, least in (("title", TITLE), ("venue", VENUE), ("address", ADDRESS), ("host", HOST))}
        self.areas: dict[str, set[str]] = defaultdict(set)

    def put(self, event: str, names: dict[str, str]) -> None:
        for c, index in self.texts.items():
            index.put(event, names[c])
        self.areas[names["neighborhood"]].add(event)

    def drop(self, event: str, names: dict[str, str]) -> None:
        for c, index in self.texts.items():
            index.drop(event, names[c])
        self.areas[names["neighborhood"]].discard(event)

    def likeliest(self, new: dict[str, str], known: Iterable[str] | None) -> Iterator[str]:
        """Of the events with a like title those of the same venue, host, address or area."""
        places = [self.texts[c].by_text.get(new[c]) for c in ("venue", "host", "address") if new[c]]
        if new["neighborhood"]:
            places.append(self.areas.get(new["neighborhood"]))
        titles = self.texts["title"].like(new["title"], known) if any(places) else []
        return (event for here in places if here for events in titles for event in events & here)

    def candidates(self, new: dict[str, str], known: Iterable[str] | None) -> Iterable[str]:
        """A set of events that holds all that are the same occurrence, some of them perhaps twice: those with a like title,
        or those with a like place, host or area, whichever are fewer."""
        titles = self.texts["title"].like(new["title"], known)
        if sum(map(len, titles)) <= self.FEW:
            return chain.from_iterable(titles)
        places = [events for c in ("venue", "address", "host") for events in self.texts[c].like(new[c])]
        if new["neighborhood"]:
            places.append(self.areas.get(new["neighborhood"], set()))
        return chain.from_iterable(min(titles, places, key=lambda sets: sum(map(len, sets))))


def _slots(moment: _Moment) -> tuple[int, int | None]:
    """The half hours of the wall time and, with an offset, of the instant."""
    return moment[0] // _HALF, None if moment[1] is None else moment[1] // _HALF


class Replay:
    """The store as one component sees it, changed row by row and indexed by URL and by half hour."""

    #: Up to so many titles that recur are compared with each other once, not in each half hour.
    TITLES = 256

    def __init__(self, events: list[dict], aliases: list[dict], staged: Sequence[dict] = ()):
        self.rows = (*events, *staged)
        self.titles = {_norm(e["title"]) for e in self.rows}
        self.recurring = len(self.titles) <= min(self.TITLES, len(self.rows) // 4)
        self.like_titles: dict[str, list[str]] = {}
        self.events: dict[str, dict] = {}
        self.names: dict[str, dict[str, str]] = {}
        self.times: dict[str, _Moment | None] = {}
        self.blocks: dict[tuple, _Block] = {}
        # The kinds of block that the staged rows look into; of rows that aren't known yet, all.
        offsets = {start.utcoffset() is not None for e in staged if (start := t.read_time(e["start"])) is not None}
        self.kinds = {kind for offset in offsets for kind in (("both", "mine") if offset else ("none",))} if staged else {"both", "mine", "none"}
        self.by_url: dict[tuple, set[str]] = defaultdict(set)
        self.aliases = {(a["event_id"], a["canonical_url"]): a for a in aliases}
        for e in events:
            self._index(e)
        for event, url in self.aliases:
            self._index_url(event, url)
        self.touched: set[str] = set()
        self.sighted: set[tuple[str, str]] = set()
        self.seen: set[str] = set()

    @cached_property
    def ranks(self) -> dict[str, int]:
        """How many of the component's texts have each bigram."""
        texts = {_norm(e[c]) for e in self.rows for c in ("title", "venue", "address", "host")}
        return Counter(g for text in texts for g in grams(text))

    def _titles_like(self, title: str) -> list[str] | None:
        """The component's titles that are like one, where its titles recur."""
        if not self.recurring:
            return None
        if title not in self.like_titles:
            self.like_titles[title] = [x for x in self.titles if _title(title, x) >= TITLE]
        return self.like_titles[title]

    def _index(self, e: dict) -> None:
        i, names = e["id"], {c: _norm(e[c]) for c in ("title", "host", "venue", "address", "neighborhood")}
        self.events[i] = e
        if self.names.get(i) == names:
            return
        if i not in self.times:
            start = t.read_time(e["start"])
            self.times[i] = None if start is None else _moment(start)
        if names["title"] not in self.titles:
            self.recurring = False
        if self.times[i] is not None:
            for key in self._stored(e["start"][:10], self.times[i]):
                block = self.blocks.setdefault(key, _Block(lambda: self.ranks))
                if i in self.names:
                    block.drop(i, self.names[i])
                block.put(i, names)
        self.names[i] = names

    def _index_url(self, event: str, url: str) -> None:
        """Under its URL and day, and under those and its half hours."""
        if event in self.events:
            day, moment = self.events[event]["start"][:10], self.times[event]
            for key in ((), *(self._stored(day, moment) if moment is not None else ())):
                self.by_url[url, day, *key].add(event)

    def _stored(self, day: str, moment: _Moment) -> list[tuple]:
        wall, instant = _slots(moment)
        own = ("none", day, wall), ("mine", day, wall) if instant is None else ("both", day, instant)
        return [key for key in own if key[0] in self.kinds]

    @staticmethod
    def _incoming(day: str, moment: _Moment) -> list[tuple]:
        wall, instant = _slots(moment)
        kinds = [("none", wall)] if instant is None else [("both", instant), ("mine", wall)]
        return [(kind, day, slot + k) for kind, slot in kinds for k in (-1, 0, 1)]

    def find(self, new: dict) -> dict | None:
        """The one event under a row's URLs on its day (or the one near in time), else that of its id, else the one that
        looks like its occurrence."""
        start = t.read_time(new["start"])
        if start is None:
            return self.events.get(new["id"])
        day, moment = start.date().isoformat(), _moment(start)
        own = {new[c] for c in ("canon_url", "canon_signup") if new[c]}
        known = [self.by_url.get((url, day), ()) for url in own]
        found = set().union(*known) if all(len(ids) < 2 for ids in known) else set()
        if len(found) != 1:
            found = self._near(moment, (i for url in own for key in self._incoming(day, moment) for i in self.by_url.get((url, day, *key), ())))
        if len(found) == 1:
            return self.events[found.pop()]
        if new["id"] in self.events:
            return self.events[new["id"]]
        names = {c: _norm(new[c]) for c in ("title", "host", "venue", "address", "neighborhood")}
        known, blocks = self._titles_like(names["title"]), [self.blocks[key] for key in self._incoming(day, moment) if key in self.blocks]
        listed = (i for listing in (_Block.likeliest, _Block.candidates) for block in blocks for i in listing(block, names, known))
        found = self._near(moment, listed, lambda i: same_occurrence(names, self.names[i]))
        return self.events[found.pop()] if len(found) == 1 else None

    def _near(self, moment: _Moment, listed: Iterable[str], holds: Callable[[str], bool] = lambda i: True) -> set[str]:
        """The events of a list that are near in time and for which a rule holds; two of them are enough to know."""
        found: set[str] = set()
        seen: set[str] = set()
        for i in listed:
            if i not in seen:
                seen.add(i)
                if (when := self.times[i]) is not None and _near(moment, when) and holds(i):
                    found.add(i)
                    if len(found) == 2:
                        break
        return found

    def sight(self, event_id: str, canonical: str | None, url: str, source: str, first: str, last: str) -> bool:
        if not canonical:
            return False
        self.sighted.add((event_id, canonical))
        old = self.aliases.get((event_id, canonical))
        if old is None:
            self._index_url(event_id, canonical)
            self.aliases[event_id, canonical] = {"event_id": event_id, "canonical_url": canonical, "url": url, "source_id": source or "", "first_seen": first, "last_seen": last}
            return True
        old.update(url=url or old["url"], source_id=old["source_id"] or source or "", first_seen=min(old["first_seen"], first), last_seen=max(old["last_seen"], last))
        return False

    def _store(self, e: dict) -> None:
        self._index(e)
        self.touched.add(e["id"])
        for c, url in (("canon_url", "url"), ("canon_signup", "signup_url")):
            self.sight(e["id"], e[c], e[url], e["source_id"], e["first_seen"], e["last_seen"])

    def take(self, new: dict, seen: str) -> tuple[str | None, str]:
        """Merge one staged row; its event and outcome."""
        if not new["start"]:
            return None, "rejected"
        old = self.find(new)
        if old is None:
            self._store({k: v for k, v in new.items() if k not in ("n", "raw_keys")})
            event, outcome = new["id"], "new"
        else:
            changed = False
            for c in VOLATILE:
                clears = c in CLEARABLE and c in (new["raw_keys"] or ()) and old["source_id"] == new["source_id"]
                if (clears or new[c] not in (None, "", 0)) and old[c] != new[c]:
                    old[c] = new[c]
                    changed = True
                    if c == "signup_url":
                        old["canon_signup"] = new["canon_signup"]
            if len(new["description"] or "") > len(old["description"] or ""):
                old["description"], changed = new["description"], True
            if not old["canon_url"] and new["canon_url"]:
                old.update(url=new["url"], canon_url=new["canon_url"])
                changed = True
            for c, url in (("canon_url", "url"), ("canon_signup", "signup_url")):
                changed |= self.sight(old["id"], new[c], new[url], new["source_id"], seen, seen)
            old["last_seen"] = seen
            self._store(old)
            event, outcome = old["id"], "updated" if changed else "unchanged"
        if event in self.seen:
            return event, "duplicate"
        self.seen.add(event)
        return event, outcome


#: Kinds of rows that go into a replay and come out of it.
_EVENT, _ALIAS, _STAGED, _OUTCOME = range(4)
#: What an alias's columns are called among an event's.
_ALIASED = {"event_id": "id", "canonical_url": "canon_url", "url": "url", "source_id": "source_id", "first_seen": "first_seen", "last_seen": "last_seen"}
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}


def _replayed(seen: str, fields: list[str], kinds: list[pa.DataType]):
    """Rows (root, kind, n, raw_keys, fields) come ordered by root; each component is replayed in memory.

    Out come outcomes, and the events and aliases that were touched: (kind, n, outcome, fields), of an outcome only the id.
    """
    at = {c: fields.index(c) for c in _ALIASED.values()}

    def one(rows: list[tuple]) -> Iterator[tuple]:
        events, aliases, staged = [], [], []
        for _, kind, n, raw_keys, *values in rows:
            if kind == _ALIAS:
                aliases.append({a: values[at[c]] for a, c in _ALIASED.items()})
            elif kind == _EVENT:
                events.append(dict(zip(fields, values, strict=True)))
            else:
                staged.append(dict(zip(fields, values, strict=True), n=n, raw_keys=raw_keys))
        staged.sort(key=lambda b: b["n"])
        store = Replay(events, aliases, staged)
        blank, place = [None] * len(fields), at["id"]
        for new in staged:
            event, outcome = store.take(new, seen)
            yield _OUTCOME, new["n"], outcome, *blank[:place], event, *blank[place + 1 :]
        for i in store.touched:
            yield _EVENT, 0, None, *(store.events[i][c] for c in fields)
        for key in store.sighted:
            row = {c: store.aliases[key][a] for a, c in _ALIASED.items()}
            yield _ALIAS, 0, None, *(row.get(c) for c in fields)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * (len(fields) + 3)
        types = (pa.int8(), pa.int64(), pa.string(), *kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "n", "outcome", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for _, own in groupby(rows, key=lambda r: r[0]):
            for row in one(list(own)):
                out.append(row)
                if len(out) >= 5000:
                    yield batch(out)
                    out = []
        yield batch(out)

    return run


def prepared(rows: DataFrame, *more: str, dealt: bool = False) -> DataFrame:
    """FIELDS (missing ones null) with canonical URLs, null where they don't name one event; more: other columns that stay;
    dealt: the rows come from a shuffle."""
    have = {c: F.col(c) if c in rows.columns else F.lit(None) for c in FIELDS}
    texts = [c for c in FIELDS if c not in ("is_free", "age_min", "age_max")]
    out = rows.select(*(c for c in ("n", "raw_keys") if c in rows.columns), *(F.coalesce(have[c].cast("string"), F.lit("")).alias(c) if c not in ("end", "capacity_flag") else have[c].cast("string").alias(c) for c in texts), have["is_free"].cast("boolean").alias("is_free"), have["age_min"].cast("int").alias("age_min"), have["age_max"].cast("int").alias("age_max"), *more)
    # Both are worked out once a row, on many tasks however few files the rows come from.
    out = t.settled(out if dealt else spread(out, "id"), canon_url=t.canon_url(F.col("url")), canon_signup=t.canon_url(F.col("signup_url")))
    return out.withColumns({c: F.when(t.is_event_url(F.col(c)), F.col(c)) for c in ("canon_url", "canon_signup")})


def _node(id_: str) -> Column:
    """What stands for all rows of an id: an even number. Two ids that share one are replayed together, which changes nothing."""
    return F.shiftleft(F.xxhash64(id_), 1)


def _key(kind: str, *of: str | Column) -> Column:
    """What stands for something that rows of one day share: an odd number."""
    return F.shiftleft(F.xxhash64(F.lit(kind), *of), 1).bitwiseOR(F.lit(1))


def _day(block: str) -> Column:
    return F.split_part(F.col(block), F.lit("|"), F.lit(2))


def _edges(staged: DataFrame, events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of nodes that hang together as rows may meet: by one URL and day, one id, or titles alike at nearly one time.

    A row's node is its id's. It is tied to what it shares with others, not to them: a URL and day, or a title in a block in
    which it is found. Such places hang together where a staged row of one would look at the other. So there are a few edges a
    row, however many rows share something. A staged row is incoming first and stored later, under the day that it was read as.
    """
    before, columns = written(), ("id", "canon_url", "canon_signup", "start", "title")
    both = staged.select(*columns, F.lit(True).alias("comes")).unionByName(events.select(*columns, F.lit(False).alias("comes")))
    read = t.settled(both.select(_node("id").alias("node"), "comes", "canon_url", "canon_signup", "start", "title"), at=t.iso_start(F.col("start")))
    read = read.select("node", "comes", "canon_url", "canon_signup", F.col("at").alias("start"), F.substring("start", 1, 10).alias("stored_day"), t.norm_text(F.col("title")).alias("title"))
    rows = materialize(read.select("*", *(c.alias(k) for k, c in zip(("aware", "instant", "wall"), _timed("start"), strict=True))), "nodes")
    timed = (F.col("aware"), F.col("instant"), F.col("wall"))
    days = F.array_distinct(F.filter(F.array(F.substring("start", 1, 10), F.col("stored_day")), lambda d: d.isNotNull()))
    urls = rows.select("node", F.explode(F.array_distinct(F.filter(F.array("canon_url", "canon_signup"), lambda u: u.isNotNull()))).alias("url"), days.alias("days"))
    known = aliases.select(_node("event_id").alias("node"), F.col("canonical_url").alias("url")).join(rows.where("not comes").select("node", days.alias("days")).hint("merge"), "node")
    urls = urls.unionByName(known.select("node", "url", "days")).select("node", "url", F.explode("days").alias("day"))
    keyed = urls.select(F.col("node").alias("a"), _key("url", "url", "day").alias("b"), "day")
    dated = rows.where("start is not null and title <> ''")
    met = dated.agg(*(F.coalesce(F.max(F.expr(x)), F.lit(False)) for x in ("comes and aware", "comes and not aware", "not aware"))).first()
    kinds = [k for k, looked in (("both", met[0]), ("mine", met[0] and met[2]), ("none", met[1])) if looked]
    lie, in_kinds = stored_blocks("start", F.col("stored_day"), timed), F.substring("block", 1, 4).isin(*kinds)
    found = dated.select("node", "title", F.explode_outer(lie).alias("block")).where(in_kinds)
    looks = dated.where("comes").select("title", _key("title", F.when(F.col("aware"), lie[0]).otherwise(lie[1]), F.col("title")).alias("key"), F.explode_outer(incoming_blocks("start", timed)).alias("block")).where(in_kinds)
    lies = found.select("node", "block", "title", _key("title", "block", "title").alias("key"))
    tied = ties(looks, lies.select("block", "title", "key"), TITLE).select("a", "b", _day("block").alias("day"))
    edges = keyed.unionAll(lies.select("node", "key", _day("block"))).unionAll(tied)
    made = materialize(contracted(edges.select("a", "b", F.hash("day").alias("day")), "day"), "contracted")
    discard_since(before, made)
    return made


def finalize(staged: DataFrame, events: DataFrame, aliases: DataFrame, seen: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new event and alias tables, and (n, event_id, outcome) of every staged row.

    Starts of staged rows are put into ISO form first, those that can't be read stay as they are. staged has n (the order of discovery, unique), raw_keys (the keys its source gave) and FIELDS; events FIELDS; aliases
    event_id, canonical_url, url, source_id, first_seen, last_seen. whole: replay everything as one component (for tests).
    """
    staged, events = prepared(staged).withColumn("start", F.coalesce(t.iso_start(F.col("start")), "start")), prepared(events)
    return replayed(materialize(staged, "staged"), materialize(events, "stored"), aliases, seen, whole)


def replayed(staged: DataFrame, events: DataFrame, aliases: DataFrame, seen: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """finalize() for tables that are prepared and written; staged may have more columns."""
    events = events.drop("n", "raw_keys")
    fields, zero = events.columns, F.lit(0).cast("long")

    def part(rows: DataFrame, kind: int, n: Column, have: dict[str, str]) -> DataFrame:
        raw_keys = F.col("raw_keys") if "raw_keys" in rows.columns else F.lit(None).cast("array<string>")
        own = [(F.col(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
        return rows.select(F.lit(kind).cast("byte").alias("kind"), n.alias("n"), raw_keys.alias("raw_keys"), *own)

    same = {c: c for c in fields}
    rows = part(staged, _STAGED, F.col("n"), same).unionAll(part(events, _EVENT, zero, same)).unionAll(part(aliases, _ALIAS, zero, {c: a for a, c in _ALIASED.items()}))
    parts = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = written()
    if whole:
        grouped = rows.withColumn("root", zero)
    else:
        nodes = components(_edges(staged, events, aliases))
        own = staged.select(_node("id").alias("node")).distinct()
        # Components without a staged row pass by: their events and aliases stay as they are.
        busy = materialize(own.join(nodes.hint("merge"), "node", "left").select(F.coalesce("root", "node").alias("root")).distinct(), "busy")
        live = materialize(nodes.join(busy.hint("merge"), "root", "left_semi").select("node", "root").unionAll(busy.select(F.col("root").alias("node"), "root")), "live")
        discard_since(before, live)
        grouped = rows.withColumn("node", _node("id")).join(hinted(live), "node")
    dealt = grouped.select("root", "kind", "n", "raw_keys", *fields).repartition(parts, "root").sortWithinPartitions("root")
    schema = "kind byte, n long, outcome string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    result = materialize(dealt.mapInArrow(_replayed(seen, fields, [_ARROW[f.dataType.simpleString()] for f in events.schema]), schema), "replayed")
    discard_since(before, result)
    changed = result.where(F.col("kind") == _EVENT).select(*fields)
    kept = events.join(changed.select("id").hint("merge"), "id", "left_anti").select(*changed.columns)
    fresh = result.where(F.col("kind") == _ALIAS).select(*(F.col(c).alias(a) for a, c in _ALIASED.items()))
    stale = aliases.join(fresh.select("event_id", "canonical_url").hint("merge"), ["event_id", "canonical_url"], "left_anti").select(*fresh.columns)
    return kept.unionByName(changed), stale.unionByName(fresh), result.where(F.col("kind") == _OUTCOME).select("n", F.col("id").alias("event_id"), "outcome")

"""Read views over the event store and the catalog: filters, orders, groups, calendar and dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from listingloom.functions.text import RANK_ORDER, norm_text, rank_order, series_key
from listingloom.operators.accounting import PROBLEM_STATES, count_if

#: Orders a list may be asked for; anything else is by start.
SORTS = ("start", "title", "host", "place", "source", "rank", "status")


def day(start: str = "start") -> Column:
    """The local day of a start: its first ten characters, whatever its offset."""
    return F.substring(start, 1, 10)


def nocase(c: Column) -> Column:
    """ASCII letters folded, others kept."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_rank(rank: Column, floor: str | None) -> Column:
    """Whether a rank is at least floor; any row where floor isn't a rank."""
    return rank_order(rank) <= RANK_ORDER[floor] if floor in RANK_ORDER else F.lit(True)


def upcoming(events: DataFrame, as_of: str, days: int, floor: str | None = None, source: str | None = None) -> DataFrame:
    """Events not cancelled from as_of through days later, by start and rank."""
    last = F.date_add(F.lit(as_of).cast("date"), days).cast("string")
    rows = events.where((F.col("status") != "cancelled") & day().between(F.lit(as_of), last) & least_rank(F.col("rank"), floor))
    rows = rows.where(F.col("source_id") == source) if source else rows
    return rows.orderBy(F.coalesce("start", F.lit("")), rank_order(F.col("rank")))


def needs_rank(events: DataFrame, as_of: str, days: int | None = None, force: bool = False, host: str | None = None) -> DataFrame:
    """The ranking queue: not cancelled, undated or from as_of on, unranked unless forced or of one host, by start."""
    undated = F.coalesce("start", F.lit("")) == ""
    rows = events.where((F.col("status") != "cancelled") & (undated | (day() >= as_of)))
    rows = rows if force or host else rows.where(F.col("rank").isNull())
    if days is not None:
        rows = rows.where(undated | (day() <= F.date_add(F.lit(as_of).cast("date"), days).cast("string")))
    if host:
        rows = rows.where(F.lower("host").contains(host.lower()) | (F.col("source_id") == host))
    return rows.orderBy(F.coalesce("start", F.lit("")))


def sort_events(events: DataFrame, field: str = "start", descending: bool = False, limit: int = 500) -> DataFrame:
    """The first rows in one of SORTS, ties by latest start and title."""
    place = F.coalesce(F.nullif("neighborhood", F.lit("")), F.col("venue"))
    keys = {"start": F.col("start"), "title": nocase(F.col("title")), "host": nocase(F.col("host")), "place": nocase(place), "source": nocase(F.col("source_id")), "rank": rank_order(F.col("rank")), "status": F.col("status")}
    key = keys.get(field, keys["start"])
    return events.orderBy(key.desc() if descending else key.asc(), F.col("start").desc(), nocase(F.col("title")).asc(), "id").limit(limit)


def list_events(events: DataFrame, as_of: str, q: str = "", floor: str | None = None, period: str = "upcoming", source: str | None = None, sort: str = "start", descending: bool = False) -> DataFrame:
    """The event list: active rows that match a pattern in title, host, venue or description."""
    rows = events.where(F.col("status") == "active").where(least_rank(F.col("rank"), floor))
    if q:
        pattern = "%" + q.replace("\\", "\\\\").lower() + "%"
        rows = rows.where(F.greatest(*(nocase(F.coalesce(c, F.lit(""))).like(pattern) for c in ("title", "host", "venue", "description"))))
    if period == "upcoming":
        rows = rows.where(day() >= as_of)
    elif period == "past":
        rows = rows.where(day() < as_of)
    rows = rows.where(F.col("source_id") == source) if source else rows
    return sort_events(rows, sort, descending)


def events_between(events: DataFrame, first: str, last: str, floor: str | None = None, source: str | None = None) -> DataFrame:
    rows = events.where((F.col("status") == "active") & day().between(first, last)).where(least_rank(F.col("rank"), floor))
    rows = rows.where(F.col("source_id") == source) if source else rows
    return rows.orderBy("start", nocase(F.col("title")))


def calendar_grid(events: DataFrame, month: str, as_of: str) -> DataFrame:
    """Whole weeks, Monday first, that cover a month (yyyy-mm; anything else is the month of as_of), with each day's events."""
    spark = events.sparkSession
    valid = F.lit(month + "-01").try_cast("date") if len(month) == 7 else F.lit(None).cast("date")
    span = spark.range(1).select(F.coalesce(valid, F.trunc(F.lit(as_of).cast("date"), "month")).alias("first"))
    span = span.select("first", F.last_day("first").alias("last"))
    week = lambda c: F.date_trunc("week", c).cast("date")
    days = span.select("first", F.explode(F.sequence(week("first"), F.date_add(week("last"), 6))).alias("date"))
    days = days.select(F.col("date").cast("string").alias("date"), (F.trunc("date", "month") == F.col("first")).alias("in_month"))
    # Few days (at most 42): sent to the events, which are filtered to them before anything moves.
    shown = events.where("status = 'active'").select(day().alias("date"), "start", "title", "id").join(F.broadcast(days.select("date")), "date")
    counted = shown.groupBy("date").agg(F.count("*").alias("n"))
    # Three of a day are kept before the rows are dealt out, so a day's list never grows with its events.
    place = F.row_number().over(Window.partitionBy("date").orderBy("start", nocase(F.col("title")), "id"))
    first = shown.withColumn("k", place).where("k <= 3").groupBy("date").agg(F.array_sort(F.collect_list(F.struct("k", "title"))).alias("first"))
    grid = days.join(counted.join(first.hint("merge"), "date"), "date", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("int"))
    titles = F.transform(F.coalesce("first", F.array().cast("array<struct<k:int,title:string>>")), lambda e: e["title"])
    return grid.select("date", "in_month", (F.col("date") < as_of).alias("past"), (F.col("date") == as_of).alias("today"), "n", titles.alias("shown"), F.greatest(F.col("n") - 3, F.lit(0)).alias("more")).orderBy("date")


def rank_groups(queue: DataFrame, norm=norm_text) -> DataFrame:
    """The queue by series: the earliest occurrence stands for the group, occurrences are in order."""
    keyed = queue.withColumn("series_key", series_key(F.col("source_id"), F.col("host"), F.col("title"), norm))
    occurrences = F.array_sort(F.collect_list(F.struct(F.coalesce("start", F.lit("")).alias("start"), "id", "title", "venue", "neighborhood", "price", "status")))
    groups = keyed.groupBy("series_key").agg(occurrences.alias("occurrences"))
    return groups.select("series_key", F.get("occurrences", F.lit(0)).alias("first"), F.size("occurrences").alias("n"), "occurrences").orderBy("first.start", "first.id")


def dashboard_counts(events: DataFrame, runs: DataFrame, catalog: DataFrame, inbox: DataFrame, as_of: str) -> DataFrame:
    """One row of counts; sums over no events are null."""
    ahead = (day() >= as_of) & (F.col("status") != "cancelled")
    e = events.agg(F.count("*").alias("events"), F.sum(F.when(ahead, 1).otherwise(0)).alias("upcoming"), F.sum(F.when(ahead & F.col("rank").isNull(), 1).otherwise(0)).alias("unranked"))
    r = runs.agg(F.count("*").alias("runs"))
    c = catalog.agg(F.count("*").alias("sources"), count_if(F.col("enabled")).alias("enabled_sources"), count_if(~F.col("enabled")).alias("disabled_sources"), F.count_distinct("profile").alias("profiles"))
    i = inbox.agg(F.count("*").alias("inbox_items"))
    for one in (r, c, i):
        e = e.join(F.broadcast(one))  # one row each
    return e


def store_stats(events: DataFrame, as_of: str) -> DataFrame:
    """(kind, key, n): upcoming and past, upcoming by rank, upcoming by source. Undated events count as upcoming."""
    ahead = (F.coalesce(day(), F.lit("")) == "") | (day() >= as_of)
    marked = events.select(F.when(ahead, "upcoming").otherwise("past").alias("period"), F.coalesce("rank", F.lit("unranked")).alias("rank"), "source_id")
    cube = marked.groupingSets([["period"], ["period", "rank"], ["period", "source_id"]], "period", "rank", "source_id").agg(F.grouping_id("period", "rank", "source_id").alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 3, "period").when(F.col("g") == 1, "rank").otherwise("source")
    key = F.when(F.col("g") == 3, F.col("period")).when(F.col("g") == 1, F.col("rank")).otherwise(F.col("source_id"))
    return cube.where((F.col("g") == 3) | (F.col("period") == "upcoming")).select(kind.alias("kind"), key.alias("key"), "n")


def unranked_upcoming(events: DataFrame, as_of: str) -> DataFrame:
    return events.where(F.col("rank").isNull() & (day() >= as_of)).agg(F.count("*").alias("n"))


def newest_by_source(events: DataFrame, limit: int = 50) -> DataFrame:
    """The latest events of every source, place 1 first."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("start").desc(), F.col("id")))
    return events.withColumn("place", place).where(F.col("place") <= limit)


def issues(health: DataFrame, limit: int = 8) -> DataFrame:
    return health.where(F.col("state").isin(*PROBLEM_STATES)).orderBy(F.col("run_started_at").desc(), "source_id").limit(limit)


def all_sources(catalog: DataFrame, inbox: DataFrame, priority: int = 3, profile: str = "letters") -> DataFrame:
    """Website sources and inbox items, the latter with their defaults, and what kind each is."""
    filled = inbox.select(
        "id", "title", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("priority", F.lit(priority)).alias("priority"), F.lit("Inbox").alias("geo"),
        F.lit(True).alias("enabled"), F.lit("").alias("disabled_reason"), F.lit(profile).alias("profile"), F.lit("inbox").alias("kind"),
    )
    return catalog.withColumn("kind", F.lit("website")).unionByName(filled, allowMissingColumns=True)


def catalog_with_health(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Every source of the catalog with its health; sources known from history alone are left out."""
    return sources.join(health.select(F.col("source_id").alias("id"), "run_id", "state", "last_audited_at"), "id", "left")


def historical_sources(sources: DataFrame, source_runs: DataFrame, events: DataFrame) -> DataFrame:
    """Sources that runs or events name and the catalog doesn't, with defaults."""
    named = source_runs.select("source_id").union(events.select("source_id")).distinct()
    gone = named.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return gone.select(F.col("source_id").alias("id"), F.col("source_id").alias("title"), F.lit(3).alias("priority"), F.lit("Not in current catalog").alias("geo"), F.lit(False).alias("enabled"), F.lit("historical").alias("kind"))


def filter_sources(sources: DataFrame, q: str = "", state: str = "enabled") -> DataFrame:
    """Sources by a substring of five fields, and enabled, disabled, with issues, or all."""
    rows = sources.where(F.lower(F.concat_ws(" ", "id", "title", "url", "geo", "profile")).contains(q.lower())) if q else sources
    if state == "all":
        return rows
    if state == "issues":
        return rows.where(F.col("state").isin(*PROBLEM_STATES))
    return rows.where(~F.col("enabled") if state == "disabled" else F.col("enabled"))

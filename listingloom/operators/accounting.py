"""Runs, source runs and discoveries: duplicates within a run, counters, rejection reasons, health and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PROBLEM_STATES = ("empty_suspicious", "parse_failed", "validation_failed", "fetch_failed", "auth_required", "blocked")
GOOD_STATES = ("ok", "ok_via_fallback", "empty_verified")
OUTCOMES = ("new", "updated", "unchanged", "duplicate", "rejected")


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def mark_duplicates(discoveries: DataFrame) -> DataFrame:
    """The first discovery of an event in a run keeps its outcome, later ones become duplicates; rejected ones stay."""
    order = Window.partitionBy("run_id", "event_id", F.col("outcome") == "rejected").orderBy("discovery_id")
    later = (F.row_number().over(order) > 1) & (F.col("outcome") != "rejected")
    return discoveries.withColumn("outcome", F.when(later, "duplicate").otherwise(F.col("outcome")))


def finalized_counts(discoveries: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Counters by run and source from marked discoveries; planned (run_id, source_id) rows without any keep zeros."""
    outcome = F.col("outcome")
    found = discoveries.groupBy("run_id", "source_id").agg(
        F.count("*").alias("found"),
        count_if(outcome != "rejected").alias("parsed"),
        count_if(outcome != "rejected").alias("qualified"),
        *(count_if(outcome == o).alias(o) for o in OUTCOMES),
    )
    if planned is None:
        return found
    return planned.select("run_id", "source_id").join(found, ["run_id", "source_id"], "left").fillna(0)


def rejection_counts(discoveries: DataFrame) -> DataFrame:
    """A row for each run, source and reason of its rejected discoveries; no or a blank reason counts as 'rejected'."""
    rejected = discoveries.where("outcome = 'rejected'")
    return rejected.groupBy("run_id", "source_id", F.coalesce(F.nullif("reason", F.lit("")), F.lit("rejected")).alias("reason")).agg(F.count("*").alias("n"))


def rejection_histogram(discoveries: DataFrame) -> DataFrame:
    """rejection_counts as a map for each run and source."""
    pairs = F.array_sort(F.collect_list(F.struct("reason", "n")))
    return rejection_counts(discoveries).groupBy("run_id", "source_id").agg(F.map_from_entries(pairs).alias("rejection_counts"))


def staged_counts(events: DataFrame, rejections: DataFrame) -> DataFrame:
    """Counters at staging: events (run_id, source_id, start) and rejections (run_id, source_id, reason)."""
    keys = ["run_id", "source_id"]
    e = events.groupBy(*keys).agg(F.count("*").alias("events"), count_if(F.coalesce("start", F.lit("")) != "").alias("parsed"))
    r = rejections.groupBy(*keys).agg(F.count("*").alias("rejections"))
    both = e.join(r, keys, "full").fillna(0)
    return both.select(*keys, (F.col("events") + F.col("rejections")).alias("found"), "parsed", F.col("parsed").alias("qualified"), (F.col("rejections") + F.col("events") - F.col("parsed")).alias("rejected"))


def final_state(state: Column, found: Column, missing_start: Column) -> Column:
    return F.when((state == "ok") & (missing_start > 0), "validation_failed").when((state == "ok") & (found == 0), "empty_suspicious").otherwise(state)


def run_totals(discoveries: DataFrame, store_size: int | None = None) -> DataFrame:
    """For each run: scraped, after_dedup, new."""
    outcome = F.col("outcome")
    return discoveries.groupBy("run_id").agg(F.count("*").alias("scraped"), count_if(~outcome.isin("duplicate", "rejected")).alias("after_dedup"), count_if(outcome == "new").alias("new"))


def run_detail_totals(source_runs: DataFrame, discoveries: DataFrame) -> DataFrame:
    """Counters of a run's page: over its sources, and over its discoveries by outcome."""
    s = source_runs.groupBy("run_id").agg(F.count("*").alias("sources"), count_if(~F.col("state").isin("not_due", "pending")).alias("checked"), count_if(F.col("state").isin(*PROBLEM_STATES)).alias("issues"))
    d = discoveries.groupBy("run_id").agg(F.count("*").alias("discoveries"), *(count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    d = d.withColumn("existing", F.col("updated") + F.col("unchanged"))
    return s.join(d, "run_id", "full").fillna(0)


def list_runs(runs: DataFrame, source_runs: DataFrame, discoveries: DataFrame, limit: int = 100) -> DataFrame:
    """The newest runs with their counts; children are counted by run first, so nothing fans out."""
    s = source_runs.groupBy("run_id").agg(F.count_distinct("source_id").alias("source_count"), F.count_distinct(F.when(F.col("state").isin(*PROBLEM_STATES), F.col("source_id"))).alias("issue_count"))
    d = discoveries.groupBy("run_id").agg(F.count("*").alias("discovery_count"), count_if(F.col("outcome") == "new").alias("new_count"), count_if(F.col("outcome") == "rejected").alias("rejected_count"))
    both = runs.join(s, "run_id", "left").join(d, "run_id", "left").fillna(0, ["source_count", "issue_count", "discovery_count", "new_count", "rejected_count"])
    return both.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def latest_health(source_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each source's row of its newest completed run, with the newest finish of an audit in good state."""
    completed = runs.where("state = 'completed'").select("run_id", "seen_date", F.col("started_at").alias("run_started_at"))
    newest = Window.partitionBy("source_id").orderBy(F.col("run_started_at").desc(), F.col("run_id").desc())
    rows = source_runs.join(completed, "run_id").withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k")
    audited = source_runs.where(F.col("audit") & F.col("state").isin(*GOOD_STATES)).groupBy("source_id").agg(F.max("finished_at").alias("last_audited_at"))
    return rows.join(audited, "source_id", "left")


def previous_states(source_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source run with the state of the same source in the run before, and whether it changed."""
    rows = source_runs.join(runs.select("run_id", "started_at"), "run_id")
    before = F.lag("state").over(Window.partitionBy("source_id").orderBy("started_at", "run_id"))
    return rows.withColumn("previous_state", before).withColumn("state_changed", F.col("previous_state").isNotNull() & (F.col("previous_state") != F.col("state")))


def source_history(source_runs: DataFrame, runs: DataFrame, limit: int = 30) -> DataFrame:
    """The newest runs of every source, newest first (place 1), whatever their state."""
    rows = source_runs.join(runs.select("run_id", "seen_date", F.col("started_at").alias("run_started_at")), "run_id")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("run_started_at").desc(), F.col("run_id").desc()))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def discoveries_with_event(discoveries: DataFrame, events: DataFrame) -> DataFrame:
    """Discoveries with the title and start to show: the event's, else the raw ones, else a stand-in."""
    named = events.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"), F.col("start").alias("event_start"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = discoveries.join(named, "event_id", "left")
    return rows.withColumn("display_title", F.coalesce(blank("event_title"), blank("raw_title"), F.lit("Untitled candidate"))).withColumn("display_start", F.coalesce(blank("event_start"), blank("raw_start"), F.lit("")))

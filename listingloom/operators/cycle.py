"""The cycle of a run: results are staged, a finished run is merged into the store, an older payload is merged at once.

Each step takes tables and returns the new ones with its violations; what has a violation changes nothing. Writing the
tables is up to `sources.store`. Discoveries have discovery_id, run_id, source_id, event_id, outcome, reason, raw (JSON);
of source_runs and runs only the columns that are there are set.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from listingloom.functions import text as t
from listingloom.functions.events import normalised
from listingloom.operators.accounting import final_state, finalized_counts, rejection_counts, rejection_histogram, staged_counts
from listingloom.operators.checks import check_payload, check_staging
from listingloom.operators.resolve import FIELDS, prepared, replayed
from listingloom.operators.updates import numbered, replace_rows
from listingloom.session import hinted, materialize, spread

KEYS = ["run_id", "source_id"]
COUNTERS = ("found", "parsed", "qualified", "rejected", "new", "updated", "unchanged", "duplicate")


class Closed(NamedTuple):
    """The tables after a run, its violations, and one row of totals (none where there is a violation)."""

    events: DataFrame
    aliases: DataFrame
    discoveries: DataFrame
    source_runs: DataFrame
    runs: DataFrame
    problems: DataFrame
    totals: DataFrame | None


def _said(raw: str, *names: str) -> Column:
    return t.given(*(F.get_json_object(raw, f"$.{n}") for n in names))


def _shaped(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows with the columns of another table, null where they have none."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))


def _set(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with the columns that new has too taken from it, where it has a row of these keys."""
    taken = [c for c in new.columns if c in table.columns and c not in keys]
    fresh = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in taken), F.lit(True).alias("_hit"))
    both = table.join(fresh.hint("merge"), keys, "left")
    return both.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in taken else F.col(c) for c in table.columns))


def _candidates(events: DataFrame, rejections: DataFrame) -> DataFrame:
    """Both lists as discoveries without numbers: events are staged, rejections keep their reason; events come first."""
    parts = [
        events.select(*events.columns, F.lit(0).alias("part"), F.lit("staged").alias("outcome"), F.lit(None).cast("string").alias("reason")),
        rejections.withColumn("reason", F.coalesce(F.nullif("reason", F.lit("")), F.lit("rejected"))).withColumn("outcome", F.lit("rejected")).withColumn("part", F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("raw_title", F.coalesce(_said("raw", "title"), F.lit(""))).withColumn("raw_start", F.coalesce(_said("raw", "start", "start_datetime"), F.lit("")))


def stage_results(results: DataFrame, events: DataFrame, rejections: DataFrame, runs: DataFrame, source_runs: DataFrame, discoveries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New discoveries and source_runs after results were staged, and (run_id, source_id, problem) of those that weren't.

    results has run_id, source_id, state and columns of source_runs to set; events run_id, source_id, position, raw;
    rejections also reason. A staged result replaces all earlier discoveries of its run and source, also by nothing.
    """
    foreign = lambda rows, what: rows.where(_said("raw", "source_id") != F.col("source_id")).select(*KEYS, F.lit(f"{what} of another source").alias("problem"))
    shapeless = lambda rows, what: rows.where(F.json_object_keys("raw").isNull()).select(*KEYS, F.lit(f"{what} is no object").alias("problem"))
    rules = [
        check_staging(results, runs, source_runs),
        results.groupBy(*KEYS).agg(F.count("*").alias("k")).where("k > 1").select(*KEYS, F.lit("reported twice").alias("problem")),
        *(rule(rows, what) for rule in (foreign, shapeless) for rows, what in ((events, "event"), (rejections, "rejection"))),
    ]
    problems = materialize(reduce(DataFrame.unionByName, rules).distinct(), "staging_problems")
    good = materialize(results.dropna(subset=KEYS).join(problems.select(*KEYS).hint("merge"), KEYS, "left_anti"), "staging")
    wanted = hinted(good.select(*KEYS))
    mine = lambda rows: rows.join(wanted, KEYS, "left_semi")
    own_events, own_rejections = mine(events).select(*KEYS, "position", "raw"), mine(rejections).select(*KEYS, "position", "raw", "reason")
    kept = discoveries.join(wanted, KEYS, "left_anti").select(*discoveries.columns)
    staged = numbered(kept, _candidates(own_events, own_rejections), KEYS, ["part", "position"])
    counts = staged_counts(own_events.withColumn("start", F.coalesce(_said("raw", "start", "start_datetime"), F.lit(""))), own_rejections)
    rows = good.join(counts.hint("merge"), KEYS, "left").fillna(0, ["found", "parsed", "qualified", "rejected"])
    reasons = rejection_histogram(own_rejections.withColumn("outcome", F.lit("rejected")))
    rows = rows.drop("rejection_counts").join(reasons.hint("merge"), KEYS, "left")
    plain = [c for c in good.columns if c not in {f"{n}_count" for n in COUNTERS} | {"rejection_counts"}]
    rows = rows.select(*plain, *((F.col(n) if n in ("found", "parsed", "qualified", "rejected") else F.lit(0)).cast("long").alias(f"{n}_count") for n in COUNTERS), _reasons())
    return kept.unionByName(_shaped(staged, discoveries)), _set(source_runs, rows, KEYS), problems


def _reasons() -> Column:
    return F.coalesce("rejection_counts", F.expr("cast(map() as map<string, bigint>)")).alias("rejection_counts")


def run_problems(runs: DataFrame, source_runs: DataFrame, discoveries: DataFrame) -> DataFrame:
    """(run_id, source_id, problem) of what keeps runs from being finalized: not running, pending sources, strange outcomes."""
    strange = ~F.coalesce(F.col("outcome").isin("staged", "rejected"), F.lit(False))
    rules = [
        runs.where(~F.coalesce(F.col("state") == "running", F.lit(False))).select("run_id", F.lit("").alias("source_id"), F.lit("run isn't running").alias("problem")),
        source_runs.where("state = 'pending'").select(*KEYS, F.lit("still pending").alias("problem")),
        discoveries.where(strange).select(*KEYS, F.concat(F.lit("unexpected outcome "), F.coalesce("outcome", F.lit("<none>"))).alias("problem")).distinct(),
    ]
    return reduce(DataFrame.unionByName, rules)


def _merged(fresh: DataFrame, events: DataFrame, aliases: DataFrame, seen: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New events and aliases, and the fresh discoveries, without their JSON, with what became of the staged ones."""
    found = spread(fresh.where("outcome = 'staged'").select("discovery_id", "source_id", "raw"), "discovery_id")
    staged = normalised(found, "raw", seen, F.col("discovery_id").alias("n"), F.nullif("source_id", F.lit("unknown")).alias("found_by"))
    staged = staged.withColumn("source_id", F.coalesce(F.nullif("source_id", F.lit("")), "found_by", F.lit(""))).drop("found_by")
    # Columns that no merge touches: those of the store, and for new events those of the row that made them.
    others = [c for c in events.columns if c not in FIELDS]
    own = [c for c in others if c in staged.columns]
    staged = materialize(prepared(staged, *own, dealt=True).withColumn("start", F.coalesce(t.iso_start(F.col("start")), "start")), "staged")
    stored = materialize(prepared(events), "stored")
    new, urls, outcomes = replayed(staged, stored, aliases, seen)
    told = outcomes.select(F.col("n").alias("discovery_id"), "event_id", "outcome", F.when(F.col("outcome") == "rejected", "missing_start").alias("reason"))
    marked = materialize(_set(fresh.drop("raw"), told, ["discovery_id"]), "merged")
    store = _shaped(new, events)
    if others:
        made = staged.join(outcomes.where("outcome = 'new'").select("n", "event_id").hint("merge"), "n").where("id = event_id")
        known = events.select("id", *others).unionByName(_shaped(made, events.select("id", *others)))
        store = _shaped(new.select(*FIELDS).join(known.hint("merge"), "id", "left"), events)
    return store, urls, marked


def _whole(marked: DataFrame, fresh: DataFrame) -> DataFrame:
    """Marked discoveries with all columns of the fresh ones, the JSON joined back."""
    rest = fresh.select("discovery_id", *(c for c in fresh.columns if c not in marked.columns))
    return marked.join(rest.hint("merge"), "discovery_id", "left").select(*fresh.columns)


def _counted(marked: DataFrame, planned: DataFrame) -> DataFrame:
    """(run_id, source_id) of planned with the counters, the reasons and the final state that its discoveries give it."""
    counts = finalized_counts(marked, planned).select(*KEYS, *(F.col(n).cast("long").alias(f"{n}_count") for n in COUNTERS))
    missing = rejection_counts(marked).where("reason = 'missing_start'").select(*KEYS, F.col("n").alias("missing"))
    rows = planned.select(*KEYS, "state").join(counts.hint("merge"), KEYS).join(missing.hint("merge"), KEYS, "left").join(rejection_histogram(marked).hint("merge"), KEYS, "left")
    state = final_state(F.col("state"), F.col("found_count"), F.coalesce("missing", F.lit(0)))
    return rows.select(*KEYS, state.alias("state"), *(f"{n}_count" for n in COUNTERS), _reasons())


def _totals(marked: DataFrame, events: DataFrame) -> DataFrame:
    """One row: outcomes, existing (updated or unchanged), and the size of the store."""
    n = lambda *outcomes: F.count_if(F.col("outcome").isin(*outcomes))
    own = marked.agg(*(n(o).alias(o) for o in ("new", "updated", "unchanged", "duplicate", "rejected")), n("updated", "unchanged").alias("existing"))
    return own.join(F.broadcast(events.agg(F.count("*").alias("store"))), F.lit(True))


def _completed(runs: DataFrame, run_id: str, finished_at: str) -> DataFrame:
    mine = F.coalesce(F.col("run_id") == run_id, F.lit(False))
    done = {"state": "completed", "finished_at": finished_at}
    return runs.select(*(F.when(mine, done[c]).otherwise(F.col(c)).alias(c) if c in done else F.col(c) for c in runs.columns))


def finalize_run(run_id: str, runs: DataFrame, source_runs: DataFrame, discoveries: DataFrame, events: DataFrame, aliases: DataFrame, finished_at: str = "") -> Closed:
    """One run merged: all staged discoveries replayed in order of their ids, every source recounted, the run completed.

    Nothing is changed where the run is unknown or not running, a source is pending, or an outcome is neither staged nor
    rejected: the tables come back as they are, with the violations.
    """
    mine = lambda rows: rows.where(F.col("run_id") == run_id)
    unknown = mine(runs).agg(F.count("*").alias("k")).where("k = 0").select(F.lit(run_id).alias("run_id"), F.lit("").alias("source_id"), F.lit("unknown run").alias("problem"))
    problems = materialize(run_problems(mine(runs), mine(source_runs), mine(discoveries)).unionByName(unknown), "run_problems")
    if not problems.isEmpty():
        return Closed(events, aliases, discoveries, source_runs, runs, problems, None)
    seen = mine(runs).first()["seen_date"]
    store, urls, marked = _merged(mine(discoveries), events, aliases, seen)
    others = discoveries.where(~F.coalesce(F.col("run_id") == run_id, F.lit(False)))
    counted = _set(source_runs, _counted(marked, mine(source_runs)), KEYS)
    return Closed(store, urls, others.unionByName(_whole(marked, mine(discoveries))), counted, _completed(runs, run_id, finished_at), problems, _totals(marked, store))


def merge_payload(
    run_id: str, seen: str, sources: DataFrame, events: DataFrame, rejections: DataFrame, runs: DataFrame, source_runs: DataFrame, discoveries: DataFrame,
    store: DataFrame, aliases: DataFrame, manifest: DataFrame | None = None, started_at: str = "", finished_at: str = "",
) -> Closed:
    """A payload merged as a run of its own: sources (columns of source_runs but run_id), events (position, raw), rejections
    (position, reason, source_id, raw), in the order of their positions.

    The run is made where it isn't there. Sources that only candidates name get a row with state ok; a candidate without a
    source belongs to 'unknown'. With a manifest (source_id), the payload is checked against it first, and a violation leaves
    the tables as they are.
    """
    told = _said("raw", "source_id")
    of_events = events.select("position", "raw", told.alias("source_id"))
    of_rejections = rejections.select("position", "raw", "reason", F.coalesce(F.nullif("source_id", F.lit("")), told).alias("source_id"))
    rows = _candidates(of_events, of_rejections)
    planned = manifest if manifest is not None else sources.limit(0)
    problems = check_payload(planned, sources, rows) if manifest is not None else planned.select("source_id", F.lit("").alias("problem"))
    problems = materialize(problems.select(F.lit(run_id).alias("run_id"), "source_id", "problem"), "payload_problems")
    if not problems.isEmpty():
        return Closed(store, aliases, discoveries, source_runs, runs, problems, None)
    # Positions are unique in each list, so numbers need no sort: events first, rejections behind them.
    last = discoveries.agg(F.coalesce(F.max("discovery_id"), F.lit(0)).alias("last")).join(F.broadcast(of_events.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("size"))), F.lit(True))
    fresh = rows.join(F.broadcast(last), F.lit(True)).withColumn("discovery_id", F.col("last") + 1 + F.col("position") + F.when(F.col("part") == 1, F.col("size")).otherwise(0))
    fresh = fresh.withColumn("run_id", F.lit(run_id)).withColumn("source_id", F.coalesce("source_id", F.lit("unknown")))
    fresh = materialize(_shaped(fresh, discoveries), "discovered")
    new, urls, marked = _merged(fresh, store, aliases, seen)
    derived = marked.select("source_id").distinct().join(sources.select("source_id").hint("merge"), "source_id", "left_anti").withColumn("state", F.lit("ok"))
    given = sources.withColumn("run_id", F.lit(run_id)).unionByName(derived.withColumn("run_id", F.lit(run_id)), allowMissingColumns=True)
    counted = _shaped(_counted(marked, given).join(given.drop("state", "rejection_counts", *(f"{n}_count" for n in COUNTERS)).hint("merge"), KEYS), source_runs)
    own = runs.where(F.col("run_id") == run_id)
    made = own.agg(F.count("*").alias("k")).where("k = 0").select(F.lit(run_id).alias("run_id"), F.lit(seen).alias("seen_date"), F.lit(started_at).alias("started_at"), F.lit("running").alias("state"))
    every = runs.unionByName(_shaped(made, runs))
    return Closed(new, urls, discoveries.unionByName(_whole(marked, fresh)), replace_rows(source_runs, counted, KEYS), _completed(every, run_id, finished_at), problems, _totals(marked, new))

"""Store updates as table-to-table jobs: each takes tables and returns the new ones; writing them is the caller's swap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from listingloom.functions import text as t
from listingloom.operators.accounting import rejection_counts


def with_canonical(rows: DataFrame) -> DataFrame:
    """rows with canonical_url of url."""
    return t.settled(rows, canonical_url=t.canon_url(F.col("url")))


def upsert_events(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace the stored ones of their id, all columns; others stay. The last of repeated ids wins by n."""
    last = incoming.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc()))).where("k = 1").select(*store.columns)
    return store.join(last.select("id"), "id", "left_anti").select(*store.columns).unionByName(last)


def upsert_aliases(aliases: DataFrame, sightings: DataFrame) -> DataFrame:
    """Aliases with new sightings (event_id, url, source_id, seen) taken in.

    Only URLs that name an event count. The newest URL text that isn't blank stays, the oldest source that isn't blank,
    the earliest first_seen and the latest last_seen. is_new tells aliases that weren't there.
    """
    new = with_canonical(sightings).where(t.is_event_url(F.col("canonical_url")))
    new = new.select("event_id", "canonical_url", "url", F.coalesce("source_id", F.lit("")).alias("source_id"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), F.lit(1).alias("age"))
    both = aliases.select("event_id", "canonical_url", "url", "source_id", "first_seen", "last_seen", F.lit(0).alias("age")).unionByName(new)
    said = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.struct("age", "first_seen", c))
    grouped = both.groupBy("event_id", "canonical_url").agg(
        F.coalesce(F.max(said(F.col("url")))["url"], F.lit("")).alias("url"),
        F.coalesce(F.min(said(F.col("source_id")))["source_id"], F.lit("")).alias("source_id"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), (F.min("age") == 1).alias("is_new"),
    )
    return grouped


def backfill_aliases(events: DataFrame) -> DataFrame:
    """The alias of every stored event's own URL."""
    own = with_canonical(events).where(t.is_event_url(F.col("canonical_url")))
    return own.select(F.col("id").alias("event_id"), "canonical_url", "url", "source_id", "first_seen", "last_seen")


def event_aliases(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases of every event, with is_preferred for the one of its own URL."""
    own = events.select(F.col("id").alias("event_id"), t.canon_url(F.col("url")).alias("own"))
    return aliases.join(own, "event_id").withColumn("is_preferred", F.col("canonical_url") == F.col("own")).drop("own")


def merge_fields(pairs: DataFrame) -> DataFrame:
    """Field rules on joined rows with structs old and new (and new.raw_keys): the merged row and whether it changed.

    A later value wins unless it is blank, false or zero; the same source may clear some fields it names; the longer
    description wins; a URL that names no event gives way to one that does; the rest never changes.
    """
    from listingloom.operators.resolve import CLEARABLE, VOLATILE

    o, n = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    fields = [f for f in pairs.schema["old"].dataType.names if f != "raw_keys"]

    def said(c: str):
        kind = pairs.schema["new"].dataType[c].dataType.simpleString()
        return F.coalesce(n(c), F.lit(False)) if kind == "boolean" else F.coalesce(n(c) != F.lit("" if kind == "string" else 0), F.lit(False))

    out, changes = {}, []
    pairs = t.settled(pairs, _was=t.canon_url(o("url")), _is=t.canon_url(n("url")))
    named_old, named_new = (t.is_event_url(F.col(c)) for c in ("_was", "_is"))
    for c in fields:
        if c in VOLATILE:
            clears = F.array_contains(n("raw_keys"), c) & o("source_id").eqNullSafe(n("source_id")) if c in CLEARABLE else F.lit(False)
            change = (said(c) | clears) & ~o(c).eqNullSafe(n(c))
        elif c == "description":
            change = F.length(F.coalesce(n(c), F.lit(""))) > F.length(F.coalesce(o(c), F.lit("")))
        elif c == "url":
            change = ~named_old & named_new
        else:
            change = F.lit(False)
        out[c] = F.when(change, n(c)).otherwise(o(c)).alias(c)
        changes.append(F.coalesce(change, F.lit(False)))
    return pairs.select(*out.values(), F.greatest(*changes).alias("changed"))


def replace_rows(table: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Staging anew: all earlier rows of the staged keys go, even where nothing comes instead."""
    gone = staged.select(*keys).distinct()
    return table.join(gone, keys, "left_anti").select(*table.columns).unionByName(staged.select(*table.columns))


def upsert_source_runs(source_runs: DataFrame, rows: DataFrame) -> DataFrame:
    return replace_rows(source_runs, rows, ["run_id", "source_id"])


def numbered(before: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with a discovery_id each, going on from the largest of before, by keys and, within them, by order.

    Ranks are taken within each key and shifted by the keys before it, so no task sees all rows; only the sizes of the keys
    (a row for each source and run) are summed up in one.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    shift = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    last = before.agg(F.coalesce(F.max("discovery_id"), F.lit(0)).alias("_last"))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    every = ranked.join(shift.hint("merge"), keys).join(F.broadcast(last), F.lit(True))
    return every.withColumn("discovery_id", (F.col("_last") + F.col("_before") + F.col("_k")).cast("long")).drop("_last", "_before", "_k")


def record_discoveries(discoveries: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows appended with ids that go on from the largest, by source ('unknown' where it is null) and position."""
    rows = rows.withColumn("source_id", F.coalesce("source_id", F.lit("unknown")))
    return discoveries.unionByName(numbered(discoveries, rows, ["source_id"], ["position"]).select(*discoveries.columns))


def invalidate_events(events: DataFrame, aliases: DataFrame, discoveries: DataFrame, ids: DataFrame, source_id: str, reason: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Repair: a source's events deleted with their aliases, their discoveries rejected, the touched source runs recounted.

    Returns events, aliases, discoveries, (run_id, source_id, reason, n) of the touched runs, the touched runs' new columns
    of source_runs, and (id, problem) of ids that aren't the source's. If there is one of these, nothing is changed.
    """
    listed = ids.select("id").distinct()
    own = events.where(F.col("source_id") == source_id).join(listed, "id", "left_semi").select(F.col("id").alias("event_id"))
    foreign = listed.join(own, F.col("id").eqNullSafe(F.col("event_id")), "left_anti")
    own = own.join(F.broadcast(foreign.limit(1)), F.lit(True), "left_anti")
    hit = discoveries.join(own.withColumn("hit", F.lit(True)), "event_id", "left")
    changed = hit.withColumn("outcome", F.when(F.col("hit"), "rejected").otherwise(F.col("outcome"))).withColumn("reason", F.when(F.col("hit"), reason).otherwise(F.col("reason")))
    changed = changed.withColumn("event_id", F.when(F.col("hit").isNull(), F.col("event_id")))
    touched = changed.where("hit").select("run_id", "source_id").distinct()
    return (
        events.join(own.withColumnRenamed("event_id", "id"), "id", "left_anti"),
        aliases.join(own, "event_id", "left_anti"),
        changed.select(*discoveries.columns),
        rejection_counts(changed).join(touched, ["run_id", "source_id"], "left_semi"),
        _recounted(changed.join(touched, ["run_id", "source_id"], "left_semi"), reason),
        foreign.select("id", F.lit("not an event of the source").alias("problem")),
    )


def _recounted(discoveries: DataFrame, reason: str) -> DataFrame:
    """Counts of each run and source after a repair; what the repair rejected had been parsed."""
    n = lambda *outcomes: F.count_if(F.col("outcome").isin(*outcomes))
    qualified = n("new", "updated", "unchanged", "duplicate")
    repaired = F.count_if((F.col("outcome") == "rejected") & (F.col("reason") == reason))
    return discoveries.groupBy("run_id", "source_id").agg(
        F.lit("validation_failed").alias("state"), F.count("*").alias("found_count"), (qualified + repaired).alias("parsed_count"), qualified.alias("qualified_count"),
        *(n(o).alias(f"{o}_count") for o in ("rejected", "new", "updated", "unchanged", "duplicate")), F.lit(reason).alias("error"),
    )


def drop_aliases(aliases: DataFrame, source_id: str, day: str) -> DataFrame:
    return aliases.where(~((F.col("source_id") == source_id) & (F.col("first_seen") == day)))


def apply_ranks(events: DataFrame, groups: DataFrame, single: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Events with ranking decisions, and (id, problem) of those that fit no event or no rank.

    groups has ids, rank, note; single id, rank, note and overrides a group; of several the last (largest n) wins. A blank
    rank stamps the event and may set its note, but leaves the rank.
    """
    spread = groups.select(F.explode("ids").alias("id"), "rank", "note", "n", F.lit(0).alias("level"))
    every = spread.unionByName(single.select("id", "rank", "note", "n", F.lit(1).alias("level")))
    last = every.groupBy("id").agg(F.max_by(F.struct("rank", "note"), F.struct("level", "n")).alias("d")).select("id", "d.rank", "d.note")
    blank = F.coalesce("rank", F.lit("")) == ""
    good = last.where(blank | F.col("rank").isin(*t.RANKS))
    problems = last.where(~blank & ~F.col("rank").isin(*t.RANKS)).select("id", F.lit("bad rank").alias("problem"))
    problems = problems.unionByName(good.join(events.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("problem")))
    d = good.select("id", F.nullif("rank", F.lit("")).alias("new_rank"), F.nullif("note", F.lit("")).alias("new_note"), F.lit(as_of).alias("stamp"))
    joined = events.join(d, "id", "left")
    ranked = joined.withColumn("rank", F.coalesce("new_rank", "rank")).withColumn("fit_note", F.coalesce("new_note", F.col("fit_note") if "fit_note" in events.columns else F.lit(None))).withColumn("ranked_on", F.coalesce("stamp", F.col("ranked_on") if "ranked_on" in events.columns else F.lit(None)))
    return ranked.drop("new_rank", "new_note", "stamp"), problems


def start_runs(runs: DataFrame, planned: DataFrame) -> DataFrame:
    """Runs not there yet are added: running, or completed at once where they have no work (pending)."""
    new = planned.groupBy("run_id", "seen_date", "started_at").agg(F.count_if(F.col("state") == "pending").alias("pending"))
    new = new.join(runs.select("run_id"), "run_id", "left_anti")
    return runs.unionByName(new.select("run_id", "seen_date", "started_at", F.when(F.col("pending") > 0, "running").otherwise("completed").alias("state")))


def import_legacy(events: DataFrame, discoveries: DataFrame) -> DataFrame:
    """Outcomes of discoveries from a file store: 'new' where their event exists, else rejected."""
    known = events.select(F.col("id").alias("event_id"), F.lit(True).alias("known"))
    return discoveries.drop("outcome").join(known, "event_id", "left").withColumn("outcome", F.when(F.col("known"), "new").otherwise("rejected")).drop("known")

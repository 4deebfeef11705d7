"""Validation as tables of violations, set differences and duplicates; and the run plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

RETRY_STATES = ("empty_suspicious", "parse_failed", "validation_failed", "fetch_failed")
FINAL_STATES = ("ok", "ok_via_fallback", "empty_verified", "empty_suspicious", "parse_failed", "validation_failed", "fetch_failed", "auth_required", "blocked")


def manifest_diff(manifest: DataFrame, rows: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, problem): planned but missing, present but not planned."""
    a, b = manifest.select(key).distinct(), rows.select(key).distinct()
    return a.exceptAll(b).withColumn("problem", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("extra")))


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the first place of each."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def profile_references(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, profile) that name no profile, kind dangling; profiles in use, kind used (their id null)."""
    names = profiles.select(F.col("name").alias("profile"))
    gone = sources.join(names, "profile", "left_anti").select("id", "profile", F.lit("dangling").alias("kind"))
    used = names.join(sources.select("profile"), "profile", "left_semi").select(F.lit(None).cast("string").alias("id"), "profile", F.lit("used").alias("kind"))
    return gone.unionByName(used)


def check_catalog(sources: DataFrame, profiles: DataFrame, inbox: DataFrame | None = None) -> DataFrame:
    """(id, problem) of a catalog: sources (id, enabled, disabled_reason, adapter, profile), profiles (name), inbox (id, profile).

    What a typed table can't show comes as flags, as `tables.read_catalog` gives them: bad_enabled, bad_adapter and has_cadence
    of sources, has_cadence of the inbox, has_primary, has_required_fields, has_empty_signal and has_audit_cadence of
    profiles. A rule whose flag is no column isn't checked. The id of a problem of the inbox as a whole is empty.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    said = lambda rows, problem: rows.select("id", F.lit(problem).alias("problem"))
    named, names = sources.where(~blank("id")), profiles.select(F.col("name").alias("profile"))
    rules = [
        sources.where(blank("id")).select(F.lit("").alias("id"), F.lit("source without id").alias("problem")),
        said(duplicate_ids(named), "duplicate source id"),
        said(named.where(~F.coalesce("enabled", F.lit(True)) & blank("disabled_reason")), "disabled without reason"),
        said(named.where((F.col("bad_adapter") if "bad_adapter" in sources.columns else F.lit(False)) | (F.col("adapter").isNotNull() & blank("adapter"))), "invalid adapter"),
        named.join(names, "profile", "left_anti").select("id", F.concat(F.lit("missing profile "), F.coalesce(F.nullif("profile", F.lit("")), F.lit("<none>"))).alias("problem")),
    ]
    if "bad_enabled" in sources.columns:
        rules.append(said(named.where("bad_enabled"), "non-boolean enabled"))
    if "has_cadence" in sources.columns:
        rules.append(said(named.where("has_cadence"), "obsolete cadence"))
    for flag, wrong, problem in (("has_primary", False, "profile without primary"), ("has_required_fields", False, "profile without required fields"), ("has_empty_signal", False, "profile without empty rule"), ("has_audit_cadence", True, "obsolete audit_cadence")):
        if flag in profiles.columns:
            rules.append(said(profiles.where(F.col(flag) == wrong).withColumnRenamed("name", "id"), problem))
    if inbox is not None:
        items = inbox.where(~blank("id"))
        again = items.groupBy("id").agg(F.count("*").alias("n")).join(named.select("id", F.lit(True).alias("taken")).distinct(), "id", "left")
        rules += [
            inbox.select("profile").distinct().join(names, "profile", "left_anti").select(F.lit("").alias("id"), F.concat(F.lit("inbox with missing profile "), F.coalesce(F.nullif("profile", F.lit("")), F.lit("<none>"))).alias("problem")),
            inbox.where(blank("id")).select(F.lit("").alias("id"), F.lit("inbox source without id").alias("problem")),
            said(again.where("taken or n > 1"), "duplicate source id across catalog and inbox"),
        ]
        if "has_cadence" in inbox.columns:
            rules.append(said(items.where("has_cadence"), "obsolete cadence"))
    return reduce(DataFrame.unionByName, rules)


def check_payload(manifest: DataFrame, rows: DataFrame, events: DataFrame) -> DataFrame:
    """(source_id, problem) of a crawl's result rows (source_id, state) and events against what was planned."""
    planned = manifest.select("source_id").distinct()
    rules = [
        manifest_diff(manifest, rows),
        duplicate_ids(manifest, "source_id").select("source_id", F.lit("planned twice").alias("problem")),
        duplicate_ids(rows, "source_id").select("source_id", F.lit("reported twice").alias("problem")),
        rows.where("state = 'pending'").select("source_id", F.lit("still pending").alias("problem")),
        rows.where((F.col("state") != "pending") & ~F.col("state").isin(*FINAL_STATES)).select("source_id", F.lit("invalid state").alias("problem")),
        events.select("source_id").distinct().join(planned, "source_id", "left_anti").select("source_id", F.lit("event of a source not planned").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, rules)


def check_staging(results: DataFrame, runs: DataFrame, planned: DataFrame) -> DataFrame:
    """(run_id, source_id, problem) of results that may not be staged."""
    r = results.select("run_id", "source_id", "state").join(runs.select("run_id", F.col("state").alias("run_state")), "run_id", "left").join(planned.select("run_id", "source_id", F.lit(True).alias("planned")), ["run_id", "source_id"], "left")
    problem = F.when(F.col("run_state").isNull(), "unknown run").when(F.col("run_state") != "running", "run isn't running").when(F.col("planned").isNull(), "source isn't planned").when(~F.col("state").isin(*FINAL_STATES), "state isn't final")
    return r.withColumn("problem", problem).where("problem is not null").select("run_id", "source_id", "problem")


def plan_run(sources: DataFrame, health: DataFrame, profiles: DataFrame, mail: bool = False, only: str | None = None) -> DataFrame:
    """One row for each enabled source: what to do, whether to audit, and why; a target that can't be planned is an error row."""
    enabled = F.coalesce("enabled", F.lit(True))
    rows = sources.where(enabled).join(health.select(F.col("source_id").alias("id"), F.col("state").alias("before")), "id", "left").join(profiles.select(F.col("name").alias("profile"), "method", "recipe"), "profile", "left")
    inbox = F.col("kind") == "inbox"
    retry = F.col("before").isin(*RETRY_STATES)
    reason = F.when(inbox & F.lit(not mail), "mail connector unavailable").when(inbox, "selected for this run").when(F.col("before").isNull(), "never checked").when(retry, F.concat(F.lit("retry after "), "before")).otherwise("selected for this run")
    plan = rows.select(
        F.col("id").alias("source_id"),
        F.when(inbox & F.lit(not mail), "blocked").otherwise("pending").alias("state"),
        F.when(inbox, "gmail" if mail else "not_run").otherwise(F.col("method")).alias("method"),
        F.when(inbox, F.when(F.lit(mail), F.col("profile"))).otherwise(F.col("recipe")).alias("recipe_version"),
        (~inbox & (F.col("before").isNull() | retry)).alias("audit"),
        reason.alias("detail"),
    )
    if only is None:
        return plan
    plan = plan.where(F.col("source_id") == only).withColumn("detail", F.lit("targeted source crawl"))
    known = sources.where(F.col("id") == only).agg(F.count("*").alias("n"), F.count_if(enabled).alias("on"))
    error = known.where("on = 0").select(F.lit(only).alias("source_id"), F.lit("error").alias("state"), F.lit("").alias("method"), F.lit(None).cast("string").alias("recipe_version"), F.lit(False).alias("audit"), F.when(F.col("n") == 0, "unknown source").otherwise("disabled source").alias("detail"))
    return plan.unionByName(error)


def pending_work(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """Pending rows with their source; those without an adapter are skipped, unknown ones errors."""
    s = sources.select(F.col("id").alias("source_id"), "adapter", F.lit(True).alias("known"))
    rows = plan.where("state = 'pending'").join(s, "source_id", "left")
    action = F.when(F.col("known").isNull(), "error").when(F.coalesce("adapter", F.lit("")) == "", "skipped").otherwise("run")
    return rows.select("source_id", action.alias("action"), F.coalesce("adapter", F.lit("")).alias("adapter")).orderBy("source_id")

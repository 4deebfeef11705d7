"""Readers of catalogs, results, payloads and responses; writers of staged partitions and JSON."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom.functions.events import source_row

SOURCE = "id STRING, title STRING, url STRING, priority INT, geo STRING, parse_hint STRING, retrieval_profile STRING, enabled BOOLEAN, disabled_reason STRING, adapter STRING"
PROFILE = "primary STRUCT<method: STRING, recipe: STRING>, required_fields ARRAY<STRING>, empty_signal STRING"
INBOX = "priority INT, retrieval_profile STRING, query_template STRING, items ARRAY<STRING>"
ITEM = "id STRING, title STRING, url STRING, sender_hint STRING, note STRING, priority INT"


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, profiles and inbox items (with the defaults they inherit) of a catalog file, with the flags of check_catalog."""
    whole = spark.read.text(path, wholetext=True)
    part = lambda name, kind: F.from_json(F.get_json_object("value", f"$.{name}"), kind)
    kind = lambda name: F.schema_of_variant(F.variant_get(F.parse_json("raw"), f"$.{name}", "variant"))
    has = lambda name: F.coalesce(F.array_contains(F.json_object_keys("raw"), name), F.lit(False)).alias(f"has_{name}")
    filled = lambda name: (~F.coalesce(F.get_json_object("raw", f"$.{name}"), F.lit("")).isin("", "{}", "[]", "null", "false", "0")).alias(f"has_{name}")
    other = lambda name, wanted: F.coalesce(kind(name) != wanted, F.lit(False)).alias(f"bad_{name}")
    sources = whole.select(F.explode(part("sources", "array<string>")).alias("raw")).select(F.from_json("raw", SOURCE).alias("s"), other("enabled", "BOOLEAN"), other("adapter", "STRING"), has("cadence"))
    sources = sources.select("s.*", "bad_enabled", "bad_adapter", "has_cadence").withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    profiles = whole.select(F.explode(part("retrieval_profiles", "map<string,string>")).alias("name", "raw"))
    profiles = profiles.select("name", F.from_json("raw", PROFILE).alias("p"), filled("primary"), filled("required_fields"), has("empty_signal"), has("audit_cadence"))
    profiles = profiles.select("name", "p.primary.method", "p.primary.recipe", "p.required_fields", "p.empty_signal", "has_primary", "has_required_fields", "has_empty_signal", "has_audit_cadence")
    inbox = whole.select(part("inbox_sources", INBOX).alias("b")).select("b.retrieval_profile", F.col("b.priority").alias("default"), F.explode("b.items").alias("raw"))
    inbox = inbox.select("retrieval_profile", "default", F.from_json("raw", ITEM).alias("i"), has("cadence"))
    return sources, profiles, inbox.select("i.id", "i.title", F.coalesce("i.url", F.lit("")).alias("url"), F.coalesce("i.priority", "default", F.lit(3)).alias("priority"), F.col("retrieval_profile").alias("profile"), F.col("i.note").alias("parse_hint"), "has_cadence")


RESULT = "source STRUCT<id: STRING, state: STRING, method: STRING, recipe_version: STRING, detail: STRING, artifacts: ARRAY<STRING>>, events ARRAY<STRING>, rejections ARRAY<STRUCT<reason: STRING, source_id: STRING, raw: STRING>>"


def read_source_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source rows, events (source_id, position, raw) and rejections of result files, lists in their order.

    Members that are no objects keep their text in raw; `stage_results` reports them.
    """
    whole = spark.read.option("multiLine", True).schema(RESULT).json(path)
    events = whole.select(F.col("source.id").alias("source_id"), F.posexplode("events").alias("position", "raw"))
    rejections = whole.select(F.col("source.id").alias("source_id"), F.posexplode("rejections").alias("position", "r")).select("source_id", "position", "r.reason", "r.raw")
    return whole.select("source.*"), events, rejections


class Payload(NamedTuple):
    """An older file's run (one row), what it planned, its sources, events and rejections; empty tables where it is a bare list."""

    run: DataFrame
    manifest: DataFrame
    sources: DataFrame
    events: DataFrame
    rejections: DataFrame


def read_crawl_payload(spark: SparkSession, path: str) -> Payload:
    """An older file: an object with run, sources, events and rejections, or a bare list of events."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    part = lambda name: F.from_json(F.get_json_object("v", f"$.{name}"), "array<string>")
    listed = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(part("events"))
    said = lambda column, *names: F.coalesce(*(F.nullif(F.get_json_object(column, f"$.{n}"), F.lit("")) for n in names))
    run = whole.select(*(said("v", f"run.{n}").alias(a) for n, a in (("id", "run_id"), ("seen_date", "seen_date"), ("started_at", "started_at"), ("finished_at", "finished_at"))))
    manifest = whole.select(F.explode(part("run.manifest_source_ids")).alias("source_id"))
    sources = source_row(whole.select(F.explode(part("sources")).alias("body")).withColumn("source_id", F.coalesce(said("body", "source_id", "id"), F.lit("unknown"))))
    rejected = whole.select(F.posexplode(part("rejections")).alias("position", "r"))
    rejected = rejected.select("position", said("r", "reason").alias("reason"), said("r", "source_id").alias("source_id"), F.coalesce(said("r", "raw", "event"), "r").alias("raw"))
    return Payload(run, manifest, sources, whole.select(F.posexplode(listed).alias("position", "raw")), rejected)


def decode_responses(responses: DataFrame) -> DataFrame:
    """Bodies as text by the charset of their content-type (UTF-8 by default, bad bytes replaced), with their hash."""
    charset = F.lower(F.regexp_extract(F.coalesce("content_type", F.lit("")), r"(?i)charset\s*=\s*\"?([\w-]+)", 1))
    latin = charset.isin("iso-8859-1", "latin-1", "latin1", "windows-1252")
    text = F.when(latin, F.decode("body", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("body").cast("string")))
    return responses.withColumn("text", text).withColumn("content_hash", F.sha2("body", 256))


def evidence(source_runs: DataFrame) -> DataFrame:
    """A row for each artifact of a source run, with its place."""
    return source_runs.select("run_id", "source_id", F.posexplode("artifacts").alias("place", "a")).select("run_id", "source_id", "place", "a.*")


def artifact_at(source_runs: DataFrame, place: int) -> DataFrame:
    """The artifact at a place of each source run; none where it is out of range."""
    return source_runs.select("run_id", "source_id", F.get("artifacts", F.lit(place)).alias("a")).where("a is not null").select("run_id", "source_id", "a.*")


def write_staged(staged: DataFrame, path: str) -> None:
    """Partitions of the staged (run_id, source_id) are replaced, others stay."""
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "source_id").parquet(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

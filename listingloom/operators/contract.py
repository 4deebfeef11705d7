"""The raw-event contract: strict fields, checked on each row's JSON, problems as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Field -> kinds its JSON value may have.
REQUIRED = {
    "title": "STRING", "start": "STRING", "end": "STRING|VOID", "url": "STRING", "signup_url": "STRING", "host": "STRING",
    "venue": "STRING", "neighborhood": "STRING", "address": "STRING", "price": "STRING", "is_free": "BOOLEAN|VOID",
    "description": "STRING", "capacity_flag": "STRING|VOID", "status": "STRING", "source_id": "STRING",
    "source_listing_url": "STRING", "source_url": "STRING", "source_event_id": "STRING", "fetched_at": "STRING",
    "parser_version": "STRING", "content_hash": "STRING", "extracted_json": "[A-Z]+",
}
OPTIONAL = {"explicit_age_min": "BIGINT|VOID", "explicit_age_max": "BIGINT|VOID", "explicit_age_label": "STRING|VOID", "orientation_scope": "STRING|VOID"}
METHOD = "python_adapter"
STATUSES = ("active", "cancelled", "postponed")
_AWARE = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)$"


def check_raw_events(rows: DataFrame, raw: str = "raw", most: int = 5) -> DataFrame:
    """rows with problems, the first few in field order: missing, wrong kind, unknown keys, times without offset, status."""
    # In steps, so that a row is parsed once and not once for each check.
    rows = rows.withColumn("_top", F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>"))
    rows = rows.withColumn("_kinds", F.transform_values("_top", lambda _, x: F.regexp_extract(F.schema_of_variant(x), "^([A-Z]+)", 1)))
    of = lambda name: F.try_variant_get(F.try_element_at("_top", F.lit(name)), "$", "string")
    said = {name: of(name).alias(f"_{name}") for name in ("start", "end", "fetched_at", "status")}
    rows = rows.select("*", *said.values(), F.map_keys("_kinds").alias("_keys"))
    checks = []
    for name, kinds in {**REQUIRED, **OPTIONAL}.items():
        kind = F.try_element_at("_kinds", F.lit(name))
        if name in REQUIRED:
            checks.append(F.when(kind.isNull(), f"{name}: missing"))
        checks.append(F.when(~kind.isin(*kinds.split("|")) if kinds != "[A-Z]+" else kind == "", f"{name}: wrong kind"))
    for name in ("start", "end", "fetched_at"):
        text = F.col(f"_{name}")
        checks.append(F.when(text.isNotNull() & ~text.rlike(_AWARE), f"{name}: not a time with offset"))
    checks.append(F.when(~F.col("_status").isin(*STATUSES), "status: unknown"))
    unknown = F.array_except("_keys", F.array(*map(F.lit, [*REQUIRED, *OPTIONAL])))
    checks.append(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ","))))
    found = F.slice(F.filter(F.array(*checks), lambda c: c.isNotNull()), 1, most)
    checked = rows.withColumn("problems", F.when(F.col("_kinds").isNull(), F.array(F.lit("not an object"))).otherwise(found))
    return checked.drop("_top", "_kinds", "_keys", *(f"_{name}" for name in said))


def check_source_results(rows: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """rows (state, method, fetched_at, reasons) with problems of a source result's own fields."""
    checks = [
        F.when(~F.coalesce(F.col("state").isin(*states), F.lit(False)), "state: unknown"),
        F.when(~F.coalesce(F.col("method") == METHOD, F.lit(False)), "method: unknown"),
        F.when(~F.coalesce(F.col("fetched_at").rlike(_AWARE), F.lit(False)), "fetched_at: not a time with offset"),
        F.when(F.exists(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: F.coalesce(F.trim(r), F.lit("")) == ""), "rejection: no reason"),
    ]
    return rows.withColumn("problems", F.filter(F.array(*checks), lambda c: c.isNotNull()))

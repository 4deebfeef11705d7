"""The store as versions of its tables: a version counts from when its marker is there, readers take the newest one.

A table lies in buckets of its key. A version's marker says for each table which folder holds each bucket; an update writes
the buckets that its rows fall into and points to the folders before for all others. Files are never changed. The marker is
made whole, last, and only where none of that number exists, so a job that dies leaves the version before, and of two writers
that started from one version the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from listingloom.session import hinted, materialize

_MARKS = "versions"
BUCKETS = 64
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer made this version first."""


def _path(spark: SparkSession, *parts: str):
    where = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole and only where there is none; Conflict where there is one.

    On a local disk by a hard link to a file written before, elsewhere by a rename that doesn't overwrite, which is atomic on
    HDFS. Object stores promise neither: give write_store() and update_store() their own conditional put there.
    """
    files, where = _path(spark, path)
    files, temporary = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(temporary, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    try:
        if files.getUri().getScheme() == "file":
            to = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(to(where), to(temporary))
        elif not files.rename(temporary, where):
            raise Conflict(f"exists already: {path}")
    except Exception as e:
        if isinstance(e, Conflict) or "FileAlreadyExists" in str(e):
            raise Conflict(f"exists already: {path}") from None
        raise
    finally:
        files.delete(temporary, False)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions in rising order."""
    files, where = _path(spark, root, _MARKS)
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    """What a version's marker says: for each table its key, number of buckets, schema, and the folder of each bucket."""
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/{_MARKS}/{version:010d}").collect()))


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int") if key and buckets > 1 else F.lit(0)


def _write(rows: DataFrame, folder: str, name: str, root: str) -> list[int]:
    """Rows with their bucket to files by bucket; which buckets have any."""
    rows.write.partitionBy(_BUCKET).parquet(f"{root}/tables/{folder}/{name}")
    files, where = _path(rows.sparkSession, root, "tables", folder, name)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(where) if f.getPath().getName().startswith(f"{_BUCKET}="))


def _table(spark: SparkSession, root: str, name: str, entry: dict, only: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(entry["schema"])
    paths = [f"{root}/tables/{folder}/{name}/{_BUCKET}={b}" for b, folder in entry["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_store(tables: dict[str, DataFrame], root: str, based_on: int = 0, keys: dict[str, list[str]] | None = None, buckets: int = BUCKETS, put: Callable[[SparkSession, str, str], None] = put_once) -> int:
    """Write a new version of all tables whole and swap it in; its number. based_on is the version that it comes after.

    keys names the columns by which a table lies in buckets; a table without them lies in one.
    """
    spark = next(iter(tables.values())).sparkSession
    folder, said = uuid.uuid4().hex, {}
    for name, table in tables.items():
        key = (keys or {}).get(name, [])
        n = buckets if key else 1
        rows = table.withColumn(_BUCKET, _bucket(key, n))
        found = _write(rows.repartition(F.col(_BUCKET)) if key else rows, folder, name, root)
        said[name] = {"key": key, "buckets": n, "schema": json.loads(table.schema.json()), "folders": {str(b): folder for b in found}}
    put(spark, f"{root}/{_MARKS}/{based_on + 1:010d}", json.dumps(said))
    return based_on + 1


def update_store(changed: dict[str, DataFrame], root: str, based_on: int, gone: dict[str, DataFrame] | None = None, put: Callable[[SparkSession, str, str], None] = put_once) -> int:
    """A new version in which changed rows replace those of their key, or are added, and rows with the keys of gone are left
    out; its number. Of each table only the buckets that these rows fall into are read and written."""
    spark = next(iter((*changed.values(), *(gone or {}).values()))).sparkSession
    said, folder = manifest(spark, root, based_on), uuid.uuid4().hex
    for name in {**changed, **(gone or {})}:
        entry = said[name]
        key, schema = entry["key"], StructType.fromJson(entry["schema"])
        place = _bucket(key, entry["buckets"])
        rows = changed[name].select(*schema.names) if name in changed else spark.createDataFrame([], schema)
        rows = materialize(rows.withColumn(_BUCKET, place), f"changed-{name}")
        named = rows.select(*key, _BUCKET)
        if name in (gone or {}):
            named = named.unionByName(gone[name].select(*key).withColumn(_BUCKET, place))
        named = materialize(named.distinct(), f"named-{name}")
        touched = {r[0] for r in named.select(_BUCKET).distinct().collect()}  # at most as many as there are buckets
        before = _table(spark, root, name, entry, touched).withColumn(_BUCKET, place)
        other = hinted(named.select(*(F.col(k).alias(f"_{k}") for k in key)))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        kept = before.join(other, same, "left_anti")
        found = _write(kept.unionByName(rows).repartition(F.col(_BUCKET)), folder, name, root)
        folders = {b: f for b, f in entry["folders"].items() if int(b) not in touched}
        entry["folders"] = {**folders, **{str(b): folder for b in found}}
    put(spark, f"{root}/{_MARKS}/{based_on + 1:010d}", json.dumps(said))
    return based_on + 1


def read_store(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """A version's number and tables: the newest one, or one by its number; 0 and no tables where there is none."""
    known = versions(spark, root)
    if version is None and not known:
        return 0, {}
    number = version or known[-1]
    return number, {name: _table(spark, root, name, entry) for name, entry in manifest(spark, root, number).items()}

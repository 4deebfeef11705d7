"""Session helpers: where intermediate tables go, how they are let go again, and how a join is told its strategy."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

#: Size of a table up to which it is broadcast, as estimated from its rows; beyond that the join shuffles.
BROADCAST_BYTES = 64 << 20
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="listingloom-"))
        found = _own[0]
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, sizes are known, lost executors cost nothing.

    by: columns by which the files are kept apart. What the write shuffled is deleted with its end, not when the driver's
    garbage is next collected.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_CLEANED, "false")
    conf.set(_CLEANED, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANED, before)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """df dealt over as many tasks as a shuffle has, for much work on the rows of a small file, which one task would read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read any more."""
    for df in tables:
        files = df.inputFiles()[:1]
        for path in [p for p in _written if any(p.rsplit("/", 1)[-1] in f for f in files)]:
            _delete(df.sparkSession, path)
            _written.remove(path)


def written() -> int:
    """How many tables there are by now, for discard_since()."""
    return len(_written)


def discard_since(before: int, *kept: DataFrame) -> None:
    """Delete the tables materialized since written() told their number, but those that are kept."""
    files = [f for df in kept for f in df.inputFiles()[:1]]
    for path in [p for p in _written[before:] if not any(p.rsplit("/", 1)[-1] in f for f in files)]:
        _delete(kept[0].sparkSession, path)
        _written.remove(path)


def cleanup(spark: SparkSession) -> None:
    """Delete everything that materialize() wrote in this process; call it once results have been written or read."""
    while _written:
        _delete(spark, _written.pop())


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes in memory: 8 for a number, the length of a text or binary, and so on inside arrays."""

    def size(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
                return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + size(x, kind.elementType)), F.lit(0)) + 16
            return 8 * F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) + 16
        if isinstance(kind, T.StructType):
            return reduce(lambda a, b: a + b, (size(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
        return F.lit(8)

    return reduce(lambda a, b: a + b, (size(F.col(f.name), f.dataType) for f in schema.fields), F.lit(16)).cast("long")


def hinted(side: DataFrame) -> DataFrame:
    """Broadcast a table whose rows, measured, stay under BROADCAST_BYTES, else ask for a sort-merge join."""
    measured = side.agg(F.sum(row_bytes(side.schema))).first()[0] or 0
    return F.broadcast(side) if measured <= BROADCAST_BYTES else side.hint("merge")

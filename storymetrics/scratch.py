"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, int] = {}  # path: which of all tables it was
_count = itertools.count()
_readers: dict[str, object] = {}
#: Rows of ids (8 or 16 bytes each) up to which a side of a join is broadcast.
BROADCAST_ROWS = 2_000_000


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the session names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, from which what nothing reads any more goes first."""
    sweep(spark)
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut, and it outlives any executor."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return owned(df.sparkSession.read.schema(df.schema).parquet(path), path)


def owned(table: DataFrame, path: str) -> DataFrame:
    """A table over files of our own: they stay for as long as anything can read it, see sweep()."""
    leaf = table._jdf.queryExecution().analyzed().collectLeaves().head()
    _readers[path] = table.sparkSession._jvm.java.lang.ref.WeakReference(leaf.relation().location())
    _written[path] = next(_count)
    return table


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that no data frame reads any more, neither one that was returned nor one derived from it.

    The list of a table's files is part of every plan over it; once the JVM has collected it, there is no such plan.
    """
    for path in [p for p in _written if p in _readers and _readers[p].get() is None]:
        delete(spark, path)


def claimed(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that are no table; the caller deletes it."""
    path = place(spark, name)
    _written[path] = next(_count)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that saved() made, and nothing outside the shared folder."""
    if path in _written:
        del _written[path]
        _readers.pop(path, None)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables made by saved(), once nothing reads them any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0].rsplit("/", 1)[-1]
            for path in [p for p in _written if p.rsplit("/", 1)[-1] == folder]:
                delete(df.sparkSession, path)


def written() -> int:
    """A mark between the tables that saved() has made so far and those to come."""
    return next(_count)


def written_since(n: int) -> list[str]:
    """The tables that were made after a mark and are still there."""
    return [path for path, k in _written.items() if k > n]


def alone(df: DataFrame, name: str, since: int) -> DataFrame:
    """saved(df), after which all other tables that saved() made after the mark `since` (of written()) are deleted."""
    out = saved(df, name)
    for path in written_since(since):
        if path != _path(out):
            delete(df.sparkSession, path)
    return out


def _path(table: DataFrame) -> str:
    return next(p for p in _written if p.rsplit("/", 1)[-1] == table._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths().head().getName())


def sided(table: DataFrame) -> DataFrame:
    """A written table of ids as the smaller side of a join: it is broadcast only up to BROADCAST_ROWS rows."""
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return table.hint("broadcast" if few else "merge")

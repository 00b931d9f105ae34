"""Where intermediate tables go: the folder all executors share, never a machine-local one on a cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Tables:
    """The intermediate tables of one query. They live until the query's owner releases them, as its result is computed
    only when it is used; what nobody owns goes when the application ends."""

    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def release(self, spark: SparkSession) -> None:
        """Deletes the tables. To be called once the results that read them are written."""
        while self.paths:
            _delete(spark, self.paths.pop())
        while self.names:
            spark.sql(f"DROP TABLE IF EXISTS {self.names.pop()} PURGE")


_unowned = Tables()
_owners = [_unowned]


@contextmanager
def owned() -> Iterator[Tables]:
    """Tables made inside belong to the owner that this gives."""
    _owners.append(Tables())
    try:
        yield _owners[-1]
    finally:
        _owners.pop()


@atexit.register
def _leave() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        _unowned.release(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary folder is used under a
    local master only; on a cluster the setting is required."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="tallyframe-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor
    costs a re-read instead of a recomputation. Unless kept, it belongs to the current owner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tallyframe_path = path
    if not kept:
        _own(spark, path)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that a query writes and reads; it belongs to the current owner."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    _own(spark, folder)
    return f"{folder}/data"


def _own(spark: SparkSession, path: str) -> None:
    """Notes a path that exists for the current owner, and for the file system, which deletes it when the driver ends
    even if the session was stopped before."""
    _owners[-1].paths.append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def discard(*dfs: DataFrame) -> None:
    """Deletes materialized tables that nothing still to be run reads."""
    for df in dfs:
        path = df.tallyframe_path
        for tables in _owners:
            if path in tables.paths:
                tables.paths.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, name: str, buckets: int, *columns: str) -> DataFrame:
    """Writes df as a bucketed table in the warehouse, so that later groupings by the columns read it in place."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "none").bucketBy(buckets, *columns).saveAsTable(table)
    _owners[-1].names.append(table)
    return df.sparkSession.table(table)


"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
_leaving: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a session whose executors are this machine (tests, a laptop) may do without: it gets a temporary
    folder of this process. Elsewhere a missing setting is an error, as no other executor could read what one wrote.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        own = sc._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="loomstone-"))
    return _own_folder[0]


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        fs.deleteOnExit(p)
    else:
        fs.delete(p, True)


def own_tables(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_folder(spark)}/loomstone/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Drop all intermediate tables of this application, once no result that reads them is needed any more."""
    _delete(spark, own_tables(spark))


class Table:
    """A written intermediate table; ``drop`` it once nothing reads it any more."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.df = spark.read.parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def cut(df: DataFrame, name: str) -> Table:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there,
    so a lost executor costs no recomputation of what came before.

    Results are lazy and read these tables, so they stay until ``Table.drop``, ``release`` or the end of
    the driver, whichever comes first.
    """
    spark = df.sparkSession
    own = own_tables(spark)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if own not in _leaving:
        _leaving.add(own)
        _delete(spark, own, at_exit=True)
    return Table(spark, path)


def memo(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A step that runs once: the table at ``path`` if it was written whole before, else what ``build`` gives, written
    there. A job that is started again goes on behind its finished steps."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def emit(events: DataFrame, path: str) -> None:
    """Append events ``(name, payload)`` to the outbox at ``path``, each once: its id is the hash of both."""
    spark = events.sparkSession
    named = events.select(F.sha2(F.concat_ws("|", "name", "payload"), 256).alias("event_id"), "name", "payload").dropDuplicates(["event_id"])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        named = named.join(spark.read.parquet(path).select("event_id"), "event_id", "left_anti")
    named.write.mode("append").parquet(path)

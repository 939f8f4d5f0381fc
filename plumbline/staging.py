"""Tables written to the shared scratch folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a single-process local master gets a temporary folder.
    Any other master uses the warehouse if that lies in a shared store, and raises where
    it is a plain local path, which other machines could not read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    root = getattr(spark, "_plumbline_scratch", None)
    if root is None:
        master = spark.sparkContext.master
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if master == "local" or master.startswith("local["):
            root = tempfile.mkdtemp(prefix="plumbline-")
        elif ":" in warehouse and not warehouse.startswith("file:"):
            root = warehouse + "/_scratch"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark._plumbline_scratch = root
    return root


def _path(spark: SparkSession, path: str):
    """The path as the JVM has it, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder; nothing exists there yet. The application's folder goes when the driver's JVM ends."""
    home = f"{scratch_root(spark)}/plumbline/{spark.sparkContext.applicationId}"
    if getattr(spark, "_plumbline_home", None) != home:
        at, store = _path(spark, home)
        store.mkdirs(at)
        store.deleteOnExit(at)
        spark._plumbline_home = home
    return f"{home}/{label}-{uuid.uuid4().hex}"


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that is never sent whole to the driver and all executors.

    The size of a staged table is told from its files, and those of drawings and searches are
    so dense that millions of rows look small enough to broadcast. The hint holds for what is
    selected, filtered and summed from ``df``, up to the next join or union.
    """
    return df.hint("merge")


#: Rows of a table that may be sent whole to every machine.
FEW = 50_000


def sent_if_few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have ``rows`` rows, as a side of joins: broadcast if they are few, else ``unsent``."""
    return F.broadcast(df) if rows <= FEW else unsent(df)


#: Rows of a shuffle that one task should have.
TASK_ROWS = 500_000


@contextmanager
def _dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within is shuffled to as many partitions as ``rows`` rows need, if those are more than the session has."""
    setting = "spark.sql.shuffle.partitions"
    usual, needed = spark.conf.get(setting), -(-rows // TASK_ROWS)
    if needed <= int(usual):
        yield
        return
    spark.conf.set(setting, needed)
    try:
        yield
    finally:
        spark.conf.set(setting, usual)


def stage(df: DataFrame, label: str, grows: bool = False, rows: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and return the table read back; one that ``grows`` with the input is ``unsent``.

    ``rows`` tells how many its largest shuffle has, about: tasks get no more of them when there are more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _dealt(spark, rows):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table = unsent(table) if grows else table
    table._plumbline_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` returned, once all that is made from them is itself staged."""
    for table in tables:
        at, store = _path(table.sparkSession, table._plumbline_path)
        store.delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer partitions than there are cores, as small files have; else ``df`` as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tasks for each core that many small files are read in.
TASKS = 32


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in ``TASKS`` tasks for each core where it has more partitions, as thousands of small files have, which cost more than what they hold; else ``df`` as it is."""
    most = df.sparkSession.sparkContext.defaultParallelism * TASKS
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df

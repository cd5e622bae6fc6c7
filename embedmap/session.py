"""Session helpers: local session builder and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, name: str = "embedmap") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    When the setting is missing, a folder in the session's warehouse is used, which a cluster
    shares as well.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if current is not None:
            return current
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"
    if current is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for one intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/embedmap-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes sampled range bounds and the order of partitions.

    The planner keeps the size estimate of the plan that is cut, so loops end their rounds with
    ``store``, whose size is that of its files.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as a write ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table used more than once to the shared folder, and read it back.

    Unlike a checkpoint the copy is columnar, so later uses read only the columns they need, and the
    planner knows its size. The schema is handed on, so no job reads it from the files. ``options`` are the writer's.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table that ``store`` wrote and no later step reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt to ``tasks`` tasks for costly row functions, if the caller asks for it; else as they are."""
    return df if tasks is None else df.repartition(tasks)

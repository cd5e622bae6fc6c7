"""Pages of a large ordered table (SRT2): a range-sorted copy and a directory of its ranges.

``orderBy(...).offset(n)`` sorts everything in front of a page each time it is asked for. Here the rows
are put into ranges of bounded size once, each a partition folder, and a directory tells how many rows lie
before each range. A page then reads its own range, however deep it lies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Pages:
    """A stored table in order: its folder and the order it was built with."""

    path: str
    order: tuple[str | Column, ...]


def build_pages(df: DataFrame, order: list[str | Column], path: str, range_rows: int = RANGE_ROWS) -> Pages:
    """Write ``df`` in ranges of about ``range_rows`` rows of ``order``, whose columns are unique together.

    Range bounds are sampled, so ranges differ in size; the directory counts what was written. A hot value
    of the leading column is cut as well, since the columns behind it take part in the bounds. ``df`` may be
    empty, and must have no column ``_range``.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // range_rows))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranged.write.partitionBy("_range").parquet(f"{path}/rows")
    # an empty file that holds the columns, for tables and pages without a row
    df.limit(0).write.parquet(f"{path}/columns")
    counted = spark.read.schema(ranged.schema).parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n"))
    # one row per range
    before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted.withColumn("before", before).coalesce(1).write.parquet(f"{path}/directory")
    return Pages(path, tuple(order))


def directory(spark: SparkSession, pages: Pages) -> DataFrame:
    """(_range, n, before): rows of each range and rows in front of it."""
    return spark.read.parquet(f"{pages.path}/directory")


def read_page(spark: SparkSession, pages: Pages, number: int, per_page: int = 100) -> DataFrame:
    """One page in order (0-based): only the ranges it lies in are read. Beyond the last page it has no rows."""
    start = number * per_page
    hit = directory(spark, pages).filter((F.col("before") < start + per_page) & (F.col("before") + F.col("n") > start))
    # ranges that hold at least one row of the page
    found = hit.orderBy("_range").collect()
    columns = spark.read.parquet(f"{pages.path}/columns")
    if not found:
        return columns
    folders = [f"{pages.path}/rows/_range={r['_range']}" for r in found]
    return spark.read.schema(columns.schema).parquet(*folders).orderBy(*pages.order).offset(start - found[0]["before"]).limit(per_page)


def count_pages(spark: SparkSession, pages: Pages, per_page: int = 100) -> DataFrame:
    """One row (total, total_pages) from the directory alone."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    return directory(spark, pages).agg(total.alias("total"), F.ceil(total / per_page).alias("total_pages"))

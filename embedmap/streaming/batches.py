"""Append with a manifest of batches (STR2): which ids are stored is known without reading stored rows.

A batch is a folder of rows and a folder of bitmaps. The manifest keeps one bit per id, in
bitmaps of 32,768 neighbouring ids, so it is exact, ids that interleave between batches stay cheap,
and a look-up reads only the bitmaps near the ids it asks for. Rows count as stored once their bitmaps are
written, so a batch that dies half way leaves nothing behind that readers see, and its replay writes it anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embedmap.session import store

MANIFEST = "bucket long, ids binary"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches whose bitmaps are wholly written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/*/_SUCCESS")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(f.getPath().getParent().getName() for f in found or [])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, ids): bitmaps of stored ids; a bucket has one per batch that touches it."""
    names = _folders(spark, path)
    if not names:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(*[f"{path}/manifest/{n}" for n in names])


def _holds(ids: Column, position: Column) -> Column:
    """Whether a bitmap has the bit of a position: bytes in order, the lowest bit first."""
    byte = F.conv(F.hex(F.substring(ids, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def unstored(batch: DataFrame, path: str) -> DataFrame:
    """Rows of a batch whose id no stored batch holds; each id once, rows without an id not at all."""
    spark = batch.sparkSession
    fresh = batch.filter(F.col("ls_index").isNotNull()).dropDuplicates(["ls_index"])
    bucket = F.bitmap_bucket_number("ls_index")
    span = batch.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi")).first()
    if span.lo is None:
        return fresh
    # ids in the range of the batch only; batches that share a bucket become one bitmap
    near = manifest(spark, path).filter(F.col("bucket").between(span.lo, span.hi)).groupBy("bucket").agg(F.bitmap_or_agg("ids").alias("_ids"))
    met = fresh.withColumn("bucket", bucket).join(near, "bucket", "left")
    kept = met.filter(F.col("_ids").isNull() | ~_holds(F.col("_ids"), F.bitmap_bit_position("ls_index")))
    return kept.select(*batch.columns)


def append_batch(batch: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Store the rows of a batch that are not stored yet; rows first, then the bitmaps that make them count.

    ``embed`` turns rows into rows with ``ls_index``; those that it leaves out stay open for a later batch.
    """
    spark = batch.sparkSession
    fresh = store(unstored(batch, path), "fresh")
    if fresh.isEmpty():
        return
    name = f"batch-{uuid.uuid4().hex}"
    made = embed(fresh)
    made.write.parquet(f"{path}/rows/{name}")
    ids = spark.read.schema(made.schema).parquet(f"{path}/rows/{name}").select("ls_index")
    bits = ids.groupBy(F.bitmap_bucket_number("ls_index").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("ls_index")).alias("ids"))
    bits.write.parquet(f"{path}/manifest/{name}")


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows that count as stored, or None before the first batch."""
    names = _folders(spark, path)
    return spark.read.parquet(*[f"{path}/rows/{n}" for n in names]) if names else None


def stream_batches(source: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Embed and append new rows per micro-batch; a replay, also under a new checkpoint, adds nothing.

    One stream writes a path at a time.
    """

    def step(batch: DataFrame, _: int) -> None:
        append_batch(batch, embed, path)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

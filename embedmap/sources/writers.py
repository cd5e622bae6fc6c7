"""Sinks (SNK*)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmap.operators.joins import scope_input_join, tag_columns
from embedmap.operators.tokens import TOKEN_FILES, require_token_counts
from embedmap.session import shuffles_end

VECTOR_SCHEMA = {"ls_index": "bigint", "vector": "array<float>"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder already holds readable data."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:  # no such folder, or no file in it yet
        return False


def _beside(spark: SparkSession, path: str) -> tuple[str, Callable[[bool], None]]:
    """A fresh path beside ``path``, and a function that moves what is there to ``path`` or drops it."""
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    jvm = spark._jvm
    here, there = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())

    def put(good: bool) -> None:
        fs.delete(there if good else here, True)
        if good and not fs.rename(here, there):
            raise OSError(f"cannot move the copy to {path}")

    return beside, put


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Append rows as (ls_index BIGINT, vector ARRAY<FLOAT>), or in an older table's own types."""
    spark = vectors.sparkSession
    kinds = dict(VECTOR_SCHEMA)
    if exists(spark, path):
        kinds = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema.fields}
    vectors.select(*[F.col(c).cast(t) for c, t in kinds.items()]).write.mode("append").parquet(path)


def append_token_rows(docs: DataFrame, tokens: DataFrame, path: str) -> None:
    """Write token rows anew, and only if they agree with the stored token counts.

    They are written once, beside the target, and take its place when their counts are right.
    """
    spark = tokens.sparkSession
    beside, put = _beside(spark, path)
    with shuffles_end(spark):
        tokens.write.options(**TOKEN_FILES).parquet(beside)
    try:
        require_token_counts(docs, spark.read.schema(tokens.schema).parquet(beside))
    except ValueError:
        put(False)
        raise
    put(True)


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """Copy a table of many small files to a new path with few files sorted by row id."""
    df = spark.read.parquet(path)
    df.repartitionByRange(files, "ls_index").sortWithinPartitions("ls_index").write.mode("overwrite").parquet(target)


def write_scope(source: DataFrame, scope: DataFrame, path: str) -> None:
    """Write the scope and the scope joined to its input; the second reads the first."""
    spark = scope.sparkSession
    scope.write.mode("overwrite").parquet(f"{path}/scope")
    stored = spark.read.parquet(f"{path}/scope")
    scope_input_join(source, stored).write.mode("overwrite").parquet(f"{path}/scope-input")


def write_export(source: DataFrame, scope: DataFrame, tags: DataFrame, names: list[str], path: str) -> None:
    """Scope with its input and one boolean column per tag."""
    tag_columns(scope_input_join(source, scope), tags, names).write.mode("overwrite").parquet(path)


def copy_report(source: DataFrame, copied: DataFrame) -> DataFrame:
    """One row: counts on both sides, rows without a partner, and the largest difference."""
    a = source.select("ls_index", F.col("vector").cast("array<double>").alias("a"))
    b = copied.select("ls_index", F.col("vector").cast("array<double>").alias("b"))
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.size("a") == F.size("b"))
    return a.join(b, "ls_index", "full").agg(
        F.count("a").alias("source_rows"),
        F.count("b").alias("copied_rows"),
        F.count_if(~same).alias("unmatched"),
        F.coalesce(F.max(F.when(same, gap)), F.lit(0.0)).alias("max_difference"),
    )


def verified_copy(source: DataFrame, path: str, tolerance: float = 1e-6) -> str:
    """Copy vectors and check every value before the copy takes the target's place.

    An equal target is left alone. A copy that fails the check is dropped, and whatever was at the
    target stays.
    """
    spark = source.sparkSession

    def sound(at: str) -> bool:
        r = copy_report(source, spark.read.parquet(at)).first()
        return r["unmatched"] == 0 and r["max_difference"] <= tolerance

    if exists(spark, path) and sound(path):
        return "already_migrated"
    beside, put = _beside(spark, path)
    source.select("ls_index", F.col("vector").cast("array<float>")).write.parquet(beside)
    if not sound(beside):
        put(False)
        raise ValueError(f"copy for {path} differs from its source")
    put(True)
    return "migrated"

"""Sources (SRC*)."""

from __future__ import annotations

import os.path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: file endings that count as images
IMAGE_FILES = ["png", "jpg", "jpeg", "webp", "gif"]


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """Read by file ending. Give a schema for big csv or json to save the inference pass.

    Quoted csv fields may span lines; turn ``multi_line`` off for big csv files without such
    fields, as only then one file can be split over tasks.
    """
    ending = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if ending == "parquet":
        return reader.parquet(path)
    if ending == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=multi_line, escape='"')
    if ending == "jsonl":
        return reader.json(path)
    if ending == "json":
        return reader.json(path, multiLine=True)
    raise ValueError(f"unknown file type: {path}")


def read_image_dir(spark: SparkSession, path: str) -> DataFrame:
    """(ls_index, image, filename, date, size_kb) of the images in one folder, by name."""
    from embedmap.operators.ranking import assign_row_index

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("filename", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))
    images = files.filter(F.lower("filename").rlike(rf"\.({'|'.join(IMAGE_FILES)})$"))
    if images.select("filename").limit(1).count() == 0:
        raise ValueError(f"no images in {path}")
    out = images.select(
        F.col("content").alias("image"),
        "filename",
        F.date_format("modificationTime", "yyyy-MM-dd").alias("date"),
        F.round(F.col("length") / 1024, 1).alias("size_kb"),
    )
    return assign_row_index(out, [F.col("filename").asc()])


def import_vectors(df: DataFrame, column: str, check: bool = True) -> DataFrame:
    """Use an array column as embedding; every row must have the same number of dimensions."""
    vectors = df.select("ls_index", F.col(column).cast("array<float>").alias("vector"))
    if check:
        got = vectors.agg(
            F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"),
            F.count_if(F.col("vector").isNull()).alias("missing"),
        ).first()
        if got["missing"] or got["lo"] != got["hi"]:
            raise ValueError(f"vectors differ in size: {got.asDict()}")
    return vectors


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Only ``ls_index`` and ``vector`` of a stored embedding; token data is never read."""
    return spark.read.parquet(path).select("ls_index", "vector").orderBy("ls_index")


def read_indices(spark: SparkSession, glob: str) -> DataFrame:
    """(tag, ls_index) from text of one row number per line; ``<tag>.indices`` is a file or folder."""
    lines = spark.read.text(glob).withColumn("path", F.input_file_name())
    tag = F.regexp_extract("path", r"([^/]+)\.indices(?:/[^/]*)?$", 1)
    number = F.trim("value").cast("double").cast("long")
    return lines.filter(F.trim("value") != "").select(tag.alias("tag"), number.alias("ls_index"))

"""Column profile of an ingested table (PRF*)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.NumericType, T.BooleanType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# fixed values: first bytes of the image formats a browser shows, and the url endings
IMAGE_MARKS = ["89504E470D0A1A0A", "FFD8FF", "47494638"]
WEBP_RIFF, WEBP_NAME = "52494646", "57454250"
IMAGE_ENDINGS = ["png", "jpg", "jpeg", "webp", "svg", "gif"]

MAX_CATEGORIES = 100


def _is_binary(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return {"bytes", "path"} <= set(t.fieldNames())
    return isinstance(t, T.BinaryType)


def logical_type(t: T.DataType) -> str:
    """Logical type by Spark type; byte columns are told apart by their content."""
    if isinstance(t, DATES):
        return "date"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(t, NUMBERS):
        return "number"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
        return "array"
    return "binary" if _is_binary(t) else "unknown"


def is_image(content: Column) -> Column:
    """Whether bytes start like a PNG, JPEG, GIF or WEBP file."""
    head = F.hex(F.substring(content, 1, 12))
    hit = F.startswith(head, F.lit(WEBP_RIFF)) & F.endswith(head, F.lit(WEBP_NAME))
    for mark in IMAGE_MARKS:
        hit = hit | F.startswith(head, F.lit(mark))
    return hit


def _bytes_of(df: DataFrame, name: str) -> Column:
    return F.col(f"{name}.bytes") if isinstance(df.schema[name].dataType, T.StructType) else F.col(name)


def _any_image(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.bool_or(is_image(_bytes_of(df, name))), F.lit(False))


def binary_image_flag(df: DataFrame, column: str) -> DataFrame:
    """One row: does any of the values look like an image."""
    return df.agg(_any_image(df, column).alias("image")).select(F.lit(column).alias("column"), "image")


def _long(df: DataFrame, structs: list[Column], *aggs: Column) -> DataFrame:
    """One aggregate pass turned into one row per column."""
    row = df.agg(*aggs) if aggs else df.agg(F.count("*").alias("_n"))
    return row.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


def column_types(df: DataFrame) -> DataFrame:
    """(column, type) for every column; byte columns are told apart by all their values, in one pass."""
    structs, aggs = [], []
    for i, f in enumerate(df.schema.fields):
        kind = F.lit(logical_type(f.dataType))
        if _is_binary(f.dataType):
            aggs.append(_any_image(df, f.name).alias(f"_i{i}"))
            kind = F.when(F.col(f"_i{i}"), "image").otherwise("unknown")
        structs.append(F.struct(F.lit(f.name).alias("column"), kind.alias("type")))
    return _long(df, structs, *aggs)


def _value_key(f: T.StructField) -> Column:
    """A value as 128 bits in text, whatever its width; null stays null."""
    c = F.col(f.name)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)  # the two zeros are one value
    if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)):
        c = F.when(c.isNotNull(), F.to_json(c))
    return F.md5(c if isinstance(f.dataType, T.BinaryType) else c.cast("string"))


def _value_counts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """(i, key, n): rows per column number and value, counted before they meet in a shuffle."""
    each = [F.struct(F.lit(i).alias("i"), _value_key(f).alias("key")) for i, f in enumerate(fields)]
    return df.select(F.explode(F.array(*each)).alias("_p")).select("_p.*").groupBy("i", "key").agg(F.count("*").alias("n"))


def unique_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, unique): distinct non-null values per column; sketches if approximate."""
    fields = df.schema.fields
    names = F.array(*[F.lit(f.name) for f in fields])
    if approximate:
        aggs = [F.approx_count_distinct(_value_key(f)).alias(f"_u{i}") for i, f in enumerate(fields)]
        structs = [F.struct(F.lit(f.name).alias("column"), F.col(f"_u{i}").alias("unique")) for i, f in enumerate(fields)]
        return _long(df, structs, *aggs)
    counts = _value_counts(df, fields).groupBy("i").agg(F.count("key").alias("unique"))
    every = df.sparkSession.range(len(fields)).select(F.col("id").cast("int").alias("i"), F.get(names, F.col("id").cast("int")).alias("column"))
    return every.join(counts, "i", "left").select("column", F.coalesce("unique", F.lit(0)).alias("unique"))


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if logical_type(f.dataType) == "string"]


def categories(df: DataFrame, limit: int = MAX_CATEGORIES) -> DataFrame:
    """(column, value, n) for string columns with at most ``limit`` distinct values.

    ``limit`` is what a category column is. Digests of values are counted first, so long free text
    is not shuffled to find that out.
    """
    fields = [df.schema[n] for n in _string_columns(df)]
    empty = df.sparkSession.createDataFrame([], "column string, value string, n long")
    if not fields:
        return empty
    found = _value_counts(df, fields).groupBy("i").agg(F.count("key").alias("k")).filter(F.col("k") <= limit)
    names = [fields[i].name for i in sorted(r.i for r in found.collect())]  # at most one row per column
    if not names:
        return empty
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in names]))
    counts = df.select(pairs.alias("_p")).select("_p.*").filter("value IS NOT NULL").groupBy("column", "value")
    counts = counts.agg(F.count("*").alias("n"))
    return counts


def number_extent(df: DataFrame) -> DataFrame:
    """(column, min, max) of numeric columns; an infinite bound becomes null."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMBERS)]
    inf = F.lit(float("inf"))
    aggs, structs = [], []
    for i, n in enumerate(names):
        v = F.col(n).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}")]
        finite = lambda c: F.when(F.abs(F.col(c)) < inf, F.col(c))
        structs.append(F.struct(F.lit(n).alias("column"), finite(f"_lo{i}").alias("min"), finite(f"_hi{i}").alias("max")))
    return _long(df, structs, *aggs)


def date_extent(df: DataFrame) -> DataFrame:
    """(column, min, max) of date columns as ISO text."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, DATES)]
    aggs, structs = [], []
    for i, n in enumerate(names):
        day = isinstance(df.schema[n].dataType, T.DateType)
        text = lambda c: F.date_format(c, "yyyy-MM-dd" if day else "yyyy-MM-dd'T'HH:mm:ss")  # noqa: E731, B023
        aggs += [F.min(n).alias(f"_lo{i}"), F.max(n).alias(f"_hi{i}")]
        structs.append(F.struct(F.lit(n).alias("column"), text(F.col(f"_lo{i}")).alias("min"), text(F.col(f"_hi{i}")).alias("max")))
    return _long(df, structs, *aggs)


def url_flags(df: DataFrame) -> DataFrame:
    """(column, url, image_url): do all values start like a link, and end like an image."""
    aggs, structs = [], []
    for i, n in enumerate(_string_columns(df)):
        v = F.col(n)
        aggs.append(F.coalesce(F.bool_and(F.startswith(v, F.lit("http"))), F.lit(False)).alias(f"_u{i}"))
        ends = F.lower(v).rlike(f"({'|'.join(IMAGE_ENDINGS)})$")
        aggs.append(F.coalesce(F.bool_and(ends), F.lit(False)).alias(f"_i{i}"))
        both = F.col(f"_u{i}") & F.col(f"_i{i}")
        structs.append(F.struct(F.lit(n).alias("column"), F.col(f"_u{i}").alias("url"), both.alias("image_url")))
    return _long(df, structs, *aggs)


def column_roles(df: DataFrame, text_column: str | None = None) -> DataFrame:
    """(role, column): the default text column, candidate embeddings, and columns to colour by."""
    types = column_types(df)
    strings = _string_columns(df)
    default = text_column or ("text" if "text" in df.columns else (strings[0] if strings else None))
    few = categories(df).select("column").distinct().withColumn("_few", F.lit(True))
    known = types.join(few, "column", "left")
    kind = F.col("type")
    roles = F.array(
        F.when(F.col("column") == F.lit(default), "text"),
        F.when(kind == "array", "embedding"),
        F.when((kind == "number") | ((kind == "string") & F.col("_few")), "color"),
    )
    return known.select(F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("role"), "column")


def text_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean and max length, mean words (whole) and estimated tokens."""
    t = F.coalesce(F.col(column).cast("string"), F.lit(""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    row = df.agg(
        F.count("*").alias("rows"),
        F.avg(F.length(t)).alias("avg_length"),
        F.max(F.length(t)).cast("long").alias("max_length"),
        F.floor(F.avg(words)).alias("avg_words"),
    )
    # fixed values: tokens per word and the usual context limit
    return row.withColumn("est_tokens", F.least(F.floor(F.col("avg_words") * 1.3), F.lit(512)))


def storage_estimate(df: DataFrame, column: str, dims: int, token_vectors: bool = False) -> DataFrame:
    """One row: estimated bytes of an embedding table, with a fifth on top."""
    p = text_profile(df, column)
    per_row = F.lit(4 * dims)
    if token_vectors:
        per_row = per_row + F.col("est_tokens") * dims * 2
    return p.select("rows", "est_tokens", F.floor(F.col("rows") * per_row * 1.2).alias("bytes"))


def vector_stats(df: DataFrame, vector: str = "vector") -> DataFrame:
    """(dim, min, max, n) per dimension, from one aggregate over whole vectors."""
    stats = Summarizer.metrics("min", "max", "count").summary(array_to_vector(F.col(vector).cast("array<double>")))
    one = df.select(stats.alias("s")).select(
        vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"), F.col("s.count").alias("n")
    )
    return one.select(F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "b"), "n").select(
        "dim", F.col("b.lo").alias("min"), F.col("b.hi").alias("max"), "n"
    )


def token_stats(df: DataFrame, num_tokens: str = "num_tokens") -> DataFrame:
    """One row: total, mean (2 digits), min, max and count of token counts."""
    n = F.col(num_tokens)
    return df.agg(
        F.sum(n).alias("total"), F.round(F.avg(n), 2).alias("mean"), F.min(n).cast("long").alias("min"),
        F.max(n).cast("long").alias("max"), F.count("*").alias("rows"),
    )

"""Append-only growth as Structured Streaming (STR*)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embedmap.functions.scalars import prepare_text
from embedmap.operators.joins import aligned_tables_check
from embedmap.operators.knn import prepare
from embedmap.operators.project import place_near
from embedmap.operators.sets import ids_minus
from embedmap.session import spread, store
from embedmap.sources.writers import append_vectors, exists


def pending_rows(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows not stored yet, by key; each id once."""
    return ids_minus(source, stored).dropDuplicates(["ls_index"])


def _not_stored(batch: DataFrame, path: str) -> DataFrame:
    """Rows of a batch that the table lacks; of the stored ids only those in the batch's range are read."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["ls_index"])
    if not exists(spark, path):
        return fresh
    span = fresh.agg(F.min("ls_index").alias("lo"), F.max("ls_index").alias("hi")).first()
    if span.lo is None:
        return fresh
    stored = spark.read.parquet(path).select("ls_index").filter(F.col("ls_index").between(span.lo, span.hi))
    return ids_minus(fresh, stored)


def stream_append(
    source: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Embed new rows per micro-batch and append them; a replayed batch adds nothing.

    ``embed`` turns a batch into (ls_index, vector).
    """

    def step(batch: DataFrame, _: int) -> None:
        append_vectors(embed(_not_stored(batch, path)), path)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_place(
    source: DataFrame, old: DataFrame, old_map: DataFrame, path: str, checkpoint: str, k: int = 15
) -> StreamingQuery:
    """Place arriving (ls_index, vector) rows on a published map and append their coordinates.

    Only rows of the published map serve as neighbours, so the result does not depend on how the
    stream is cut into batches. They are checked and prepared once, before the stream starts; a batch
    meets the cells near it.
    """
    aligned_tables_check(old_map, old)
    ready = prepare(old, k, "cosine")
    known = store(old_map.select("ls_index"), "published")

    def step(batch: DataFrame, _: int) -> None:
        fresh = ids_minus(_not_stored(batch, path), known)
        place_near(old_map, ready, fresh, k).write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarantine(
    docs: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "", batch_size: int = 100
) -> tuple[DataFrame, DataFrame]:
    """(good, failed): vectors of rows that embed, and id, input and error of rows that do not.

    A failing batch is retried row by row, so one bad row does not take its neighbours along.
    The tagged result is written once and split, so the model is not called twice.
    """

    def run(frames):
        model = load()
        for pdf in frames:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s : s + batch_size]
                texts = part["t"].tolist()
                try:
                    vectors, errors = list(np.asarray(model(texts), dtype=np.float32)), [None] * len(part)
                except Exception:  # noqa: BLE001
                    vectors, errors = [], []
                    for t in texts:
                        try:
                            vectors.append(np.asarray(model([t]), dtype=np.float32)[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            vectors.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame(
                    {"ls_index": part["ls_index"].to_numpy(), "input": texts, "vector": vectors, "error": errors}
                )

    ready = spread(docs).select(F.col("ls_index").cast("long"), prepare_text(text, prefix).alias("t"))
    tried = ready.mapInPandas(run, "ls_index long, input string, vector array<float>, error string")
    stored = store(tried, "quarantine")
    good = stored.filter("error IS NULL").select("ls_index", "vector")
    return good, stored.filter("error IS NOT NULL").select("ls_index", "input", "error")

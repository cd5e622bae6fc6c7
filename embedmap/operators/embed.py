"""User functions that turn text into vectors (UDF*)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.functions.scalars import prepare_text
from embedmap.functions.vectors import EPS
from embedmap.session import spread

Embed = Callable[[list[str]], np.ndarray]


def _chunks(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for s in range(0, len(pdf), size):
            yield pdf.iloc[s : s + size]


def embed(docs: DataFrame, text: str, load: Callable[[], Embed], batch_size: int = 100, prefix: str = "") -> DataFrame:
    """(ls_index, vector). ``load`` runs once per task and returns a function on batches of text."""

    def run(frames):
        model = load()
        for pdf in _chunks(frames, batch_size):
            vectors = np.asarray(model(pdf["t"].tolist()), dtype=np.float32)
            yield pd.DataFrame({"ls_index": pdf["ls_index"].to_numpy(), "vector": list(vectors)})

    ready = spread(docs).select(F.col("ls_index").cast("long"), prepare_text(text, prefix).alias("t"))
    return ready.mapInPandas(run, "ls_index long, vector array<float>")


def embed_query(queries: DataFrame, text: str, load: Callable[[], Embed], prefix: str = "query: ") -> DataFrame:
    """Query side of a model whose queries carry another prefix than its documents."""
    return embed(queries, text, load, prefix=prefix)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Consecutive slices of the given sizes as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def embed_multi(
    docs: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[np.ndarray]]],
    batch_size: int = 100, prefix: str = "", dimensions: int | None = None,
) -> DataFrame:
    """(ls_index, vector, token_vectors, num_tokens): token vectors and their unit mean.

    Every text must give at least one token vector. With ``dimensions`` token vectors are cut and
    scaled to unit length first.
    """

    def run(batches):
        model = load()
        for b in batches:
            for s in range(0, b.num_rows, batch_size):
                part = b.slice(s, batch_size)
                per_doc = [np.asarray(t, dtype=np.float64) for t in model(part.column("t").to_pylist())]
                sizes = np.array([len(t) for t in per_doc])
                flat = np.concatenate(per_doc)
                if dimensions:
                    flat = flat[:, :dimensions]
                    flat = flat / (np.sqrt((flat * flat).sum(1, keepdims=True)) + EPS)
                mean = np.add.reduceat(flat, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                mean = mean / (np.sqrt((mean * mean).sum(1, keepdims=True)) + EPS)
                rows = lambda m: _lists(pa.array(m.ravel(), pa.float32()), np.full(len(m), m.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("ls_index"), rows(mean), _lists(rows(flat), sizes), pa.array(sizes, pa.int32())],
                    names=["ls_index", "vector", "token_vectors", "num_tokens"],
                )

    ready = spread(docs).select(F.col("ls_index").cast("long"), prepare_text(text, prefix).alias("t"))
    return ready.mapInArrow(
        run, "ls_index long, vector array<float>, token_vectors array<array<float>>, num_tokens int"
    )


def hash_embed(docs: DataFrame, text: str, dim: int = 256) -> DataFrame:
    """(ls_index, vector) without any model: hashed word counts, scaled to unit length.

    A word, lower-cased, counts at the first 28 bits of its MD5 modulo ``dim``. Words become places
    in SQL functions, counts come from one numpy pass per batch, and nothing is shuffled.
    """
    words = F.regexp_extract_all(F.lower(prepare_text(text)), F.lit(r"\p{L}+"), F.lit(0))
    place = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"), F.lit(dim))
    ready = docs.select(F.col("ls_index").cast("long"), F.transform(words, place).alias("places"))

    def run(batches):
        for b in batches:
            lists = b.column("places")
            n = b.num_rows
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            counts = np.bincount(row * dim + lists.flatten().to_numpy(), minlength=n * dim).reshape(n, dim).astype(np.float64)
            unit = counts / np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1e-300)
            vectors = _lists(pa.array(unit.ravel(), pa.float32()), np.full(n, dim))
            yield pa.RecordBatch.from_arrays([b.column("ls_index"), vectors], names=["ls_index", "vector"])

    return ready.mapInArrow(run, "ls_index long, vector array<float>")

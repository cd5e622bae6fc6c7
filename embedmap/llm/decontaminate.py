"""Benchmark items inside documents: n-gram seeds, then Smith-Waterman alignment of words.

A table of fixed size holds the items' n-grams by hash; documents leave a trace only where one of theirs
passes it. Around such places the words that an alignment with an item of that n-gram could reach are
cut out, so texts never move. Seeds are joined with the items exactly, rare ones first: a seed that many
passages hold is only looked at for passages and items that no rarer one has brought together. Each
passage is aligned with all items it shares a seed with.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.llm.words import arrow_rows, mix, slices
from embedmap.session import store

TABLE_BITS = 22  # 4 MB; more items only make more places pass it
RARE = 32  # a seed of more passages is a common one
MATCH, MISMATCH, GAP = 2, -1, -1
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _plain(text) -> F.Column:
    """Lower case, and anything but letters and digits as a space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    ends = max(len(words) - size + 1, 0)
    rolled = words[:ends]
    for j in range(1, size):
        rolled = mix(rolled * _STEP + words[j : ends + j])
    return mix(rolled + _U(size))


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> _U(64 - TABLE_BITS)).astype(np.int64)


def _span(words: int, similarity: float) -> int:
    """Most text words in an alignment that reaches the similarity with an item of so many words.

    With m item words and M matches at most m, the score asks for mismatches and gaps of at most
    2 M - 2 m similarity, and each text word beyond the matches costs one of them.
    """
    return int(np.floor(words + 2 * words * (1 - similarity) + 1e-9))


def _class(words: np.ndarray) -> np.ndarray:
    """Lengths by half powers of two, from 1; the items of a class have at most ``_longest`` words."""
    return (np.ceil(np.log2(np.maximum(words, 1)) * 2 - 1e-9) + 1).astype(np.uint8)


def _longest(kind: int) -> int:
    return int(np.floor(2 ** ((kind - 1) / 2) + 1e-6))


def item_words(items: DataFrame, n: int) -> DataFrame:
    """(item_id, words, grams) of (item_id, text); an item of fewer words than n is one n-gram."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                words = part.hashes()
                own = [words[a:b] for a, b in zip(part.first[:-1], part.first[1:], strict=True)]
                grams = [np.unique(_grams(w, min(n, len(w)))) if len(w) else w for w in own]
                lists = [pa.array([x.view(np.int64) for x in side], pa.list_(pa.int64())) for side in (own, grams)]
                yield pa.record_batch([batch.column(0).slice(part.lo, part.hi - part.lo), *lists], names=["item_id", "words", "grams"])

    return arrow_rows(items, rows, "item_id long, words array<long>, grams array<long>")


def _seed_table(items: DataFrame) -> np.ndarray:
    """Per slot the class of the longest item with an n-gram there, 0 for none: 2**TABLE_BITS bytes reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, np.uint8)
        for batch in batches:
            sizes = _class(batch.column(1).to_numpy())
            for grams, size in zip(batch.column(0).to_numpy(zero_copy_only=False), sizes, strict=True):
                slot = _slot(np.asarray(grams, np.int64).view(_U))
                table[slot] = np.maximum(table[slot], size)
        yield pa.record_batch([pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], names=["table"])

    parts = arrow_rows(items.select("grams", F.size("words").alias("n")).coalesce(8), rows, "table binary")
    total = np.zeros(1 << TABLE_BITS, np.uint8)
    for row in parts.toLocalIterator():
        total = np.maximum(total, np.frombuffer(zlib.decompress(row.table), np.uint8))
    return total


def passages(docs: DataFrame, table: np.ndarray, sizes: list[int], similarity: float) -> DataFrame:
    """(id, at, words, grams): stretches of words around n-grams that pass the table, as far as an alignment may reach."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    spans = np.array([0, *[_span(_longest(k), similarity) for k in range(1, 64)]], np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1)):
                words = part.hashes()
                text = np.repeat(np.arange(part.hi - part.lo), np.diff(part.first))
                at, grams, reach, after = [], [], [], []
                for size in sizes:
                    rolled = _grams(words, size)
                    kind = table[_slot(rolled)]
                    hit = np.flatnonzero(kind)
                    hit = hit[text[hit] == text[hit + size - 1]]
                    at.append(hit)
                    grams.append(rolled[hit])
                    reach.append(np.maximum(spans[kind[hit]] - size, 0))
                    after.append(np.full(len(hit), size))
                at, grams, reach, after = (np.concatenate(x) for x in (at, grams, reach, after))
                if not len(at):
                    continue
                own = text[at]
                lo = np.maximum(at - reach, part.first[own])
                hi = np.minimum(at + reach + after, part.first[own + 1])
                order = np.argsort(lo, kind="stable")
                grams, own, lo, hi = grams[order], own[order], lo[order], hi[order]
                # texts follow each other, so a running end never reaches into the next one
                upto = np.maximum.accumulate(hi)
                new = np.concatenate(([True], (own[1:] != own[:-1]) | (lo[1:] > upto[:-1])))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(lo))
                signed = words.view(np.int64)
                yield pa.record_batch(
                    [
                        ids.take(pa.array(part.lo + own[first])),
                        pa.array(lo[first] - part.first[own[first]]),
                        pa.array([signed[a:b] for a, b in zip(lo[first], upto[last - 1], strict=True)], pa.list_(pa.int64())),
                        pa.array([np.unique(grams[a:b]).view(np.int64) for a, b in zip(first, last, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["id", "at", "words", "grams"],
                )

    return arrow_rows(docs, rows, "id long, at long, words array<long>, grams array<long>")


def local_alignment(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and the first text word after its end."""
    steps = np.arange(len(item) + 1) * -GAP
    row = np.zeros(len(item) + 1, np.int64)
    best, end = 0, 0
    for i, word in enumerate(text):
        fit = np.maximum(row[:-1] + np.where(item == word, MATCH, MISMATCH), row[1:] + GAP)
        row = np.concatenate(([0], np.maximum(fit, 0)))
        # gaps in the text's row: the best cell to the left, less a gap for each step
        row = np.maximum.accumulate(row + steps) - steps
        if row.max() > best:
            best, end = int(row.max()), i + 1
    return best, end


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, similarity: float = 0.5) -> DataFrame:
    """(doc_id, item_id, similarity, word_end) of every document that holds an item or an edited copy of it.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Words are
    runs of letters and digits, lower-cased. Similarity is the best local alignment's score over
    that of the whole item; pairs of at least ``similarity`` are returned, once for repeated rows.
    Seeds are all of an item's n-grams, and an alignment is found if it lies within the reach of one. Null and empty texts hold nothing and are held by nothing. Rows of a null doc_id are reported together under
    the null id, items of a null item_id likewise. ``word_end`` is the number of words up to the end
    of the best alignment, the earliest one among equals.
    """
    items = item_words(items.select(F.col("item_id").cast("long"), _plain("text").alias("text")), n)
    items = store(items.filter(F.size("words") > 0), "item-words")
    shape = items.agg(F.collect_set(F.least(F.size("words"), F.lit(n))).alias("sizes")).first()
    if not shape.sizes:
        none = docs.select(F.col("doc_id").cast("long")).filter("false")
        return none.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("word_end"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), _plain("text").alias("text"))
    found = store(passages(texts, _seed_table(items), sorted(shape.sizes), similarity).withColumn("passage", F.monotonically_increasing_id()), "passages")

    hits = found.select("passage", F.explode("grams").alias("gram"))
    seeds = items.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "words", "grams")
    seeds = store(seeds, "items")
    grams = seeds.select("item", F.explode("grams").alias("gram"))
    held = hits.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("held"))
    ranked = store(grams.join(held, "gram").select("gram", "item", (F.col("held") <= RARE).alias("rare")), "ranked-seeds")
    rare = store(hits.join(ranked.filter("rare"), "gram").select("passage", "item").distinct(), "rare-pairs")
    common = hits.join(ranked.filter("NOT rare"), "gram").select("passage", "item").distinct().join(rare, ["passage", "item"], "left_anti")
    pairs = rare.unionByName(common)
    both = pairs.join(found.select("passage", "id", "at", F.col("words").alias("text")), "passage")
    both = both.join(seeds.select("item", "item_id", F.col("words").alias("words")), "item")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("text", "words"))
            starts = batch.column("at").to_numpy()
            # each word of an item matches once at most, so the number of them in the text bounds the score
            able = np.array([np.isin(w, t).sum() / len(w) >= similarity for t, w in zip(texts, words, strict=True)], bool)
            batch, texts, words, starts = batch.filter(pa.array(able)), texts[able], words[able], starts[able]
            best = [local_alignment(t, w) for t, w in zip(texts, words, strict=True)]
            score = [s / (MATCH * len(w)) for (s, _), w in zip(best, words, strict=True)]
            ends = [int(a) + e for a, (_, e) in zip(starts, best, strict=True)]
            yield pa.record_batch([batch.column("id"), batch.column("item_id"), pa.array(score, pa.float64()), pa.array(ends, pa.int64())], names=["doc_id", "item_id", "similarity", "word_end"])

    scored = arrow_rows(both.select("id", "at", "text", "item_id", "words"), rows, "doc_id long, item_id long, similarity double, word_end long")
    top = F.max(F.struct("similarity", (-F.col("word_end")).alias("end"))).alias("top")
    pairs = scored.filter(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(top)
    return pairs.select("doc_id", "item_id", "top.similarity", (-F.col("top.end")).alias("word_end"))

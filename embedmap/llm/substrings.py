"""Repeated passages, word for word, found by recompression.

Rounds name runs of equal words, then pairs of neighbours: a hash bit of a symbol says whether it
opens or closes a pair, so which symbols meet depends on their names alone. A name is the hash of
what it stands for, hence equal passages get equal interior symbols in every task without a shared
dictionary. Each symbol carries the stretch of words that settled it.

A window of words picks the lowest-ranked symbol settled inside it, long ones first. Equal windows
pick equal symbols, so a window whose symbol occurs once in the corpus is unique and is never
looked at again; that leaves the true repeats and few others. These windows, and those without a
settled symbol, are confirmed by 96-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.llm.words import Slice, arrow_rows, joined, mix, slices
from embedmap.session import store

ROUNDS = 5
LONG_SYMBOL = 4  # words; shorter symbols repeat by chance and are picked last
_U = np.uint64
_ONE, _STEP = _U(1), _U(0x9E3779B97F4A7C15)
_FAR = 1 << 40


class Symbols:
    """Top-level symbols of all texts of a slice: first word, name, and the words [lo, hi) that settled them."""

    def __init__(self, words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
        n = len(words)
        opens = np.zeros(n + 1, bool)
        opens[first] = True
        opens = opens[:n]
        same = np.concatenate(([False], words[1:] == words[:-1])) & ~opens if n else opens
        self.at = np.flatnonzero(~same)
        size = np.diff(np.append(self.at, n))
        base = words[self.at]
        self.name = np.where(size > 1, mix(base ^ (size.astype(_U) * _STEP)), base)
        self.head = opens[self.at]
        self.tail = np.append(self.head[1:], True)[: len(self.at)]
        # a run is settled by the words on both sides; nothing outside a text settles anything
        self.lo = np.where(self.head, -_FAR, self.at - 1)
        self.hi = np.where(self.tail, _FAR, self.at + size + 1)
        for r in range(rounds if n else 0):
            self._pair(r)
        self.size = np.diff(np.append(self.at, n))

    def _pair(self, r: int) -> None:
        left = (mix(self.name + _U(2 * r + 1)) & _ONE) == 0
        after = lambda x, end: np.append(x[1:], end)
        before = lambda x, end: np.append(end, x[:-1])
        pair = left & ~after(left, True) & ~self.tail
        second = before(pair, False)
        # an opener is settled together with what follows, a closer with what is before it
        lo = np.where(left, np.where(self.tail, self.lo, np.minimum(self.lo, after(self.lo, 0))), np.where(self.head, -_FAR, np.minimum(self.lo, before(self.lo, 0))))
        hi = np.where(left, np.where(self.tail, _FAR, np.maximum(self.hi, after(self.hi, 0))), np.where(self.head, self.hi, np.maximum(self.hi, before(self.hi, 0))))
        name = np.where(pair, mix(self.name * _STEP + after(self.name, _U(0)) + _U(r)), self.name)
        tail = np.where(pair, after(self.tail, True), self.tail)
        keep = ~second
        self.at, self.name, self.lo, self.hi = self.at[keep], name[keep], lo[keep], hi[keep]
        self.head, self.tail = self.head[keep], tail[keep]


def picked(part: Slice, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of all windows, their symbol's first word or -1, names by first word)."""
    last = np.repeat(part.first[1:], np.diff(part.first)) - window
    starts = np.flatnonzero(np.arange(len(words)) <= last)
    symbols = Symbols(words, part.first[:-1])
    names = np.zeros(len(words), _U)
    names[symbols.at] = symbols.name
    use = np.flatnonzero((symbols.lo > -_FAR) & (symbols.hi < _FAR) & (symbols.hi - symbols.lo <= window))
    pick = np.full(len(starts), -1)
    if not len(use) or not len(starts):
        return starts, pick, names
    rank = (mix(symbols.name[use]) >> _ONE) | np.where(symbols.size[use] < LONG_SYMBOL, _ONE << _U(63), _U(0))
    # lo and hi rise along the text, so a window's symbols are neighbours
    a = np.searchsorted(symbols.lo[use], starts)
    b = np.searchsorted(symbols.hi[use], starts + window, "right")
    some = np.flatnonzero(a < b)
    a, b = a[some], b[some]
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    best, found = np.arange(len(use)), np.zeros(len(some), np.int64)
    lower = lambda x, y: np.where(rank[y] < rank[x], y, x)
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        found[mine] = lower(best[a[mine]], best[b[mine] - (1 << k)])
        best = lower(best[: len(best) - (1 << k)], best[1 << k :])
    pick[some] = symbols.at[use][found]
    return starts, pick, names


def window_hashes(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of ``window`` words from each start, by doubling."""
    power, size, out, done = words, 1, None, 0
    while done < window:
        if window & size:
            piece = power[starts + done]
            out = piece if out is None else mix(out * _STEP + piece)
            done += size
        if done < window:
            power = mix(power[: max(len(power) - size, 0)] * _STEP + power[size:] + _U(size))
            size *= 2
    return out


def _word_rows(docs: DataFrame, window: int) -> DataFrame:
    """Per row its words' digest and number, picked symbols with first words, and whether some window has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                _, pick, names = picked(part, part.hashes(), window)
                starts = np.flatnonzero(np.arange(int(part.first[-1])) <= np.repeat(part.first[1:], np.diff(part.first)) - window)
                at = np.unique(pick[pick >= 0])
                text = np.searchsorted(part.first, at, "right") - 1
                offsets = pa.array(np.searchsorted(text, np.arange(part.hi - part.lo + 1)).astype(np.int32))
                bare = np.zeros(part.hi - part.lo, bool)
                bare[np.searchsorted(part.first, starts[pick < 0], "right") - 1] = True
                own = batch.slice(part.lo, part.hi - part.lo)
                yield pa.record_batch(
                    [
                        own.column("id"),
                        own.column("key"),
                        pa.array(np.diff(part.first)),
                        pa.array([hashlib.sha256(t).digest() for t in joined(part)], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(names[at].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array((at - part.first[text]).astype(np.int32))),
                        pa.array(bare),
                    ],
                    names=["id", "key", "n", "digest", "names", "at", "bare"],
                )

    return arrow_rows(docs.select("id", "key", "text"), rows, "id long, key long, n long, digest binary, names array<long>, at array<int>, bare boolean")


def _window_rows(texts: DataFrame, window: int) -> DataFrame:
    """(k1, k2, row, at) of windows that may be repeated; row is null where the text is removed anyway."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                one, two = part.hashes(), part.hashes(seed=2)
                starts, pick, _ = picked(part, one, window)
                marked = np.zeros(len(one) + 1, bool)
                own = batch.slice(part.lo, part.hi - part.lo)
                lists = own.column("at")
                offsets = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                marked[flat + np.repeat(part.first[:-1], np.diff(offsets))] = True
                marked[-1] = True  # where a window has no symbol
                starts = starts[marked[pick]]
                text = np.searchsorted(part.first, starts, "right") - 1
                ids = own.column("row").to_numpy(zero_copy_only=False)[text]
                known = np.array(own.column("copied").to_pylist(), bool)[text]
                yield pa.record_batch(
                    [
                        pa.array(window_hashes(one, starts, window).view(np.int64)),
                        pa.array((window_hashes(two, starts, window) >> _U(32)).astype(np.uint32).view(np.int32)),
                        pa.array(ids.astype(np.int64), pa.int64(), mask=known),
                        pa.array((starts - part.first[text]).astype(np.int32)),
                    ],
                    names=["k1", "k2", "row", "at"],
                )

    return arrow_rows(texts.select("row", "copied", "at", "text"), rows, "k1 long, k2 int, row long, at int")


def _kept_rows(texts: DataFrame, window: int) -> DataFrame:
    """(row, n_removed, kept) of texts with removed windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                own = batch.slice(part.lo, part.hi - part.lo)
                lists = own.column("gone")
                offsets = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                first = flat + np.repeat(part.first[:-1], np.diff(offsets))
                cover = np.zeros(len(part.start) + 1, np.int64)
                np.add.at(cover, first, 1)
                np.subtract.at(cover, first + window, 1)
                keep = np.cumsum(cover[:-1]) == 0
                gone = np.concatenate(([0], np.cumsum(~keep)))[part.first]
                kept = pa.array([t.decode("utf-8", "replace") for t in joined(part, keep)], pa.string())
                yield pa.record_batch([own.column("row"), pa.array(np.diff(gone)), kept], names=["row", "n_removed", "kept"])

    return arrow_rows(texts.select("row", "gone", "text"), rows, "row long, n_removed long, kept string")


def drop_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, kept, kept_sha256) of every row.

    Words are runs of other characters than space and controls 9 to 13, unchanged. A word goes if some
    window of ``window`` words over it also starts anywhere else, in this text or another; every copy
    goes. ``kept`` holds the other words with one space between, and is null where nothing was removed
    (the words are the text's) or where ``keep_text`` is false. Null and empty texts have no words.
    Repeated rows are texts of their own and so repeat each other; null ids stay null; other columns
    are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    rows = store(_word_rows(docs, window).withColumn("row", F.monotonically_increasing_id()), "word-rows")
    # texts of equal words are one class; all windows of two such texts are repeats
    classes = rows.filter(F.col("n") >= window).groupBy("digest").agg(F.min(F.struct("row", "id", "key", "bare")).alias("one"), (F.count("*") > 1).alias("copied"))
    classes = store(classes.select("one.*", "digest", "copied"), "word-classes")

    symbols = rows.select("row", F.explode(F.arrays_zip("names", "at")).alias("s")).select("row", F.col("s.names").alias("name"), F.col("s.at").alias("at"))
    # stored, so that the join below has a shuffle of its own and a very common name can be split
    repeated = store(symbols.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name"), "repeated-names")
    marks = symbols.join(repeated, "name", "left_semi").groupBy("row").agg(F.collect_list("at").alias("at"))
    work = classes.join(marks, "row", "left").filter("bare OR at IS NOT NULL").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))

    same = lambda right: (docs["key"] == right["key"]) & docs["id"].eqNullSafe(right["id"])
    texts = docs.join(work, same(work)).select("row", "copied", "at", "text")
    windows = _window_rows(texts, window)
    twice = windows.groupBy("k1", "k2").agg(F.count("*").alias("c")).filter("c > 1").select("k1", "k2")
    gone = windows.filter("row IS NOT NULL").join(twice, ["k1", "k2"], "left_semi")
    # not stored: in one plan the shuffle of texts by key serves the windows and the removal below
    gone = gone.groupBy("row").agg(F.collect_list("at").alias("gone"))

    # a null id may stand for several rows of one text only if they are copies, which are not here
    partial = classes.filter("NOT copied").select("row", "id", "key").join(gone, "row")
    kept = _kept_rows(docs.join(partial, same(partial)).select("row", "gone", "text"), window)
    kept = kept.withColumn("sha", F.sha2("kept", 256))
    kept = kept if keep_text else kept.drop("kept").withColumn("kept", F.lit(None).cast("string"))

    out = rows.select("row", "id", "n", "digest").join(classes.select("digest", "copied"), "digest", "left").join(kept, "row", "left")
    copied = F.coalesce("copied", F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(copied, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, "").otherwise(F.col("kept")).alias("kept"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )

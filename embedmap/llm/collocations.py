"""Collocations of two and three words: best-first growth of phrases under admissible score bounds.

A phrase of count a is scored by its weakest cut into first part (count l) and rest (r): the floor
of 1000000 a a / (l r). A phrase occurs no more often than its prefix, so all that grows from the
prefix ``w1 w2`` scores at most the floor of 1000000 f(w1 w2) / f(w1). The frontier are the frequent
word pairs of a language in order of this bound. A round expands it down to a bound, which is
the score of some pair of that language: it counts the triples that grow from these pairs, and those
that end in a pair scoring as much, as they alone can drop it. Then everything that scores at
least the bound is known, and so is whether it survives. If that is as much as was asked for, the
language is settled, ties included; else the next round goes deeper, at last to all pairs.

Counting is exact: hashes only choose what is counted, through bitmaps of fixed size that let too
much pass but never too little, and counts are of strings. Within a task equal strings are
recognised by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from embedmap.llm.words import Slice, arrow_rows, bitmap, mix, passing, slices
from embedmap.session import store

TEXT_SLICE = 1 << 20
TASK_KEYS = 3_000_000  # hashes a task holds before it counts them
TASK_ROWS = 500_000  # distinct phrases a task holds before it hands them on
START, DEEPER = 2, 4  # the first bound is the score at START times the places asked for, then DEEPER times as many
UNKNOWN = "und"

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
# fixed values: what ends a piece, and what separates words
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True


def _in_word(data: np.ndarray) -> np.ndarray:
    return ~_APART[data]


def _seed(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((UNKNOWN if lang is None else lang).encode(), digest_size=8).digest(), "little")


class Phrases:
    """The words of a slice with their language: hashes of phrases by the place of their first word."""

    def __init__(self, part: Slice, langs: list[str | None]):
        self.part = part
        self.text = np.repeat(np.arange(part.hi - part.lo), np.diff(part.first))
        breaks = np.concatenate(([0], np.cumsum(_BREAK[part.data])))
        # a word and the next one of the same piece
        self.joined = (self.text[1:] == self.text[:-1]) & (breaks[part.start[1:]] == breaks[part.end[:-1]])
        self.word = part.hashes(lower=True)
        seeds = np.array([_seed(x) for x in langs], _U)
        self.one = mix(self.word + seeds[self.text])
        self.two = mix(self.one[:-1] * _STEP + self.word[1:])  # meant where joined

    def three(self, at: np.ndarray) -> np.ndarray:
        return mix(self.two[at] * _STEP + self.word[at + 2])

    def strings(self, at: np.ndarray, size: int) -> pa.Array:
        words = [self.part.strings(at + j) for j in range(size)]
        return pc.binary_join_element_wise(*words, " ") if size > 1 else words[0]


def _phrases(batch: pa.RecordBatch, limit: int = TEXT_SLICE) -> Iterator[Phrases]:
    """Slices of (lang, text)."""
    langs = batch.column(0).to_pylist()
    for part in slices(batch.column(1), limit, _in_word):
        yield Phrases(part, langs[part.lo : part.hi])


def _pair_keys(pairs: DataFrame) -> DataFrame:
    """(key) of (lang, phrase) of two words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in _phrases(batch):
                yield pa.record_batch([pa.array(p.two[p.part.first[:-1]].view(np.int64))], names=["key"])

    return arrow_rows(pairs.select("lang", "phrase"), rows, "key long")


def _often(texts: DataFrame, min_count: int) -> DataFrame:
    """(key) of words and pairs whose hash occurs ``min_count`` times, and maybe a few others of the same hash."""

    def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, c = np.unique(np.concatenate(keys), return_counts=True)
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(c, pa.int64())], names=["key", "c"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for p in _phrases(batch):
                held += [p.one, p.two[p.joined]]
                n += len(held[-1]) + len(held[-2])
                if n > TASK_KEYS:
                    yield counted(held)
                    held, n = [], 0
        if held:
            yield counted(held)

    found = arrow_rows(texts, rows, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    return found.filter(F.col("c") >= min_count).select("key")


def _counts(texts: DataFrame, pick: Callable[[Phrases], list[tuple[int, np.ndarray, np.ndarray]]], totals: bool) -> DataFrame:
    """(lang, size, phrase, f): exact counts of the phrases that ``pick`` names by size, place and hash.

    With ``totals`` the words of a language are counted as size 0 as well.
    """

    def merged(held: list[tuple]) -> tuple:
        key = np.concatenate([h[0] for h in held])
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        count = np.zeros(len(first), np.int64)
        np.add.at(count, of.reshape(-1), np.concatenate([h[1] for h in held]))
        rest = [pa.concat_arrays([h[i] for h in held]).take(pa.array(first)) for i in (2, 3, 4)]
        return key[first], count, *rest

    def told(row: tuple) -> pa.RecordBatch:
        _, count, lang, size, phrase = row
        return pa.record_batch([lang, size, phrase, pa.array(count)], names=["lang", "size", "phrase", "f"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            langs = pc.fill_null(batch.column(0), UNKNOWN)
            for p in _phrases(batch):
                own = langs.slice(p.part.lo, p.part.hi - p.part.lo)
                if totals:
                    words = np.diff(p.part.first)
                    sizes, empty = pa.array(np.zeros(len(words), np.int32)), pa.array([""] * len(words), pa.string())
                    held.append((np.array([_seed(x) for x in own.to_pylist()], _U), words, own, sizes, empty))
                for size, at, keys in pick(p):
                    key, first, c = np.unique(keys, return_index=True, return_counts=True)
                    first = at[first]
                    # hashes of unlike sizes must not meet
                    key = mix(key + _U(size))
                    held.append((key, c, own.take(pa.array(p.text[first])), pa.array(np.full(len(c), size, np.int32)), p.strings(first, size)))
                n += sum(len(h[0]) for h in held[-3:])
                if n > 2 * TASK_ROWS:
                    held = [merged(held)]
                    n = len(held[0][0])
                    if n > TASK_ROWS:
                        yield told(held[0])
                        held, n = [], 0
        if held:
            yield told(merged(held))

    found = arrow_rows(texts, rows, "lang string, size int, phrase string, f long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def _floor(numerator: tuple, denominator: tuple) -> Column:
    """1000000 times a fraction, rounded down, in whole numbers of up to 38 digits."""
    over = lambda names: "*".join(f"CAST({n} AS DECIMAL(38, 0))" for n in names)
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(38, 0)) * {over(numerator)}) DIV ({over(denominator)}) AS LONG)")


def _bounds(pairs: DataFrame, langs: DataFrame, places: int) -> DataFrame:
    """(lang, low): the score of each language's pair at that place, 0 if it has fewer pairs."""
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("phrase"))
    best = pairs.select("lang", "score", "phrase").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= places)
    low = best.groupBy("lang").agg(F.when(F.count("*") == places, F.min("score")).otherwise(0).alias("low"))
    return store(langs.join(low, "lang", "left").select("lang", F.coalesce("low", F.lit(0)).alias("low")), "score-bounds")


def _expanded(texts: DataFrame, pairs: DataFrame, low: DataFrame, often: np.ndarray, min_count: int, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all that survives and scores at least the language's bound ``low``."""
    sc = texts.sparkSession.sparkContext
    reached = pairs.join(low, "lang")
    top = store(reached.filter(F.col("score") >= F.col("low")), "top-pairs")
    grow = sc.broadcast(bitmap(_pair_keys(reached.filter(F.col("bound") >= F.col("low")))))
    ends = sc.broadcast(bitmap(_pair_keys(top)))
    often = sc.broadcast(often)

    def triples(p: Phrases) -> list[tuple[int, np.ndarray, np.ndarray]]:
        at = np.flatnonzero(p.joined[1:] & p.joined[:-1])
        first, rest = p.two[at], p.two[at + 1]
        at = at[passing(often.value, first) & passing(often.value, rest) & (passing(grow.value, first) | passing(ends.value, rest))]
        return [(3, at, p.three(at))]

    mine = texts.join(low.select("lang"), "lang", "left_semi").select("lang", "text")
    words = F.split("phrase", " ")
    pair = lambda i: F.concat_ws(" ", words[i], words[i + 1])
    counted = _counts(mine, triples, False).filter(F.col("f") >= min_count)
    counted = store(counted.select("lang", "phrase", F.col("f").alias("a"), pair(0).alias("first"), pair(1).alias("rest")), "triples")
    first = pairs.select("lang", F.col("phrase").alias("first"), F.col("a").alias("f12"), F.col("l").alias("f1"))
    rest = pairs.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    cut = counted.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    cut = cut.withColumn("s1", _floor(("a", "a"), ("f1", "f23"))).withColumn("s2", _floor(("a", "a"), ("f12", "f3")))
    early = F.col("s1") <= F.col("s2")
    either = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    longer = cut.select("lang", "phrase", "a", either("f1", "f12").alias("l"), either("f23", "f3").alias("r"), F.least("s1", "s2").alias("score"))
    longer = longer.join(low, "lang").filter(F.col("score") >= F.col("low")).drop("low")

    inside = counted.select("lang", F.explode(F.array("first", "rest")).alias("phrase"), F.col("a").alias("around"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = top.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("around") < share * F.col("a"), F.lit(True)))
    return kept.select(*longer.columns).union(longer)


def collocations(
    docs: DataFrame, top: int = 2000, min_count: int = 10, share: int = 50, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, a, and byte order of the phrase.

    Texts are lower-cased in A-Z, cut into pieces at .,;:!? and line ends and these into words at spaces and tabs;
    n is the number of a language's words. Candidates are phrases of two and three words within a piece that
    occur at least ``min_count`` times. One that lies inside a longer candidate of at least ``share`` per
    cent of its count is dropped. The cut of lowest score counts, ties to the first. A null language is
    ``und``, null and empty texts have no words, repeated rows count as often as they occur. Other columns
    are not read. An empty table, or one without frequent pairs, gives an empty one.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    often = bitmap(_often(texts, min_count))
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def frequent(p: Phrases) -> list[tuple[int, np.ndarray, np.ndarray]]:
        one, two = np.flatnonzero(passing(shared.value, p.one)), np.flatnonzero(p.joined)
        two = two[passing(shared.value, p.two[two])]
        return [(1, one, p.one[one]), (2, two, p.two[two])]

    grams = store(_counts(texts, frequent, True).filter((F.col("f") >= min_count) | (F.col("size") == 0)), "phrase-counts")
    word = grams.filter("size = 1").select("lang", F.col("phrase").alias("word"), F.col("f"))
    side = lambda name, f: word.withColumnsRenamed({"word": name, "f": f})
    pairs = grams.filter("size = 2").select("lang", "phrase", F.col("f").alias("a"), F.substring_index("phrase", " ", 1).alias("w1"), F.substring_index("phrase", " ", -1).alias("w2"))
    pairs = pairs.join(side("w1", "l"), ["lang", "w1"]).join(side("w2", "r"), ["lang", "w2"])
    pairs = store(pairs.select("lang", "phrase", "a", "l", "r", _floor(("a", "a"), ("l", "r")).alias("score"), _floor(("a",), ("l",)).alias("bound")), "pairs")

    langs, places, settled = pairs.select("lang").distinct(), START * top, []
    while True:
        low = _bounds(pairs.join(langs, "lang", "left_semi"), langs, places)
        if low.isEmpty():
            break
        found = store(_expanded(texts, pairs, low, often, min_count, share), "survivors")
        enough = low.join(found.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left")
        enough = store(enough.select("lang", (F.coalesce("found", F.lit(0)) >= top).alias("full"), "low"), "settled")
        settled.append(found.join(enough.filter("full OR low = 0").select("lang"), "lang", "left_semi"))
        langs, places = enough.filter("NOT full AND low > 0").select("lang"), places * DEEPER
    survivors = pairs.select("lang", "phrase", "a", "l", "r", "score").limit(0)
    for found in settled:
        survivors = survivors.union(found.select(*survivors.columns))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = survivors.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    words = grams.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(top: int = 2000, min_count: int = 10, share: int = 50) -> str:
    """The same in SQL: all phrases are counted, scored and ranked."""
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY lang, x),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
    f2 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM w) GROUP BY lang, x HAVING count(*) >= {min_count}),
    f3 AS MATERIALIZED (SELECT lang, x, split_part(x, ' ', 1) AS x1, split_part(x, ' ', 2) AS x2, split_part(x, ' ', 3) AS x3, count(*) AS f
        FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w) GROUP BY lang, x HAVING count(*) >= {min_count}),
    k AS (SELECT f2.lang, f2.x AS phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = split_part(f2.x, ' ', 1) JOIN f1 r ON r.lang = f2.lang AND r.x = split_part(f2.x, ' ', 2)
        UNION ALL SELECT f3.lang, f3.x, f3.f, 1, l.f, r.f FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.x = x1 JOIN f2 r ON r.lang = f3.lang AND r.x = x2 || ' ' || x3
        UNION ALL SELECT f3.lang, f3.x, f3.f, 2, l.f, r.f FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = x1 || ' ' || x2 JOIN f1 r ON r.lang = f3.lang AND r.x = x3),
    s AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM k),
    c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    d AS (SELECT DISTINCT f2.lang, f2.x FROM f2 JOIN (SELECT lang, x1 || ' ' || x2 AS x, f FROM f3 UNION ALL SELECT lang, x2 || ' ' || x3, f FROM f3) t ON t.lang = f2.lang AND t.x = f2.x WHERE 100 * t.f >= {share} * f2.f)
    SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
    FROM c JOIN n ON n.lang = c.lang LEFT JOIN d ON d.lang = c.lang AND d.x = c.phrase WHERE d.x IS NULL QUALIFY rank <= {top}"""

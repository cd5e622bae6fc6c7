"""Language identification with interpolated Kneser-Ney character models.

One model per language over 4-character n-grams of lower-cased letters; everything else is a word
boundary and contexts do not reach over one. Counts, continuation counts, discounts and the
probabilities of all n-grams that occur anywhere are Spark aggregates and joins over all rows. The
table of probabilities is cut by hash into parts of bounded size; each part goes to the tasks as a
sorted hash array, and a text's sums over the parts are whole numbers, so neither the number of
parts nor of tasks changes a result. A text gets the language of lowest cross-entropy per character.
A softmax temperature and, per language, the usual cross-entropy are calibrated on the training
rows: the first gives the score, the second rejects texts that look like none of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.llm.words import Slice, arrow_rows, mix, slices
from embedmap.session import store

ORDER = 4
NONE = "und"
PART_VALUES = 1 << 24  # n-grams times languages that one part of the models holds: 64 MB, and 8 bytes for each n-gram
SCALE = 1 << 20  # logarithms are whole numbers of this part of a nat
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 6.0  # of the spreads of training rows, and spreads beyond it
LEAST_SPREAD = 0.5  # nats times root characters; a few equal training texts must not reject all others
_U = np.uint64
_GAP = 32
_HELD = 1 << 18  # n-grams a task gathers before it passes partial counts on
_HASHES = 1 << 32  # part of an n-gram by 32 bits of its hash


def _symbol(c: int) -> int:
    """16 bits for a letter, lower-cased; the gap for anything else."""
    ch = chr(c)
    if not ch.isalpha():
        return _GAP
    low = ch.lower()
    low = ord(low) if len(low) == 1 else c
    return low if low < 0x10000 else 0xE000 + low % 6400  # the private use area holds no letters


class _Symbols:
    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([_symbol(c) for c in range(0x10000)], np.uint16)
        out = cls.table[np.minimum(points, 0xFFFF)]
        wide = np.flatnonzero(points > 0xFFFF)
        if len(wide):
            found, at = np.unique(points[wide], return_inverse=True)
            out[wide] = np.array([_symbol(int(c)) for c in found], np.uint16)[at]
        return out


def ngrams(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all texts, and where each text's begin (and the end).

    A text's stream is its words, each closed by one gap.
    """
    points = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))
    bounds = lead[part.bounds]
    sym = np.insert(_Symbols.of(points), bounds[1:], _GAP)
    bounds = bounds + np.arange(len(bounds))
    s0 = sym.astype(_U)
    keep = np.concatenate(([sym[0] != _GAP], (sym[1:] != _GAP) | (sym[:-1] != _GAP)))
    bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
    s0 = s0[keep]
    packed, before, gap = s0.copy(), s0, _U(_GAP)
    for n in range(1, ORDER):
        shifted = np.concatenate((np.full(min(n, len(s0)), gap), s0[: max(len(s0) - n, 0)]))
        before = shifted if n == 1 else np.where(before == gap, gap, shifted)
        packed |= before << _U(16 * n)
    return packed, bounds


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def count_ngrams(training: DataFrame) -> DataFrame:
    """(lang, gram, c) over all rows of (lang, text); a null lang is a group like the others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str | None, list[np.ndarray]] = {}
        counted: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def settle() -> None:
            nonlocal size
            for lang, parts in waiting.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                old = counted.get(lang)
                counted[lang] = _merged([old[0], keys], [old[1], counts]) if old else (keys, counts)
            waiting.clear()
            size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in counted.items():
                yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "c"])
            counted.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for part in slices(batch.column(1)):
                grams, bounds = ngrams(part)
                own = langs[part.lo : part.hi]
                for lang in set(own):
                    mine = grams[np.repeat(own == lang, np.diff(bounds))]
                    waiting.setdefault(lang, []).append(mine)
                size += len(grams)
                if size > 4 * _HELD:
                    settle()
                    if sum(len(k) for k, _ in counted.values()) > 4 * _HELD:
                        yield from out()
        settle()
        yield from out()

    counts = arrow_rows(training.select("lang", "text"), rows, "lang string, gram long, c long")
    return counts.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _suffix(gram: Column, n: int) -> Column:
    """The last ``n`` symbols."""
    return gram.bitwiseAND(F.lit(2 ** (16 * n) - 1)) if n else F.lit(0).cast("long")


def _context(gram: Column) -> Column:
    """All but the last symbol."""
    return F.shiftrightunsigned(gram, 16)


def _levels(counts: DataFrame, langs: list[str]) -> dict[int, DataFrame]:
    """By order: (gram, s0.., c0..), occurrences and Kneser-Ney counts by language; null where a language lacks it.

    Shorter n-grams count their distinct left neighbours. Those at a word's start have one only,
    the gap, so their occurrences count.
    """
    span = range(len(langs))
    whole = counts.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("c"))).alias(f"s{i}") for i, lang in enumerate(langs)])
    levels = {ORDER: store(whole.select("gram", *[f"s{i}" for i in span], *[F.col(f"s{i}").alias(f"c{i}") for i in span]), f"order-{ORDER}")}
    for n in range(ORDER - 1, 0, -1):
        gram = F.col("gram")
        starts = F.shiftrightunsigned(gram, 16 * (n - 1)) == _GAP if n > 1 else F.lit(False)
        sums = [F.sum(f"s{i}").alias(f"s{i}") for i in span] + [F.count(f"s{i}").alias(f"k{i}") for i in span]
        shorter = levels[n + 1].groupBy(_suffix(gram, n).alias("gram")).agg(*sums)
        kept = [F.when(starts | F.col(f"s{i}").isNull(), F.col(f"s{i}")).otherwise(F.col(f"k{i}")).alias(f"c{i}") for i in span]
        levels[n] = store(shorter.select("gram", *[f"s{i}" for i in span], *kept), f"order-{n}")
    return levels


def _discounts(level: DataFrame, k: int) -> list[float]:
    """Absolute discount of each language from its n-grams of counts 1 and 2, all of them."""
    ones = [F.count_if(F.col(f"c{i}") == c).alias(f"n{c}_{i}") for i in range(k) for c in (1, 2)]
    got = level.agg(*ones).first()
    share = [(got[f"n1_{i}"], got[f"n2_{i}"]) for i in range(k)]
    return [min(max(one / (one + 2 * two) if one else 0.5, 0.1), 0.95) for one, two in share]


@dataclass
class Models:
    """Languages, and (gram, h, l0..): scaled logarithms of every n-gram of the documents under each of them."""

    langs: list[str]
    table: DataFrame
    grams: int


def fit(docs: DataFrame) -> Models | None:
    """Models learnt from all rows of (lang, text) with both set, for the n-grams of all rows. None if nothing is learnt.

    Rows without a language teach nothing; their n-grams only get probabilities. Every n-gram of
    every language stays. What is collected are labels and two counts per language and order.
    """
    counts = store(count_ngrams(docs.filter("text IS NOT NULL")), "ngrams")
    langs = sorted(r.lang for r in counts.filter("lang IS NOT NULL").select("lang").distinct().collect())
    if not langs:
        return None
    k, gram = len(langs), F.col("gram")
    levels = _levels(counts, langs)
    learnt = reduce(lambda a, b: a | b, [F.col(f"c{i}").isNotNull() for i in range(k)])
    alphabet = 1 + levels[1].filter(learnt).count()
    lower = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("_suffix"), *[F.lit(1.0 / alphabet).alias(f"q{i}") for i in range(k)])
    for n in range(1, ORDER + 1):
        d = _discounts(levels[n], k)
        totals = [F.sum(f"c{i}").alias(f"t{i}") for i in range(k)] + [F.count(f"c{i}").alias(f"k{i}") for i in range(k)]
        contexts = levels[n].groupBy(_context(gram).alias("_context")).agg(*totals)
        own = levels[n].select("gram", _context(gram).alias("_context"), _suffix(gram, n - 1).alias("_suffix"), *[f"c{i}" for i in range(k)])
        met = own.join(contexts, "_context").join(lower, "_suffix")
        parts = [(F.col(f"c{i}"), F.col(f"t{i}"), F.col(f"k{i}"), F.col(f"q{i}")) for i in range(k)]
        mixed = [F.when(t.isNull(), q).otherwise(F.coalesce(c - d[i], F.lit(0.0)) / t + d[i] * kinds / t * q) for i, (c, t, kinds, q) in enumerate(parts)]
        if n < ORDER:
            lower = store(met.select(gram.alias("_suffix"), *[p.alias(f"q{i}") for i, p in enumerate(mixed)]), f"probabilities-{n}")
    logs = [F.round(F.log(p) * SCALE).cast("int").alias(f"l{i}") for i, p in enumerate(mixed)]
    table = store(met.select("gram", F.pmod(F.xxhash64("gram"), F.lit(_HASHES)).alias("h"), *logs).sortWithinPartitions("h"), "models")
    return Models(langs, table, table.count())


def _part(models: Models, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hash array of one part, and its rows of logarithms."""
    inside = (F.col("h") >= part * _HASHES // parts) & (F.col("h") < (part + 1) * _HASHES // parts)
    got = models.table.filter(inside).drop("h").toArrow()
    hashed = mix(got.column("gram").to_numpy().view(_U))
    order = np.argsort(hashed)
    logs = [got.column(f"l{i}").to_numpy().astype(np.int32) for i in range(len(models.langs))]
    return hashed[order], np.stack(logs, axis=1)[order]


_OUT = "row long, doc_id long, held_out boolean, lang string, size long, sums array<long>"


def _sums(docs: DataFrame, models: Models, part: int, parts: int) -> DataFrame:
    """(row, doc_id, held_out, lang, size, sums): characters, and sums of logarithms of the part's n-grams by language."""
    shared, k = docs.sparkSession.sparkContext.broadcast(_part(models, part, parts)), len(models.langs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, logs = shared.value
        for batch in batches:
            for piece in slices(batch.column("text")):
                grams, bounds = ngrams(piece)
                size = np.diff(bounds)
                sums = np.zeros((len(size), k), np.int64)
                full = np.flatnonzero(size)
                if len(full) and len(hashed):
                    wanted = mix(grams)
                    at = np.minimum(np.searchsorted(hashed, wanted), len(hashed) - 1)
                    found = logs[at]
                    if parts > 1:
                        found = np.where((hashed[at] == wanted)[:, None], found, 0)
                    sums[full] = np.add.reduceat(found, bounds[full], axis=0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * k), pa.array(sums.ravel()))
                own = batch.slice(piece.lo, piece.hi - piece.lo)
                kept = [own.column(name) for name in ("row", "doc_id", "held_out", "lang")]
                yield pa.record_batch([*kept, pa.array(size, pa.int64()), lists], names=["row", "doc_id", "held_out", "lang", "size", "sums"])

    return arrow_rows(docs.select("row", "doc_id", "held_out", "lang", "text"), rows, _OUT)


def cross_entropies(docs: DataFrame, models: Models, part_values: int = PART_VALUES) -> DataFrame:
    """(doc_id, held_out, lang, size, xent): characters scored and nats a character by language.

    One pass over the texts for each part of the models; with several parts rows are numbered in a
    stored table first, and the passes' sums are added up.
    """
    k = len(models.langs)
    parts = max(1, -(-models.grams * k // part_values))
    if parts == 1:
        summed = _sums(docs.withColumn("row", F.lit(0).cast("long")), models, 0, 1)
    else:
        numbered = store(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        passes = [store(_sums(numbered, models, part, parts), f"part-{part}") for part in range(parts)]
        added = F.array(*[F.sum(F.col("sums")[i]) for i in range(k)]).alias("sums")
        first = [F.first(name).alias(name) for name in ("doc_id", "held_out", "lang", "size")]
        summed = reduce(DataFrame.unionByName, passes).groupBy("row").agg(*first, added)
    per = F.lit(float(SCALE)) * F.greatest("size", F.lit(1))
    return summed.select("doc_id", "held_out", "lang", "size", F.transform("sums", lambda x: -x / per).alias("xent"))


def _posterior(xent: Column, size: Column, temperature: float) -> Column:
    """Softmax weight of the best language."""
    heat = F.sqrt(size.cast("double")) * temperature
    total = F.aggregate(xent, F.lit(0.0), lambda s, x: s + F.exp((F.array_min(xent) - x) * heat))
    return 1.0 / total


def identify(docs: DataFrame, training: Column | None = None, part_values: int = PART_VALUES, reject_margin: float = REJECT_MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row of (doc_id, text, lang).

    The models learn from ``text`` and ``lang`` of rows where ``training`` holds and ``lang`` is set; by
    default rows whose crc32(doc_id as text) mod 5 is not 0, the others being held out (a null
    doc_id is neither). A prediction sees the text only. Texts that are null or hold no letter get
    ``und`` with score 0, as do all texts if there is nothing to learn from. Ties go to the
    language that sorts first. ``accepted`` is false for ``und`` and for texts whose cross-entropy lies
    more spreads above the usual one of their language than nearly all training rows of that language, and
    of that language and length (by powers of two), do, and ``reject_margin`` beyond that.
    ``part_values`` bounds what one pass over the texts carries and changes no result. Repeated rows stay rows; other
    columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    learn = F.col("doc_id").isNotNull() & ~F.col("held_out") if training is None else training
    model = fit(docs.select(F.when(learn, F.col("lang")).alias("lang"), "text"))
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    scored = store(cross_entropies(docs, model, part_values), "cross-entropies")
    langs = F.array(*[F.lit(x) for x in model.langs])
    xent, size = F.col("xent"), F.col("size")
    best = F.array_min("xent")
    pred = F.element_at(langs, F.array_position("xent", best).cast("int"))

    # calibration over all training rows: one aggregate
    grid = [0.25 * 2 ** (i / 2) for i in range(14)]
    true = F.element_at(xent, F.array_position(langs, F.col("lang")).cast("int"))
    loss = [F.avg(F.log(1.0 / _posterior(xent, size, t)) + (true - best) * F.sqrt(size.cast("double")) * t).alias(f"t{i}") for i, t in enumerate(grid)]
    learnt = scored.filter(learn & F.col("lang").isNotNull() & (size > 0)) if training is None else scored.filter("lang IS NOT NULL AND size > 0")
    losses = learnt.agg(*loss).first()
    heat = min(grid, key=lambda t: losses[f"t{grid.index(t)}"] if losses[f"t{grid.index(t)}"] is not None else 0.0)
    weight = F.least(size, F.lit(400)).cast("double")
    usual = learnt.groupBy("lang").agg(F.avg(true).alias("mu"), F.avg(true * true * weight).alias("a"), F.avg(true * weight).alias("b"), F.avg(weight).alias("w")).collect()
    level = {r.lang: (r.mu, max(r.a - 2 * r.mu * r.b + r.mu**2 * r.w, LEAST_SPREAD**2) ** 0.5) for r in usual}
    at = lambda i: F.element_at(F.array(*[F.lit(level.get(x, (0.0, 1e9))[i]) for x in model.langs]), F.array_position("xent", best).cast("int"))
    z = (best - at(0)) * F.sqrt(weight) / at(1)
    some = size > 0

    # one aggregate over the training rows that are recognised: by language and length, and by language
    band = F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")
    spans = learnt.filter(pred == F.col("lang")).select("lang", band.alias("band"), z.alias("z")).rollup("lang", "band")
    high = spans.agg(F.percentile_approx("z", REJECT_QUANTILE, 10000).alias("q")).filter("lang IS NOT NULL").collect()
    overall = {r.lang: r.q for r in high if r.band is None}
    limits = {(r.lang, r.band): max(r.q, overall[r.lang]) for r in high if r.band is not None}
    per = F.lit(None).cast("double")
    for lang in model.langs:
        own = F.lit(overall.get(lang, 1e9))
        for (other, b), q in limits.items():
            own = F.when(band == b, q).otherwise(own) if other == lang else own
        per = F.when(pred == lang, own).otherwise(per)
    return scored.select(
        "doc_id",
        "held_out",
        F.when(some, pred).otherwise(NONE).alias("lang_pred"),
        F.when(some, _posterior(xent, size, heat)).otherwise(0.0).alias("score"),
        F.coalesce(some & (z <= per + reject_margin), F.lit(False)).alias("accepted"),
        F.when(some, best).alias("cross_entropy"),
        F.when(some, z).alias("spreads"),
    )

"""Silhouette by cell summaries (EVAL1): distance sums to far cells from their moments, near cells exactly.

The map is cut into cells that halve with each level. Pairs of cells of one level are refined until the cell
of the sources is small against its distance, or they hold few pairs of places. Far cells of many places count by the
number, the first and the second moments of each cluster in them (the expansion of a distance up to second order), others
by every distance, which numpy has sooner than Spark has the moments of few places. A cell meets a bounded number of
cells per level, so the work grows with the places and the levels and not with their square. Where many places are
compared, the cells below two ancestors are compared in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.operators.cluster import map_axes
from embedmap.operators.evaluate import distance_sums
from embedmap.operators.project import frame_bounds
from embedmap.session import store

LEAF = 1024  # two cells with fewer pairs of places than its square are compared place by place
LIST = 8  # times LEAF: places in one list at most
FAMILY_WORK = 2**26  # compared places of a level from which cells go together with those of their ancestor
FAMILY = 6  # halvings, of all axes together, from an ancestor to the cells that go with it
SALTS = 8
LEVELS = 40  # places closer than the extent of the map / 2^40 are one place


def far_ratio(tolerance: float) -> float:
    """Largest radius to distance at which a score is off by less than ``tolerance``.

    The expansion leaves out less than 0.2 r^3 / (1 - r)^2 of a distance, r being that ratio. A score
    holds two mean distances, so it is off by no more than twice that share.
    """
    lo, hi = 0.0, 0.9
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.4 * mid**3 / (1 - mid) ** 2 <= tolerance else (lo, mid)
    return lo


def _near_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(spot, other, total) of pairs of place lists: numpy distances, summed per cluster of the right side."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                field = lambda name: b.column(name)[i].values  # noqa: B023, E731
                spots, c, n = field("left"), field("right").to_numpy(), field("n").to_numpy()
                order = np.argsort(c, kind="stable")
                c, n = c[order], n[order]
                first = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
                left, right = [field(f"l{k}").to_numpy() for k in keys], [field(f"r{k}").to_numpy()[order] for k in keys]
                step = max(1, 2**20 // len(c))
                for s in range(0, len(spots), step):
                    d = np.sqrt(sum((x[s : s + step, None] - y) ** 2 for x, y in zip(left, right, strict=True)))
                    sums = np.add.reduceat(d * n, first, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            spots.slice(s, len(d)).take(pa.array(np.repeat(np.arange(len(d)), len(first)))),
                            pa.array(np.tile(c[first], len(d)).astype(np.int32)),
                            pa.array(sums.ravel()),
                        ],
                        names=["spot", "other", "total"],
                    )

    return pairs.mapInArrow(run, "spot long, other int, total double")


def _families(near: DataFrame, spots: DataFrame, entries: DataFrame, level: int, t: list[str], s: list[str], keys: list[str]) -> DataFrame:
    """(met, left, right): pairs of cells (t, s) of one level by the pair of their ancestors, with the places and entries below these.

    A place is sent once to an ancestor and leaves with one sum per cluster. Where there is but one ancestor its places
    are dealt to ``SALTS`` tasks.
    """
    up = FAMILY // len(keys)
    salts = SALTS if level <= up else 1
    unit = lambda k: (F.col(k) + 0.5) / 2**LEVELS
    above = lambda names, cells: [F.shiftright(c, up).alias(f"a{n}") for n, c in zip(names, cells, strict=True)]
    # the place of a cell in its ancestor, as one number
    child = lambda cells: sum(((F.col(c) if isinstance(c, str) else c).bitwiseAND(2**up - 1) * 2 ** (up * i) for i, c in enumerate(cells)), F.lit(0)).cast("int")
    at, at_s = [f"a{n}" for n in t], [f"a{n}" for n in s]
    salt = F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt")
    met = near.groupBy(*above(t, t), *above(s, s)).agg(F.collect_list(F.struct(child(t).alias("t"), child(s).alias("s"))).alias("met"))
    met = store(met.select("*", salt).withColumn("pair", F.xxhash64(*at, *at_s, "salt")), "ancestor-pairs")
    own = [F.shiftright(k, LEVELS - level) for k in keys]
    left = spots.select(*above(t, own), F.pmod(F.xxhash64("spot"), F.lit(salts)).cast("int").alias("salt"), child(own).alias("t"), "spot", *[unit(k).alias(f"l{k}") for k in keys])
    left = left.groupBy(*at, "salt").agg(F.collect_list(F.struct("t", "spot", *[f"l{k}" for k in keys])).alias("left"))
    right = entries.select(*above(s, own), child(own).alias("s"), "c", "n", *[unit(k).alias(f"r{k}") for k in keys])
    right = right.groupBy(*at_s).agg(F.collect_list(F.struct("s", "c", "n", *[f"r{k}" for k in keys])).alias("right"))
    sent = met.select("pair", *at, "salt", "met").join(left, [*at, "salt"]).select("pair", "met", "left")
    return sent.join(met.select("pair", *at_s).join(right, at_s).select("pair", "right").hint("shuffle_hash"), "pair").select("met", "left", "right")


def _family_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(spot, other, total) of families of cells: every distance between cells that meet, summed per cluster of the right side."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                field = lambda side, name: b.column(side)[i].values.field(name).to_numpy()  # noqa: B023, E731
                order = np.lexsort((field("right", "c"), field("right", "s")))
                at_right, c, n, rv = (field("right", "s")[order], field("right", "c")[order], field("right", "n")[order].astype(float), [field("right", f"r{k}")[order] for k in keys])
                by_cell = np.argsort(field("left", "t"), kind="stable")
                at_left, spots, lv = field("left", "t")[by_cell], field("left", "spot")[by_cell], [field("left", f"l{k}")[by_cell] for k in keys]
                mt, ms = field("met", "t"), field("met", "s")
                for cell, lo, hi in zip(*(x.tolist() for x in _groups(at_left)), strict=True):
                    seen = np.flatnonzero(np.isin(at_right, ms[mt == cell]))
                    if not len(seen):
                        continue
                    seen = seen[np.argsort(c[seen], kind="stable")]
                    labels, first, _ = _groups(c[seen])
                    rows = [x[seen] for x in rv]
                    step = max(64, min(8192, 2**22 // len(labels)))
                    for j in range(lo, hi, step):
                        some = slice(j, min(j + step, hi))
                        sums = distance_sums([x[some] for x in lv], rows, n[seen], first)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(spots[some], len(labels))), pa.array(np.tile(labels, len(sums)).astype(np.int32)), pa.array(sums.ravel())],
                            names=["spot", "other", "total"],
                        )

    return pairs.mapInArrow(run, "spot long, other int, total double")


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each of the sorted values, where it begins and where it ends."""
    first = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1)) if len(values) else np.empty(0, np.int64)
    return values[first], first, np.append(first[1:], len(values))[: len(first)]


def silhouette_far(points: DataFrame, cluster: str = "cluster", tolerance: float = 1e-3, leaf: int = LEAF) -> DataFrame:
    """One row (silhouette, scored) as ``silhouette`` gives for all rows, off by at most ``tolerance``.

    Rows without a place or cluster are not scored. Copies of a place are folded first. With one
    cluster the score is null.
    """
    axes = map_axes(points)
    rows = points.select(F.col(cluster).cast("int").alias("c"), *[F.col(a).cast("double").alias(a) for a in axes]).dropna()
    bounds = frame_bounds(rows, axes)
    if bounds[f"{axes[0]}_min"] is None:
        return rows.agg(F.lit(None).cast("double").alias("silhouette"), F.count("*").alias("scored"))
    span = max(bounds[f"{a}_max"] - bounds[f"{a}_min"] for a in axes) or 1.0
    top = 2**LEVELS
    keys = [f"k{i}" for i in range(len(axes))]
    at = {k: F.least(F.floor((F.col(a) - bounds[f"{a}_min"]) / span * top), F.lit(top - 1)).cast("long") for k, a in zip(keys, axes, strict=True)}
    # the entries of a place, one per cluster, and the places; coordinates as shares of the extent
    entries = store(rows.select("c", *[v.alias(k) for k, v in at.items()]).groupBy("c", *keys).agg(F.count("*").alias("n")), "entries")
    spots = store(entries.select(*keys).distinct().withColumn("spot", F.monotonically_increasing_id()), "spots")
    unit = lambda k: (F.col(k) + 0.5) / top
    ratio = far_ratio(tolerance)

    def cell(level: int, names: list[str] = keys) -> list[Column]:
        return [F.shiftright(k, LEVELS - level).alias(n) for k, n in zip(keys, names, strict=True)]

    t, s = [f"t{i}" for i in range(len(axes))], [f"s{i}" for i in range(len(axes))]
    frontier = entries.sparkSession.createDataFrame([tuple([0] * 2 * len(axes))], ", ".join(f"{n} long" for n in t + s))
    sums = []
    for level in range(LEVELS + 1):
        sizes = store(spots.groupBy(*cell(level)).agg(F.count("*").alias("m")), "cells")
        # a cell of the target and the centre of the source, in cells of this level
        gaps = [F.when(F.col(a) == F.col(b), 0.0).otherwise(F.abs(F.col(a) - F.col(b)) - 0.5) for a, b in zip(t, s, strict=True)]
        far = F.sqrt(sum((g * g for g in gaps), F.lit(0.0))) * ratio >= len(axes) ** 0.5 / 2
        side = lambda names, m: sizes.withColumnsRenamed({**dict(zip(keys, names, strict=True)), "m": m})  # noqa: B023, E731
        met = frontier.join(side(t, "tm"), t).join(side(s, "sm"), s)
        listed = (F.col("tm") <= LIST * leaf) & (F.col("sm") <= LIST * leaf)
        few = listed & (F.col("tm") * F.col("sm") <= leaf * leaf) | F.lit(level == LEVELS)
        kind = F.when(few, "near").when(far, "far").otherwise("split")
        met = store(met.select(*t, *s, kind.alias("kind"), (F.col("tm").cast("double") * F.col("sm")).alias("work")), "cell-pairs")
        counts = {r["kind"]: r for r in met.groupBy("kind").agg(F.sum("work").alias("work")).collect()}
        h = 1.0 / 2**level
        if "far" in counts:
            off = [unit(k) - (F.shiftright(k, LEVELS - level) + 0.5) * h for k in keys]
            moments = {"w": F.col("n"), **{f"u{i}": F.col("n") * o for i, o in enumerate(off)}}
            moments |= {f"m{i}{j}": F.col("n") * off[i] * off[j] for i in range(len(axes)) for j in range(i, len(axes))}
            summary = entries.select("c", *cell(level, s), *[v.alias(k) for k, v in moments.items()]).groupBy("c", *s).agg(*[F.sum(k).alias(k) for k in moments])
            seen = spots.select("spot", *[unit(k).alias(f"p{i}") for i, k in enumerate(keys)], *cell(level, t))
            # the cells meet first, so that rows of places leave the last join as sums
            each = seen.join(store(met.filter("kind = 'far'").select(*t, *s).join(summary, s), "far-moments"), t)
            gap = [F.col(f"p{i}") - (F.col(s[i]) + 0.5) * h for i in range(len(axes))]
            d = F.sqrt(sum((g * g for g in gap), F.lit(0.0)))
            along = sum((g * F.col(f"u{i}") for i, g in enumerate(gap)), F.lit(0.0)) / d
            second = sum(((2.0 if i < j else 1.0) * gap[i] * gap[j] * F.col(f"m{i}{j}") for i in range(len(axes)) for j in range(i, len(axes))), F.lit(0.0)) / (d * d)
            spread = sum((F.col(f"m{i}{i}") for i in range(len(axes))), F.lit(0.0))
            total = F.col("w") * d - along + (spread - second) / (2 * d)
            sums.append(store(each.select("spot", F.col("c").alias("other"), total.alias("total")).groupBy("spot", "other").agg(F.sum("total").alias("total")), "far-sums"))
        if "near" in counts:
            near = met.filter("kind = 'near'").drop("work")
            if counts["near"]["work"] >= FAMILY_WORK:
                found = _family_sums(_families(near, spots, entries, level, t, s, keys), keys)
            else:
                # bounded lists of the places of a cell, or one place of the last level
                lists = lambda df, names, fields: df.join(near.select(*names).distinct(), names, "left_semi").groupBy(*names).agg(F.collect_list(F.struct(*fields)).alias("e")).select(*names, *[F.col("e")[f].alias(f) for f in fields])  # noqa: B023, E731
                left = lists(spots.select(F.col("spot").alias("left"), *[unit(k).alias(f"l{k}") for k in keys], *cell(level, t)), t, ["left", *[f"l{k}" for k in keys]])
                right = lists(entries.select(F.col("c").alias("right"), "n", *[unit(k).alias(f"r{k}") for k in keys], *cell(level, s)), s, ["right", "n", *[f"r{k}" for k in keys]])
                found = _near_sums(near.join(left, t).join(right, s).drop("kind", *t, *s), keys)
            sums.append(store(found.groupBy("spot", "other").agg(F.sum("total").alias("total")), "near-sums"))
        if "split" not in counts:
            break
        deeper = lambda names: [(2 * F.col(n) + F.col(f"_{n}")).alias(n) for n in names]
        frontier = met.filter("kind = 'split'").select(*t, *s)
        for n in t + s:
            frontier = frontier.withColumn(f"_{n}", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
        # children without a row fall out where the sizes are joined
        frontier = frontier.select(*deeper(t), *deeper(s))

    totals = reduce(DataFrame.unionByName, sums).groupBy("spot", "other").agg(F.sum("total").alias("total"))
    held = rows.groupBy(F.col("c").alias("other")).agg(F.count("*").alias("k"))
    held = store(held, "cluster-sizes")
    own = entries.join(spots, keys).select("spot", "c", F.col("n").alias("copies"))
    mine = F.col("c") == F.col("other")
    per = totals.join(held, "other").join(own, "spot").groupBy("spot", "c", "copies").agg(
        F.max(F.when(mine, F.col("k"))).alias("own_n"),
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("k") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("k"))).alias("b"),
    )
    score = F.when(F.col("own_n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    mean = F.sum(score * F.col("copies")) / F.sum("copies")
    alone = F.count_if(F.col("b").isNull()) > 0
    return per.agg(F.when(alone, F.lit(None)).otherwise(F.round(mean, 4)).alias("silhouette"), F.sum("copies").alias("scored"))

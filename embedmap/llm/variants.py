"""Spelling variants: dense tiles of padded code points, compared by common prefix and suffix.

Two words are near if their common prefix and suffix together reach the longer length less one: one
code point is inserted, deleted or replaced. Of lengths X and X - 1 such a pair keeps M = X - 1 code
points, i before the edit and M - i after it. The places i are cut into a few bands; a pair whose
edit lies in band lo..hi shares its first lo and its last M - hi code points, which are the key of a
group. Groups are cut into blocks of bounded size, each two blocks of a group make a tile, and a tile
compares what lies between the shared ends as padded matrices, many small groups at a time. A pair
with several readings of its edit counts in the band of the first.

Only sums and each word's best partner leave a tile, never its pairs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.llm.words import Slice, arrow_rows, slices
from embedmap.session import store

BANDS = 3  # more bands mean more keys a word and smaller groups
BLOCK = 512  # words of a block
TEXT_SLICE = 1 << 20
TASK_WORDS = 300_000  # counts a task holds before it hands them on
CELLS = 1 << 22  # of a tile's matrices at a time

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _in_run(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and the code points 192 to 255, which UTF-8 writes as byte 195 and another."""
    lead = data == 0xC3
    run = _LETTER[data] | lead
    run[1:] |= lead[:-1]
    return run


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def _crc32(part: Slice, begun: np.ndarray) -> np.ndarray:
    """crc32 of each run, lower-cased in A-Z, put behind what already has the crc ``begun``."""
    size = part.end - part.start
    order = np.argsort(-size, kind="stable")
    start, state = part.start[order], ~begun[order].astype(np.uint32)
    longer = np.searchsorted(-size[order], -np.arange(int(size.max()) if len(size) else 0), "left")  # runs of more than j bytes
    for j, k in enumerate(longer.tolist()):
        byte = part.data[start[:k] + j]
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint32)
        state[:k] = _CRC[(state[:k] ^ byte) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def run_counts(docs: DataFrame, cut_every: int | None = None, min_length: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each run of letters A-Z, a-z and U+00C0 to U+00FF occurs, lower-cased in A-Z.

    With ``cut_every``, typing errors are put in: let h be the crc32 of ``<id>:<run>``; where the number
    divides h, the run loses its code point h % length. Results of fewer than ``min_length`` code points
    are not counted. Null texts hold no run, a null id is written as an empty string; repeated rows count
    as often as they occur. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)

        def told() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in slices(batch.column(1), TEXT_SLICE, _in_run):
                more = np.concatenate(([0], np.cumsum((part.data & 0xC0) == 0x80)))
                points = part.end - part.start - (more[part.end] - more[part.start])
                whole = points >= min_length
                if cut_every is not None:
                    begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[part.lo : part.hi]], np.uint32)
                    h = _crc32(part, np.repeat(begun, np.diff(part.first)))
                    cut = h % np.uint32(cut_every) == 0
                    whole &= ~cut
                    for i in np.flatnonzero(cut & (points > min_length)).tolist():
                        word, at = part.data[part.start[i] : part.end[i]].tobytes().lower().decode(), int(h[i]) % int(points[i])
                        counts[word[:at] + word[at + 1 :]] += 1
                at = np.flatnonzero(whole)
                _, first, n = np.unique(part.hashes(lower=True)[at], return_index=True, return_counts=True)
                for word, c in zip(part.strings(at[first]).to_pylist(), n.tolist(), strict=True):
                    counts[word] += c
                if len(counts) > TASK_WORDS:
                    yield told()
        if counts:
            yield told()

    found = arrow_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(words: DataFrame, bands: int, block: int) -> DataFrame:
    """(size, lo, hi, key, blocks, part, words, counts): the groups' blocks, words by falling count."""
    size = F.length("word")
    long = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("size"))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(
        F.floor(b * F.col("size") / bands).cast("int").alias("lo"), (F.floor((b + 1) * F.col("size") / bands) - 1).cast("int").alias("hi")
    ))).alias("b")
    keyed = long.select("word", "n", "size", band).select("word", "n", "size", "b.lo", "b.hi").filter("lo <= hi")
    # the two ends have fixed lengths in a band, so one string tells them apart
    key = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.substring("word", size - (F.col("size") - 1 - F.col("hi")) + 1, F.col("size") - 1 - F.col("hi")))
    group = ["size", "lo", "hi", "key"]
    keyed = keyed.select(*group[:3], key.alias("key"), "word", "n")
    # a group of short words only has no pair of its own
    sizes = keyed.groupBy(*group).agg(F.count("*").alias("all"), F.count_if(F.length("word") == F.col("size")).alias("long"))
    sizes = sizes.filter("all > 1 AND long > 0").select(*group, F.ceil(F.col("all") / block).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("part")
    # at most a few times ``block`` words meet in one row
    members = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))).alias("ws")
    out = keyed.join(sizes, group).groupBy(*group, "blocks", part).agg(members)
    return out.select(*group, "blocks", "part", F.col("ws.word").alias("words"), F.transform("ws", lambda w: -w["m"]).alias("counts"))


def _ends(words: list[str], size: np.ndarray, lo: np.ndarray, hi: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wide`` code points after the shared prefix, those before the shared suffix, and which words are short."""
    points = np.array(words)
    points = points.view(np.uint32).reshape(len(words), -1)
    points = np.concatenate((points, np.zeros((len(words), 1), np.uint32)), axis=1)
    length = (points != 0).sum(1)
    pad, row = points.shape[1] - 1, np.arange(len(words))[:, None]
    step = np.arange(wide)
    head = np.minimum(lo[:, None] + step, pad)
    tail = (length - (size - 1 - hi) - wide)[:, None] + step
    return points[row, head], points[row, np.where(tail < 0, pad, tail)], length < size


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading equal columns of every row of a's blocks with every row of b's."""
    alive = np.ones((a.shape[0], a.shape[1], b.shape[1]), bool)
    total = np.zeros(alive.shape, np.int32)
    for j in range(a.shape[2]):
        alive &= a[:, :, None, j] == b[:, None, :, j]
        if not alive.any():
            break
        total += alive
    return total


def _near(a: tuple, b: tuple, d: int, from_start: np.ndarray) -> np.ndarray:
    """Which words of one block are near which of the other, for tiles of one band width d."""
    (head_a, tail_a, short_a), (head_b, tail_b, short_b) = a, b
    before, after = _shared(head_a, head_b), _shared(tail_a[:, :, ::-1], tail_b[:, :, ::-1])
    short = short_a[:, :, None] | short_b[:, None, :]
    # a shared suffix that reaches beyond the band has an earlier reading, unless the band is the first
    earlier = short & (after > d) & ~from_start[:, None, None]
    return (before + after >= d) & ~earlier & ~(short_a[:, :, None] & short_b[:, None, :])


def _tile_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(word, c, m, best): per word of the tiles its near words, and the first by falling count and order."""
    size, lo, hi, same = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "lo", "hi", "same"))
    sides = []
    for words, counts in (("words", "counts"), ("others", "other_counts")):
        lists = batch.column(words)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        sides.append((n, np.cumsum(n) - n, lists.flatten().to_pylist(), batch.column(counts).flatten().to_numpy(zero_copy_only=False)))
    (na, _, _, _), (nb, _, _, _) = sides
    nb = np.where(same, na, nb)
    pad_a, pad_b = (1 << np.ceil(np.log2(np.maximum(x, 1))).astype(int) for x in (na, nb))
    shape = np.stack((hi - lo, pad_a, pad_b, same), axis=1)
    kinds, kind = np.unique(shape, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    for k, (d, s, t, alone) in enumerate(kinds.tolist()):
        tiles = np.flatnonzero(kind == k)
        step = max(1, CELLS // max(s * t, (s + t) * int(size[tiles].max())))
        for c in range(0, len(tiles), step):
            yield _tiles(tiles[c : c + step], sides[: 1 if alone else 2], d, (s, t), size, lo, hi)


def _tiles(tiles: np.ndarray, sides: list, d: int, wide: tuple[int, int], size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """The rows of tiles of one padded shape."""
    ends, valid, names, counts = [], [], [], []
    for (n, first, words, count), s in zip(sides, wide, strict=False):
        mine = n[tiles]
        at = np.repeat(first[tiles], mine) + np.arange(int(mine.sum())) - np.repeat(np.cumsum(mine) - mine, mine)
        of = np.repeat(tiles, mine)
        flat = _ends([words[i] for i in at.tolist()], size[of], lo[of], hi[of], d + 1)
        here = np.arange(s)[None, :] < mine[:, None]
        dense = []
        for x in flat:
            y = np.zeros((len(tiles), s, *x.shape[1:]), x.dtype)
            y[here] = x
            dense.append(y)
        index = np.zeros((len(tiles), s), np.int64)
        index[here] = at
        ends.append(tuple(dense))
        valid.append(here)
        names.append((words, index))
        counts.append(count)
    if len(sides) == 1:
        ends, valid, names, counts = ends * 2, valid * 2, names * 2, counts * 2
    near = _near(ends[0], ends[1], d, lo[tiles] == 0) & valid[0][:, :, None] & valid[1][:, None, :]
    if len(sides) == 1:
        near[:, np.arange(wide[0]), np.arange(wide[0])] = False
    out: tuple[list, list, list, list] = ([], [], [], [])
    for axis in ((2,) if len(sides) == 1 else (2, 1)):
        total = near.sum(axis)
        g, i = np.nonzero(total)
        best = near.argmax(axis)[g, i]
        (mine, at), (theirs, other) = (names[0], names[1]) if axis == 2 else (names[1], names[0])
        partner = other[g, best]
        out[0].extend(mine[x] for x in at[g, i].tolist())
        out[1].append(total[g, i])
        out[2].append(counts[1 if axis == 2 else 0][partner])
        out[3].extend(theirs[x] for x in partner.tolist())
    return pa.record_batch(
        [pa.array(out[0], pa.string()), pa.array(np.concatenate(out[1]), pa.int64()), pa.array(np.concatenate(out[2]), pa.int64()), pa.array(out[3], pa.string())],
        names=["word", "c", "m", "best"],
    )


def near_words(words: DataFrame, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near) of the words that have a near one: how many, and the one of largest n, ties to the smallest."""
    blocks = store(_blocks(words, bands, block), "word-blocks")
    group = ["size", "lo", "hi"]
    nothing = F.lit(None)
    alone = blocks.select(*group, F.lit(True).alias("same"), "words", "counts", nothing.cast("array<string>").alias("others"), nothing.cast("array<long>").alias("other_counts"))
    many = blocks.filter("blocks > 1")
    left = many.filter(F.col("part") < F.col("blocks") - 1).withColumn("y", F.explode(F.sequence(F.col("part") + 1, F.col("blocks") - 1)))
    right = many.select(*group, "key", F.col("part").alias("y"), F.col("words").alias("others"), F.col("counts").alias("other_counts"))
    crossed = left.join(right, [*group, "key", "y"]).select(*group, F.lit(False).alias("same"), "words", "counts", "others", "other_counts")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _tile_rows(batch)

    found = arrow_rows(alone.unionByName(crossed), rows, "word string, c long, m long, best string")
    top = F.min(F.struct((-F.col("m")).alias("m"), "best")).alias("t")
    return found.groupBy("word").agg(F.sum("c").alias("n_near"), top).select("word", "n_near", (-F.col("t.m")).alias("near_n"), F.col("t.best").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to their end by doubling; n at least doubles along a form, so chains are short."""
    links = store(forms, "forms")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = store(links.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "form-roots")
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links


def spelling_variants(counts: DataFrame, min_length: int = 5, min_count: int = 3, times: int = 2, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (word, n) long and frequent enough.

    Rows of one word are added up; null words and counts take no part, other columns are not read.
    Near words differ by exactly one inserted, deleted or replaced code point, never by none. A word's form
    is its near word of largest n, ties to the smallest in code-point order, if that n is at least
    ``times`` its own, which must be 2 or more; else null. The root is the end of its forms, the
    word itself if it has none. An empty table gives an empty one.
    """
    if times < 2:
        raise ValueError("forms would not be sure to end")
    words = counts.select("word", "n").filter((F.length("word") >= min_length) & F.col("n").isNotNull())
    words = store(words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "vocabulary")
    near = words.join(near_words(words, bands, block), "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    near = store(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "near-words")
    roots = _roots(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """The same in SQL: crc32 by its table, near words by removing or masking each code point."""
    return r"""WITH RECURSIVE t AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL
        SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
    crc AS MATERIALIZED (SELECT i, c FROM t WHERE k = 8),
    o AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    s AS MATERIALIZED (SELECT d, run, count(*) AS n, hex(encode(d || ':' || run)) AS x FROM o WHERE length(run) >= 5 GROUP BY d, run),
    h AS (SELECT d, run, x, 4294967295 AS c, 0 AS k FROM s UNION ALL
        SELECT d, run, x, xor(h.c >> 8, crc.c), k + 1 FROM h JOIN crc ON crc.i = xor(h.c & 255, CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)) WHERE 2 * k < length(x)),
    f AS (SELECT d, run, xor(c, 4294967295) AS h FROM h WHERE 2 * k = length(x)),
    w AS MATERIALIZED (SELECT CASE WHEN f.h % 97 = 0 THEN left(run, CAST(f.h % length(run) AS BIGINT)) || substr(run, CAST(f.h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(s.n) AS BIGINT) AS n
        FROM f JOIN s USING (d, run) GROUP BY 1 HAVING length(word) >= 5 AND sum(s.n) >= 3),
    p AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    e AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT a.word, b.word AS near, b.n AS m FROM p a JOIN p b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
        UNION ALL SELECT p.word, w.word, w.n FROM p JOIN w ON p.less = w.word UNION ALL SELECT w.word, p.word, p.n FROM p JOIN w ON p.less = w.word)),
    g AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, encode(near)) AS near, max(m) AS m FROM e GROUP BY word),
    v AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN g ON w.word = g.word),
    r AS (SELECT word, word AS root, form AS up, 0 AS k FROM v UNION ALL SELECT r.word, v.word, v.form, k + 1 FROM r JOIN v ON r.up = v.word)
    SELECT v.word, v.form, r.root, v.n, v.n_near, v.form_n FROM v JOIN r ON v.word = r.word AND r.up IS NULL"""

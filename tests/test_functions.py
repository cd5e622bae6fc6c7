"""Row-wise functions against hand-computed values."""


from pyspark.sql import functions as F

from embedmap.functions import scalars as S
from embedmap.functions import vectors as V


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_voxel_and_tile_constants(spark):
    points = spark.createDataFrame(
        [(-1.0, -1.0, -1.0), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.757, -0.298, 0.624)], "x double, y double, z double"
    )
    got = points.select(S.voxel_index("x", "y", "z", 32).alias("v"), S.tile_index("x", "y", 32).alias("t")).collect()
    # fixed values: cell numbers of a convention that stored maps depend on
    assert [r["v"] for r in got] == [0, 32767, 16912, 25980]
    assert all(r["v"] % 1024 == r["t"] for r in got)


def test_voxel_center_inverts(spark):
    centers = spark.range(32**3).select("id", S.voxel_center("id", 32).alias("c"))
    back = centers.filter(S.voxel_index("c.x", "c.y", "c.z", 32) != F.col("id"))
    assert back.count() == 0


def test_image_tiles_follow_the_pixels(spark):
    # 96 cells of 20 px on tiles of 400 px: 20 cells along a tile, rows from the top
    cells = [(0, (0, 4)), (19, (0, 4)), (20, (1, 4)), (96 * 95, (0, 0)), (96 * 76 + 95, (4, 0)), (96 * 75, (0, 1))]
    df = spark.createDataFrame([(c,) for c, _ in cells], "cell int")
    got = [(r.t.tx, r.t.ty) for r in df.select(S.image_tile("cell", 96, 20, 400).alias("t")).collect()]
    assert got == [t for _, t in cells]


def test_prepare_text_empties(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "t string")
    assert [r[0] for r in df.select(S.prepare_text("t", "p: ")).collect()] == ["p:  ", "p:  ", "p: a"]
    assert one(spark, v=S.prepare_text(F.lit(7)))["v"] == "7"


def test_labels_and_tokens(spark):
    got = one(
        spark,
        a=S.clean_label(F.lit('**"My\nlabel\'s" <|eot_id|> is  one two three')),
        b=S.clean_token(F.lit("####ing")),
        c=S.display_token(F.lit("▁Ġ##ing")),
        d=S.display_token(F.lit("▁")),
    )
    assert tuple(got) == ("My labels is one two", "ing", "ing", "▁")


def test_token_snippet(spark):
    text = "x" * 200 + "word" + "y" * 10
    s = one(spark, s=S.token_snippet(F.lit(text), F.lit(200), F.lit(204)))["s"]
    assert (len(s["before"]), s["match"], s["after"], s["cut_before"], s["cut_after"]) == (150, "word", "y" * 10, True, False)
    # an end beyond the text is its end; a start at the end has nothing to show
    s = one(spark, s=S.token_snippet(F.lit(text), F.lit(210), F.lit(999)))["s"]
    assert (s["match"], s["after"], s["cut_after"]) == ("y" * 4, "", False)
    for a, b in ((-1, 3), (5, 4), (214, 214), (300, 301)):
        assert one(spark, s=S.token_snippet(F.lit(text), F.lit(a), F.lit(b)))["s"] is None
    assert one(spark, s=S.token_snippet(F.lit(None).cast("string"), F.lit(0), F.lit(1)))["s"] is None


def test_repeated_words(spark):
    df = spark.createDataFrame([("a " * 101,), ("a " * 100,), ("",), (None,), ("a b " * 60,)], "t string")
    assert [r[0] for r in df.select(S.repeated_words("t", 100)).collect()] == [True, False, False, False, False]


def test_color_scales(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (20.0,), (None,)], "v double")
    assert [r[0] for r in df.select(S.color_norm("v", F.lit(0), F.lit(10))).collect()] == [0.0, 0.5, 1.0, None]
    assert one(spark, v=S.color_norm(F.lit(3.0), F.lit(3.0), F.lit(3.0)))["v"] == 0.0
    assert one(spark, v=S.symlog_scale(F.lit(0.0), F.lit(-1.0), F.lit(1.0)))["v"] == 0.5


def test_vector_functions(spark):
    v = F.array(F.lit(3.0), F.lit(4.0), F.lit(12.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    got = one(
        spark,
        unit=V.l2_normalize(v),
        cut=V.truncate_dims(v, 2),
        none=V.l2_normalize(zero),
        padded=V.l2_normalize(zero, V.EPS),
        layered=V.truncate_dims(v, 3, layer_normalize=True),
    )
    assert got["unit"] == [3 / 13, 4 / 13, 12 / 13]
    assert got["cut"] == [0.6, 0.8]
    assert got["none"] == [None, None] and got["padded"] == [0.0, 0.0]
    assert abs(sum(got["layered"])) < 1e-9 and abs(sum(x * x for x in got["layered"]) - 1) < 1e-9


def test_drop_binary_columns(spark):
    df = spark.sql("SELECT 1 AS a, X'00' AS b, named_struct('bytes', X'00', 'path', 'p') AS c, array(1) AS d")
    assert S.drop_binary_columns(df).columns == ["a", "d"]


def test_letter_counts_of_many_texts_at_once():
    import numpy as np

    from embedmap.plans.text import LETTERS, _letter_counts

    texts = ["", "Abba", "zZ\u0130i \u212a", "\u03a3\u03a3 \u00e9a", "\U0001d400b", "x" * 1000]
    got = _letter_counts()(texts)
    assert got.dtype == np.float32 and got.tolist() == [[t.lower().count(c) for c in LETTERS] for t in texts]

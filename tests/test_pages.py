import math
import shutil

import pytest
from pyspark.sql import functions as F

from embedmap.operators import pages as PG
from embedmap.streaming import batches as BT


def _rows(spark, n, hot=False):
    v = F.lit(5) if hot else (F.col("id") * 7919) % 1009
    return spark.range(n).select(F.col("id").alias("ls_index"), F.when(F.col("id") % 13 != 0, v).alias("v"))


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("per_page", [7, 100, 450])
def test_every_page(spark, tmp_path, hot, per_page):
    rows = _rows(spark, 1003, hot)
    order = [F.col("v").desc_nulls_last(), "ls_index"]
    pages = PG.build_pages(rows, order, str(tmp_path / "p"), range_rows=100)
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    last = math.ceil(1003 / per_page)
    assert PG.count_pages(spark, pages, per_page).first().asDict() == {"total": 1003, "total_pages": last}
    for number in {0, 1, last // 2, last - 1, last, last + 5}:
        got = [tuple(r) for r in PG.read_page(spark, pages, number, per_page).collect()]
        assert got == want[number * per_page : (number + 1) * per_page]


def test_deep_page_reads_one_range(spark, tmp_path):
    pages = PG.build_pages(_rows(spark, 2000, hot=True), ["v", "ls_index"], str(tmp_path / "p"), range_rows=100)
    sizes = [r.n for r in PG.directory(spark, pages).collect()]
    # one hot value is cut into ranges like any other
    assert len(sizes) > 10 and max(sizes) < 500
    start = {r.before: r.n for r in PG.directory(spark, pages).collect()}
    deep = max(start)
    page = PG.read_page(spark, pages, deep, 1)
    assert len({f.rsplit("/", 2)[1] for f in page.inputFiles()}) == 1 and page.count() == 1


def test_pages_of_an_empty_table(spark, tmp_path):
    pages = PG.build_pages(_rows(spark, 0), ["v", "ls_index"], str(tmp_path / "p"))
    assert PG.count_pages(spark, pages).first().asDict() == {"total": 0, "total_pages": 0}
    assert PG.read_page(spark, pages, 0).collect() == []
    assert PG.read_page(spark, pages, 0).columns == ["ls_index", "v"]


def _same(batch):
    return batch.select("ls_index", "v")


def _ids(spark, path):
    return sorted(r.ls_index for r in BT.read_batches(spark, path).collect())


def test_batches_read_no_stored_row(spark, tmp_path):
    path = str(tmp_path / "t")
    assert BT.read_batches(spark, path) is None
    rows = _rows(spark, 100_000).withColumn("ls_index", F.col("ls_index") - 40_000)
    # ids that interleave, ids below zero, and ids in one bucket
    BT.append_batch(rows.filter("ls_index % 3 = 0"), _same, path)
    assert len(_ids(spark, path)) == rows.filter("ls_index % 3 = 0").count()
    # without the stored rows, the next batches still know them
    shutil.move(f"{path}/rows", f"{path}/aside")
    BT.append_batch(rows.filter("ls_index % 3 <= 0"), _same, path)
    BT.append_batch(rows.union(rows), _same, path)
    BT.append_batch(rows, _same, path)
    for kept in (tmp_path / "t" / "aside").iterdir():
        shutil.move(str(kept), f"{path}/rows/{kept.name}")
    assert _ids(spark, path) == list(range(-40_000, 60_000))
    assert len(BT._folders(spark, path)) == 3


def test_batch_that_dies_is_written_anew(spark, tmp_path):
    path, rows = str(tmp_path / "t"), _rows(spark, 50)
    BT.append_batch(rows.filter("ls_index < 10"), _same, path)
    # rows without a finished manifest, and a manifest without its mark
    rows.filter("ls_index >= 10").write.parquet(f"{path}/rows/batch-x")
    spark.range(1).selectExpr("0L AS bucket", "X'00' AS ids").write.parquet(f"{path}/manifest/batch-x")
    (tmp_path / "t" / "manifest" / "batch-x" / "_SUCCESS").unlink()
    assert _ids(spark, path) == list(range(10))
    BT.append_batch(rows, _same, path)
    assert _ids(spark, path) == list(range(50))


def test_rows_left_out_stay_open(spark, tmp_path):
    path, rows = str(tmp_path / "t"), _rows(spark, 20)
    BT.append_batch(rows.union(spark.sql("SELECT CAST(NULL AS BIGINT), 1L")), lambda b: _same(b).filter("ls_index % 2 = 0"), path)
    assert _ids(spark, path) == list(range(0, 20, 2))
    BT.append_batch(rows, _same, path)
    BT.append_batch(rows.limit(0), _same, path)
    assert _ids(spark, path) == list(range(20))

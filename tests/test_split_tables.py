"""Queries on tables that are folders of several files, as large tables are."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("split"))
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["str2_stream_append", "str2_stream_batches", "str3_stream_place"])
def test_streams_read_tables_of_several_files(spark, split, name):
    run = entry.queries()[name]
    assert sorted(run(spark, split).collect()) == sorted(run(spark, SF).collect())

"""Tokens of large batches."""

import time
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from embedmap.operators import tokens as TK


def test_pieces_hold_a_bounded_text():
    texts = ["a" * 300_000, "", "b" * 3_000_000, "c" * 600_000, "d", "e" * 600_000] + ["f" * 1000] * 5000
    batch = pa.RecordBatch.from_pydict({"ls_index": list(range(len(texts))), "t": texts})
    pieces = list(TK._pieces(batch, "t"))
    assert [t for p in pieces for t in p.column("t").to_pylist()] == texts
    # one text may be long; those after it add no more than the bound
    assert all(sum(len(t) for t in p.column("t").to_pylist()[1:]) <= TK.PIECE_BYTES for p in pieces)
    assert list(TK._pieces(batch.slice(0, 0), "t")) == []


def test_tokens_of_texts_in_several_pieces(spark):
    docs = spark.range(6, numPartitions=1).select(F.col("id").alias("ls_index"), F.repeat(F.lit("ab  c "), 70_000).alias("text"))
    got = TK.tokenize(docs, "text").groupBy("ls_index").agg(
        F.count("*").alias("n"), F.count_distinct("token_pos").alias("places"), F.max("token_pos").alias("last"), F.max("char_end").alias("end")
    )
    assert sorted(tuple(r) for r in got.collect()) == [(i, 140_000, 140_000, 139_999, 70_000 * 6 - 1) for i in range(6)]


def test_tokens_are_numbered_without_sorting_them(spark):
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        docs = spark.createDataFrame([(7, "a b"), (2, "c"), (5, ""), (3, "d e f")], "ls_index long, text string")
        numbered = TK.number_tokens(TK.tokenize(docs, "text"))
        got = sorted(tuple(r) for r in numbered.select("token_index", "ls_index", "token_str").collect())
        assert got == [(0, 2, "c"), (1, 3, "d"), (2, 3, "e"), (3, 3, "f"), (4, 7, "a"), (5, 7, "b")]
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin [ls_index#" in plan and "SortMergeJoin [ls_index#" not in plan
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def test_tokens_carry_columns_and_labels_read_them_once(spark):
    from embedmap.operators.labels import token_labels

    docs = spark.createDataFrame([(1, "a b a", 0, -1), (2, "", 0, -1), (3, "c", 1, 0)], "ls_index long, text string, cluster int, raw_cluster int")
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    tokens = TK.tokenize(docs, "text", keep=["cluster", "raw_cluster"])
    rows = [(r.ls_index, r.token_pos, r.token_str, r.cluster, r.raw_cluster) for r in tokens.orderBy("ls_index", "token_pos").collect()]
    assert rows == [(1, 0, "a", 0, -1), (1, 1, "b", 0, -1), (1, 2, "a", 0, -1), (3, 0, "c", 1, 0)]
    got = {r.cluster: r.label for r in token_labels(tokens.mapInArrow(once, tokens.schema)).collect()}
    assert got == {0: "Unclustered", 1: "c"} and seen.value == 4


def test_numbered_tokens_keep_their_columns_and_nulls(spark):
    rows = [(4, 0, "x", None, 1.5), (4, 1, None, 7, None), (None, 0, "lost", 1, 0.0), (2, 0, "é", -(2**31), 2.0), (2, 1, "y", 2**31 - 1, 3.0)]
    tokens = spark.createDataFrame(rows, "ls_index long, token_pos int, token_str string, extra int, weight double")
    got = TK.number_tokens(tokens)
    assert got.columns == ["token_index", *tokens.columns] and got.dtypes[1:] == tokens.dtypes
    # rows without a document come first in the order, but are no one's
    assert sorted(tuple(r) for r in got.collect()) == [(1, *rows[3]), (2, *rows[4]), (3, *rows[0]), (4, *rows[1])]


def test_tokens_are_stored_and_moved_packed(spark, tmp_path):
    from embedmap.session import shared_dir
    from embedmap.sources import writers as WR

    def files():
        top = Path(shared_dir(spark).removeprefix("file:"))
        return {p: p.stat().st_size for p in [*top.rglob("*"), *tmp_path.rglob("*")] if p.is_file()}

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.translate((F.col("id") * 7919 + i * 104729).cast("string"), "0123456789", "abcdefghij")), " ")
    docs = spark.range(40, numPartitions=2).select(F.col("id").alias("ls_index"), words.alias("text"))
    counts = docs.select("ls_index", F.lit(2000).alias("num_tokens"))
    path, before = f"{tmp_path}/rows", files()
    WR.append_token_rows(counts, TK.number_tokens(TK.tokenize(docs, "text")), path)
    written = sum(size for p, size in files().items() if p not in before)
    # both tables and nothing else, at less than the 28 bytes that the numbers of one token take
    assert spark.read.parquet(path).count() == 80_000 and written < 80_000 * 20
    assert [p.name for p in tmp_path.iterdir()] == ["rows"]


def test_shuffles_end_with_the_write(spark):
    from embedmap.session import SHUFFLES_END, store

    def held():
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        dirs = env.blockManager().diskBlockManager().localDirsString()
        return {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}

    before = held()
    store(spark.range(100_000).repartition(7, F.col("id") % 11), "spread")
    deadline = time.time() + 10
    while held() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(SHUFFLES_END) == "false"

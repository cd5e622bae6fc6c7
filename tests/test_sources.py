"""Readers, writers, streams and embedding functions on files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.operators import embed as U
from embedmap.sources import readers as RD
from embedmap.sources import writers as WR
from embedmap.streaming import append as ST


def test_read_table_by_ending(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,day\n1,"two\nlines, ""quoted""",2024-01-02\n2,b,2024-01-03\n')
    (tmp_path / "a.jsonl").write_text('{"id": 1, "day": "2024-01-02"}\n{"id": 2, "day": "x"}\n')
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}], indent=1))
    csv = RD.read_table(spark, f"{tmp_path}/a.csv").orderBy("id").collect()
    assert csv[0]["text"] == 'two\nlines, "quoted"' and len(csv) == 2
    jsonl = RD.read_table(spark, f"{tmp_path}/a.jsonl")
    assert dict(jsonl.dtypes)["day"] == "string" and jsonl.count() == 2
    assert RD.read_table(spark, f"{tmp_path}/a.json").count() == 2
    with pytest.raises(ValueError):
        RD.read_table(spark, f"{tmp_path}/a.xlsx")


def test_read_image_dir(spark, tmp_path):
    for name, n in (("b c+d.PNG", 2048), ("a.jpg", 100), ("note.txt", 5)):
        (tmp_path / name).write_bytes(b"x" * n)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.png").write_bytes(b"x")
    got = RD.read_image_dir(spark, str(tmp_path)).orderBy("ls_index").collect()
    assert [(r["ls_index"], r["filename"], r["size_kb"]) for r in got] == [(0, "a.jpg", 0.1), (1, "b c+d.PNG", 2.0)]
    with pytest.raises(ValueError):
        RD.read_image_dir(spark, _empty(tmp_path))


def _empty(tmp_path):
    d = tmp_path / "none"
    d.mkdir()
    (d / "x.txt").write_text("x")
    return str(d)


def test_read_indices_files(spark, tmp_path):
    (tmp_path / "good.indices").write_text("3\n1\n")
    (tmp_path / "one.indices").write_text("7")
    got = {(r["tag"], r["ls_index"]) for r in RD.read_indices(spark, f"{tmp_path}/*.indices").collect()}
    assert got == {("good", 3), ("good", 1), ("one", 7)}


def test_import_vectors_rejects_ragged(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "ls_index long, v array<double>")
    with pytest.raises(ValueError):
        RD.import_vectors(df, "v")


def test_append_keeps_older_types(spark, tmp_path):
    path = f"{tmp_path}/v"
    v = spark.createDataFrame([(0, [0.5])], "ls_index int, vector array<double>")
    v.write.parquet(path)
    WR.append_vectors(spark.createDataFrame([(1, [1.5])], "ls_index long, vector array<float>"), path)
    back = RD.read_vectors(spark, path)
    assert dict(back.dtypes)["vector"] == "array<double>" and back.count() == 2


def test_token_rows_not_written_on_mismatch(spark, tmp_path):
    docs = spark.createDataFrame([(0, 2)], "ls_index long, num_tokens int")
    tokens = spark.createDataFrame([(0, 0, 0, "a", 0, 1)], "token_index long, ls_index long, token_pos int, token_str string, char_start int, char_end int")
    with pytest.raises(ValueError):
        WR.append_token_rows(docs, tokens, f"{tmp_path}/tok")
    assert not WR.exists(spark, f"{tmp_path}/tok")


def test_verified_copy_states(spark, tmp_path):
    path = f"{tmp_path}/copy"
    v = spark.range(100).select(F.col("id").alias("ls_index"), F.array(F.col("id").cast("float")).alias("vector"))
    v.filter("ls_index < 40").write.parquet(path)
    assert WR.verified_copy(v, path) == "migrated"
    assert WR.verified_copy(v, path) == "already_migrated"
    assert spark.read.parquet(path).count() == 100


def test_compact_leaves_few_sorted_files(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "ls_index").repartition(10).write.parquet(f"{tmp_path}/many")
    WR.compact(spark, f"{tmp_path}/many", f"{tmp_path}/few", 2)
    files = [p for p in (tmp_path / "few").iterdir() if p.name.startswith("part-")]
    assert len(files) <= 2 and spark.read.parquet(f"{tmp_path}/few").count() == 100


def test_stream_append_is_idempotent(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "ls_index long, text string"

    def embed(batch):
        return batch.select("ls_index", F.array(F.length("text").cast("float")).alias("vector"))

    def run(offsets):
        stream = spark.readStream.schema(schema).parquet(source)
        ST.stream_append(stream, embed, path, f"{tmp_path}/{offsets}").awaitTermination()
        return sorted(r["ls_index"] for r in spark.read.parquet(path).collect())

    spark.createDataFrame([(0, "a"), (1, "b"), (1, "b")], schema).write.mode("append").parquet(source)
    assert run("o1") == [0, 1]
    spark.createDataFrame([(1, "b"), (2, "c")], schema).write.mode("append").parquet(source)
    assert run("o1") == [0, 1, 2]
    assert run("o2") == [0, 1, 2]


def test_quarantine_keeps_neighbours_of_bad_rows(spark):
    docs = spark.createDataFrame([(i, "bad" if i == 3 else "ok") for i in range(10)], "ls_index long, text string")

    def load():
        def model(texts):
            if "bad" in texts:
                raise ValueError("no")
            return np.ones((len(texts), 2), dtype=np.float32)

        return model

    good, failed = ST.quarantine(docs, "text", load)
    assert good.count() == 9
    assert failed.collect()[0][:] == (3, "bad", "ValueError: no")


def test_embed_multi_mean_and_cut(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b c")], "ls_index long, text string")

    def load():
        return lambda texts: [np.array([[3.0, 4.0, 0.0]] * len(t.split())) for t in texts]

    got = {r["ls_index"]: r for r in U.embed_multi(docs, "text", load, dimensions=2).collect()}
    assert got[1]["num_tokens"] == 2 and np.allclose(got[1]["token_vectors"], [[0.6, 0.8]] * 2)
    assert np.allclose(got[0]["vector"], [0.6, 0.8])


def test_hash_embed_is_stable_and_unit(spark):
    docs = spark.createDataFrame([(0, "Red fox"), (1, "fox red"), (2, ""), (3, "blue sky")], "ls_index long, text string")
    got = {r["ls_index"]: np.array(r["vector"]) for r in U.hash_embed(docs, "text", 64).collect()}
    assert np.allclose(got[0], got[1]) and abs(np.linalg.norm(got[0]) - 1) < 1e-6
    assert np.allclose(got[2], 0) and not np.allclose(got[0], got[3])

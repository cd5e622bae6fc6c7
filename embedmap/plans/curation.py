"""Registered queries for edits, tags, and append-only streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from embedmap.operators import curate as CU
from embedmap.plans import fixtures as X
from embedmap.plans.fixtures import r6, with_scope, with_tags
from embedmap.plans.mapping import HULL, PLACE_SQL
from embedmap.plans.registry import query
from embedmap.session import scratch_path
from embedmap.streaming import append as ST
from embedmap.streaming import batches as BT


def _scope(spark, sf):
    return X.scope(spark, sf).select("ls_index", "cluster", "label", "deleted")


def _chosen(spark, sf):
    """Row ids to edit: those of good documents."""
    return X.tags(spark, sf).filter("tag = 'good'").select("ls_index")


GOOD = "ls_index IN (SELECT doc_id FROM labels WHERE quality = 1)"


@query(
    "cur1_change_cluster",
    with_scope(f"""SELECT ls_index, CASE WHEN {GOOD} THEN 4 ELSE cluster END AS cluster, CASE WHEN {GOOD} THEN 'Cluster 4' ELSE label END AS label, deleted FROM scope"""),
)
def cur1(spark, sf):
    return CU.change_cluster(_scope(spark, sf), _chosen(spark, sf), 4, "Cluster 4")


@query("cur2_rename_cluster", with_scope("SELECT ls_index, cluster, CASE WHEN cluster = 4 THEN 'Four' ELSE label END AS label, deleted FROM scope"))
def cur2(spark, sf):
    return CU.rename_cluster(_scope(spark, sf), 4, "Four")


@query("cur3_delete_rows", with_scope(f"SELECT ls_index, cluster, label, deleted OR {GOOD} AS deleted FROM scope"))
def cur3(spark, sf):
    return CU.delete_rows(_scope(spark, sf), _chosen(spark, sf))


@query(
    "cur4_rehull",
    f"""WITH {X.SCOPE_SQL}, {HULL.replace('SELECT raw_cluster AS c', 'SELECT cluster AS c').replace('WHERE raw_cluster >= 0', 'WHERE NOT deleted')}
        SELECT CAST(c AS INT) AS cluster, a AS ls_index FROM edge""",
)
def cur4(spark, sf):
    return CU.rehull(X.scope(spark, sf)).select("cluster", "ls_index")


def _log(spark, sf):
    """Transactions from events: clicks move a row, errors delete it, purchases rename a cluster."""
    e = X.table(spark, sf, "events")
    action = (
        F.when(F.col("event_type") == "click", "change_cluster")
        .when(F.col("event_type") == "purchase", "change_cluster_name")
        .when((F.col("event_type") == "error") & (F.col("value") > 120), "delete_rows")
    )
    return e.select(
        F.col("event_id").alias("seq"), action.alias("action"), F.array("user_id").alias("ids"),
        F.least(F.floor("value"), F.lit(9)).cast("int").alias("cluster"),
        F.concat(F.lit("Name "), F.col("event_id").cast("string")).alias("label"),
    ).filter("action IS NOT NULL")


@query(
    "cur5_replay",
    with_scope("""SELECT s.ls_index, coalesce(mv.c, s.cluster) AS cluster,
         coalesce(nm.name, CASE WHEN mv.c IS NULL THEN s.label ELSE coalesce(b.label, s.label) END) AS label, s.deleted OR coalesce(del.gone, false) AS deleted
       FROM scope s
       LEFT JOIN (SELECT user_id, arg_max(CAST(least(floor(value), 9) AS INT), event_id) AS c FROM events WHERE event_type = 'click' GROUP BY 1) mv ON mv.user_id = s.ls_index
       LEFT JOIN (SELECT DISTINCT user_id, true AS gone FROM events WHERE event_type = 'error' AND value > 120) del ON del.user_id = s.ls_index
       LEFT JOIN (SELECT CAST(least(floor(value), 9) AS INT) AS c, arg_max('Name ' || event_id, event_id) AS name FROM events WHERE event_type = 'purchase' GROUP BY 1) nm
         ON nm.c = coalesce(mv.c, s.cluster)
       LEFT JOIN (SELECT cluster, min(label) AS label FROM scope GROUP BY 1) b ON b.cluster = coalesce(mv.c, s.cluster)"""),
)
def cur5(spark, sf):
    s = _scope(spark, sf)
    labels = s.groupBy("cluster").agg(F.min("label").alias("label"))
    return CU.replay(s, labels, _log(spark, sf)).select("ls_index", "cluster", "label", "deleted")


@query(
    "cur6_tags",
    with_tags("""SELECT DISTINCT tag, ls_index FROM (SELECT * FROM tags WHERE tag <> 'toxic' UNION ALL SELECT 'french', doc_id FROM documents WHERE lang = 'fr') t
       WHERE NOT (tag = 'french' AND ls_index IN (SELECT ls_index FROM tags WHERE tag = 'good'))"""),
)
def cur6(spark, sf):
    tags = X.tags(spark, sf)
    french = X.documents(spark, sf).filter("lang = 'fr'").select("ls_index")
    added = CU.tag_add(tags, "french", french)
    return CU.tag_delete(CU.tag_remove(added, "french", _chosen(spark, sf)), "toxic")


# --- streams ------------------------------------------------------------------------------


@query("str1_resume_embed", f"SELECT vec_id AS ls_index FROM embeddings WHERE label >= {X.NEW_LABEL}")
def str1(spark, sf):
    v = X.vectors(spark, sf).select("ls_index", "label")
    stored = v.filter(F.col("label") < X.NEW_LABEL)
    return ST.pending_rows(v, stored).select("ls_index")


def _stream(spark, sf, name):
    """The table as a file stream, whether it is one file or a folder of files."""
    whole = X.table(spark, sf, name)
    # a file stream reads folders only, but a pattern may also name a single file
    return spark.readStream.schema(whole.schema).parquet(f"{sf}/{name}.parque[t]")


@query("str2_stream_append", "SELECT doc_id AS ls_index, CAST(length(text) AS BIGINT) AS total FROM documents")
def str2(spark, sf):
    path = scratch_path(spark, "stream-append")

    def lengths(batch):
        return batch.select("ls_index", F.array(F.length("text").cast("float")).alias("vector"))

    # half is stored before, and the stream is run twice: neither may give a row twice
    docs = X.documents(spark, sf)
    lengths(docs.filter("lang IN ('en', 'fr')")).select(F.col("ls_index").cast("long"), "vector").write.parquet(path)
    for again in ("a", "b"):
        source = _stream(spark, sf, "documents").withColumnRenamed("doc_id", "ls_index")
        ST.stream_append(source, lengths, path, scratch_path(spark, f"offsets-{again}")).awaitTermination()
    return spark.read.parquet(path).select("ls_index", F.col("vector")[0].cast("long").alias("total"))


@query("str2_stream_batches", "SELECT doc_id AS ls_index, CAST(length(text) AS BIGINT) AS total FROM documents")
def str2_batches(spark, sf):
    path = scratch_path(spark, "stream-batches")

    def lengths(batch):
        return batch.select(F.col("ls_index").cast("long"), F.length("text").cast("long").alias("total"))

    # half is stored before, with ids all over the table, and the stream is run twice
    BT.append_batch(X.documents(spark, sf).filter("lang IN ('en', 'fr')"), lengths, path)
    for again in ("a", "b"):
        source = _stream(spark, sf, "documents").withColumnRenamed("doc_id", "ls_index")
        BT.stream_batches(source, lengths, path, scratch_path(spark, f"offsets-{again}")).awaitTermination()
    return BT.read_batches(spark, path)


@query(
    "str3_stream_place",
    f"WITH {X.MAP_SQL}, {PLACE_SQL} SELECT ls_index, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y FROM placed",
)
def str3(spark, sf):
    path = scratch_path(spark, "stream-place")
    v = X.vectors(spark, sf).select("ls_index", F.col("e").alias("vector"), "label")
    old = v.filter(F.col("label") < X.NEW_LABEL).drop("label")
    old_map = X.first_map(spark, sf).join(old, "ls_index", "left_semi").select("ls_index", "x", "y")
    source = _stream(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ls_index"), F.col("embedding").cast("array<double>").alias("vector")
    )
    ST.stream_place(source, old, old_map, path, scratch_path(spark, "offsets")).awaitTermination()
    return r6(spark.read.parquet(path), "x", "y")


def _picky():
    """A model that refuses texts of more than 2000 characters."""

    def model(texts):
        if any(len(t) > 2000 for t in texts):
            raise ValueError("text too long")
        return np.array([[len(t)] for t in texts], dtype=np.float32)

    return model


@query(
    "str4_quarantine",
    """SELECT doc_id AS ls_index, 'failed' AS outcome, CAST(length(text) AS BIGINT) AS size FROM documents WHERE length(text) > 2000
       UNION ALL SELECT doc_id, 'good', CAST(length(text) AS BIGINT) FROM documents WHERE length(text) <= 2000""",
)
def str4(spark, sf):
    good, failed = ST.quarantine(X.documents(spark, sf), "text", _picky)
    good = good.select("ls_index", F.lit("good").alias("outcome"), F.col("vector")[0].cast("long").alias("size"))
    failed = failed.select("ls_index", F.lit("failed").alias("outcome"), F.length("input").cast("long").alias("size"))
    return good.unionByName(failed)

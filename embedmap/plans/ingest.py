"""Registered queries for sources, sinks and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.functions.common import rounded
from embedmap.operators import profile as PR
from embedmap.operators import ranking as R
from embedmap.operators import tokens as TK
from embedmap.plans import fixtures as X
from embedmap.plans.fixtures import r6, with_scope, with_tags, with_vectors
from embedmap.plans.registry import query
from embedmap.session import scratch_path
from embedmap.sources import readers as RD
from embedmap.sources import writers as WR

# --- sources ------------------------------------------------------------------------------


@query("src1_read_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src1(spark, sf):
    return RD.read_table(spark, f"{sf}/customer.parquet")


@query("src1_read_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def src1_csv(spark, sf):
    path = scratch_path(spark, "customer") + ".csv"
    c = X.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    c.write.csv(path, header=True)
    return RD.read_table(spark, path, c.schema)


@query("src1_read_jsonl", "SELECT doc_id, text, lang FROM documents")
def src1_jsonl(spark, sf):
    path = scratch_path(spark, "documents") + ".jsonl"
    d = X.table(spark, sf, "documents").select("doc_id", "text", "lang")
    d.write.json(path)
    return RD.read_table(spark, path, d.schema)


@query("src2_read_image_dir", "SELECT CAST(sum(2 * strlen(html) + 1) AS BIGINT) AS bytes, true AS all_png, true AS dense FROM pages")
def src2(spark, sf):
    # the pages' bytes as files with an image ending, read back as a folder of images
    path = scratch_path(spark, "images")
    coded = X.table(spark, sf, "pages").repartition(5, "page_id").select(F.hex(F.encode("html", "UTF-8")))
    coded.write.option("extension", "png").csv(path)
    got = RD.read_image_dir(spark, path)
    dense = (F.min("ls_index") == 0) & (F.max("ls_index") + 1 == F.count("*"))
    return got.agg(F.sum(F.octet_length("image")).alias("bytes"), F.bool_and(F.endswith("filename", F.lit(".png"))).alias("all_png"), dense.alias("dense"))


@query("src3_assign_row_index", "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS ls_index, event_id FROM events")
def src3(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", "ts")
    return R.assign_row_index(e, [F.col("ts"), F.col("event_id")]).select("ls_index", "event_id")


@query("src5_read_vectors", with_vectors("SELECT ls_index, round(e[1],6)+0.0 AS v0, round(e[64],6)+0.0 AS v63 FROM v"))
def src5(spark, sf):
    path = scratch_path(spark, "vectors")
    tokens = X.token_vectors(spark, sf)
    X.vectors(spark, sf).select("ls_index", "vector").join(tokens, "ls_index").write.parquet(path)
    v = RD.read_vectors(spark, path)
    return v.select(
        "ls_index", rounded(F.col("vector")[0].cast("double")).alias("v0"), rounded(F.col("vector")[63].cast("double")).alias("v63")
    )


@query("src6_read_indices", with_tags("SELECT tag, ls_index FROM tags"))
def src6(spark, sf):
    path = scratch_path(spark, "tags")
    tags = X.tags(spark, sf)
    for name in ("good", "toxic"):
        own = tags.filter(F.col("tag") == name).select(F.col("ls_index").cast("string"))
        own.write.text(f"{path}/{name}.indices")
    return RD.read_indices(spark, f"{path}/*.indices")


# --- sinks --------------------------------------------------------------------------------


def _stored(df):
    return df.select("ls_index", rounded(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)).alias("total"))


VECTOR_SUM = with_vectors("SELECT ls_index, round(list_sum(e),6)+0.0 AS total FROM v")


@query("snk1_append_vectors", VECTOR_SUM)
def snk1(spark, sf):
    path = scratch_path(spark, "vectors")
    v = X.vectors(spark, sf)
    for part in (v.filter(F.col("label") < X.NEW_LABEL), v.filter(F.col("label") >= X.NEW_LABEL)):
        WR.append_vectors(part.select("ls_index", "vector"), path)
    return _stored(RD.read_vectors(spark, path))


@query("snk2_append_token_rows", r"SELECT doc_id AS ls_index, CAST(len(regexp_extract_all(text, '\p{L}+')) AS BIGINT) AS n FROM documents WHERE len(regexp_extract_all(text, '\p{L}+')) > 0")
def snk2(spark, sf):
    path = scratch_path(spark, "tokens")
    docs = X.documents(spark, sf)
    tokens = TK.number_tokens(TK.tokenize(docs, "text"))
    counts = docs.select("ls_index", F.size(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("num_tokens"))
    WR.append_token_rows(counts, tokens, path)
    return spark.read.parquet(path).groupBy("ls_index").agg(F.count("*").alias("n"))


@query("snk3_compact", VECTOR_SUM)
def snk3(spark, sf):
    path, target = scratch_path(spark, "vectors"), scratch_path(spark, "compacted")
    X.vectors(spark, sf).select("ls_index", "vector").repartition(16).write.parquet(path)
    WR.compact(spark, path, target, 2)
    return _stored(RD.read_vectors(spark, target))


@query(
    "snk4_write_scope",
    with_scope("SELECT ls_index, e.label, s.label AS label_ls, s.cluster, s.deleted FROM scope s JOIN embeddings e ON e.vec_id = s.ls_index"),
)
def snk4(spark, sf):
    path = scratch_path(spark, "scope")
    source = X.vectors(spark, sf).select("ls_index", "label")
    WR.write_scope(source, X.scope(spark, sf).select("ls_index", "cluster", "label", "deleted"), path)
    return spark.read.parquet(f"{path}/scope-input")


@query(
    "snk5_write_export",
    f"""WITH {X.SCOPE_SQL}, {X.TAGS_SQL} SELECT ls_index, lang, cluster, ls_index IN (SELECT ls_index FROM tags WHERE tag = 'good') AS tag_good,
        ls_index IN (SELECT ls_index FROM tags WHERE tag = 'toxic') AS tag_toxic FROM scope JOIN documents ON doc_id = ls_index""",
)
def snk5(spark, sf):
    path = scratch_path(spark, "export")
    source = X.documents(spark, sf).select("ls_index", "lang")
    WR.write_export(source, X.scope(spark, sf).select("ls_index", "cluster"), X.tags(spark, sf), ["good", "toxic"], path)
    return spark.read.parquet(path)


@query("snk6_verified_copy", "SELECT count(*) AS source_rows, count(*) AS copied_rows, CAST(0 AS BIGINT) AS unmatched, 0.0::DOUBLE AS max_difference FROM embeddings")
def snk6(spark, sf):
    path = scratch_path(spark, "copy")
    v = X.vectors(spark, sf).select("ls_index", "vector")
    WR.verified_copy(v, path)
    return r6(WR.copy_report(v, spark.read.parquet(path)), "max_difference")


# --- profile ------------------------------------------------------------------------------

TYPES = """SELECT column_name AS "column", CASE WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'date' WHEN data_type = 'VARCHAR' THEN 'string'
  WHEN data_type LIKE '%[]' THEN 'array' ELSE 'number' END AS type FROM (DESCRIBE {t})""".replace("data_type", "column_type")


@query("prf1_column_types", f"{TYPES.format(t='events')} UNION ALL {TYPES.format(t='embeddings')}")
def prf1(spark, sf):
    return PR.column_types(X.table(spark, sf, "events")).unionByName(PR.column_types(X.table(spark, sf, "embeddings")))


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "prf2_unique_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"unique\" FROM orders" for c in ORDERS)
    + " UNION ALL SELECT 'vec_id', count(DISTINCT vec_id) FROM embeddings UNION ALL SELECT 'embedding', count(DISTINCT embedding) FROM embeddings"
    " UNION ALL SELECT 'label', count(DISTINCT label) FROM embeddings",
)
def prf2(spark, sf):
    return PR.unique_counts(X.table(spark, sf, "orders")).unionByName(PR.unique_counts(X.table(spark, sf, "embeddings")))


@query(
    "prf3_categories",
    """SELECT * FROM (SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY lang
       UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
       UNION ALL SELECT 'text', text, count(*) FROM documents GROUP BY text) t
       WHERE "column" IN (SELECT 'lang' FROM documents HAVING count(DISTINCT lang) <= 100 UNION ALL SELECT 'source' FROM documents HAVING count(DISTINCT source) <= 100
         UNION ALL SELECT 'text' FROM documents HAVING count(DISTINCT text) <= 100)""",
)
def prf3(spark, sf):
    return PR.categories(X.table(spark, sf, "documents"))


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "prf4_number_extent",
    " UNION ALL ".join(f'SELECT \'{c}\' AS "column", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem' for c in NUMBERS),
)
def prf4(spark, sf):
    return PR.number_extent(X.table(spark, sf, "lineitem"))


@query(
    "prf5_date_extent",
    """SELECT 'ts' AS "column", strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS min, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS max FROM events
       UNION ALL SELECT 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') FROM orders""",
)
def prf5(spark, sf):
    return PR.date_extent(X.table(spark, sf, "events")).unionByName(PR.date_extent(X.table(spark, sf, "orders")))


@query(
    "prf6_url_flags",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", bool_and(starts_with({c}, 'http')) AS url, bool_and(starts_with({c}, 'http')) AND "
        f"bool_and(regexp_matches(lower({c}), '(png|jpg|jpeg|webp|svg|gif)$')) AS image_url FROM {t}"
        for c, t in (("url", "pages"), ("html", "pages"), ("img", "(SELECT url || '.PNG' AS img FROM pages)"))
    ),
)
def prf6(spark, sf):
    p = X.table(spark, sf, "pages")
    return PR.url_flags(p.select("url", "html", F.concat("url", F.lit(".PNG")).alias("img")))


@query("prf7_binary_image_flag", "SELECT 'raw' AS \"column\", false AS image FROM pages HAVING count(*) > 0 UNION ALL SELECT 'png', true FROM pages HAVING count(*) > 0")
def prf7(spark, sf):
    raw = F.encode("html", "UTF-8")
    png = F.concat(F.unhex(F.lit(PR.IMAGE_MARKS[0])), raw)
    p = X.table(spark, sf, "pages").select(raw.alias("raw"), png.alias("png"))
    return PR.binary_image_flag(p, "raw").unionByName(PR.binary_image_flag(p, "png"))


@query(
    "prf8_column_roles",
    """SELECT 'text' AS role, 'text' AS "column" UNION ALL SELECT 'color', 'doc_id' UNION ALL SELECT 'color', 'n_chars'
       UNION ALL SELECT 'color', 'lang' FROM documents HAVING count(DISTINCT lang) <= 100
       UNION ALL SELECT 'color', 'source' FROM documents HAVING count(DISTINCT source) <= 100
       UNION ALL SELECT 'color', 'vec_id' UNION ALL SELECT 'color', 'label' UNION ALL SELECT 'embedding', 'embedding'""",
)
def prf8(spark, sf):
    docs = PR.column_roles(X.table(spark, sf, "documents"))
    return docs.unionByName(PR.column_roles(X.table(spark, sf, "embeddings")))


WORDS = r"""SELECT count(*) AS "rows", avg(length(text)) AS avg_length, CAST(max(length(text)) AS BIGINT) AS max_length,
  CAST(floor(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))) AS BIGINT) AS avg_words FROM documents"""


@query(
    "prf9_text_profile",
    f"""SELECT "rows", round(avg_length,6)+0.0 AS avg_length, max_length, avg_words, CAST(least(floor(avg_words*1.3), 512) AS BIGINT) AS est_tokens FROM ({WORDS})""",
)
def prf9(spark, sf):
    return r6(PR.text_profile(X.table(spark, sf, "documents"), "text"), "avg_length")


@query(
    "prf10_storage_estimate",
    f"""SELECT "rows", est_tokens, CAST(floor("rows" * (4*64 + est_tokens*64*2) * 1.2) AS BIGINT) AS bytes FROM
        (SELECT "rows", CAST(least(floor(avg_words*1.3), 512) AS BIGINT) AS est_tokens FROM ({WORDS}))""",
)
def prf10(spark, sf):
    return PR.storage_estimate(X.table(spark, sf, "documents"), "text", 64, token_vectors=True)


@query(
    "prf11_vector_stats",
    with_vectors("""SELECT dim, round(min(val),6)+0.0 AS min, round(max(val),6)+0.0 AS max, count(*) AS n FROM
       (SELECT d AS dim, e[d+1] AS val FROM v, (SELECT CAST(unnest(range(64)) AS INT) AS d)) GROUP BY dim"""),
)
def prf11(spark, sf):
    return r6(PR.vector_stats(X.vectors(spark, sf)), "min", "max")


@query(
    "prf12_token_stats",
    r"""SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n),2) AS mean, CAST(min(n) AS BIGINT) AS min, CAST(max(n) AS BIGINT) AS max, count(*) AS "rows" FROM
       (SELECT len(regexp_extract_all(text, '\p{L}+')) AS n FROM documents)""",
)
def prf12(spark, sf):
    n = F.size(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("num_tokens")
    return PR.token_stats(X.documents(spark, sf).select(n))

"""Registered queries for text functions, labels, tokens and embedding functions."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from embedmap.functions import scalars as S
from embedmap.operators import embed as U
from embedmap.operators import joins as J
from embedmap.operators import labels as L
from embedmap.operators import project as P
from embedmap.operators import tokens as TK
from embedmap.plans import fixtures as X
from embedmap.plans.fixtures import r6, with_scope
from embedmap.plans.registry import query

# --- scalar text functions ----------------------------------------------------------------


@query(
    "fn1_prepare_text",
    """SELECT doc_id AS ls_index, 'query: ' || CASE WHEN t IS NULL OR t = '' THEN ' ' ELSE t END AS prepared
       FROM (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN '' WHEN l.quality = 0 THEN NULL ELSE text END AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
)
def fn1(spark, sf):
    # rows with a label lose their text, so both empty cases occur
    d = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id", "left")
    t = F.when(F.col("toxic") == 1, "").when(F.col("quality") == 0, None).otherwise(F.col("text"))
    return d.select(F.col("doc_id").alias("ls_index"), S.prepare_text(t, "query: ").alias("prepared"))


@query(
    "fn6_clean_label",
    r"""SELECT doc_id AS ls_index, array_to_string(list_slice(string_split(trim(regexp_replace(regexp_replace(
         '**"' || lang || '": ' || text || '<|eot_id|>', '<\|eot_id\|>|[*"'']', '', 'g'), '\s+', ' ', 'g')), ' '), 1, 5), ' ') AS label FROM documents""",
)
def fn6(spark, sf):
    raw = F.concat(F.lit('**"'), F.col("lang"), F.lit('": '), F.col("text"), F.lit("<|eot_id|>"))
    return X.documents(spark, sf).select("ls_index", S.clean_label(raw).alias("label"))


MARKED = "CASE WHEN p_size > 40 THEN '##' WHEN p_size > 30 THEN '▁Ġ' WHEN p_size > 20 THEN 'Ġ##' WHEN p_size > 10 THEN '####' ELSE '' END || p_brand"


@query(
    "fn7_clean_token",
    f"""SELECT p_partkey, regexp_replace(t, '^(?:##|▁|Ġ)+', '') AS snippet_form,
        coalesce(nullif(regexp_replace(regexp_replace(t, '^[▁Ġ]+', ''), '^##', ''), ''), t) AS label_form FROM (SELECT p_partkey, {MARKED} AS t FROM part)""",
)
def fn7(spark, sf):
    size = F.col("p_size")
    mark = F.when(size > 40, "##").when(size > 30, "▁Ġ").when(size > 20, "Ġ##").when(size > 10, "####").otherwise("")
    t = X.table(spark, sf, "part").select("p_partkey", F.concat(mark, "p_brand").alias("t"))
    return t.select("p_partkey", S.clean_token("t").alias("snippet_form"), S.display_token("t").alias("label_form"))


@query(
    "fn8_token_snippet",
    """SELECT doc_id AS ls_index, substr(text, lo+1, s-lo) AS before, substr(text, s+1, e-s) AS "match", substr(text, e+1, hi-e) AS after,
         lo > 0 AS cut_before, hi < n AS cut_after FROM (SELECT *, greatest(s-150, 0) AS lo, least(e+150, n) AS hi FROM
         (SELECT doc_id, text, n, s, least(s + doc_id % 400, n) AS e FROM
           (SELECT doc_id, text, length(text) AS n, CASE WHEN doc_id % 9 = 0 THEN length(text) ELSE length(text)//2 END AS s FROM documents)) WHERE s < n)""",
)
def fn8(spark, sf):
    # some spans start at the text's end, and many end beyond it
    n = F.length("text")
    start = F.when(F.col("ls_index") % 9 == 0, n).otherwise(F.floor(n / 2))
    d = X.documents(spark, sf).select("ls_index", S.token_snippet("text", start, start + F.col("ls_index") % 400).alias("s"))
    return d.filter("s IS NOT NULL").select("ls_index", "s.*")


# --- tokens -------------------------------------------------------------------------------

# runs of letters and of other characters, with the place where each starts
WORDS_SQL = r"""runs AS (SELECT doc_id AS ls_index, unnest(regexp_extract_all(text, '\p{L}+|[^\p{L}]+')) AS run,
    generate_subscripts(regexp_extract_all(text, '\p{L}+|[^\p{L}]+'), 1) AS k FROM documents),
runs2 AS (SELECT ls_index, run, k, CAST(sum(length(run)) OVER (PARTITION BY ls_index ORDER BY k) AS BIGINT) AS z FROM runs),
word AS (SELECT ls_index, CAST(row_number() OVER (PARTITION BY ls_index ORDER BY k) - 1 AS INT) AS token_pos, run AS token_str,
    CAST(z - length(run) AS INT) AS char_start, CAST(z AS INT) AS char_end FROM runs2 WHERE regexp_matches(run, '^\p{L}'))"""


def _tokens(spark, sf):
    return TK.tokenize(X.documents(spark, sf), "text")


@query("tok1_tokenize", f"WITH {WORDS_SQL} SELECT ls_index, token_pos, token_str, char_start, char_end FROM word")
def tok1(spark, sf):
    return _tokens(spark, sf)


@query(
    "tok2_shift_prefix",
    f"""WITH {WORDS_SQL} SELECT ls_index, token_pos, token_str, CAST(CASE WHEN char_start < 20 THEN -1 ELSE char_start - 20 END AS INT) AS char_start,
        CAST(CASE WHEN char_start < 20 THEN -1 ELSE char_end - 20 END AS INT) AS char_end FROM word""",
)
def tok2(spark, sf):
    return TK.shift_prefix(_tokens(spark, sf), 20)


@query(
    "tok3_check_token_counts",
    f"""WITH {WORDS_SQL} SELECT doc_id AS ls_index, n_chars AS expected, coalesce(n, 0) AS got FROM documents
        LEFT JOIN (SELECT ls_index, count(*) AS n FROM word GROUP BY 1) w ON ls_index = doc_id WHERE n_chars <> coalesce(n, 0)""",
)
def tok3(spark, sf):
    docs = X.documents(spark, sf).select("ls_index", F.col("n_chars").alias("num_tokens"))
    return TK.check_token_counts(docs, _tokens(spark, sf))


@query(
    "tok4_token_totals",
    f"""WITH {WORDS_SQL} SELECT count(*) AS total_tokens, count(DISTINCT ls_index) AS "rows", round(count(*)/count(DISTINCT ls_index), 2) AS avg_tokens_per_row FROM word""",
)
def tok4(spark, sf):
    return TK.token_totals(_tokens(spark, sf))


@query(
    "tok5_explode_token_vectors",
    f"""WITH {X.TOKENS_SQL} SELECT row_number() OVER (ORDER BY ls_index, token_pos) - 1 AS token_index, ls_index, CAST(token_pos AS INT) AS token_pos,
        round(t[1],6)+0.0 AS v0, round(t[8],6)+0.0 AS v7 FROM tok""",
)
def tok5(spark, sf):
    each = TK.explode_token_vectors(X.token_vectors(spark, sf))
    return r6(each.select("token_index", "ls_index", "token_pos", F.col("vector")[0].alias("v0"), F.col("vector")[7].alias("v7")), "v0", "v7")


@query("win5_token_index", f"WITH {WORDS_SQL} SELECT row_number() OVER (ORDER BY ls_index, token_pos) - 1 AS token_index, ls_index, token_pos FROM word")
def win5_index(spark, sf):
    return TK.number_tokens(_tokens(spark, sf)).select("token_index", "ls_index", "token_pos")


@query(
    "tok6_token_lookup",
    f"""WITH {WORDS_SQL} SELECT ls_index, token_pos, token_str FROM word WHERE ls_index IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def tok6(spark, sf):
    asked = X.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("ls_index"))
    tokens = TK.number_tokens(_tokens(spark, sf))
    return TK.token_lookup(tokens, asked, "ls_index", ["ls_index", "token_pos", "token_str"])


@query(
    "join3_token_parent_join",
    f"""WITH {WORDS_SQL}, ix AS (SELECT *, row_number() OVER (ORDER BY ls_index, token_pos) - 1 AS token_index FROM word)
    SELECT token_index AS "index", ix.ls_index AS parent_index, token_pos, token_str, lang, -item_id AS ord FROM ix JOIN benchmark ON item_id * 5 = token_index
    JOIN documents d ON d.doc_id = ix.ls_index""",
)
def join3(spark, sf):
    asked = X.table(spark, sf, "benchmark").select((F.col("item_id") * 5).alias("token_index"), (-F.col("item_id")).alias("ord"))
    tokens = TK.number_tokens(_tokens(spark, sf)).select("token_index", "ls_index", "token_pos", "token_str")
    return J.token_parent_join(tokens, X.documents(spark, sf).select("ls_index", "lang"), asked)


def _token_map(spark, sf):
    """Token vectors with a two-axis map and a cluster per token: the largest of the first four dimensions."""
    each = TK.explode_token_vectors(X.token_vectors(spark, sf))
    top = F.array_max(F.slice("vector", 1, 4))
    cluster = F.array_position(F.slice("vector", 1, 4), top).cast("int") - 1
    points = each.select(
        "token_index", "ls_index", "token_pos", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"), cluster.alias("cluster")
    )
    return P.normalize_frame(points, ["x", "y"])


@query(
    "tok7_token_scope",
    f"""WITH {X.TOKENS_SQL}, b AS (SELECT min(t[1]) x0, max(t[1]) x1, min(t[2]) y0, max(t[2]) y1 FROM tok),
    c AS (SELECT *, CASE greatest(t[1], t[2], t[3], t[4]) WHEN t[1] THEN 0 WHEN t[2] THEN 1 WHEN t[3] THEN 2 ELSE 3 END AS cluster FROM tok)
    SELECT row_number() OVER (ORDER BY ls_index, token_pos) - 1 AS ls_index, cluster, 'Cluster ' || cluster AS label, ls_index AS parent_index,
      CAST(token_pos AS INT) AS token_pos, 't' || token_pos AS token_str, round(2*(t[1]-x0)/(x1-x0)-1,6)+0.0 AS x, round(2*(t[2]-y0)/(y1-y0)-1,6)+0.0 AS y,
      false AS deleted FROM c, b""",
)
def tok7(spark, sf):
    m = _token_map(spark, sf)
    tokens = m.select("token_index", "ls_index", "token_pos", F.concat(F.lit("t"), F.col("token_pos").cast("string")).alias("token_str"))
    projection = m.select(F.col("token_index").alias("ls_index"), "x", "y")
    clustering = m.select(F.col("token_index").alias("ls_index"), "cluster")
    labels = m.groupBy("cluster").agg(F.concat(F.lit("Cluster "), F.first("cluster").cast("string")).alias("label"))
    return r6(TK.token_scope(projection, clustering, labels, tokens), "x", "y")


# --- labels -------------------------------------------------------------------------------


@query(
    "lab1_default_labels",
    with_scope("""SELECT cluster, min(label) AS label, CASE WHEN min(raw_cluster) = -1 THEN count(*) || ' noise points the clustering algorithm did not assign to any cluster.'
       ELSE 'This is cluster ' || cluster || ' with ' || count(*) || ' items.' END AS description FROM scope GROUP BY cluster"""),
)
def lab1(spark, sf):
    from embedmap.operators.cluster import default_labels

    return default_labels(X.scope(spark, sf))


@query(
    "lab2_token_labels",
    f"""WITH {WORDS_SQL}, cl AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS cluster FROM documents),
    n AS (SELECT cluster, token_str, count(*) AS m, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, token_str) AS rn
          FROM word JOIN cl ON doc_id = ls_index GROUP BY cluster, token_str),
    t AS (SELECT cluster, sum(m) AS m FROM n GROUP BY cluster),
    s AS (SELECT cluster, token_str, row_number() OVER (PARTITION BY cluster ORDER BY rn) AS k FROM n WHERE rn <= 5),
    l AS (SELECT cluster, string_agg(token_str, ', ' ORDER BY k) AS names FROM s WHERE k <= 3 GROUP BY cluster),
    z AS (SELECT DISTINCT cluster, source = 'src3' AS noise FROM cl)
    SELECT CAST(l.cluster AS INT) AS cluster, CASE WHEN noise THEN 'Unclustered' ELSE names END AS label,
      CASE WHEN noise THEN m || ' noise points the clustering algorithm did not assign to any cluster.'
           ELSE 'Token cluster ' || l.cluster || ' with ' || m || ' tokens; most frequent: ' || names || '.' END AS description
    FROM l JOIN t USING (cluster) JOIN z USING (cluster)""",
)
def lab2(spark, sf):
    from embedmap.operators.cluster import column_clusters

    docs = X.documents(spark, sf)
    # one source plays the noise cluster; every token carries its document's cluster
    raw = F.when(F.col("source") == "src3", -1).otherwise(0).alias("raw_cluster")
    cluster = column_clusters(docs, "source").withColumnRenamed("raw_cluster", "cluster")
    # documents meet their cluster once, in a hash of the numbers, and hand it to their many tokens
    placed = docs.select("ls_index", "text", raw).join(cluster.hint("shuffle_hash"), "ls_index")
    return L.token_labels(TK.tokenize(placed, "text", keep=["cluster", "raw_cluster"]))


STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOP_WORDS)


@query(
    "lab3_top_word_labels",
    rf"""WITH w AS (SELECT source, unnest(regexp_extract_all(text, '\p{{L}}+')) AS word FROM documents),
    n AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, word) AS rn FROM w WHERE lower(word) NOT IN ({STOP_SQL}) GROUP BY source, word)
    SELECT source, string_agg(word, ' ' ORDER BY rn) AS label FROM n WHERE rn <= 3 GROUP BY source""",
)
def lab3(spark, sf):
    return L.top_word_labels(X.documents(spark, sf), "text", 3, "source")


def _doc_scope(spark, sf):
    """Scope rows that also have a document."""
    docs = X.documents(spark, sf).select("ls_index", "text", "n_chars")
    return X.scope(spark, sf).select("ls_index", "x", "y", "cluster", "raw_cluster").join(docs, "ls_index")


# members nearest each cluster's centroid, within a budget of characters
EXTRACTS_SQL = """sd AS (SELECT s.*, d.text, least(n_chars, 2000) AS used_tokens FROM scope s JOIN documents d ON doc_id = ls_index),
sz AS (SELECT cluster, count(*) AS size, count(*) FILTER (WHERE raw_cluster = cluster) AS nraw FROM sd GROUP BY cluster),
pool AS (SELECT sd.cluster, sd.ls_index, sd.x, sd.y FROM sd JOIN sz USING (cluster) WHERE raw_cluster = cluster
  UNION ALL SELECT sd.cluster, sd.ls_index, sd.x, sd.y FROM sd JOIN sz USING (cluster) WHERE nraw < 10),
c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM pool GROUP BY cluster),
d AS (SELECT cluster, ls_index, sqrt((x-cx)**2+(y-cy)**2) AS dist FROM pool JOIN c USING (cluster)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, ls_index) AS rn FROM d),
near AS (SELECT DISTINCT cluster, ls_index, dist FROM r WHERE rn <= 10),
picked AS (SELECT * FROM (SELECT near.*, used_tokens, text, sum(used_tokens) OVER (PARTITION BY near.cluster ORDER BY dist, ls_index) AS run
  FROM near JOIN sd USING (cluster, ls_index)) WHERE run <= 8000)"""


@query(
    "lab4_label_with",
    rf"""WITH {X.SCOPE_SQL}, {EXTRACTS_SQL},
    w AS (SELECT cluster, unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM picked),
    best AS (SELECT cluster, CASE WHEN cluster = 10 THEN 'Unclustered' ELSE '**' || word || '** "sample"' || chr(10) END AS label_raw FROM
      (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY length(word) DESC, word) AS rn FROM w) WHERE rn = 1)
    SELECT cluster, label_raw, array_to_string(list_slice(string_split(trim(regexp_replace(regexp_replace(label_raw,
      '<\|eot_id\|>|[*"'']', '', 'g'), '\s+', ' ', 'g')), ' '), 1, 5), ' ') AS label FROM best""",
)
def lab4(spark, sf):
    def longest_word(texts):
        words = {w for t in texts for w in re.split(r"[ \t\n\r\f]+", t)}
        return f'**{min(words, key=lambda w: (-len(w), w))}** "sample"\n'

    picked = L.extracts(_doc_scope(spark, sf), "text", 10, "n_chars", 2000, 8000)
    return L.label_with(picked, longest_word, "text", skip=[10])


@query("lab4_extracts", f"WITH {X.SCOPE_SQL}, {EXTRACTS_SQL} SELECT cluster, ls_index, used_tokens FROM picked")
def lab4_extracts(spark, sf):
    return L.extracts(_doc_scope(spark, sf), "text", 10, "n_chars", 2000, 8000).select("cluster", "ls_index", "used_tokens")


@query("lab5_resume_labels", with_scope("SELECT cluster, min(label) AS label FROM scope GROUP BY cluster HAVING count(*) < 45"))
def lab5(spark, sf):
    s = X.scope(spark, sf).groupBy("cluster").agg(F.min("label").alias("label"), F.count("*").alias("n"))
    return L.resume_labels(s.select("cluster", "label"), s.select("cluster", (F.col("n") >= 45).alias("labeled")))


# --- embedding functions ------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_SQL = ", ".join(f"length(lower(t)) - length(replace(lower(t), '{c}', ''))" for c in LETTERS)


def _letter_counts():
    """A stand-in model: how often each letter occurs."""

    def count(texts):
        low = [t.lower() for t in texts]
        letter = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32) - np.uint32(ord("a"))
        first = np.repeat(np.arange(len(low)) * len(LETTERS), [len(t) for t in low])
        known = letter < len(LETTERS)
        return np.bincount(first[known] + letter[known], minlength=len(low) * len(LETTERS)).reshape(len(low), len(LETTERS)).astype(np.float32)

    return count


def _sum_of(df):
    v = F.col("vector")
    return df.select("ls_index", F.col("vector")[0].cast("long").alias("n_a"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).cast("long").alias("letters"))


def _embed_sql(source: str) -> str:
    return f"SELECT ls_index, CAST(l[1] AS BIGINT) AS n_a, CAST(list_sum(l) AS BIGINT) AS letters FROM (SELECT ls_index, [{LETTER_SQL}] AS l FROM ({source}))"


@query("udf1_embed", _embed_sql("SELECT doc_id AS ls_index, text AS t FROM documents"))
def udf1(spark, sf):
    return _sum_of(U.embed(X.documents(spark, sf), "text", _letter_counts))


@query("udf2_embed_query", _embed_sql("SELECT item_id AS ls_index, 'query: ' || text AS t FROM benchmark"))
def udf2(spark, sf):
    asks = X.table(spark, sf, "benchmark").withColumnRenamed("item_id", "ls_index")
    return _sum_of(U.embed_query(asks, "text", _letter_counts))


@query("udf3_embed_multi", r"SELECT doc_id AS ls_index, CAST(greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS INT) AS num_tokens, 26 AS dim FROM documents")
def udf3(spark, sf):
    def load():
        one = _letter_counts()
        return lambda texts: [one(t.split() or [t]) for t in texts]

    out = U.embed_multi(X.documents(spark, sf), "text", load)
    return out.select("ls_index", "num_tokens", F.size("vector").alias("dim"))


@query(
    "udf4_hash_embed",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN text IS NULL OR text = '' THEN ' ' ELSE text END), '\p{L}+')) AS word FROM documents),
    c AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) % 256 AS d, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT doc_id AS ls_index, CAST(d AS INT) AS place, round(CAST(CAST(n / sqrt(sum(n*n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5)+0.0 AS weight FROM c""",
)
def udf4(spark, sf):
    places = U.hash_embed(X.documents(spark, sf), "text", 256).select("ls_index", F.posexplode("vector").alias("place", "weight"))
    return r6(places.filter("weight <> 0").withColumn("weight", F.col("weight").cast("double")), "weight", digits=5)

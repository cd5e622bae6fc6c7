"""Registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from embedmap.llm import ann, bpe, byte_bpe, chat, collocations, licenses, secrets, variants
from embedmap.llm.decontaminate import contaminated
from embedmap.llm.lang_id import identify
from embedmap.llm.line_dedup import drop_boilerplate
from embedmap.llm.near_dup import near_duplicates
from embedmap.llm.substrings import drop_repeats
from embedmap.llm.tables import query, table

WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query("op1_language_id")
def op1(spark, sf):
    return identify(table(spark, sf, "documents"))


@query("op2_license_scan", licenses.scan_sql())
def op2(spark, sf):
    found = licenses.license_scan(table(spark, sf, "documents"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses", "unmatched")])


@query("op3_decontamination")
def op3(spark, sf):
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op4_chat_format",
    r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(13 + length(text) + length(regexp_replace(text, '[^<#\\]', '', 'g')) + length(role) + length(regexp_replace(role, '[^<#\n\\]', '', 'g'))) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id""",
)
def op4(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    found = chat.format_conversations(rows.union(extra))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss("formatted", "loss_spans")
    read = found.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op5_ann_search")
def op5(spark, sf):
    return ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query(
    "op6_substring_dedup",
    r"""WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM w WHERE len(w) >= 35),
    k AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS k FROM p),
    r AS MATERIALIZED (SELECT doc_id, p FROM k JOIN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) USING (k)),
    g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r),
    e AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM w),
    s AS (SELECT e.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL), '') AS kept
        FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
    SELECT w.doc_id, CAST(coalesce(len(w.w), 0) AS BIGINT) AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
    FROM w LEFT JOIN s ON w.doc_id = s.doc_id""",
)
def op6(spark, sf):
    return drop_repeats(table(spark, sf, "documents"), window=35, keep_text=False).drop("kept")


@query("op7_secret_scan")
def op7(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return secrets.digests(secrets.secret_spans(table(spark, sf, "documents"), path, public_tokenizers.PATTERN))


@query("op8_bpe")
def op8(spark, sf):
    return bpe.digests(bpe.bpe_roundtrip(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query(
    "op9_line_dedup",
    """WITH l AS MATERIALIZED (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
    b AS MATERIALIZED (SELECT line, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 8),
    k AS (SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line),
    g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""",
)
def op9(spark, sf):
    found = drop_boilerplate(table(spark, sf, "documents"), min_sites=8)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op10_minhash_near_dedup",
    rf"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
        WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS s FROM w),
    e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id,
        s.doc_id = least(s.doc_id, coalesce(m.low, s.doc_id)) AS kept
    FROM s LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON s.doc_id = m.a""",
)
def op10(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), shingle=2, percent=80)


@query("op11_spelling_variants", variants.sql())
def op11(spark, sf):
    counts = variants.run_counts(table(spark, sf, "documents"), cut_every=97, min_length=5)
    return variants.spelling_variants(counts, min_length=5, min_count=3)


@query("op12_collocations", collocations.sql())
def op12(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"), top=2000, min_count=10, share=50)


@query("op13_byte_bpe")
def op13(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.byte_digests(byte_bpe.byte_bpe(table(spark, sf, "documents"), path, public_tokenizers.PATTERN))

"""A training corpus from raw documents: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's result to the shared folder and reads it back for the next.

Rows of one doc_id count as one document: what is decided for an id holds for its repeated rows. A null
doc_id names no document, so the stages that drop documents keep such rows, but for texts without a
letter in the first stage. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmap.llm import bpe
from embedmap.llm.decontaminate import contaminated
from embedmap.llm.lang_id import identify
from embedmap.llm.line_dedup import drop_boilerplate
from embedmap.llm.near_dup import near_duplicates
from embedmap.session import store

# SQL has no n-gram models, alignments or BPE; tests hold the stages against brute force
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Documents whose id is not listed; the list is written first, so the plan knows its size."""
    return docs.join(store(ids.select("doc_id").distinct(), name), "doc_id", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that language identification rejects: no letter, or like no language learnt."""
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    return _without(lettered, identify(docs).filter("NOT accepted"), "rejected")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take cross-site boilerplate lines out of the texts; no document goes.

    Copies of one text count as one, so a page copied to many sites stays whole for the next stage,
    which keeps one of them; lines that different texts share go from every text.
    """
    kept = drop_boilerplate(docs, min_sites=8, fold_copies=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the lowest id of each group of near duplicates: five-word shingles, similarity 0.8."""
    return _without(docs, near_duplicates(docs, shingle=5, percent=80).filter("NOT kept"), "near-copies")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or an edited copy of one."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: doc_id, n_tokens and digests of the ids and the decoded text."""
    return bpe.digests(bpe.bpe_roundtrip(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language id", language),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("decontamination", benchmark_free),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

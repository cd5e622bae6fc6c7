"""Cluster labels (LAB*)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.functions.scalars import clean_label, display_token
from embedmap.operators.ranking import nearest_to_centroid, token_budget, top_per_group
from embedmap.session import spread, store

# fixed values: the common English stop words list
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

UNCLUSTERED = "Unclustered"


def token_labels(tokens: DataFrame) -> DataFrame:
    """(cluster, label, description) of tokens that carry their ``cluster``, from their most frequent names.

    The five most frequent tokens are cleaned, repeated names removed, and the first three kept;
    a cluster without any gets its number. Ties go to the lower token. Where ``raw_cluster`` is
    given, the noise cluster keeps its own name. Tokens are read once.
    """
    noise = F.bool_or(F.col("raw_cluster") == -1) if "raw_cluster" in tokens.columns else F.lit(False)
    counts = tokens.groupBy("cluster", "token_str").agg(
        F.count("*").alias("every"), F.count_if(F.col("char_start") >= 0).alias("n"), noise.alias("noise")
    )
    counts = store(counts, "token-counts")
    sizes = counts.groupBy("cluster").agg(F.sum("every").alias("n"), F.bool_or("noise").alias("noise"))
    top = top_per_group(counts.filter("n > 0").select("cluster", "token_str", "n"), ["cluster"], [F.col("n").desc(), F.col("token_str").asc()], 5)
    # at most five rows per cluster
    lists = top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "token_str"))).alias("top"))
    names = F.filter(
        F.transform(F.transform("top", lambda t: t["token_str"]), display_token), lambda t: F.trim(t) != ""
    )
    every = sizes.join(lists, "cluster", "left")
    every = every.withColumn("names", F.coalesce(F.array_join(F.slice(F.array_distinct(names), 1, 3), ", "), F.lit("")))
    number, size = F.col("cluster").cast("string"), F.col("n").cast("string")
    # fixed values: the sentences a label's readers expect
    some = F.concat(F.lit("Token cluster "), number, F.lit(" with "), size, F.lit(" tokens; most frequent: "), F.col("names"), F.lit("."))
    none = F.concat(F.lit("Token cluster "), number, F.lit(" with "), size, F.lit(" tokens."))
    lost = F.concat(size, F.lit(" noise points the clustering algorithm did not assign to any cluster."))
    named = F.col("names") != ""
    return every.select(
        "cluster",
        F.when(F.col("noise"), UNCLUSTERED).when(named, F.col("names")).otherwise(F.concat(F.lit("Cluster "), number)).alias("label"),
        F.when(F.col("noise"), lost).when(named, some).otherwise(none).alias("description"),
    )


def top_word_labels(docs: DataFrame, text: str, k: int = 3, group: str = "cluster") -> DataFrame:
    """(group, label): the k most frequent words that are letters only and not stop words.

    Words are counted per row before they meet in a shuffle, and ties go to the lower word.
    """
    words = spread(docs).select(group, F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    words = words.filter(~F.lower("word").isin(STOP_WORDS))
    counts = words.groupBy(group, "word").agg(F.count("*").alias("n"))
    top = top_per_group(counts, [group], [F.col("n").desc(), F.col("word").asc()], k)
    lists = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("top"))
    return lists.select(group, F.array_join(F.transform("top", lambda t: t["word"]), " ").alias("label"))


def extracts(
    scope: DataFrame, text: str, samples: int, tokens: str, per_item: int = 0, total: int = 0
) -> DataFrame:
    """Texts each cluster is labelled from: the most central members within a token budget.

    Either bound may be 0 for none, but not both: a cluster's texts meet in one task later.
    """
    if not samples and not total:
        raise ValueError("give a number of samples or a total of tokens")
    picked = nearest_to_centroid(scope, samples).filter(F.col(text).isNotNull())
    return token_budget(
        picked, ["cluster"], [F.col("centroid_dist").asc_nulls_last(), F.col("ls_index")], tokens, per_item, total
    )


def label_with(
    items: DataFrame, fn: Callable[[list[str]], str], text: str, skip: list[int] | None = None
) -> DataFrame:
    """(cluster, label, label_raw) from one call of a caller's function per cluster.

    ``items`` should come from ``extracts``, which bounds the texts of a cluster. Clusters in
    ``skip`` (noise) keep the label Unclustered.
    """
    keep = skip or []

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cluster = int(pdf["cluster"].iloc[0])
        ordered = pdf.sort_values(["centroid_dist", "ls_index"], na_position="last")
        answer = UNCLUSTERED if cluster in keep else fn(ordered["text"].tolist())
        return pd.DataFrame({"cluster": [cluster], "label_raw": [answer]})

    ready = items.select(F.col("cluster").cast("int"), F.col("ls_index"), "centroid_dist", F.col(text).alias("text"))
    raw = ready.groupBy("cluster").applyInPandas(one, "cluster int, label_raw string")
    return raw.select("cluster", clean_label("label_raw").alias("label"), "label_raw")


def resume_labels(clusters: DataFrame, done: DataFrame) -> DataFrame:
    """Clusters that still need a label."""
    return clusters.join(done.filter("labeled").select("cluster"), "cluster", "left_anti")

"""Reply trees as conversations: root-to-leaf paths by self-joins, ranked, and formatted as one text.

Jump tables double the distance to an ancestor in every round, so a path of length d takes log2(d)
joins. Scores are summed along the way up; each tree gives its best leaves, and the paths of these
leaves alone are enumerated, from the longest jump to the shortest. Everything is DataFrame functions.

A turn is written as

    ### role
    text</turn>

and inside a role or text each backslash, less-than sign and number sign is written as a backslash
and a letter (in a role also a line feed), so no text can hold a mark and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedmap.session import store

OPEN, CLOSE = "### ", "</turn>\n"
_ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"))  # the backslash first, and last on the way back
_ROLE_ESCAPES = (*_ESCAPES, ("\n", "\\n"))


def escape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def chain(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds node and parent to flat conversations: each row answers the row before it."""
    rows = store(rows.withColumn("node", F.monotonically_increasing_id()), "chat-rows")
    w = Window.partitionBy(tree).orderBy(*order, "node")
    # a null tree is no conversation of its own; its rows stand alone
    parent = F.when(F.col(tree).isNotNull(), F.lag("node").over(w))
    links = rows.select(tree, *order, "node").withColumn("parent", parent).select("node", "parent")
    return rows.join(links, "node")


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, node): the nodes of each tree's best root-to-leaf paths, depth from 0 at the root.

    ``nodes`` has tree, node, parent (null at a root) and score (null counts 0). A parent that is not among
    the nodes makes a root. Paths are ranked by the sum of their scores, then by the lowest leaf.
    """
    base = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = base.select(F.col("node").alias("parent"))
    linked = base.filter("parent IS NOT NULL").join(known, "parent", "left_semi").select("node", F.col("parent").alias("up"), "score")
    # each jump row: node -> ancestor `up`, with the scores of node and those passed on the way
    jumps = [store(linked, "jumps")]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        far = last.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("score").alias("more"))
        jumps.append(store(last.join(far, "up").select("node", F.col("far").alias("up"), (F.col("score") + F.col("more")).alias("score")), "jumps"))
    jumps.pop()

    inner = linked.select(F.col("up").alias("node")).distinct()
    leaves = base.join(inner, "node", "left_anti")
    # climb from each leaf, longest jump first: what is left of the way shrinks below the next jump
    climb = leaves.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("total"), F.lit(0).alias("steps"))
    for i in reversed(range(len(jumps))):
        up = jumps[i].select(F.col("node").alias("at"), "up", "score")
        climb = climb.join(up, "at", "left").select(
            "tree", "leaf", F.coalesce("up", "at").alias("at"), (F.col("total") + F.coalesce("score", F.lit(0.0))).alias("total"),
            (F.col("steps") + F.when(F.col("up").isNotNull(), 2**i).otherwise(0)).alias("steps"),
        )
    roots = base.select(F.col("node").alias("at"), F.col("score").alias("own"))
    scored = climb.join(roots, "at").select("tree", "leaf", "steps", (F.col("total") + F.col("own")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    best = store(scored.withColumn("rank", rank).filter(F.col("rank") <= per_tree).select("tree", "leaf", "rank", "steps"), "leaves")

    path = best.withColumn("node", F.col("leaf")).withColumn("depth", F.col("steps"))
    for i in reversed(range(len(jumps))):
        up = jumps[i].select("node", "up")
        higher = path.join(up, "node").select("tree", "leaf", "rank", "steps", F.col("up").alias("node"), (F.col("depth") - 2**i).alias("depth"))
        path = store(path.unionByName(higher), "paths")
    return path.select("tree", "leaf", "rank", "depth", "node")


def format_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): one text per path; spans of assistant texts in code points, end exclusive.

    ``nodes`` has node, role and text; a null text or role is empty.
    """
    turns = paths.join(nodes.select("node", "role", "text"), "node")
    role = escape(F.coalesce(F.col("role"), F.lit("")), _ROLE_ESCAPES)
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), role, F.lit("\n"))).withColumn("body", escape(F.coalesce(F.col("text"), F.lit(""))))
    size = F.length("head") + F.length("body") + len(CLOSE)
    above = Window.partitionBy("leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size.cast("long")).over(above), F.lit(0)) + F.length("head")
    turn = F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), (F.col("role") == "assistant").alias("learn"), "start", (F.col("start") + F.length("body")).alias("end"))
    grouped = turns.withColumn("start", start).groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    learnt = F.filter("turns", lambda t: t["learn"])
    return grouped.select(
        "tree", "leaf", "rank",
        F.array_join("turns.piece", "").alias("formatted"),
        F.transform(learnt, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
    )


def read_turns(formatted) -> Column:
    """Array of (role, text) read back from a formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    cut = lambda p: F.instr(p, "\n")

    def turn(p: Column) -> Column:
        role = F.substring(p, F.lit(len(OPEN) + 1), cut(p) - (len(OPEN) + 1))
        return F.struct(unescape(role, _ROLE_ESCAPES).alias("role"), unescape(F.substring(p, cut(p) + 1, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: str, spans: str) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def format_conversations(rows: DataFrame, tree: str = "conv_id", order: str = "turn", per_tree: int = 1) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) formatted, one row each: tree, leaf, rank, formatted, loss_spans.

    Rows go by turn; ties go by role and text, nulls first, then in any order. A null text is empty.
    Rows of a null conv_id are conversations of one turn. Other columns are not read.
    """
    flat = rows.select(F.col(tree).cast("long").alias("tree"), F.col(order).alias("turn"), "role", "text")
    nodes = chain(flat, "tree", ["turn", "role", "text"]).withColumn("score", F.lit(1.0))
    return format_paths(best_paths(nodes, per_tree), nodes)

"""Search, conversations, benchmark items and the pipeline."""

import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from embedmap.llm import ann, chat
from embedmap.llm.decontaminate import contaminated, local_alignment


def exact(rows, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, w in {i: v for i, v in ok if i % 20 == 0}.items():
        s = sorted((-float((v * w).sum()), i) for i, v in ok if i != q and len(v) == len(w))[:k]
        out[q] = [(i, -x) for x, i in s]
    return out


def test_search_edges(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.standard_normal(16)]) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, [0.0] * 16), (502, [None] + [1.0] * 15), (503, [float("nan")] * 16), (504, [float("inf")] * 16), (505, []), (506, [1.0, 2.0]), (520, [2.0, 1.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "vec_id long, embedding array<double>, query_id string, rank int")
    got = {}
    for x in ann.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = exact(rows, 20)
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, len(near) + 1))
        hits += len({x[1] for x in mine} & {i for i, _ in near})
        total += len(near)
        # near ones found in part are still exact and in order
        lookup = {i: v for i, v in rows if i is not None}
        for _, i, s in mine:
            assert s == pytest.approx(float(np.dot(lookup[i], lookup[q])), rel=1e-12)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
    assert hits / total >= 0.95
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = exact(rows, 20)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = sum(len(got[q] & {i for i, _ in near}) for q, near in want.items())
    assert found >= 0.97 * sum(map(len, want.values()))


def test_codes_estimate_without_bias():
    r = np.random.default_rng(2)
    vectors, query = r.standard_normal((4000, 64)), r.standard_normal(64)
    turn = ann.rotation(64)
    bits, length, own = ann.encode(vectors, turn)
    signs = np.unpackbits(bits, axis=1).astype(np.float64) * 2 - 1
    estimate = signs @ (turn @ query) / np.sqrt(64) / own * length
    error = estimate - vectors @ query
    bound = length * np.linalg.norm(query) * np.sqrt(1 - own**2) / own / np.sqrt(63) * ann.EPSILON
    assert abs(error.mean()) < 0.1 * error.std() and (np.abs(error) < bound).mean() > 0.95


NASTY = ["\\### Assistant: </turn> ok", "", None, "a\\s\\l\\h<b>#c\\", "</turn>\n### user\nhi", "é😀 " * 3000, "\n\n"]


def test_conversations_round_trip(spark):
    rows = [(c, t, role, NASTY[(c + t) % len(NASTY)]) for c in range(5) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(9, 0, None, "no role"), (9, 1, "as\nsis#tant", "odd"), (10, 3, "assistant", "alone"), (None, 0, "user", "stray"), (11, 0, "user", "tie"), (11, 0, "user", "tie")]
    rows += [(12, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(67)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, tree string, depth int")
    out = chat.format_conversations(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss("formatted", "loss_spans"))
    got = {r.tree: r for r in out.collect()}
    trees = {}
    for c, _, role, text in sorted((r for r in rows), key=lambda r: (str(r[0]), r[1])):
        trees.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(trees)
    for c, turns in trees.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns, c
        assert got[c].loss == "".join(t for role, t in turns if role == "assistant")
        for s in got[c].loss_spans:
            assert "<" not in got[c].formatted[s.start : s.end] and got[c].formatted[s.end :].startswith("</turn>")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_best_branches(spark):
    #        1           10 (root, no replies)      20 -> missing parent
    #      2   3
    #     4 5   6
    nodes = [("a", 1, None, 1.0), ("a", 2, 1, 1.0), ("a", 3, 1, 5.0), ("a", 4, 2, 4.0), ("a", 5, 2, 4.0), ("a", 6, 3, 0.5), ("b", 10, None, None), ("b", 20, 99, 3.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    paths = {}
    for r in chat.best_paths(df, per_tree=3).collect():
        paths.setdefault((r.tree, r["rank"]), []).append((r.depth, r.node))
    got = {k: [n for _, n in sorted(v)] for k, v in paths.items()}
    assert got == {("a", 1): [1, 3, 6], ("a", 2): [1, 2, 4], ("a", 3): [1, 2, 5], ("b", 1): [20], ("b", 2): [10]}


def test_alignment_is_smith_waterman():
    r = random.Random(4)
    for _ in range(60):
        text, item = ([r.choice("abcd") for _ in range(r.randint(0, 30))] for _ in range(2))
        if item:
            code = lambda ws: np.array([ord(w) for w in ws], np.int64)
            assert local_alignment(code(text), code(item))[0] / (2 * len(item)) == brute.alignment(text, item)


def test_contaminated_edges(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("bcdfgkl") + r.choice("aeiou") for _ in range(3))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(1, say(40)), (2, say(12)), (3, say(2)), (4, None), (5, ""), (6, say(30)), (None, say(20)), (1 << 40, say(25))]
    text = dict(items)
    edited = " ".join(word() if i % 6 == 5 else w for i, w in enumerate(text[1].split()))
    docs = [
        (10, say(50) + " " + text[1].upper().replace(" ", ", ") + " " + say(30)),
        (11, say(20) + " " + edited),
        (12, text[3] + " " + say(9)),
        (13, say(300)),
        (14, None),
        (15, ""),
        (16, say(4000) + " " + text[2] + " " + text[6] + " " + say(4000)),
        (17, " ".join(text[1].split()[:8])),
        (10, say(50) + " " + text[1]),
        (None, text[2]),
        (18, text[None]),
    ]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, item_id string, words string")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, grams string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(df, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 3), (16, 2), (16, 6), (None, 2), (18, None)}
    assert got[10, 1] == 1.0 and got[11, 1] == pytest.approx(brute.alignment(edited.split(), text[1].split()))
    assert contaminated(df, bench.limit(0)).count() == 0 and contaminated(df.limit(0), bench).count() == 0


def test_contaminated_finds_edited_copies_beside_verbatim_ones(spark):
    """Seeds that several copies share are those by which an edited copy is found."""
    item = [f"w{i}" for i in range(40)]
    edited = [f"x{i}" if i % 4 == 3 else w for i, w in enumerate(item)]
    docs = [(1, " ".join(item)), (2, "before " + " ".join(edited) + " after"), (3, " ".join(item)), (4, "nothing of it")]
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, docs[0][1])], "item_id long, text string")).collect()}
    assert got == pytest.approx(brute.leaks(docs, [(7, docs[0][1])])) and set(got) == {(1, 7), (2, 7), (3, 7)}


def test_contaminated_is_brute_force_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, items).collect()}
    want = brute.leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == pytest.approx(want)


def test_pipeline_is_brute_force(spark, sf):
    import corpus_pipeline

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]  # the table's texts are all in a learnt language
    docs = [(i, kept, s) for (i, _, s), (_, _, kept) in zip(docs, brute.without_boilerplate(docs, 8, fold_copies=True), strict=True)]
    group = brute.components([(i, t) for i, t, _ in docs], 5, 80)
    docs = [(i, t) for i, t, _ in docs if group[i][1] == i]
    leaked = {i for i, _ in brute.leaks(docs, items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in docs:
        if i not in leaked:
            ids = library.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_pipeline_line_stage_takes_lines_from_every_text(spark, sf):
    """Short pages of cross-site lines lose them; a page copied to many sites keeps its own."""
    import corpus_pipeline

    shared, page = ["Accept all cookies", "Subscribe to the newsletter", "Back to the top"], "a page\nof lines\nof its own"
    rows = [(i, "\n".join([f"own {i}", *shared]), f"s{i}") for i in range(10)] + [(20 + i, page, f"s{i}") for i in range(10)]
    # nine texts of one site, one of which is copied to nine others
    rows += [(40 + i, f"text {i}\nof one site", "s0") for i in range(9)] + [(60 + i, "text 0\nof one site", f"s{i}") for i in range(1, 10)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: f"own {i}" if 0 < i < 10 else t for i, t, _ in rows}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, sf).collect()} == want
    plain = [(i, t, s) for i, t, s in rows]
    assert {i: text for (i, _, _), (_, _, text) in zip(rows, brute.without_boilerplate(plain, 8, fold_copies=True), strict=True)} == want
    # without folding, the copied page would be taken apart
    assert brute.without_boilerplate(plain, 8)[11][1] == 3


def test_pipeline_edges(spark, sf):
    import corpus_pipeline

    text = "the cat sat on the mat and looked at the dog that ran over the hill in the rain "
    rows = [(1, text * 3, "en", "a", 1, "x"), (2, text * 3, "en", "b", 1, "x"), (3, None, "en", "c", 1, "x"), (4, "", None, None, None, None), (None, text, "en", "a", 1, "x"), (1, text * 3, "en", "a", 1, "x"), (5, "... 123", "en", "a", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string"
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "id"]
        left = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert sorted(str(r.doc_id) for r in left.collect()) == (["1", "1", "None"] if given else [])


@pytest.mark.parametrize("name", ["op2", "op4", "op6", "op9", "op10"])
def test_query_against_sql(spark, sf, name):
    import duckdb

    from embedmap.llm import queries  # noqa: F401
    from embedmap.llm.tables import QUERIES, SQL

    full = next(q for q in QUERIES if q.startswith(name + "_"))
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[full](spark, sf)
    cols = sorted(got.columns)
    rel = con.sql(SQL[full])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_every_operator_is_registered():
    from embedmap.llm import queries  # noqa: F401
    from embedmap.llm.tables import QUERIES

    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10


def test_contaminated_reaches_over_inserted_words_and_long_items(spark):
    rng = np.random.default_rng(11)
    item = [f"w{i}" for i in range(40)]
    # the first three words, then every further word behind an inserted one
    spread = item[:3] + [x for i, w in enumerate(item[3:]) for x in (f"in{i}", w)]
    longer = [f"v{i}" for i in range(130)]
    noise = lambda n: [f"z{x}" for x in rng.integers(0, 500, n)]
    docs = [
        (1, " ".join(noise(90) + spread + noise(90))),
        (2, " ".join(noise(40) + spread[::-1] + noise(30))),
        (3, " ".join(noise(10) + longer[20:110] + noise(5) + item)),
        (4, " ".join(noise(200) + [x for i in range(0, 130, 3) for x in (*longer[i : i + 3], "gap")])),
        (5, " ".join(noise(300))),
    ]
    items = [(1, " ".join(item)), (2, " ".join(longer))]
    frames = [spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(*frames).collect()}
    assert got == pytest.approx(brute.leaks(docs, items)) and got[1, 1] == 0.5375


def test_common_seeds_bring_what_rare_ones_do_not(spark):
    item = "one of the best known things of all the many that there are"
    docs = [(i, f"one of the {i} others {i}") for i in range(80)] + [(100, item), (101, "one of the best x known y things of all z many that there are")]
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "one of the")], "item_id long, text string")]
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(*frames).collect()}
    assert got == pytest.approx(brute.leaks(docs, [(1, item), (2, "one of the")])) and len(got) == 84

"""Spelling variants against a brute-force version."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from embedmap.llm import variants


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def found(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize(("bands", "block"), [(1, 3), (3, 4), (3, 512), (5, 2)])
def test_equals_brute_force(spark, bands, block):
    rng = np.random.default_rng(7)
    words = {"".join(rng.choice(list("abé"), n)) for n in rng.integers(5, 9, 260)} | {"a" * n for n in range(5, 14)}
    words |= {"ab" * 40, "ab" * 40 + "a", "ab" * 20 + "x" + "ab" * 20, "z" * 9_000, "z" * 9_001, "z" * 4_000 + "y" + "z" * 5_000}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.integers(3, 60, len(words)), strict=True)}
    table = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string").repartition(5)
    got = variants.spelling_variants(table, bands=bands, block=block).collect()
    assert len(got) == len(counts) and found(got) == brute(counts)


def test_rows_of_a_word_are_added_and_nulls_left_out(spark):
    rows = [("apple", 2), ("apple", 2), ("appel", 1), ("aple", 50), ("aaple", 3), (None, 9), ("apples", None), ("applé", 2), ("", 7)]
    got = found(variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect())
    assert got == {"apple": (None, "apple", 4, 1, None), "aaple": (None, "aaple", 3, 1, None)}
    with pytest.raises(ValueError, match="end"):
        variants.spelling_variants(spark.createDataFrame(rows, "word string, n long"), times=1)


def test_ties_go_to_the_smallest_and_chains_are_followed(spark):
    rows = [("aaaaa", 3), ("aaaab", 6), ("aaaac", 6), ("aaabb", 12), ("aabbb", 24), ("aacab", 6)]
    got = found(variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect())
    assert got["aaaaa"][:2] == ("aaaab", "aabbb") and got["aaaab"][:2] == ("aaabb", "aabbb") and got["aaaac"][:2] == (None, "aaaac")


def test_empty_table(spark, make):
    assert variants.spelling_variants(variants.run_counts(make([]), 97)).collect() == []
    assert variants.spelling_variants(variants.run_counts(make([(1, None), (2, ""), (None, "12 34")]), 97)).collect() == []


def test_runs_and_planted_errors(spark, make, monkeypatch):
    monkeypatch.setattr(variants, "TASK_WORDS", 20)
    rng = np.random.default_rng(9)
    alphabet = list("abcDEFéÀ×÷ÿß") + [" ", "-", "日", "1", "ā"]
    rows = [(i, "".join(rng.choice(alphabet, 400))) for i in range(60)] + [(None, "abcdef " * 50), (5, None), (6, ""), (7, "q" * 70_000), (7, "q" * 70_000)]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 7 == 0 else run
            want[word] += len(word) >= 5
    got = variants.run_counts(make(rows).repartition(3), cut_every=7).collect()
    assert {r.word: r.n for r in got} == {w: n for w, n in want.items() if n}

"""Collocations against a brute-force version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from embedmap.llm import collocations


def brute(docs, top, min_count, share):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * b >= share * a for b in inside):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def mined(frame, **more):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[x] for x in names) for r in collocations.collocations(frame, **more).collect())


def planted(seed, n):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "of", "é", "Ü", "x-y", "日", "a1", "b c", "zed"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\r\n"]
    docs = []
    for i in range(n):
        text = "".join(w + e for w, e in zip(rng.choice(words, 40, p=np.arange(1, 11) / 55), rng.choice(ends, 40), strict=True))
        docs.append(((None, "en", "en", "und", "fr")[i % 5], text + (" one fixed phrase" if i % 3 else " fixed phrase")))
    return docs


@pytest.mark.parametrize(("top", "start", "share"), [(3, 1, 50), (7, 2, 30), (40, 1, 80), (5_000, 2, 50)])
def test_equals_brute_force_whatever_the_rounds(spark, monkeypatch, top, start, share):
    monkeypatch.setattr(collocations, "START", start)
    monkeypatch.setattr(collocations, "DEEPER", 2)
    docs = planted(top, 60) + [("en", None), ("en", ""), (None, "   "), ("fr", "word " * 3_000), ("en", "x" * 5_000 + " y")]
    frame = spark.createDataFrame([(d, t, "c") for d, t in docs], "lang string, text string, phrase string").repartition(4)
    assert mined(frame, top=top, min_count=3, share=share) == brute(docs, top, 3, share)


def test_later_rounds_are_needed_and_taken(spark, monkeypatch):
    monkeypatch.setattr(collocations, "START", 1)
    seen = []
    real = collocations._expanded
    monkeypatch.setattr(collocations, "_expanded", lambda *args: seen.append(1) or real(*args))
    # the best pairs all lie inside triples with them, which score less
    docs = [("en", f"p{i} q{i} r{i}") for i in range(20) for _ in range(4)] + [("en", f"r{i}") for i in range(20) for _ in range(9)] + [("en", "u v")] * 4
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert mined(frame, top=10, min_count=4, share=50) == brute(docs, 10, 4, 50) and len(seen) > 1


def test_small_tasks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TASK_KEYS", 50)
    monkeypatch.setattr(collocations, "TASK_ROWS", 20)
    docs = planted(1, 40)
    assert mined(spark.createDataFrame(docs, "lang string, text string"), top=20, min_count=3) == brute(docs, 20, 3, 50)


def test_empty_tables(spark, make):
    assert mined(make([])) == [] and mined(make([(1, None), (2, ""), (3, "once only")])) == []


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 3_000_000_000)], "a long, l long, r long")
    assert rows.select(collocations._floor(("a", "a"), ("l", "r"))).first()[0] == 10**6 * 3_000_000_000**2 // (3_000_000_001 * 3_000_000_000)

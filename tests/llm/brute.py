"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = "[\x20\x09-\x0d]+"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return [w for w in re.split(SPACE, text or "") if w]


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, size: int) -> frozenset:
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def components(rows: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (shingles, component)."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def without_repeats(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    """(words, removed, kept) of each text."""
    cut = [words(t) for t in texts]
    starts = defaultdict(list)
    for i, w in enumerate(cut):
        for p in range(len(w) - window + 1):
            starts[tuple(w[p : p + window])].append((i, p))
    gone = [set() for _ in cut]
    for places in starts.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + window))
    return [(len(w), len(g), " ".join(x for j, x in enumerate(w) if j not in g)) for w, g in zip(cut, gone, strict=True)]


def without_boilerplate(rows: list[tuple[int | None, str | None, str | None]], min_sites: int, fold_copies: bool = False) -> list[tuple[int, int, str | None]]:
    """(lines, removed, text) of each (id, text, site); with ``fold_copies`` equal texts count on the site of the lowest id."""
    sites, first, home = defaultdict(set), {}, {}
    for i, text, site in rows:
        if site is not None:
            home[text] = min(home.get(text, (True, float("inf"), chr(0x10FFFF))), (i is None, i or 0, site))
    if fold_copies:
        rows = [(i, text, None if site is None else home[text][2]) for i, text, site in rows]
    for i, text, site in rows:
        for p, line in enumerate(text.split("\n") if text is not None else []):
            if line:
                if site is not None:
                    sites[line].add(site)
                place = (i is None, i, p) if i is not None else (True, 0, p)
                first[line] = min(first.get(line, place), place)
    out = []
    for i, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        keep = []
        for p, line in enumerate(lines):
            place = (i is None, i, p) if i is not None else (True, 0, p)
            if not line or len(sites[line]) < min_sites or place == first[line]:
                keep.append(line)
        kept = "\n".join(keep) if text is not None else None
        out.append((len(lines), len(lines) - len(keep), kept))
    return out


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def alignment(text: list[str], item: list[str]) -> float:
    """Smith-Waterman with 2 for a match, -1 for a mismatch or gap, over the item's full score."""
    best, above = 0, [0] * (len(item) + 1)
    for word in text:
        row = [0]
        for j, other in enumerate(item):
            row.append(max(0, above[j] + (2 if word == other else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best / (2 * len(item))


def leaks(docs: list[tuple[int, str]], items: list[tuple[int, str]], n: int = 3, least: float = 0.5) -> dict[tuple[int, int], float]:
    """Pairs that share any n-gram and align well, whatever the n-gram's rarity."""
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}
    held = [(k, plain_words(t)) for k, t in items]
    out = {}
    for i, text in docs:
        w = plain_words(text)
        own = Counter(grams(w))
        for k, item in held:
            if item and grams(item) & own.keys():
                score = alignment(w, item)
                if score >= least:
                    out[i, k] = score
    return out


def language_entropies(training: list[tuple[str, str]], texts: list[str], order: int = 4) -> list[dict[str, float]]:
    """Nats a character of each text under interpolated Kneser-Ney models of each language."""

    def grams(text: str) -> list[str]:
        out, run = [], " "
        for ch in re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " ":
            run = (run + ch)[-order:]
            out.append(run.rjust(order))
            run = " " if ch == " " else run
        return out if text.strip() else []

    langs = sorted({lang for lang, _ in training})
    levels = {}
    for lang in langs:
        raw = Counter(g for other, t in training if other == lang for g in grams(t))
        types = raw
        for n in range(order, 0, -1):
            ones, twos = sum(c == 1 for c in types.values()), sum(c == 2 for c in types.values())
            d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95)
            total, kinds = Counter(), Counter()
            for g, c in types.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            levels[lang, n] = types, d, total, kinds
            left, seen = Counter(g[1:] for g in types), Counter()
            for g, c in raw.items():
                seen[g[order - n + 1 :]] += c
            types = {g: seen[g] if n - 1 > 1 and g[0] == " " else c for g, c in left.items()}
    alphabet = 1 + len({g for lang in langs for g in levels[lang, 1][0]})

    def probability(lang: str, g: str) -> float:
        if not g:
            return 1 / alphabet
        types, d, total, kinds = levels[lang, len(g)]
        low = probability(lang, g[1:])
        if not total[g[:-1]]:
            return low
        return max(types.get(g, 0) - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * low

    return [{lang: -sum(math.log(probability(lang, g)) for g in grams(t)) / max(len(grams(t)), 1) for lang in langs} for t in texts]

"""Secret spans: fixed patterns, and strings that a token vocabulary finds hard to spell.

Natural words and identifiers are common in the data a vocabulary was made from and take few tokens;
random strings take about one token for every two characters or less. Digests of known lengths,
universally unique ids and plain identifiers are no secrets and are left out of that test.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.llm.words import Slice, arrow_rows, slices

# fixed values: the base kinds, in their order, with their patterns and least lengths
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# fixed values: lengths of MD5, SHA-1 and SHA-2 digests in hexadecimal digits
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
LEAST = 20  # characters of a string whose efficiency is tested
RATIO = 2.2  # characters a token, below which a string counts as random

RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
_PART = re.compile(rf"[^/=]{{{LEAST},}}")
_HEX_ANY = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_IDENTIFIER = re.compile(r"[0-9]+|([A-Z]?[a-z]+|[A-Z]+)+[0-9]{0,4}")


def _class(pattern: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(pattern)] = True
    return found


_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUN_CLASS, _HEX_CLASS = _class(_ALNUM + b"+/_=-"), _class(b"0123456789abcdef")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _texts_with_runs(part: Slice, members: np.ndarray, least: int) -> set[int]:
    """Texts that hold a run of at least ``least`` bytes of a class."""
    data = np.insert(part.data, part.bounds[1:], 0)  # a run ends with its text
    starts = part.bounds + np.arange(len(part.bounds))
    breaks = np.concatenate(([-1], np.flatnonzero(~members[data])))
    runs = breaks[:-1][np.diff(breaks) > least]
    return set((np.searchsorted(starts, runs + 1, "right") - 1).tolist())


def _texts_with(part: Slice, data: bytes, word: bytes) -> Iterator[int]:
    bounds, at = part.bounds.tolist(), data.find(word)
    while at >= 0:
        i = bisect_right(bounds, at) - 1
        yield i
        at = data.find(word, bounds[i + 1])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern kinds; whole matches, leftmost first in each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def is_known(run: str) -> bool:
    """Digests, unique ids, numbers and identifiers made of words."""
    if _HEX_ANY.fullmatch(run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run):
        return True
    # words of mixed case are cut at every change, so many short ones are no identifier
    parts = [p for p in re.split(r"[+/_=-]", run) if p]
    cuts = sum(len(re.findall(r"[A-Z]?[a-z]+|[A-Z]+", p)) for p in parts)
    return all(_IDENTIFIER.fullmatch(p) for p in parts) and cuts * 3 <= len(run)


class Vocabulary:
    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def hard_to_spell(self, run: str) -> bool:
        return len(run) < RATIO * len(self.encoding.encode_ordinary(run))


def all_spans(text: str, vocabulary: Vocabulary) -> list[tuple[int, int, int]]:
    """Base spans, and random strings that touch none of them: whole runs, else their parts between / and =."""
    found = base_spans(text)
    taken = [(a, b) for a, _, b in found]

    def random(a: int, b: int) -> bool:
        run = text[a:b]
        return all(d <= a or b <= c for c, d in taken) and not is_known(run) and vocabulary.hard_to_spell(run)

    for m in RUN.finditer(text):
        if random(m.start(), m.end()):
            found.append((m.start(), 3, m.end()))
            continue
        for part in _PART.finditer(text, m.start(), m.end()):
            if part.end() - part.start() < m.end() - m.start() and random(part.start(), part.end()):
                found.append((part.start(), 3, part.end()))
    return sorted(found)


_LOADED: dict[str, Vocabulary] = {}


def secret_spans(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) of every row; spans are (kind, start, end) in code points, end exclusive.

    Ordered by start, then kind as listed in ``KINDS``. Null and empty texts have no spans, repeated
    rows stay rows, null ids stay null, other columns are not read. Only texts that hold a keyword
    or a long enough run are looked at closely. The vocabulary file is read once, on the driver.
    """
    with open(vocabulary_path, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _LOADED:
            _LOADED[vocabulary_path] = Vocabulary(source.value, pattern)
        vocabulary = _LOADED[vocabulary_path]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part in slices(batch.column(1)):
                low = _LOWER[part.data].tobytes()
                close = {i for w in KEYWORDS for i in _texts_with(part, low, w)}
                close.update(_texts_with(part, part.data.tobytes(), b"AKIA"))
                close |= _texts_with_runs(part, _HEX_CLASS, HEX_LEAST) | _texts_with_runs(part, _RUN_CLASS, LEAST)
                spans = [
                    [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(part.text_of(i).tobytes().decode("utf-8", "replace"), vocabulary)]
                    if i in close
                    else []
                    for i in range(part.hi - part.lo)
                ]
                yield pa.record_batch([batch.column(0).slice(part.lo, part.hi - part.lo), pa.array(spans, pa.list_(kind))], names=["id", "spans"])

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = arrow_rows(found, rows, "id long, spans array<struct<kind string, start long, end long>>")
    return found.withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) from the operator's output."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = joined(F.filter("spans", lambda s: s["kind"] != "token"))
    return found.select(id_col, *[of(k) for k in KINDS[:3]], F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

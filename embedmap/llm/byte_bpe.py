"""Byte-level BPE by recursive DuckDB queries, one database in memory per task.

The vocabulary is two tables: tokens, and merges, the pairs of tokens whose bytes together are a
token. The distinct pieces of a slice of texts become rows of (word, position, token). A recursive
query joins neighbours with the merges and contracts the leftmost pair of lowest rank in each word,
until no word has a pair left; ordered aggregation then gives each word's ids and the bytes they
decode to. Pieces never merge with each other, so a text's ids and bytes are those of its pieces.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.llm.words import arrow_rows, slices

SLICE = 4 << 20  # bytes of text whose distinct pieces go into the tables together
KNOWN_PIECES = 400_000  # encodings a worker remembers; only memory and speed depend on it
STATE_ROWS = 6_000_000  # rows that one query may go through: half the square of a piece's length, summed
LONG_PIECE = 512  # longer pieces in bytes are contracted in place, as a word's states take the square of it

# white space as Unicode has it, whatever the library's own notion is
_SPACE, _OTHER = r"\p{White_Space}", r"\P{White_Space}"
# fixed values: the letters, numbers and spaces among the first 256 code points
_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \u0085 "

CONTRACT = """
WITH RECURSIVE state(step, word, pos, tok) AS (
    SELECT 0, word, pos, tok FROM base
    UNION ALL
    SELECT * FROM (
        WITH found AS (
            SELECT l.word, min((m.id::BIGINT << 32) | l.pos) AS best
            FROM state l JOIN state r ON r.word = l.word AND r.pos = l.pos + 1 JOIN merges m ON m.a = l.tok AND m.b = r.tok
            GROUP BY l.word),
        pick AS (SELECT word, (best & 4294967295)::INT AS at, (best >> 32)::INT AS id FROM found)
        SELECT s.step + 1, s.word, CASE WHEN s.pos > p.at THEN s.pos - 1 ELSE s.pos END, CASE WHEN s.pos = p.at THEN p.id ELSE s.tok END
        FROM state s JOIN pick p ON s.word = p.word WHERE s.pos <> p.at + 1)),
ended AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT word, list(tok ORDER BY pos) AS ids, from_hex(string_agg(t.hex, '' ORDER BY pos)) AS raw
FROM state JOIN ended USING (word, step) JOIN tokens t ON t.id = state.tok GROUP BY word ORDER BY word"""


def read_ranks(source: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, source.splitlines()))}


class PieceCoder:
    """Pieces to ids and decoded bytes; holds the vocabulary's tables in a database of its own."""

    def __init__(self, source: bytes, pattern: str):
        self.ranks = read_ranks(source)
        items = self.ranks.items()
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in items for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.merges = {(a, b): r for a, b, r in pairs}
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        columns = np.array(pairs, np.int32).reshape(-1, 3).T
        self._table("merges", {k: pa.array(c) for k, c in zip("a b id".split(), columns, strict=True)})
        self._table("tokens", {"id": pa.array(self.ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks])})
        self.byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        self.pattern = regex.compile(pattern.replace(r"\S", _OTHER).replace(r"[^\s", "[^" + _SPACE).replace(r"\s", _SPACE))
        narrow = pattern.replace(r"[^\s", "[^" + _BLANK).replace(r"\S", f"[^{_BLANK}]").replace(r"\s", f"[{_BLANK}]")
        narrow = re.sub(r"\[\^([^]]*)\]", lambda m: "[^" + m[1].replace(r"\p{L}", _LETTER).replace(r"\p{N}", _NUMBER) + "]", narrow)
        narrow = narrow.replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]")
        # texts of the first 256 code points are split by the same pattern in plain classes, where it has such a form
        self.narrow = None if "\\p" in narrow or "(?i" in narrow else re.compile(narrow)
        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}

    def _table(self, name: str, columns: dict) -> None:
        given = pa.table(columns)
        self.con.register("given", given)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def split(self, text: str) -> list[str]:
        if self.narrow is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.pattern.findall(text)
            return self.narrow.findall(text)
        return self.pattern.findall(text)

    def _in_place(self, piece: bytes) -> list[int]:
        """The same contraction of one long piece: a heap of pairs over a linked list."""
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(tok)), -1], list(range(-1, len(tok) - 1))
        heap = [(r, i) for i, pair in enumerate(zip(tok, tok[1:])) if (r := self.merges.get(pair)) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if tok[i] < 0 or j < 0 or self.merges.get((tok[i], tok[j])) != rank:
                continue  # one of the two has changed since
            tok[i], tok[j], after[i] = rank, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := self.merges.get((tok[left], tok[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left))
        return [t for t in tok if t >= 0]

    def _start(self, piece: bytes) -> list[int] | np.ndarray:
        """A piece's tokens at first: itself if it is one, else its bytes."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.byte[np.frombuffer(piece, np.uint8)] if len(piece) <= LONG_PIECE else self._in_place(piece)

    def _contract(self, pieces: list[str], starts: list) -> None:
        sizes = np.fromiter(map(len, starts), np.int64, len(starts))
        first = np.cumsum(sizes) - sizes
        base = {
            "word": pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
            "pos": pa.array((np.arange(int(sizes.sum())) - np.repeat(first, sizes)).astype(np.int32)),
            "tok": pa.array(np.concatenate(starts).astype(np.int32)),
        }
        self.con.register("base", pa.table(base))
        out = self.con.sql(CONTRACT).to_arrow_table().combine_chunks()
        self.con.unregister("base")
        lists = out.column("ids").chunk(0)
        flat = lists.flatten().to_numpy().astype("<u4").tobytes()
        ends = np.cumsum(lists.value_lengths().to_numpy()) * 4
        for piece, a, b, raw in zip(pieces, [0, *ends[:-1].tolist()], ends.tolist(), out.column("raw").to_pylist(), strict=True):
            self.ids[piece], self.raw[piece] = flat[a:b], raw

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Per text its ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""
        split = [self.split(t) for t in texts]
        distinct = set().union(*split)
        if len(self.ids) > KNOWN_PIECES:
            kept = distinct & self.ids.keys()
            self.ids, self.raw = {p: self.ids[p] for p in kept}, {p: self.raw[p] for p in kept}
        pieces, starts, rows = [], [], 0
        for piece in distinct - self.ids.keys():
            start = self._start(piece.encode("utf-8"))
            # pieces contracted already stay as they are and take one row a token
            cost = len(start) if len(start) > LONG_PIECE else len(start) ** 2 // 2 + 1
            if rows and rows + cost > STATE_ROWS:
                self._contract(pieces, starts)
                pieces, starts, rows = [], [], 0
            pieces.append(piece)
            starts.append(start)
            rows += cost
        if pieces:
            self._contract(pieces, starts)
        return [b"".join(map(self.ids.__getitem__, p)) for p in split], [b"".join(map(self.raw.__getitem__, p)) for p in split]


_CODERS: dict[tuple[str, str], PieceCoder] = {}


def _coder(path: str, pattern: str, source: bytes) -> PieceCoder:
    if (path, pattern) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, pattern] = PieceCoder(source, pattern)
    return _CODERS[path, pattern]


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) of every row: ids of the whole text as little-endian unsigned 32-bit integers, and the bytes decoded from them.

    The text is cut by ``pattern``, each match is encoded by itself and strings of special tokens are
    ordinary text. Null and empty texts have no ids and decode to no bytes. Repeated rows stay rows, null
    ids stay null, other columns are not read. At equal rank the leftmost pair goes first. The rank file
    is read once, on the driver, and sent to the tasks; its size is bounded by the vocabulary.
    """
    with open(ranks_path, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern, source.value)
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                texts = [part.text_of(i).tobytes().decode("utf-8", "replace") for i in range(part.hi - part.lo)]
                ids, decoded = coder.encode(texts)
                yield pa.record_batch(
                    [batch.column(0).slice(part.lo, part.hi - part.lo), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    names=["id", "ids", "decoded"],
                )

    found = arrow_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "id long, ids binary, decoded binary")
    return found.withColumnRenamed("id", id_col)


def byte_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) from the operator's output."""
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return encoded.select(id_col, n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

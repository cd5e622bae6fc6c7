"""BPE encoding and decoding by prefix-sharing traversal of a trie of distinct words.

The encoding of a prefix ends in exactly one token: the one that, put behind the encoding of what
is before it, would not have been merged across the seam. So the last token is the whole state of a
prefix. The distinct words of a slice are visited in sorted order, which is the depth-first order
of their trie: the states of a shared prefix stay on the stack and are worked out once. The end of
a word is an edge of its own, as the vocabulary marks it on the last symbol.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.llm.words import arrow_rows, slices

KNOWN_WORDS = 200_000  # encodings a worker remembers; only memory and speed depend on it


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizer file's JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        letters = _byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocab.items():
            closes = token.endswith(self.end)
            raw = bytes(back[c] for c in (token[: -len(self.end)] if closes else token))
            (self.final if closes else self.inner)[raw] = i
        # a suffix that begins no token cannot grow into one
        self.begins = {raw[:n] for raw in chain(self.inner, self.final) for n in range(1, len(raw) + 1)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            self.parts[both], self.born[both] = (a, b), rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # fixed value: the split pattern, as the vocabulary was made with it
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        # the same for texts of ASCII only, in classes that are faster to match
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.seams: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens: composed, lower-cased, white space dropped."""
        if text.isascii():
            return self.plain.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # letters are lowered one by one: no final form
        return self.pattern.findall(text.lower())

    def _holds(self, left: int, right: int) -> bool:
        """True if the seam between two tokens is never merged across.

        The latest merge of the two is undone again and again; the pair then at the seam must not
        have a merge of its own that would have come before it. At one rank the left place is first.
        """
        known = self.seams.get((left, right))
        if known is not None:
            return known
        a, b = left, right
        limit, holds = len(self.rank), True
        while True:
            if self.rank.get((a, b), limit) < limit:
                holds = False
                break
            last_a, last_b = self.born.get(a, -1), self.born.get(b, -1)
            if last_a < 0 and last_b < 0:
                break
            if last_a > last_b:
                limit, a = last_a, self.parts[a][1]
            else:
                limit, b = last_b + 1, self.parts[b][0]
        if len(self.seams) > KNOWN_WORDS:
            self.seams.clear()
        self.seams[left, right] = holds
        return holds

    def _last(self, word: bytes, n: int, reach: int, tokens: dict[bytes, int], stack: list[int]) -> tuple[int, int]:
        """The last token of word[:n], at most ``reach`` long, and its length; the stack holds those of shorter prefixes."""
        for size in range(reach, 0, -1):
            token = tokens.get(word[n - size : n])
            if token is not None and (size == n or self._holds(stack[n - size], token)):
                return token, size
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, distinct: set[str]) -> None:
        """Remember the encodings of the words, sharing the work of common prefixes.

        A state is the last token, its length, and the longest suffix that begins a token.
        """
        stack, sizes, reaches = [0], [0], [0]
        begins, before = self.begins, b""
        for raw, word in sorted((w.encode("utf-8"), w) for w in distinct):
            shared, most = 0, min(len(raw) - 1, len(before), len(stack) - 1)
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del stack[shared + 1 :], sizes[shared + 1 :], reaches[shared + 1 :]
            for n in range(shared + 1, len(raw)):
                reach = reaches[-1] + 1
                while raw[n - reach : n] not in begins:
                    reach -= 1
                token, size = self._last(raw, n, reach, self.inner, stack)
                stack.append(token)
                sizes.append(size)
                reaches.append(reach)
            token, size = self._last(raw, len(raw), reaches[-1] + 1, self.final, stack)
            ids, at = [token], len(raw) - size
            while at:
                ids.append(stack[at])
                at -= sizes[at]
            self.known[word] = tuple(reversed(ids))
            before = raw

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text; strings of special tokens are these tokens."""
        split: list[list[list[str] | int]] = []
        for text in texts:
            if self.specials and "<|" in text or self.specials and not all(s.startswith("<|") for s in self.special):
                pieces = self.specials.split(text)
                split.append([self.special[p] if i % 2 else self.words(p) for i, p in enumerate(pieces)])
            else:
                split.append([self.words(text)])
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        fresh = {w for pieces in split for p in pieces if not isinstance(p, int) for w in p if w not in self.known}
        self.encode_words(fresh)
        of = self.known.__getitem__
        return [list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(of, p)) for p in pieces)) for pieces in split]

    def decode(self, ids: list[int]) -> str:
        """Token strings with a space between, as a file without a decoder has it."""
        return " ".join(map(self.names.__getitem__, ids))


_MODELS: dict[str, WordBpe] = {}


def _model(key: str, source: str) -> WordBpe:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordBpe(source)
    return _MODELS[key]


def bpe_roundtrip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) of every row: token ids of the whole text and the text decoded from them.

    Null and empty texts have no ids and decode to an empty string. Repeated rows stay rows, null ids
    stay null, other columns are not read. The vocabulary file is read once, on the driver, and sent
    to the tasks; its size is bounded by the vocabulary.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer_path, source.value)
        for batch in batches:
            for part in slices(batch.column(1), 1 << 20):  # more words share more prefixes
                texts = [part.text_of(i).tobytes().decode("utf-8", "replace") for i in range(part.hi - part.lo)]
                encoded = model.encode(texts)
                sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
                flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum()))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).slice(part.lo, part.hi - part.lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(map(model.decode, encoded), pa.string())],
                    names=["id", "ids", "decoded"],
                )

    found = arrow_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "id long, ids array<int>, decoded string")
    return found.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) from the operator's output."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

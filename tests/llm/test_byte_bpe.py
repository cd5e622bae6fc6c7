"""Byte-level BPE against the library it must equal."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from embedmap.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(row):
    return np.frombuffer(bytes(row.ids), "<u4").tolist()


def test_equals_the_library_on_the_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = byte_bpe.byte_digests(byte_bpe.byte_bpe(docs, PATH, PATTERN)).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_edges(spark, make, library):
    rng = np.random.default_rng(3)
    letters = "".join(rng.choice(list("etaoinshrdlu"), 3_000))
    texts = [
        None, "", " ", "a", "  two  spaces\t\n end \n", "don't we'LL they're", "<|endoftext|> is text", "Ünï cödé größer ½ x² ªº",
        "日本語のテキスト と emoji 🙂🙂", " \u0085 x　y", "\x1c\x1d a\x1fb", "a" * 5_000, letters, "12345 678,9", "﻿x", "word " * 300_000,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "null id")]
    found = byte_bpe.byte_bpe(make(rows), PATH, PATTERN).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, t in rows:
        assert ids_of(by_id[i]) == library.encode_ordinary(t or "")
        assert bytes(by_id[i].decoded).decode() == (t or "")


def test_pieces_at_the_length_where_the_way_changes(library):
    with open(PATH, "rb") as f:
        coder = byte_bpe.PieceCoder(f.read(), PATTERN)
    rng = np.random.default_rng(5)
    for n in (byte_bpe.LONG_PIECE - 1, byte_bpe.LONG_PIECE, byte_bpe.LONG_PIECE + 1, 3 * byte_bpe.LONG_PIECE):
        for alphabet in ("a", "ab", "the in", "abcdefghijklmnopqrstuvwxyz"):
            text = "".join(rng.choice(list(alphabet.replace(" ", "")), n))
            ids, decoded = coder.encode([text])
            assert np.frombuffer(ids[0], "<u4").tolist() == library.encode_ordinary(text) and decoded[0].decode() == text


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "KNOWN_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "STATE_ROWS", 40)
    with open(PATH, "rb") as f:
        coder = byte_bpe.PieceCoder(f.read(), PATTERN)
    for text in ("one uncommonly long sentence", "another uncommonly longish one", "one uncommonly long sentence again"):
        assert np.frombuffer(coder.encode([text])[0][0], "<u4").tolist() == library.encode_ordinary(text)


def test_empty_table(spark, make):
    assert byte_bpe.byte_digests(byte_bpe.byte_bpe(make([]), PATH, PATTERN)).collect() == []

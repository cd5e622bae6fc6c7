"""Token tables (TOK*): one row per token, numbered across the whole dataset."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from embedmap.functions.scalars import prepare_text
from embedmap.operators.joins import scope_join
from embedmap.operators.ranking import token_offsets
from embedmap.session import spread, store

# fixed values: a default token is a run of letters
LETTER_RUN = r"\p{L}+"
PIECE_BYTES = 2**20  # text whose tokens are held at a time
# numbers that grow from row to row take the bits of their steps
TOKEN_FILES = {"parquet.writer.version": "v2", "compression": "zstd"}


def letter_runs(text: str) -> list[tuple[str, int, int]]:
    """Runs of letters with their spans."""
    return [(m.group(), *m.span()) for m in regex.finditer(LETTER_RUN, text)]


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``PIECE_BYTES`` of text, so that few tokens are Python objects at a time."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // PIECE_BYTES)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def tokenize(
    docs: DataFrame, text: str, tokenizer: Callable[[str], list[tuple[str, int, int]]] = letter_runs,
    prefix: str = "", skip: list[str] | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """(ls_index, token_pos, token_str, char_start, char_end), spans 0-based and half-open.

    ``tokenizer`` returns (token, start, end) triples of a text; tokens in ``skip`` are dropped
    before positions are given. Spans refer to the text without the prefix. Tokens also carry
    their document's columns named in ``keep``, so that they need no join.
    """
    drop, carried = set(skip or []), keep or []

    def run(batches):
        for b in (piece for whole in batches for piece in _pieces(whole, "t")):
            names, starts, ends, sizes = [], [], [], []
            for t in b.column("t").to_pylist():
                kept = [x for x in tokenizer(t) if x[0] not in drop] if drop else tokenizer(t)
                sizes.append(len(kept))
                for name, start, end in kept:
                    names.append(name)
                    starts.append(start)
                    ends.append(end)
            sizes = np.array(sizes, dtype=np.int64)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            doc = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("ls_index").take(doc),
                    pa.array((np.arange(len(names)) - first).astype(np.int32)),
                    pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
                    *[b.column(c).take(doc) for c in carried],
                ],
                names=["ls_index", "token_pos", "token_str", "char_start", "char_end", *carried],
            )

    ready = spread(docs).select(F.col("ls_index").cast("long"), prepare_text(text, prefix).alias("t"), *carried)
    kinds = "".join(f", `{c}` {ready.schema[c].dataType.simpleString()}" for c in carried)
    out = ready.mapInArrow(run, f"ls_index long, token_pos int, token_str string, char_start int, char_end int{kinds}")
    return shift_prefix(out, len(prefix)) if prefix else out


def shift_prefix(tokens: DataFrame, length: int) -> DataFrame:
    """Move spans back by the prefix length; a token inside the prefix has no span."""
    inside = F.col("char_start") < length
    move = lambda c: F.when(inside, -1).otherwise(F.col(c) - length).cast("int")
    return tokens.withColumns({"char_start": move("char_start"), "char_end": move("char_end")})


def _steps(column: pa.Array, back: bool = False) -> pa.Array:
    """Whole numbers as steps from row to row, which pack well, and ``back``; other columns as they are."""
    if not pa.types.is_integer(column.type) or column.null_count:
        return column
    values = column.to_numpy()
    with np.errstate(over="ignore"):
        return pa.array(np.cumsum(values, dtype=values.dtype) if back else np.diff(values, prepend=values.dtype.type(0)))


def _pack(tokens: DataFrame) -> DataFrame:
    """(ls_index, num_tokens, size, rows): consecutive tokens of a document as one compressed value of ``size`` bytes."""

    def run(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            key = b.column("ls_index")
            edge = pc.fill_null(pc.not_equal(key[1:], key[:-1]), True).to_numpy(zero_copy_only=False) if len(key) else []
            first = np.concatenate(([0], np.flatnonzero(edge) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
            rest, sizes, packed = b.drop_columns("ls_index"), [], []
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
                part = rest.slice(lo, hi - lo)
                part = pa.RecordBatch.from_arrays([_steps(c) for c in part.columns], names=part.schema.names)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                raw = sink.getvalue()
                sizes.append(raw.size)
                packed.append(codec.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(first[:-1])), pa.array(np.diff(first)), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                names=["ls_index", "num_tokens", "size", "rows"],
            )

    kind = tokens.schema["ls_index"].dataType.simpleString()
    return tokens.mapInArrow(run, f"ls_index {kind}, num_tokens long, size long, rows binary")


def _unpack(packed: DataFrame, kinds: StructType) -> DataFrame:
    """(token_index, columns of ``kinds``) of packed tokens that carry their document's ``first_token``."""

    def run(batches):
        codec = pa.Codec("zstd")

        def rows(found):
            return pa.Table.from_batches(found).combine_chunks().to_batches()

        for b in batches:
            found, held = [], 0
            for i in range(b.num_rows):
                raw = codec.decompress(b.column("rows")[i].as_buffer(), b.column("size")[i].as_py())
                part = pa.ipc.open_stream(raw).read_next_batch()
                own = dict(zip(part.schema.names, (_steps(c, back=True) for c in part.columns), strict=True))
                own["ls_index"] = b.column("ls_index").take(pa.array(np.full(part.num_rows, i)))
                index = pc.add(own["token_pos"].cast(pa.int64()), b.column("first_token")[i])
                found.append(pa.RecordBatch.from_arrays([index, *[own[c] for c in kinds.names]], names=["token_index", *kinds.names]))
                held += raw.size
                if held > PIECE_BYTES:
                    yield from rows(found)
                    found, held = [], 0
            if found:
                yield from rows(found)

    return packed.mapInArrow(run, StructType([StructField("token_index", LongType()), *kinds.fields]))


def number_tokens(tokens: DataFrame) -> DataFrame:
    """Add the global ``token_index`` in (ls_index, token_pos) order.

    Tokens are stored first, so that a tokenizer runs once for the counts and the rows. They meet their document's
    first number in a hash of the documents, so that the many tokens of a task are never sorted; the tokens of a
    document are stored and travel there as one packed value.
    """
    packed = store(_pack(tokens), "tokens")
    counts = packed.groupBy("ls_index").agg(F.sum("num_tokens").alias("num_tokens"))
    first = token_offsets(counts).select("ls_index", "first_token")
    return _unpack(packed.join(first.hint("shuffle_hash"), "ls_index"), tokens.schema)


def check_token_counts(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(ls_index, expected, got) of documents whose token rows and num_tokens disagree."""
    got = tokens.groupBy("ls_index").agg(F.count("*").alias("got"))
    want = docs.select("ls_index", F.col("num_tokens").cast("long").alias("expected"))
    both = want.join(got, "ls_index", "full")
    both = both.select(
        "ls_index", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("got", F.lit(0)).alias("got")
    )
    return both.filter("expected <> got")


def require_token_counts(docs: DataFrame, tokens: DataFrame) -> None:
    """Raise with the first ten disagreeing documents."""
    wrong = check_token_counts(docs, tokens).orderBy("ls_index").limit(10).collect()
    if wrong:
        raise ValueError("token rows do not match: " + "; ".join(f"{r[0]}: {r[1]} stored, {r[2]} found" for r in wrong))


def token_totals(tokens: DataFrame, rows: Column | None = None) -> DataFrame:
    """One row: number of tokens, of documents, and tokens per document (2 digits)."""
    total, docs = F.count("*"), rows if rows is not None else F.count_distinct("ls_index")
    return tokens.agg(
        total.alias("total_tokens"), docs.alias("rows"),
        F.round(total / F.greatest(docs, F.lit(1)), 2).alias("avg_tokens_per_row"),
    )


def explode_token_vectors(docs: DataFrame) -> DataFrame:
    """(token_index, ls_index, token_pos, vector), one row per token vector."""
    first = token_offsets(docs.select("ls_index", "num_tokens")).select("ls_index", "first_token")
    each = docs.join(first, "ls_index").select(
        "ls_index", "first_token", F.posexplode("token_vectors").alias("token_pos", "vector")
    )
    return each.select((F.col("first_token") + F.col("token_pos")).alias("token_index"), "ls_index", "token_pos", "vector")


def token_lookup(
    tokens: DataFrame, request: DataFrame, key: str = "token_index", columns: list[str] | None = None
) -> DataFrame:
    """Tokens named by index or by document, sorted by token index."""
    found = tokens.join(request.select(key), key, "left_semi").orderBy("token_index")
    return found.select(*columns) if columns else found


def token_scope(projection: DataFrame, clustering: DataFrame, labels: DataFrame, tokens: DataFrame) -> DataFrame:
    """Scope at token level: the row id is the token, with its document and position."""
    base = scope_join(projection, clustering, labels)
    own = tokens.select(
        F.col("token_index").alias("ls_index"), F.col("ls_index").alias("parent_index"), "token_pos", "token_str"
    )
    return base.join(own, "ls_index")

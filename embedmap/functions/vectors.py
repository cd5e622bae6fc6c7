"""Arithmetic on array columns, kept in the JVM with higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from embedmap.functions.common import col

EPS = 1e-10  # guard against zero vectors in token-level normalization


def as_doubles(v) -> Column:
    return col(v).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row.

    Inside a lambda Spark evaluates a captured expression again for every element; a bound
    lambda variable is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v, eps: float | None = None) -> Column:
    """Unit vector. With ``eps`` the norm is padded, otherwise a zero vector gives nulls."""
    pad = F.lit(0.0 if eps is None else eps)
    return let(
        as_doubles(v), lambda w: let(norm(w) + pad, lambda n: F.transform(w, lambda x: F.try_divide(x, n)))
    )


def layer_norm(v, eps: float = 1e-5) -> Column:
    """Zero mean, unit variance per vector."""

    def centered(w: Column) -> Column:
        return let(total(w) / F.size(w), lambda mean: F.transform(w, lambda x: x - mean))

    def scaled(c: Column) -> Column:
        var = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x) / F.size(c)
        return let(F.sqrt(var + F.lit(eps)), lambda sd: F.transform(c, lambda x: x / sd))

    return let(let(as_doubles(v), centered), scaled)


def truncate_dims(v, k: int, eps: float | None = None, layer_normalize: bool = False) -> Column:
    """Keep the first ``k`` dimensions and renormalize."""
    v = layer_norm(v) if layer_normalize else as_doubles(v)
    return l2_normalize(F.slice(v, 1, k), eps)


def truncate_token_vectors(tokens, k: int) -> Column:
    return F.transform(col(tokens), lambda t: truncate_dims(t, k, EPS))


def mean_vector(tokens) -> Column:
    """Mean of a document's token vectors, scaled to unit length."""

    def mean(ts: Column) -> Column:
        zero = F.array_repeat(F.lit(0.0), F.size(ts[0]))
        summed = F.aggregate(ts, zero, lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b))
        return let(F.size(ts), lambda n: F.transform(summed, lambda s: s / n))

    return l2_normalize(let(col(tokens).cast("array<array<double>>"), mean), EPS)

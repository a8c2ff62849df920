"""Vectors as array<float> columns; arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least norm that a vector is divided by, so that a zero vector stays zero.
LEAST_NORM = 1e-12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null for vectors of unequal length."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """The vector (array<double>) at length 1; a zero vector stays zero."""
    return F.transform(_col(v), lambda x: x.cast("double") / F.greatest(norm(v), F.lit(LEAST_NORM)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, from 0 to 2; null if a vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, 1 - dot(a, b) / both)


def to_literal(v: Column | str) -> Column:
    """Text ``[x,y,...]`` with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(_col(v), lambda x: F.format_string("%.6f", x)), ","), F.lit("]"))


def from_literal(text: Column | str) -> Column:
    """array<float> of a text as ``to_literal`` writes it; null if it is none, empty for ``[]``."""
    inner = F.btrim(_col(text), F.lit("[] "))
    return F.when(inner == "", F.array().cast("array<float>")).otherwise(F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<float>"))


def sparse_dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two map<string, float> columns over their shared keys."""
    shared = F.array_intersect(F.map_keys(_col(a)), F.map_keys(_col(b)))
    return F.aggregate(shared, F.lit(0.0), lambda s, k: s + _col(a)[k].cast("double") * _col(b)[k].cast("double"))


def token_id(token: Column | str) -> Column:
    """The whole number of a token: a hash of 64 bits, so that coding needs no look-up; a dictionary of the tokens tells if two share one."""
    return F.xxhash64(_col(token))


def coded(weights: Column | str) -> Column:
    """map<string, float> with tokens as their numbers; raises where two tokens of a map share one."""
    w = _col(weights)
    return F.map_from_arrays(F.transform(F.map_keys(w), token_id), F.map_values(w))

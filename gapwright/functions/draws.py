"""Portable pseudo-random draws.

A draw is plain 64-bit integer arithmetic on keys and a salt, so the same value comes out
of any SQL engine and a row's draw depends on nothing but its own keys: no ordering, no
generator state, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS = 2147483647


def uniform_sql(a: str, b: str, salt: str) -> str:
    """SQL text of a uniform draw in [0, 1) from two integer keys and an integer salt."""
    x0 = f"(({a}) * 7919 + ({b}) * 104729 + ({salt}) * 1299709) % {MODULUS}"
    x1 = f"(({x0}) * 48271 + 11) % {MODULUS}"
    x2 = f"(({x1}) * (({x1}) % 65521 + 1)) % {MODULUS}"
    x3 = f"(({x2}) * 69621 + ({salt})) % {MODULUS}"
    return f"(CAST({x3} AS DOUBLE) / {MODULUS}.0D)"


def with_draws(df: DataFrame, a: str, b: str, salt: str, names: dict[str, int]) -> DataFrame:
    """Add one uniform column per entry of ``names`` (name -> offset on the salt).

    The rounds are separate projections, so each intermediate is computed once and the
    generated code stays small.
    """
    keep = df.columns
    a, b, salt = (f"CAST({v} AS BIGINT)" for v in (a, b, salt))
    first = {k: f"((({a}) * 7919 + ({b}) * 104729 + (({salt}) + {o}) * 1299709) % {MODULUS} * 48271 + 11) % {MODULUS}"
             for k, o in names.items()}
    df = df.select(*keep, *[F.expr(e).alias(f"_r_{k}") for k, e in first.items()])
    second = {k: f"(_r_{k} * (_r_{k} % 65521 + 1)) % {MODULUS}" for k in names}
    df = df.select(*keep, *[F.expr(e).alias(f"_r_{k}") for k, e in second.items()])
    third = {k: f"CAST((_r_{k} * 69621 + ({salt}) + {o}) % {MODULUS} AS DOUBLE) / {MODULUS}.0D" for k, o in names.items()}
    return df.select(*keep, *[F.expr(e).alias(k) for k, e in third.items()])


def well_key(df: DataFrame, well: str = "well") -> Column:
    """Integer identity of a well: the id itself when integral, else its CRC32."""
    if isinstance(df.schema[well].dataType, T.StringType):
        return F.crc32(F.col(well).cast("binary"))
    return F.col(well).cast("bigint")

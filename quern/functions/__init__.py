"""Scalar functions that Spark lacks or names otherwise, as expressions of built-in ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_STEPS = 100


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps over a bounded sequence: 64-bit numbers need 92 at most. null if either is; gcd(0, 0) is 0."""
    start = F.struct(F.abs(a.cast("bigint")).alias("x"), F.abs(b.cast("bigint")).alias("y"))

    def step(s: Column, _: Column) -> Column:
        done = s["y"] == 0
        return F.struct(F.when(done, s["x"]).otherwise(s["y"]).alias("x"), F.when(done, s["y"]).otherwise(F.try_mod(s["x"], s["y"])).alias("y"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_STEPS)), start, step, lambda s: s["x"])
    return F.when(a.isNotNull() & b.isNotNull(), found)


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(int_div(F.abs(a.cast("bigint")), g) * F.abs(b.cast("bigint")))


def date_bin(seconds: int, at: Column, origin: Column | None = None) -> Column:
    """The start of the bin of ``seconds`` that holds ``at``, counted from ``origin`` (1970 by default)."""
    base = F.unix_micros(origin.cast("timestamp")) if origin is not None else F.lit(0)
    width, micros = seconds * 1_000_000, F.unix_micros(at.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros - base, F.lit(width)))


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates; null for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a.cast("bigint"), b.cast("bigint")))


def trunc_number(x: Column, places: int = 0) -> Column:
    scale = 10.0**places
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale

"""Relational operators that Spark SQL has no word for, as compositions of those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, condition: Column, name: str = "_qualify") -> DataFrame:
    """Filter by a window expression."""
    return df.withColumn(name, condition).where(F.col(name)).drop(name)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return qualify(df, at == 1)


def over_groups(value: Column, partition: list[str], order: str, before: int, after: int, df: DataFrame, name: str) -> DataFrame:
    """``value`` aggregated over a GROUPS frame: peers count as one step. A dense rank makes steps into a range."""
    ranked = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    frame = Window.partitionBy(*partition).orderBy("_group").rangeBetween(-before, after)
    return ranked.withColumn(name, value.over(frame)).drop("_group")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int, on: list[str] = ()) -> DataFrame:
    """Rows with ``low <= point < high``: ranges are dealt into bins of ``width``, and bins are joined by hash.

    A range goes to as many bins as it meets, so ``width`` should be near a typical range's length.
    """
    p = points.withColumn("_bin", F.floor(F.col(point) / width).cast("bigint"))
    first, last = F.floor(F.col(low) / width).cast("bigint"), (F.ceil(F.col(high) / width) - 1).cast("bigint")
    r = ranges.where(F.col(high) > F.col(low)).withColumn("_bin", F.explode(F.sequence(first, last)))
    joined = p.join(r, ["_bin", *on])
    return joined.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it: one sort of the union, no pairs."""
    own = [c for c in left.columns if c not in by and c != on]
    absent = [F.lit(None).cast(right.schema[v].dataType).alias(f"_v_{v}") for v in values]
    a = left.select(*by, on, F.lit(1).alias("_side"), *own, *absent)
    b = right.select(*by, on, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own], *[F.col(v).alias(f"_v_{v}") for v in values])
    b = b.withColumn("_row", F.struct(*[F.col(f"_v_{v}") for v in values]))
    a = a.withColumn("_row", F.lit(None).cast(b.schema["_row"].dataType))
    frame = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_row", ignorenulls=True).over(frame)).where("_side = 1")
    return both.select(*by, on, *own, *[F.col(f"_last._v_{v}").alias(v) for v in values])


def equal_multisets(a: DataFrame, b: DataFrame) -> bool:
    """EXCEPT ALL both ways is empty."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def anti_keys(facts: DataFrame, dimension: DataFrame, fact_key: str, key: str) -> DataFrame:
    """Facts without their dimension row."""
    return facts.join(dimension.select(F.col(key).alias(fact_key)).distinct(), fact_key, "left_anti")

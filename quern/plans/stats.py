"""Statistics of a source table, on a numeric axis where a column has one."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicate import EPOCH


@dataclass(frozen=True)
class ColumnStats:
    n_distinct: float = 0.0
    null_frac: float = 0.0
    avg_width: float = 0.0
    histogram: tuple[float, ...] = ()
    common: tuple[tuple[float, float], ...] = ()  # (value, share of all rows)


@dataclass(frozen=True)
class IndexInfo:
    name: str
    columns: tuple[str, ...]
    kind: str = "btree"
    unique: bool = False
    primary: bool = False
    partial: bool = False
    has_expressions: bool = False


@dataclass(frozen=True)
class TableStats:
    row_count: int = 0
    size_bytes: int = 0
    columns: dict[str, ColumnStats] = field(default_factory=dict)


def ordinal(value: object) -> float | None:
    """A value's place on the axis of its column: integers, seconds and days since 1970."""
    if isinstance(value, bool):
        return None
    if isinstance(value, int):
        return float(value)
    if isinstance(value, dt.datetime):
        naive = value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
        return (naive - EPOCH).total_seconds()
    if isinstance(value, dt.date):
        return float((value - EPOCH.date()).days)
    return None


def distinct_of(reported: float, rows: int) -> float:
    """A catalog reports a share of the rows as a negative number."""
    return -reported * rows if reported < 0 else reported


def axis(name: str, kind: T.DataType):
    """The column of ordinals, or None where a type has no axis."""
    c = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    return None


def collect(df: DataFrame, columns: list[str] | None = None, buckets: int = 100, common: int = 20, size_bytes: int | None = None) -> TableStats:
    """Measured in one pass; columns with few distinct values take another two for their common ones."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    quoted = {f.name: F.col("`" + f.name.replace("`", "``") + "`") for f in fields}
    axes = {f.name: at for f in fields if (at := axis(f.name, f.dataType)) is not None}
    shares = [k / buckets for k in range(buckets + 1)]
    sums = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        c = quoted[f.name]
        flat = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        sums.append((F.max(F.lit(0)) if flat else F.approx_count_distinct(c, 0.01)).alias(f"d{i}"))
        sums.append(F.avg(c.isNull().cast("double")).alias(f"n{i}"))
        width = F.octet_length(c.cast("string")) if not flat and not isinstance(f.dataType, T.BinaryType) else F.lit(16)
        sums.append(F.avg(width).alias(f"w{i}"))
        if f.name in axes:
            sums.append(F.percentile_approx(axes[f.name], shares, 10_000).alias(f"h{i}"))
    row = df.agg(*sums).first()
    total, out = row["rows"], {}
    for i, f in enumerate(fields):
        bounds, most, distinct = (), (), float(row[f"d{i}"] or 0)
        if f.name in axes and total:
            bounds = row[f"h{i}"] or ()
            if distinct * 10 <= total:  # otherwise no value is common
                v = df.select(axes[f.name].alias("v")).where("v is not null")
                top = v.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(common).collect()
                # A value is common if it has more than its share among the distinct ones.
                most = tuple((r["v"], r["n"] / total) for r in top if r["n"] > 1.25 * total / max(1.0, distinct))
                if most:
                    bounds = v.where(~F.col("v").isin([x for x, _ in most])).agg(F.percentile_approx("v", shares, 10_000)).first()[0] or ()
        histogram = tuple(bounds) if bounds and bounds[0] != bounds[-1] else ()
        out[f.name] = ColumnStats(distinct, row[f"n{i}"] or 0.0, row[f"w{i}"] or 0.0, histogram, most)
    if size_bytes is None:
        size_bytes = int(total * sum(s.avg_width for s in out.values()))
    return TableStats(total, size_bytes, out)

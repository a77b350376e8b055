"""Non-overlapping ranges of a key, or of a table's pages, that together are the table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SplitPlanMismatch
from .predicate import POSTGRES, Dialect

I64 = (-(2**63), 2**63 - 1)
STRATEGIES = ("none", "keyset", "ctid")


@dataclass(frozen=True)
class Split:
    """Rows with ``lo <= key < hi``; the first split of several also has the rows without a key."""

    index: int
    lo: int | None = None
    hi: int | None = None
    key: str | None = None
    pages: bool = False

    @property
    def split_id(self) -> str:
        return f"split-{self.index}"

    @property
    def whole(self) -> bool:
        return self.lo is None and self.hi is None

    def predicate(self, dialect: Dialect = POSTGRES) -> str | None:
        if self.whole:
            return None
        if self.pages:
            above = f"ctid >= '({self.lo or 0},0)'::tid"
            return above if self.hi is None else f"{above} AND ctid < '({self.hi},0)'::tid"
        name = dialect.ident(self.key)
        if self.index == 0:
            return f"{name} < {self.hi} OR {name} IS NULL"
        return f"{name} >= {self.lo}" + (f" AND {name} < {self.hi}" if self.hi is not None else "")

    def column(self) -> Column | None:
        if self.whole:
            return None
        if self.pages:
            raise ValueError("page ranges exist only at the source")
        c = F.col("`" + self.key.replace("`", "``") + "`")
        if self.index == 0:
            return (c < self.hi) | c.isNull()
        return (c >= self.lo) & (c < self.hi) if self.hi is not None else c >= self.lo


def _cut(low: int, high: int, n: int, key: str | None, pages: bool) -> list[Split]:
    """``n`` even ranges over low..high, or fewer rather than empty ones; both ends are open."""
    width = -(-(high - low + 1) // n)
    starts = list(range(low, high + 1, width))
    return [Split(i, None if i == 0 and not pages else s, starts[i + 1] if i + 1 < len(starts) else None, key, pages) for i, s in enumerate(starts)]


def keyset(low: int | None, high: int | None, n: int, key: str) -> list[Split]:
    """Splits over the key's least and greatest value."""
    if n < 1:
        raise ValueError("partitions must be >= 1")
    if n == 1 or low is None or high is None or low >= high:
        return [Split(0)]
    if not (I64[0] <= low and high <= I64[1]):
        raise ValueError("keyset keys must fit 64 bits")
    splits = _cut(low, high, n, key, False)
    # The first split begins at the least key but is open below: a later, smaller key still has a place.
    return [Split(0, low, splits[0].hi, key), *splits[1:]] if len(splits) > 1 else [Split(0)]


def check_key(schema: T.StructType, key: str) -> None:
    kind = schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"keyset key {key!r} must be an integer column, not {kind}")


def keyset_of(df: DataFrame, key: str, n: int) -> list[Split]:
    """One read of the least and the greatest key."""
    check_key(df.schema, key)
    c = F.col("`" + key.replace("`", "``") + "`").cast("bigint")
    row = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    return keyset(row["lo"], row["hi"], n, key)


def ctid(pages: int, n: int) -> list[Split]:
    """Splits over a heap's pages; the last is open, for pages added later."""
    if n <= 1 or pages <= 1:
        return [Split(0)]
    return _cut(0, pages - 1, n, None, True)


def restore(stored: list[dict], key: str) -> list[Split]:
    """Splits from a checkpoint: bounds must rise without gaps, and each predicate be the one its bounds give."""
    if len(stored) == 1 and not stored[0].get("bounds"):
        return [Split(0)]
    out: list[Split] = []
    for i, x in enumerate(stored):
        b = x.get("bounds") or {}
        lo, hi = b.get("lo"), b.get("hi")
        if x.get("split_id") != f"split-{i}":
            raise SplitPlanMismatch(f"split {i} is stored as {x.get('split_id')!r}")
        if (lo is None and hi is None) or (lo is None and i) or (hi is None and i + 1 < len(stored)) or (lo is not None and hi is not None and hi <= lo):
            raise SplitPlanMismatch(f"split-{i} has no valid range: {lo}..{hi}")
        if out and out[-1].hi != lo:
            raise SplitPlanMismatch(f"split-{i} does not begin where split-{i - 1} ends")
        split = Split(i, lo, hi, key)
        if b.get("predicate") not in (None, split.predicate()):
            raise SplitPlanMismatch(f"the predicate of split-{i} is not that of its bounds")
        out.append(split)
    return out

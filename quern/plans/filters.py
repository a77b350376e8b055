"""Job filters: structured entries and shorthand, lowered to predicates against a schema."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import FilterError
from .predicate import Cmp, Col, IsNotNull, IsNull, Lit, Node, any_of

OPS = ("=", "!=", ">", ">=", "<", "<=", "is_null", "is_not_null")
#: Shorthand is searched for each operator in this order, anywhere in the text.
_SEARCH = ("!=", ">=", "<=", "=", ">", "<")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise FilterError(f"unknown operator {self.op!r} on {self.column!r}")


Entry = Filter | tuple[Filter, ...]  # a tuple is an OR-group


def parse_value(text: str) -> object:
    """Quotes make text; else an integer, a float, a boolean, null, or text."""
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    for kind in (int, float):
        try:
            if "_" not in text:
                return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None}.get(text.lower(), text)


def parse_shorthand(text: str) -> Filter:
    for op in _SEARCH:
        column, found, value = text.partition(op)
        if found:
            if not column.strip():
                raise FilterError(f"no column in {text!r}")
            return Filter(column.strip(), op, parse_value(value.strip()))
    raise FilterError(f"no operator in {text!r}")


def _instant(value: str) -> dt.datetime | None:
    """RFC 3339, or a date alone, in UTC and without an offset."""
    try:
        at = dt.datetime.fromisoformat(value)
    except ValueError:
        return None
    return at.astimezone(dt.UTC).replace(tzinfo=None) if at.tzinfo else at if len(value) == 10 else None


def _literal(f: Filter, kind: T.DataType) -> Lit:
    v = f.value
    if isinstance(v, str) and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = _instant(v)
        if at is None:
            raise FilterError(f"{f.column}: {v!r} is neither RFC 3339 nor YYYY-MM-DD")
        return Lit(at.replace(tzinfo=dt.UTC) if isinstance(kind, T.TimestampType) else at)
    if isinstance(v, str) and isinstance(kind, T.DateType):
        at = _instant(v)
        if at is None:
            raise FilterError(f"{f.column}: {v!r} is no date")
        return Lit(at.date())
    if isinstance(v, int) and not isinstance(v, bool) and isinstance(kind, (T.DoubleType, T.FloatType)):
        return Lit(float(v))
    if isinstance(v, (bool, int, float, str)):
        return Lit(v)
    raise FilterError(f"{f.column}: {v!r} is no filter value")


def lower_one(f: Filter, schema: T.StructType) -> Node:
    """Names are matched as written, case included."""
    if f.column not in schema.names:
        raise FilterError(f"no column {f.column!r}")
    column = Col(f.column)
    if f.op == "is_null" or (f.op == "=" and f.value is None):
        return IsNull(column)
    if f.op == "is_not_null" or (f.op == "!=" and f.value is None):
        return IsNotNull(column)
    if f.value is None:
        raise FilterError(f"{f.column}: null has no order")
    return Cmp(column, "<>" if f.op == "!=" else f.op, _literal(f, schema[f.column].dataType))


def lower(entries: list[Entry], schema: T.StructType) -> list[Node]:
    out = []
    for e in entries:
        group = (e,) if isinstance(e, Filter) else e
        if not group:
            raise FilterError("an OR-group holds no predicate")
        out.append(any_of([lower_one(f, schema) for f in group]))
    return out


def describe(e: Entry) -> str:
    if not isinstance(e, Filter):
        return "(" + " OR ".join(map(describe, e)) + ")" if len(e) > 1 else describe(e[0])
    if e.op in ("is_null", "is_not_null"):
        return f"{e.column} {e.op.replace('_', ' ').upper()}"
    return f"{e.column} {e.op} {json.dumps(e.value)}"

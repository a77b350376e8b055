"""Predicates as values: they become Spark columns or SQL text, and never hold raw SQL."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)
OPERATORS = ("=", "<>", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Dialect:
    """How a source writes names, text casts and binary order."""

    name: str
    quote: str
    text_type: str
    binary_collation: str | None
    backslash_strings: bool = False
    fetch_first: bool = False

    def ident(self, name: str) -> str:
        return self.quote + name.replace(self.quote, self.quote * 2) + self.quote

    def string(self, value: str) -> str:
        if "\0" in value:
            raise ValueError("text with a NUL cannot be written in SQL")
        body = value.replace("'", "''")
        if "\\" not in value:
            return f"'{body}'"
        body = body.replace("\\", "\\\\")
        return f"'{body}'" if self.backslash_strings else f"E'{body}'"

    def limit(self, n: int) -> str:
        return f" FETCH FIRST {max(1, n)} ROWS ONLY" if self.fetch_first else f" LIMIT {n}"

    def collate(self, expr: str) -> str:
        if self.binary_collation is None:
            return expr
        name = self.binary_collation if self.backslash_strings else f'"{self.binary_collation}"'
        return f"({expr} COLLATE {name})"


POSTGRES = Dialect("postgres", '"', "text", "C")
MYSQL = Dialect("mysql", "`", "CHAR", "utf8mb4_bin", backslash_strings=True)
SPARK = Dialect("spark", "`", "string", None, backslash_strings=True)
DERBY = Dialect("derby", '"', "VARCHAR(32672)", None, fetch_first=True)


class Node:
    """A predicate or an operand. ``render`` puts parentheses around everything composed."""

    def column(self) -> Column:
        raise NotImplementedError

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        """SQL text; with ``params``, literals become ``$n`` and are appended there."""
        raise NotImplementedError

    def children(self) -> tuple[Node, ...]:
        return ()

    def columns(self) -> list[str]:
        """Names of the columns, each once, in order."""
        found = [self.name] if isinstance(self, Col) else []
        for c in self.children():
            found += [n for n in c.columns() if n not in found]
        return found

    def __str__(self) -> str:
        return self.render()


@dataclass(frozen=True)
class Col(Node):
    name: str

    def column(self) -> Column:
        return F.col("`" + self.name.replace("`", "``") + "`")

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return dialect.ident(self.name)


@dataclass(frozen=True)
class Lit(Node):
    """bool, int, float, str, datetime (UTC, aware or not) or date."""

    value: bool | int | float | str | dt.datetime | dt.date

    def column(self) -> Column:
        return F.lit(self.value)

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        if params is not None:
            params.append(self.value)
            return f"${len(params)}"
        v = self.value
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, dt.datetime):
            text = v.strftime("%Y-%m-%d %H:%M:%S.%f")
            if dialect is POSTGRES:
                return f"'{text}+00'::timestamptz" if v.tzinfo else f"'{text}'::timestamp"
            return f"TIMESTAMP '{text}'"
        if isinstance(v, dt.date):
            return f"'{v.isoformat()}'::date" if dialect is POSTGRES else f"DATE '{v.isoformat()}'"
        if isinstance(v, float):
            return f"'{v!r}'::float8" if dialect is POSTGRES else f"CAST('{v!r}' AS DOUBLE)"
        return dialect.string(v) if isinstance(v, str) else str(v)


@dataclass(frozen=True)
class Cmp(Node):
    left: Node
    op: str
    right: Node

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown comparison: {self.op}")

    def children(self) -> tuple[Node, ...]:
        return self.left, self.right

    def column(self) -> Column:
        a, b = self.left.column(), self.right.column()
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[self.op]

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return f"({self.left.render(dialect, params)} {self.op} {self.right.render(dialect, params)})"


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node

    def children(self) -> tuple[Node, ...]:
        return self.left, self.right

    def column(self) -> Column:
        return self.left.column() & self.right.column()

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return f"({self.left.render(dialect, params)} AND {self.right.render(dialect, params)})"


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node

    def children(self) -> tuple[Node, ...]:
        return self.left, self.right

    def column(self) -> Column:
        return self.left.column() | self.right.column()

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return f"({self.left.render(dialect, params)} OR {self.right.render(dialect, params)})"


@dataclass(frozen=True)
class Not(Node):
    """Never rewritten to the opposite comparison: NULL stays NULL either way."""

    expr: Node

    def children(self) -> tuple[Node, ...]:
        return (self.expr,)

    def column(self) -> Column:
        return ~self.expr.column()

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return f"(NOT {self.expr.render(dialect, params)})"


@dataclass(frozen=True)
class IsNull(Node):
    expr: Node

    def children(self) -> tuple[Node, ...]:
        return (self.expr,)

    def column(self) -> Column:
        return self.expr.column().isNull()

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return f"({self.expr.render(dialect, params)} IS NULL)"


@dataclass(frozen=True)
class IsNotNull(Node):
    expr: Node

    def children(self) -> tuple[Node, ...]:
        return (self.expr,)

    def column(self) -> Column:
        return self.expr.column().isNotNull()

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return f"({self.expr.render(dialect, params)} IS NOT NULL)"


@dataclass(frozen=True)
class CastText(Node):
    expr: Node

    def children(self) -> tuple[Node, ...]:
        return (self.expr,)

    def column(self) -> Column:
        return self.expr.column().cast("string")

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return f"CAST({self.expr.render(dialect, params)} AS {dialect.text_type})"


@dataclass(frozen=True)
class Binary(Node):
    """Compared by bytes: a collation at the source, and what Spark does anyway."""

    expr: Node

    def children(self) -> tuple[Node, ...]:
        return (self.expr,)

    def column(self) -> Column:
        return self.expr.column()

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return dialect.collate(self.expr.render(dialect, params))


@dataclass(frozen=True)
class Opaque(Node):
    """An expression that only Spark evaluates (IN, LIKE, arithmetic, functions): never translated."""

    text: str
    over: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        return list(dict.fromkeys(self.over))

    def column(self) -> Column:
        return F.expr(self.text)

    def render(self, dialect: Dialect = POSTGRES, params: list | None = None) -> str:
        return f"({self.text})"


def all_of(nodes: list[Node]) -> Node | None:
    return reduce(And, nodes) if nodes else None


def any_of(nodes: list[Node]) -> Node | None:
    return reduce(Or, nodes) if nodes else None

"""Source types as Spark types. What has no exact counterpart is an error, never a guess."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ProjectionError, UnsupportedType

#: PostgreSQL types by name.
_POSTGRES = {
    "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "real": T.FloatType(), "double precision": T.DoubleType(), "boolean": T.BooleanType(),
    "text": T.StringType(), "character varying": T.StringType(), "character": T.StringType(),
    "date": T.DateType(), "timestamp without time zone": T.TimestampNTZType(), "timestamp with time zone": T.TimestampType(),
    "bytea": T.BinaryType(), "json": T.StringType(), "jsonb": T.StringType(), "uuid": T.StringType(), "USER-DEFINED": T.StringType(),
}
#: MySQL types by name, with the unsigned form where it differs.
_MYSQL = {
    "tinyint": (T.ByteType(), T.ShortType()), "smallint": (T.ShortType(), T.IntegerType()), "mediumint": (T.IntegerType(), T.IntegerType()),
    "int": (T.IntegerType(), T.LongType()), "bigint": (T.LongType(), T.DecimalType(20, 0)), "year": (T.ShortType(), T.ShortType()),
    "float": (T.FloatType(),), "double": (T.DoubleType(),), "date": (T.DateType(),), "datetime": (T.TimestampNTZType(),), "timestamp": (T.TimestampNTZType(),),
    "time": (T.DayTimeIntervalType(),), "json": (T.StringType(),), "enum": (T.StringType(),), "set": (T.StringType(),),
    "char": (T.StringType(),), "varchar": (T.StringType(),), "tinytext": (T.StringType(),), "text": (T.StringType(),), "mediumtext": (T.StringType(),), "longtext": (T.StringType(),),
    "binary": (T.BinaryType(),), "varbinary": (T.BinaryType(),), "tinyblob": (T.BinaryType(),), "blob": (T.BinaryType(),), "mediumblob": (T.BinaryType(),), "longblob": (T.BinaryType(),),
}
DEFAULT_NUMERIC = T.DecimalType(38, 10)


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    source_type: str
    nullable: bool = True
    precision: int | None = None
    scale: int | None = None
    udt: str | None = None
    collation: str | None = None


@dataclass(frozen=True)
class TableMeta:
    schema: str
    table: str
    columns: tuple[ColumnMeta, ...]

    def project(self, names: list[str] | None) -> tuple[ColumnMeta, ...]:
        """The columns asked for, in that order; an unknown one is an error."""
        if names is None:
            return self.columns
        known = {c.name: c for c in self.columns}
        if missing := [n for n in names if n not in known]:
            raise ProjectionError(f"{self.schema}.{self.table} has no column {', '.join(missing)}")
        return tuple(known[n] for n in names)

    def at(self, indexes: list[int]) -> tuple[ColumnMeta, ...]:
        if bad := [i for i in indexes if not 0 <= i < len(self.columns)]:
            raise ProjectionError(f"{self.schema}.{self.table} has {len(self.columns)} columns, not {bad}")
        return tuple(self.columns[i] for i in indexes)


def postgres_type(c: ColumnMeta) -> T.DataType:
    if c.source_type == "numeric":
        if c.precision is None:
            return DEFAULT_NUMERIC
        scale = c.scale or 0
        if not 1 <= c.precision <= 38 or not 0 <= scale <= c.precision:
            raise UnsupportedType(f"{c.name}: numeric({c.precision},{scale})")
        return T.DecimalType(c.precision, scale)
    if c.source_type == "ARRAY" and c.udt == "_text":
        return T.ArrayType(T.StringType(), True)
    if c.source_type in _POSTGRES:
        return _POSTGRES[c.source_type]
    raise UnsupportedType(f"{c.name}: {c.source_type}")


def mysql_type(c: ColumnMeta) -> T.DataType:
    """``source_type`` as MySQL writes a column's type, such as ``int unsigned`` or ``decimal(10,2)``."""
    found = re.fullmatch(r"(\w+)\s*(?:\(([^)]*)\))?\s*(unsigned)?.*", c.source_type.lower().strip())
    name, args, unsigned = found.groups() if found else ("", None, None)
    if name == "tinyint" and args == "1":
        return T.BooleanType()
    if name == "bit":
        return T.BooleanType() if args in (None, "1") else T.DecimalType(20, 0)
    if name == "decimal":
        p, s = c.precision or 10, c.scale or 0
        if p > 38:
            raise UnsupportedType(f"{c.name}: decimal({p},{s})")
        return T.DecimalType(p, s)
    if name not in _MYSQL:
        raise UnsupportedType(f"{c.name}: {c.source_type}")
    own = _MYSQL[name]
    return own[-1] if unsigned else own[0]


def schema_of(columns: tuple[ColumnMeta, ...], dialect: str = "postgres", requested: list[str] | None = None) -> T.StructType:
    """Columns without a type are left out, unless they, or all columns, were asked for."""
    mapper = {"postgres": postgres_type, "mysql": mysql_type}[dialect]
    fields = []
    for c in columns:
        try:
            kind = mapper(c)
        except UnsupportedType:
            if requested is None or c.name in requested:
                raise
            continue
        label = "enum" if c.source_type == "USER-DEFINED" and c.udt else "user-defined" if c.source_type == "USER-DEFINED" else c.source_type
        label = "bpchar" if c.source_type == "character" else label
        fields.append(T.StructField(c.name, kind, c.nullable, {"source_type": label} | ({"collation": c.collation} if c.collation else {})))
    return T.StructType(fields)


def selects_as_text(c: ColumnMeta) -> bool:
    return c.source_type in ("json", "jsonb", "uuid", "USER-DEFINED")


def strict_cast(c: Column, kind: T.DataType, name: str) -> Column:
    """A cast that raises for a value the type cannot hold, over-scale decimals included."""
    cast = c.try_cast(kind)
    lost = c.isNotNull() & cast.isNull()
    if isinstance(kind, T.DecimalType):
        lost = lost | (cast.cast("decimal(38,18)") != c.try_cast("decimal(38,18)"))
    message = F.concat(F.lit(f"unsupported value in {name}: "), c.cast("string"))
    return F.when(lost, F.raise_error(message).cast(kind)).otherwise(cast)


def zero_date_checked(c: Column, marker: Column, name: str) -> Column:
    """A temporal column whose marker ``(col = 0)`` says that the source holds a zero date."""
    return F.when(marker, F.raise_error(F.lit(f"zero date in {name}")).cast("date")).otherwise(c)

"""Source tables. A scan plan is fixed before Catalyst sees it, and gives the same rows under every policy."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass, field, replace
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ProjectionError, TableNotFound
from ..plans.cost import CostInputs
from ..plans.policy import Decision, Pushdown, decide
from ..plans.predicate import POSTGRES, SPARK, Dialect, Node, all_of
from ..plans.splits import Split
from ..plans.stats import ColumnStats, IndexInfo, TableStats, axis, collect, ordinal
from ..plans.translate import Fidelity, kinds_of


#: Statistics of a table in more files than these come from a part of them; memos are kept for so many tables.
MEASURED_FILES, MEMOS = 64, 1024

#: Bytes of a value, as statistics from a database take them; 16 of any other type.
WIDTHS = {T.BooleanType: 1.0, T.ShortType: 2.0, T.IntegerType: 4.0, T.DateType: 4.0, T.FloatType: 4.0, T.LongType: 8.0, T.DoubleType: 8.0, T.TimestampType: 8.0, T.TimestampNTZType: 8.0}


class Memo:
    """Statistics measured, and when; the oldest tables are forgotten first."""

    _known: OrderedDict[tuple, Memo] = OrderedDict()
    _guard = Lock()

    def __init__(self) -> None:
        self.held: tuple[float, TableStats] | None = None
        self.lock = Lock()

    @classmethod
    def of(cls, key: tuple) -> Memo:
        with cls._guard:
            memo = cls._known.setdefault(key, cls())
            cls._known.move_to_end(key)
            while len(cls._known) > MEMOS:
                cls._known.popitem(last=False)
            return memo


@dataclass
class SourceTable:
    """Parquet: what is pushed is advice, as Spark's reader pushes what it can on its own."""

    spark: SparkSession
    name: str
    df: DataFrame
    rules: Pushdown = field(default_factory=Pushdown)
    indexes: tuple[IndexInfo, ...] = ()
    dialect: Dialect = SPARK
    fixed_stats: TableStats | None = None
    server_utf8: bool = True
    path: str | None = None
    _memo: Memo | None = field(default=None, repr=False)

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, table: str, **options) -> SourceTable:
        try:
            path = f"{folder}/{table.split('.')[-1]}.parquet"
            return cls(spark, table, spark.read.parquet(path), path=path, **options)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise TableNotFound(table) from e
            raise

    def stats(self, columns: list[str] | None = None) -> TableStats:
        """Of the columns that filters use, measured when first needed and again after the time to live; a failed refresh keeps what is there."""
        if self.fixed_stats is not None:
            return self.fixed_stats
        wanted = self.schema.names if columns is None else [c for c in columns if c in self.schema.names]
        memo = self.memo()
        with memo.lock:  # one refresh at a time
            fresh = memo.held and time.monotonic() - memo.held[0] < self.rules.statistics_ttl_secs
            held = memo.held[1] if memo.held else TableStats()
            missing = [c for c in wanted if not fresh or c not in held.columns]
            if not missing and fresh:
                return held
            try:
                found = self.measure(missing)
            except Exception:
                if memo.held is None:
                    raise
                return held
            known = {**(held.columns if fresh else {}), **found.columns}
            width = sum(s.avg_width for s in known.values()) * len(self.schema.names) / max(1, len(known))
            made = TableStats(found.row_count, int(found.row_count * width), known)
            memo.held = (memo.held[0] if fresh else time.monotonic(), made)
            return made

    def memo(self) -> Memo:
        """Tables opened from the same files share what was measured of them."""
        if self._memo is None:
            self._memo = Memo.of((self.path, *sorted(self.df.inputFiles()))) if self.path else Memo()
        return self._memo

    def measure(self, columns: list[str]) -> TableStats:
        """Of a table in many files, its rows are counted from their footers and the rest is measured on files spread evenly over it."""
        files = sorted(self.df.inputFiles()) if self.path else []
        if len(files) <= MEASURED_FILES:
            return collect(self.df, columns)
        some = files[:: -(-len(files) // MEASURED_FILES)]
        found = collect(self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*some), columns)
        rows = self.df.count()
        # Many distinct values in the part mean as many more in the whole; few mean that all of them were met.
        scaled = {n: replace(c, n_distinct=c.n_distinct * rows / found.row_count) if c.n_distinct * 10 > found.row_count > 0 else c for n, c in found.columns.items()}
        return TableStats(rows, found.size_bytes, scaled)

    def decide(self, filters: list[Node]) -> list[Decision]:
        needs = self.rules.policy in ("cost_based", "strict", "hinted") and filters
        used = list(dict.fromkeys(c for f in filters for c in f.columns()))
        inputs = CostInputs(self.stats(used) if needs else TableStats(), self.indexes, kinds_of(self.schema, self.server_utf8))
        return decide(filters, self.rules, inputs, self.dialect)

    def plan(self, filters: list[Node] = (), columns: list[str] | None = None, limit: int | None = None, split: Split | None = None) -> ScanPlan:
        names = self.schema.names if columns is None else list(columns)
        if missing := [c for c in names if c not in self.schema.names]:
            raise ProjectionError(f"{self.name} has no column {', '.join(missing)}")
        decisions = self.decide(list(filters))
        rest = [d.filter for d in decisions if d.pushed is None or d.fidelity is Fidelity.INEXACT]
        # A limit at the source counts rows before the rest of the filters: only without any, and never when strict.
        at_source = limit if not rest and self.rules.policy != "strict" else None
        return ScanPlan(self, tuple(names), tuple(decisions), all_of([d.pushed for d in decisions if d.pushed]), all_of(rest), limit, at_source, split or Split(0))

    def read(self, plan: ScanPlan) -> DataFrame:
        df = self.df
        if (part := plan.split.column()) is not None:
            df = df.where(part)
        if plan.pushed is not None:
            df = df.where(plan.pushed.column())
        return df.limit(plan.source_limit) if plan.source_limit is not None else df


@dataclass(frozen=True)
class ScanPlan:
    """Frozen: what is decided here is what is read."""

    table: SourceTable
    columns: tuple[str, ...]
    decisions: tuple[Decision, ...]
    pushed: Node | None
    residual: Node | None
    limit: int | None
    source_limit: int | None
    split: Split

    def needed(self) -> list[str]:
        """Columns that must leave the source: those asked for, and those that Spark still filters by."""
        extra = self.residual.columns() if self.residual is not None else []
        return list(dict.fromkeys([*self.columns, *extra]))

    def of(self, split: Split) -> ScanPlan:
        return replace(self, split=split)

    def df(self, splits: list[Split] | None = None) -> DataFrame:
        df = self.table.read(self) if splits is None else self.table.read_splits(self, splits)
        if self.residual is not None:
            df = df.where(self.residual.column())
        df = df.select(*("`" + c.replace("`", "``") + "`" for c in self.columns))
        return df.limit(self.limit) if self.limit is not None else df


@dataclass
class JdbcTable(SourceTable):
    """A database table. Pushed filters are part of the subquery; Spark's own pushdown is off, so that kept ones stay here."""

    url: str = ""
    table: str = ""
    options: dict = field(default_factory=dict)
    pool_max: int = 8
    fetch_rows: int = 8192
    statement_timeout_ms: int | None = None

    @classmethod
    def open(cls, spark: SparkSession, url: str, table: str, options: dict | None = None, dialect: Dialect = POSTGRES, **more) -> JdbcTable:
        own = dict(options or {})
        empty = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT * FROM {table} WHERE 1 = 0) q", **own).load()
        return cls(spark, table, empty, dialect=dialect, url=url, table=table, options=own, **more)

    def query(self, plan: ScanPlan) -> str:
        """The statement that is read; without columns, one constant a row."""
        names = plan.needed()
        body = ", ".join(map(self.dialect.ident, names)) if names else "1 AS one"
        where = f" WHERE {plan.pushed.render(self.dialect)}" if plan.pushed is not None else ""
        # The range of a split is met outside of this statement: a limit would count before it.
        limit = self.dialect.limit(plan.source_limit) if plan.source_limit is not None and plan.split.predicate(self.dialect) is None else ""
        return f"SELECT {body} FROM {self.table}{where}{limit}"

    def reader_options(self) -> dict[str, str]:
        own = {"fetchsize": str(self.fetch_rows), "pushDownPredicate": "false", "pushDownAggregate": "false", "pushDownLimit": "false", "pushDownOffset": "false", "pushDownTableSample": "false"}
        if self.statement_timeout_ms:
            own["queryTimeout"] = str(-(-self.statement_timeout_ms // 1000))
        if self.dialect is POSTGRES:
            own["sessionInitStatement"] = "SET TIME ZONE 'UTC'"
        return own | self.options

    def read(self, plan: ScanPlan) -> DataFrame:
        return self.read_splits(plan, [plan.split])

    def read_splits(self, plan: ScanPlan, splits: list[Split]) -> DataFrame:
        """One JDBC partition a split; never more at once than the source's connections."""
        if len(splits) > self.pool_max:
            raise ValueError(f"{len(splits)} splits at once exceed the source's {self.pool_max} connections")
        key = [s.key for s in splits if s.key and s.key not in plan.needed()][:1]
        inner = self.query(replace(plan, columns=(*plan.columns, *key)))
        tag = self.spark.sparkContext.getLocalProperty("spark.job.description") or "quern"
        safe = "".join(c for c in tag if c.isalnum() or c in " _-.:=")
        common = {"url": self.url, "table": f"(/* {safe} */ {inner}) q", "properties": self.reader_options()}
        if any(s.predicate(self.dialect) for s in splits):
            return self.spark.read.jdbc(predicates=[s.predicate(self.dialect) or "1 = 1" for s in splits], **common)
        return self.spark.read.jdbc(**common)

    def ask(self, statement: str) -> tuple:
        """The one row of a statement that the source works out."""
        return tuple(self.spark.read.jdbc(self.url, f"({statement}) q", properties=self.reader_options()).first())

    def bounds(self, key: str) -> tuple[int | None, int | None]:
        """The least and the greatest key."""
        c = self.dialect.ident(key)
        low, high = self.ask(f"SELECT min({c}) AS lo, max({c}) AS hi FROM {self.table}")
        return (None, None) if low is None else (int(low), int(high))

    def measure(self, columns: list[str]) -> TableStats:
        """Aggregates at the source, of which one row a column travels; between the ends of a column values count as even."""
        simple = [f for f in self.schema if f.name in columns and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        rows, found = self.ask(f"SELECT count(*) AS n FROM {self.table}")[0], {}
        for f in simple:
            c, placed = self.dialect.ident(f.name), axis(f.name, f.dataType) is not None
            # As text, types without an order of their own can be told apart too.
            one = f"CAST({c} AS {self.dialect.text_type})" if isinstance(f.dataType, T.StringType) else c
            ends = f", min({c}) AS lo, max({c}) AS hi" if placed else ""
            known, distinct, *span = self.ask(f"SELECT count({c}) AS n, count(DISTINCT {one}) AS d{ends} FROM {self.table}")
            places = [ordinal(v) for v in span]
            histogram = tuple(places) if placed and None not in places and places[0] != places[1] else ()
            found[f.name] = ColumnStats(float(distinct), 1 - known / rows if rows else 0.0, WIDTHS.get(type(f.dataType), 16.0), histogram)
        return TableStats(rows, int(rows * sum(c.avg_width for c in found.values())), found)

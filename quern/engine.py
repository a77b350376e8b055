"""The facades: an engine of registered sources, and a connector for one job spec."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .errors import SpecError
from .plans.filters import describe, lower
from .plans.policy import Decision
from .plans.predicate import MYSQL, POSTGRES
from .plans.splits import Split, check_key, keyset, keyset_of
from .sources.spec import JobSpec
from .sources.tables import JdbcTable, ScanPlan, SourceTable


def session_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings that the semantics rest on: UTC, ANSI, adaptive execution."""
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")


class Engine:
    """Names sources, and gives their tables as DataFrames or SQL views."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._sources: dict[str, Callable[[str], SourceTable]] = {}

    def add_parquet(self, ref: str, folder: str) -> Engine:
        self._sources[ref] = lambda table: SourceTable.parquet(self.spark, folder, table)
        return self

    def add_jdbc(self, ref: str, url: str, options: dict | None = None, **more) -> Engine:
        self._sources[ref] = lambda table: JdbcTable.open(self.spark, url, table, options, **more)
        return self

    def table(self, ref: str, table: str) -> SourceTable:
        if ref not in self._sources:
            raise SpecError(f"unknown source {ref!r}; known: {', '.join(sorted(self._sources)) or 'none'}")
        return self._sources[ref](table)

    def source(self, ref: str, table: str) -> DataFrame:
        return self.table(ref, table).plan().df()

    def register(self, ref: str, table: str, view: str | None = None) -> None:
        """The raw table as a view: free SQL is optimized by Spark and does not pass our policy."""
        self.source(ref, table).createOrReplaceTempView(view or table.split(".")[-1])

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        return self.spark.sql(text, args=args)


@dataclass(frozen=True)
class FilterDecision:
    filter: str
    expr: str
    pushdown: str
    pushed_to_source: bool
    reason: str
    text: str


class Connector:
    """One job spec against its source."""

    def __init__(self, spark: SparkSession, spec: JobSpec, table: SourceTable | None = None) -> None:
        self.spark, self.spec = spark, spec
        self.table = table or self._open()
        self.table.rules = spec.pushdown
        self.filters = lower(list(spec.filters), self.table.schema)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> Connector:
        return cls(spark, JobSpec.load(path))

    def _open(self) -> SourceTable:
        s = self.spec.source
        if s.path is not None:
            return SourceTable.parquet(self.spark, s.path, self.spec.table)
        url = s.url or f"jdbc:{'postgresql' if s.dialect == 'postgres' else 'mysql'}://{s.host}:{s.port}/{s.database}"
        options = {"user": s.user, "password": self.spec.password()} if s.password_env else {}
        dialect = {"postgres": POSTGRES, "mysql": MYSQL}[s.dialect]
        return JdbcTable.open(self.spark, url, self.spec.resolved_table(), options, dialect, pool_max=s.pool_max, fetch_rows=self.spec.execution.batch_size, statement_timeout_ms=s.statement_timeout_ms)

    def plan(self, limit: int | None = None) -> ScanPlan:
        return self.table.plan(self.filters, list(self.spec.columns) if self.spec.columns is not None else None, limit)

    def decisions(self) -> tuple[Decision, ...]:
        return self.plan().decisions

    def explain_filters(self) -> list[FilterDecision]:
        own = zip(self.spec.filters, self.decisions(), strict=True)
        return [FilterDecision(describe(f), str(d.filter), d.level, d.pushed is not None, d.reason, d.text) for f, d in own]

    def explain_filters_df(self) -> DataFrame:
        rows = [(x.filter, x.expr, x.pushdown, x.pushed_to_source, x.reason, x.text) for x in self.explain_filters()]
        return self.spark.createDataFrame(rows, "filter string, expr string, pushdown string, pushed_to_source boolean, reason string, decision string")

    def preview(self, limit: int = 20) -> DataFrame:
        return self.plan(limit).df()

    def splits(self) -> list[Split]:
        p = self.spec.parallel_scan
        if p.strategy != "keyset":
            return [Split(0)]  # page ranges need the source's own snapshot: one split
        return self._keyset(p.partitions)

    def _keyset(self, n: int) -> list[Split]:
        key = self.spec.parallel_scan.partition_column
        if not isinstance(self.table, JdbcTable):
            return keyset_of(self.table.df, key, n)
        check_key(self.table.schema, key)
        return keyset(*self.table.bounds(key), n, key)

    def df(self) -> DataFrame:
        """All splits at once; of a database, no more of them than its connections, each a partition of its own."""
        p = self.spec.parallel_scan
        if p.strategy != "keyset" or not isinstance(self.table, JdbcTable):
            return self.plan().df()
        return self.plan().df(self._keyset(min(p.partitions, self.table.pool_max)))

    def split_df(self, split: Split) -> DataFrame:
        return self.plan().of(split).df()

"""Queries through the planner: scans, filters under every policy, splits, statistics, runs."""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Connector
from ..jobs.run import Job
from ..plans.filters import Filter
from ..plans.policy import POLICIES, Pushdown
from ..plans.predicate import And, Cmp, Col, IsNotNull, IsNull, Lit, Node, Not, Opaque, Or
from ..plans.splits import keyset_of
from ..plans.stats import IndexInfo, collect
from ..sources.spec import Checkpoint, JobSpec, ParallelScan, Source
from ..sources.tables import SourceTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf: str, name: str, **rules) -> SourceTable:
    return SourceTable.parquet(spark, sf, name, rules=Pushdown(**({"policy": "always"} | rules)))


def _filtered(name: str, table: str, columns: list[str], filters: list[Node], where: str) -> None:
    _add(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")(lambda spark, sf: _table(spark, sf, table).plan(filters, columns).df())


@_add("scan_full_orders", "SELECT * FROM orders")
def _(spark, sf):
    return _table(spark, sf, "orders").plan().df()


@_add("scan_projection", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return _table(spark, sf, "orders").plan((), ["o_orderkey", "o_totalprice"]).df()


@_add("scan_empty_projection_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, sf):
    return _table(spark, sf, "lineitem").plan((), []).df().agg(F.count("*").alias("n"))


@_add("with_column_arith", "SELECT o_orderkey, round(o_totalprice * 2.0, 2) AS doubled FROM orders")
def _(spark, sf):
    return _table(spark, sf, "orders").plan((), ["o_orderkey", "o_totalprice"]).df().withColumn("doubled", F.round(F.col("o_totalprice") * 2.0, 2)).drop("o_totalprice")


@_add("select_alias_cast", "SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def _(spark, sf):
    return _table(spark, sf, "customer").plan().df().select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("nation"))


_KEY, _STATUS, _DATE = Col("o_orderkey"), Col("o_orderstatus"), Col("o_orderdate")
_ORDER = ["o_orderkey", "o_orderstatus", "o_orderdate"]
for _label, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _filtered(f"flt_int_{_label}", "orders", _ORDER, [Cmp(_KEY, _op, Lit(700))], f"o_orderkey {_op} 700")
    if _label in ("eq", "ne", "lt", "ge"):
        _filtered(f"flt_text_{_label}", "orders", _ORDER, [Cmp(_STATUS, _op, Lit("O"))], f"o_orderstatus {_op} 'O'")
_LO, _HI = dt.datetime(1996, 1, 1), dt.datetime(1996, 3, 1)
_filtered("flt_ts_window", "orders", _ORDER, [Cmp(_DATE, ">=", Lit(_LO)), Cmp(_DATE, "<", Lit(_HI))], "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
_filtered("flt_float_eq_recheck", "lineitem", ["l_orderkey", "l_linenumber", "l_discount"], [Cmp(Col("l_discount"), "=", Lit(0.05))], "l_discount = CAST(0.05 AS DOUBLE)")
_filtered("flt_float_range_kept", "orders", ["o_orderkey", "o_totalprice"], [Cmp(Col("o_totalprice"), ">", Lit(200000.0))], "o_totalprice > 200000")
_filtered("flt_col_vs_col", "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], [Cmp(Col("l_partkey"), "<", Col("l_suppkey"))], "l_partkey < l_suppkey")
_filtered("flt_and", "orders", _ORDER, [And(Cmp(_KEY, ">=", Lit(300)), Cmp(_STATUS, "=", Lit("F")))], "o_orderkey >= 300 AND o_orderstatus = 'F'")
_filtered("flt_or_group", "orders", _ORDER, [Or(Cmp(_KEY, "<", Lit(50)), Cmp(_STATUS, "=", Lit("P")))], "o_orderkey < 50 OR o_orderstatus = 'P'")
_filtered("flt_not", "orders", _ORDER, [Not(Or(Cmp(_KEY, "<", Lit(500)), Cmp(_STATUS, "=", Lit("P"))))], "NOT (o_orderkey < 500 OR o_orderstatus = 'P')")
_filtered("flt_not_isnull_grouping", "orders", _ORDER, [Not(IsNull(Cmp(_KEY, "=", Lit(7))))], "NOT ((o_orderkey = 7) IS NULL)")
_filtered("flt_is_not_null", "orders", _ORDER, [IsNotNull(_STATUS)], "o_orderstatus IS NOT NULL")
_filtered("flt_reversed_literal", "orders", _ORDER, [Cmp(Lit(900), ">", _KEY)], "900 > o_orderkey")
_filtered("flt_in", "orders", _ORDER, [Opaque("o_orderstatus IN ('F', 'P')", ("o_orderstatus",))], "o_orderstatus IN ('F', 'P')")
_filtered("flt_between", "orders", _ORDER, [Opaque("o_orderkey BETWEEN 100 AND 400", ("o_orderkey",))], "o_orderkey BETWEEN 100 AND 400")
_filtered("flt_like", "part", ["p_partkey", "p_type"], [Opaque("p_type LIKE '%A%'", ("p_type",))], "p_type LIKE '%A%'")
_filtered("flt_arith", "orders", ["o_orderkey"], [Opaque("o_orderkey % 7 = 3", ("o_orderkey",))], "o_orderkey % 7 = 3")


def _nullable(spark: SparkSession, sf: str) -> SourceTable:
    """Orders with a status that is null where it was P: the tables themselves hold no nulls."""
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return SourceTable(spark, "orders", df, Pushdown("always"))


_NULLABLE = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders)"


@_add("flt_is_null", f"SELECT o_orderkey FROM {_NULLABLE} WHERE status IS NULL")
def _(spark, sf):
    return _nullable(spark, sf).plan([IsNull(Col("status"))], ["o_orderkey"]).df()


@_add("flt_not_with_nulls", f"SELECT o_orderkey, status FROM {_NULLABLE} WHERE NOT (status = 'O')")
def _(spark, sf):
    return _nullable(spark, sf).plan([Not(Cmp(Col("status"), "=", Lit("O")))]).df()


@_add("flt_date_window", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-05-01' AND CAST(o_orderdate AS DATE) < DATE '1997-06-01'")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    table = SourceTable(spark, "orders", df, Pushdown("always"))
    return table.plan([Cmp(Col("day"), ">=", Lit(dt.date(1997, 5, 1))), Cmp(Col("day"), "<", Lit(dt.date(1997, 6, 1)))]).df()


_SHOW = [Cmp(_KEY, ">=", Lit(300)), Cmp(_DATE, ">=", Lit(_LO)), Cmp(_DATE, "<", Lit(_HI)), Cmp(_STATUS, "<>", Lit("P")), Cmp(Col("o_totalprice"), ">", Lit(1000.0))]
_SHOW_SQL = "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey >= 300 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01' AND o_orderstatus <> 'P' AND o_totalprice > 1000"
_INDEX = (IndexInfo("orders_pkey", ("o_orderkey",), unique=True, primary=True),)


def showcase(spark: SparkSession, sf: str, policy: str, **more) -> DataFrame:
    """The same filters under any policy: the same rows."""
    table = SourceTable.parquet(spark, sf, "orders", rules=Pushdown(policy, **more), indexes=_INDEX)
    return table.plan(_SHOW, _ORDER).df()


for _policy in POLICIES:
    _add(f"policy_{_policy}", _SHOW_SQL)(lambda spark, sf, p=_policy: showcase(spark, sf, p, push=("o_orderstatus",) if p == "hinted" else ()))
_add("policy_deny", _SHOW_SQL)(lambda spark, sf: showcase(spark, sf, "always", deny=("O_ORDERDATE",)))


def _spec(sf: str, table: str = "orders", folder: str = "", **more) -> JobSpec:
    return JobSpec("catalogue", table, Source(path=sf), checkpoint=Checkpoint(folder or tempfile.mkdtemp()), **more)


@_add("explain_filters_table")
def _(spark, sf):
    filters = (Filter("o_orderkey", ">=", 300), Filter("o_orderdate", ">=", "1996-01-01T00:00:00Z"), Filter("o_orderdate", "<", "1996-03-01T00:00:00Z"), (Filter("o_orderstatus", "=", "F"), Filter("o_orderstatus", "=", "O")))
    connector = Connector(spark, _spec(sf, filters=filters))
    connector.table.indexes = _INDEX
    return connector.explain_filters_df()


@_add("preview_limit", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 20)")
def _(spark, sf):
    return Connector(spark, _spec(sf)).preview().agg(F.count("*").alias("n"))


@_add("stats_null_frac", f"SELECT 'status' AS name, round(avg(CASE WHEN status IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_frac FROM {_NULLABLE}")
def _(spark, sf):
    own = collect(_nullable(spark, sf).df).columns["status"]
    return spark.createDataFrame([("status", round(own.null_frac, 6))], "name string, null_frac double")


@_add("stats_n_distinct", "SELECT 'o_orderstatus' AS name, count(DISTINCT o_orderstatus) AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders")
def _(spark, sf):
    own = collect(spark.read.parquet(f"{sf}/orders.parquet"), ["o_orderstatus", "o_orderpriority"]).columns
    return spark.createDataFrame([(k, int(own[k].n_distinct)) for k in own], "name string, n bigint")


@_add("stats_minmax", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


@_add("stats_mcv_topk", "SELECT p_size, count(*) AS n FROM part GROUP BY p_size ORDER BY n DESC, p_size LIMIT 10")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").groupBy("p_size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_size").limit(10)


@_add("stats_histogram_equidepth")
def _(spark, sf):
    own = collect(spark.read.parquet(f"{sf}/events.parquet").select("ts"), buckets=20).columns["ts"]
    return spark.createDataFrame(list(enumerate(own.histogram)), "bucket int, bound double")


_PARTS = 4


def _splits(spark: SparkSession, sf: str):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    return df, keyset_of(df, "o_orderkey", _PARTS)


_BOUNDS = f"WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / {_PARTS}.0) AS BIGINT) AS w FROM orders)"


@_add("keyset_split_ids", f"{_BOUNDS} SELECT o_orderkey, CAST((o_orderkey - lo) // w AS INT) AS split FROM orders, b")
def _(spark, sf):
    df, splits = _splits(spark, sf)
    parts = [df.where(s.column()).select("o_orderkey", F.lit(s.index).alias("split")) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@_add("keyset_union_equals_full", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    df, splits = _splits(spark, sf)
    out = None
    for s in splits:
        p = df.where(s.column()).select("o_orderkey", "o_custkey", "o_totalprice")
        out = p if out is None else out.unionAll(p)
    return out


@_add("keyset_null_keys_first", "SELECT 0 AS split, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("k"))
    first = keyset_of(df, "k", _PARTS)[0]
    return df.where(first.column()).where("k is null").agg(F.lit(0).alias("split"), F.count("*").alias("n")).select("split", "n")


@_add("keyset_bounds", f"{_BOUNDS} SELECT CAST(i AS INT) AS split, lo + i * w AS lo, CASE WHEN i < {_PARTS - 1} THEN lo + (i + 1) * w END AS hi FROM b, range({_PARTS}) r(i)")
def _(spark, sf):
    return spark.createDataFrame([(s.index, s.lo, s.hi) for s in _splits(spark, sf)[1]], "split int, lo bigint, hi bigint")


def _ran(spark: SparkSession, sf: str) -> tuple[Job, object]:
    spec = _spec(sf, columns=("o_orderkey", "o_totalprice"), parallel_scan=ParallelScan("keyset", _PARTS, "o_orderkey"))
    job = Job(Connector(spark, spec))
    return job, job.run()


@_add("run_counts_per_split", f"{_BOUNDS} SELECT 'split-' || CAST((o_orderkey - lo) // w AS VARCHAR) AS split_id, count(*) AS n FROM orders, b GROUP BY 1")
def _(spark, sf):
    _, outcome = _ran(spark, sf)
    return spark.createDataFrame(list(outcome.counts.items()), "split_id string, n bigint")


@_add("run_report_table")
def _(spark, sf):
    job, outcome = _ran(spark, sf)
    rows = [(s["split_id"], s["outcome"], s["rows"]) for s in job.reports.read("catalogue", outcome.run_id)["splits"]]
    return spark.createDataFrame(rows, "split_id string, outcome string, row_count bigint")


@_add("checkpoint_states")
def _(spark, sf):
    job, _ = _ran(spark, sf)
    return spark.createDataFrame([(s["split_id"], s["state"], s["rows_extracted"]) for s in job.store.read("catalogue")["splits"]], "split_id string, state string, row_count bigint")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a window of orders, filters decided by cost."""
    return showcase(spark, sf, "cost_based")

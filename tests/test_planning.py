from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import types as T

from quern.errors import FilterError, PlanMismatch, RunFailed, SpecError, SplitPlanMismatch, UnsupportedType
from quern.jobs.checkpoint import JobLock, Store, file_stem, fingerprint, fnv1a64
from quern.plans.cost import Case, CostInputs, Estimate, Explain, paths, selectivity, share
from quern.plans.filters import Filter, describe, lower, parse_shorthand
from quern.plans.policy import Pushdown, decide
from quern.plans.predicate import MYSQL, POSTGRES, And, Binary, Cmp, Col, IsNotNull, IsNull, Lit, Not, Or
from quern.plans.splits import Split, ctid, keyset, restore
from quern.plans.stats import ColumnStats, IndexInfo, TableStats
from quern.plans.translate import FLOAT, INTEGER, OPAQUE, TEXT, TEXT_BYTEWISE, TEXT_CAST, TIMESTAMP, Fidelity, translate

KINDS = {"berth": INTEGER, "sailed": TIMESTAMP, "port": TEXT_BYTEWISE, "tonnage": FLOAT, "note": TEXT, "hull": TEXT_CAST, "fee": OPAQUE}


def voyages(seed=11, n=20_000):
    """Berths with a few crowded ones and some unknown; hours of sailing that thin out."""
    rng = random.Random(seed)
    berths = [None if rng.random() < 0.05 else 7 if rng.random() < 0.2 else rng.randrange(400) for _ in range(n)]
    hours = [int(rng.expovariate(1 / 900)) for _ in range(n)]
    return berths, hours


def measured(values, buckets=50, common=()):
    """Statistics by their definition, from all values."""
    known = [v for v in values if v is not None]
    rest = sorted(v for v in known if v not in common)
    bounds = tuple(float(rest[min(len(rest) - 1, k * len(rest) // buckets)]) for k in range(buckets + 1))
    shares = tuple((float(v), known.count(v) / len(values)) for v in common)
    return ColumnStats(float(len(set(known))), 1 - len(known) / len(values), 8.0, bounds, shares)


BERTHS, HOURS = voyages()
START = dt.datetime(2020, 1, 1)
STATS = TableStats(len(BERTHS), 64 << 20, {"berth": measured(BERTHS, common=(7,)), "sailed": measured([(START - dt.datetime(1970, 1, 1)).total_seconds() + 3600 * h for h in HOURS]), "port": ColumnStats(3.0), "tonnage": ColumnStats(9000.0)})
HOUR = IndexInfo("by_hour", ("sailed", "port"))
INPUTS = CostInputs(STATS, (HOUR, IndexInfo("some_ports", ("port",), partial=True), IndexInfo("tons", ("tonnage",), "hash")), KINDS)


def after(h):
    return Cmp(Col("sailed"), ">=", Lit(START + dt.timedelta(hours=h)))


def berth(op, v):
    return Cmp(Col("berth"), op, Lit(v))


def reasons(filters, **rules):
    return [(d.level, d.reason) for d in decide(filters, Pushdown(**rules), INPUTS)]


def test_each_policy_speaks():
    port, tons, heavy = Cmp(Col("port"), "=", Lit("Oslo")), Cmp(Col("tonnage"), "=", Lit(3.5)), Cmp(Col("tonnage"), ">", Lit(3.5))
    filters = [after(100), berth("=", 12), port, tons, heavy]
    assert reasons(filters, policy="always") == [("exact", "policy=always")] * 3 + [("inexact", "policy=always"), ("unsupported", "untranslatable")]
    assert reasons(filters, policy="never") == [("unsupported", "policy=never")] * 4 + [("unsupported", "untranslatable")]
    by_cost = reasons(filters, policy="cost_based")
    assert [x[0] for x in by_cost] == ["exact", "exact", "unsupported", "inexact", "unsupported"]
    assert by_cost[0][1] == "index available: by_hour" and by_cost[2][1] == "selectivity too high: 33.33% >= 30.00%" and by_cost[3][1] == "index available: tons"
    assert by_cost[1][1] == "low selectivity (0.25%) and cost (163) within budget (50000)"
    assert reasons([port], policy="hinted", push=("port",)) == [("exact", "hinted column")]
    assert reasons([port], policy="hinted", push=("PORT",))[0][0] == "unsupported"  # hints are names as they are, denials in any case
    assert reasons([port], policy="hinted", push=("port",), deny=("PORT",)) == [("unsupported", "denylisted column")]
    assert reasons([berth("=", 12)], policy="cost_based", max_source_cost=100) == [("unsupported", "cost exceeds budget: 163 > 100")]
    with pytest.raises(ValueError, match="unknown policy"):
        reasons([port], policy="sometimes")


def test_strict_gates_in_order():
    def one(node, inputs=INPUTS, **rules):
        return decide([node], Pushdown("strict", **rules), inputs)[0].reason

    late = after(4000)
    assert one(late) == "strict: indexed + selective + primitive"
    assert one(late, replace(INPUTS, stats=TableStats())) == "strict: no statistics reachable"
    assert one(Cmp(Lit(1), "=", Lit(1))) in ("strict: predicate references no columns", "untranslatable")
    assert one(berth("=", 12)) == "strict: not all columns indexed"
    assert one(Cmp(Col("tonnage"), "=", Lit(3.5))) == "strict: non-primitive type (float/text/cast/other)"
    assert one(after(0)).startswith("strict: selectivity too high (100.00% >= 30.00%)")
    assert one(late, max_source_cost=1).startswith("strict: cost exceeds budget (")


def test_decision_text():
    assert decide([berth("=", 4)], Pushdown("always"), INPUTS)[0].text == 'PUSH (Exact; policy=always; ("berth" = 4))'
    assert decide([Cmp(Col("fee"), "=", Lit(1))], Pushdown("always"), INPUTS)[0].text == "KEEP (untranslatable)"


def test_paths_through_indexes():
    both = (IndexInfo("b", ("berth",)), HOUR)
    own = replace(INPUTS, indexes=both)
    far = Cmp(Col("port"), "=", Lit("Oslo"))
    cases = [(And(far, berth("=", 1)), ["b"]), (Or(far, berth("=", 1)), []), (Or(after(1), berth("<", 1)), ["by_hour", "b"]), (Not(berth("=", 1)), []), (berth("<>", 1), []), (IsNull(Col("berth")), ["b"]), (Cmp(Lit(4), ">", Col("berth")), ["b"]), (Cmp(Col("berth"), "<", Col("fee")), [])]
    for node, names in cases:
        assert [x.name for x in paths(node, own)] == names
    hashed = replace(INPUTS, indexes=(IndexInfo("h", ("berth",), "hash"),))
    assert paths(berth("=", 1), hashed) and not paths(berth("<", 1), hashed) and not paths(IsNull(Col("berth")), hashed)
    texts = replace(INPUTS, indexes=(IndexInfo("p", ("port",)), IndexInfo("n", ("note",))))
    assert paths(Cmp(Binary(Col("port")), "=", Lit("x")), texts) and not paths(Cmp(Binary(Col("note")), "=", Lit("x")), texts)
    assert not paths(berth("=", 1), replace(INPUTS, indexes=(IndexInfo("e", ("berth",), has_expressions=True),)))


def test_translation_rules():
    port, tons = Cmp(Col("port"), "=", Lit("Oslo")), Cmp(Col("tonnage"), "=", Lit(3.5))
    assert translate(port, KINDS) == (Fidelity.EXACT, Cmp(Binary(Col("port")), "=", Lit("Oslo")))
    for kept in (Cmp(Col("hull"), "<", Lit("a")), Cmp(Col("fee"), "=", Lit(1)), Not(tons), Cmp(Col("gone"), "=", Lit(1))):
        assert translate(kept, KINDS) is None
    assert translate(IsNull(Col("fee")), KINDS)[0] is Fidelity.EXACT
    assert translate(And(berth("=", 1), tons), KINDS)[0] is Fidelity.INEXACT
    assert Cmp(Binary(Col("a`b")), "=", Lit("x\\y'z")).render(MYSQL) == "((`a``b` COLLATE utf8mb4_bin) = 'x\\\\y''z')"
    assert Lit("Na'im").render(POSTGRES) == "'Na''im'" and Lit("c\\d").render(POSTGRES) == "E'c\\\\d'"


def test_shares_of_ranges_against_counting():
    tests = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    rng = random.Random(3)
    for _ in range(60):
        ends = [(rng.choice(list(tests)), rng.choice([7, rng.randrange(-20, 430)])) for _ in range(rng.randint(1, 3))]
        true = sum(v is not None and all(tests[op](v, at) for op, at in ends) for v in BERTHS) / len(BERTHS)
        nodes = [berth(op, at) if rng.random() < 0.5 else Cmp(Lit(at), op.translate(str.maketrans("<>", "><")), Col("berth")) for op, at in ends]
        found = selectivity(nodes[0], STATS, tuple(nodes[1:]))
        assert found.comparisons == len(ends) and not found.common_only
        assert abs(found.value - true) < 0.02, (ends, found, true)
        whole = nodes[0] if len(nodes) == 1 else And(nodes[0], nodes[1])
        assert selectivity(whole, STATS, tuple(nodes[2:])).value == found.value


def test_windows_change_decisions():
    wide, end = berth(">=", 100), berth("<", 110)
    kept, pushed = (decide(f, Pushdown(), replace(INPUTS, indexes=()))[0] for f in ([wide], [wide, end]))
    assert kept.reason.startswith("selectivity too high: ") and "from histogram >=" in kept.reason
    assert pushed.pushed is not None and "from histogram, window of 2 range filters" in pushed.reason
    assert selectivity(wide, STATS, (berth("<", 50),)).value == 0
    # A source's figure is for one filter: it counts unless a window is judged.
    told = replace(INPUTS, indexes=(), explain=Explain(total_cost=9.9))
    assert Case(berth("=", 3), told).cost == 9 and Case(end, replace(told, siblings=(wide,))).cost != 9
    assert decide([berth("=", 3)], Pushdown(), INPUTS, estimator=lambda node: Explain(1.0, 1.0, "b", True))[0].reason == "EXPLAIN index path (b)"
    few = TableStats(100, 100, {"berth": ColumnStats(common=((1.0, 0.25), (2.0, 0.5)))})
    assert selectivity(berth("<", 2), few) == Estimate(pytest.approx(0.25 + 0.25 * 0.33), 1, True)


def test_plain_shares():
    for node, value in [(berth("=", 1), 1 / 400), (berth("<>", 1), 1 - 1 / 400), (Cmp(Col("port"), "<", Lit("x")), 0.33), (Cmp(Col("fee"), "=", Lit(1)), 0.5), (IsNull(Col("fee")), 0.01), (And(berth("=", 1), Cmp(Col("port"), "=", Lit("x"))), 1 / 1200), (Or(Cmp(Col("port"), "=", Lit("x")), Cmp(Col("port"), "=", Lit("y"))), 5 / 9), (Not(Cmp(Col("port"), "=", Lit("x"))), 2 / 3)]:
        assert share(node, STATS) == pytest.approx(value)
    assert share(IsNull(Col("berth")), STATS) + share(IsNotNull(Col("berth")), STATS) == 1


def test_keyset():
    rng = random.Random(9)
    for _ in range(200):
        low = rng.randrange(-50, 50)
        high, n = low + rng.randrange(0, 90), rng.randint(1, 12)
        splits = keyset(low, high, n, "k")
        assert len(splits) <= n and [s.index for s in splits] == list(range(len(splits)))
        for v in range(low - 3, high + 4):  # later keys beyond both ends have a place as well, and each key one
            own = [s for s in splits if (s.index == 0 or s.lo is None or v >= s.lo) and (s.hi is None or v < s.hi)]
            assert len(own) == 1
        assert restore([{"split_id": f"split-{s.index}", "bounds": {"lo": s.lo, "hi": s.hi}} for s in splits] if len(splits) > 1 else [{}], "k") == splits
    assert [s.predicate() for s in keyset(-4, 6, 3, "k")] == ['"k" < 0 OR "k" IS NULL', '"k" >= 0 AND "k" < 4', '"k" >= 4']
    assert keyset(3, 3, 5, "k") == keyset(None, None, 5, "k") == [Split(0)]
    assert keyset(-(2**63), 2**63 - 1, 3, "k")[-1].hi is None
    for pages in range(2, 40):
        parts = ctid(pages, 6)
        assert parts[0].lo == 0 and parts[-1].hi is None and all(a.hi == b.lo for a, b in zip(parts, parts[1:], strict=False))
    for stored in ([(0, 5), (5, 5)], [(0, 5), (None, None)], [(0, 5), (6, None)]):
        with pytest.raises(SplitPlanMismatch):
            restore([{"split_id": f"split-{i}", "bounds": {"lo": a, "hi": b}} for i, (a, b) in enumerate(stored)], "k")


def test_filters():
    assert parse_shorthand("a=x>=y") == Filter("a=x", ">=", "y") and parse_shorthand("zip='007'") == Filter("zip", "=", "007")
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("d", T.TimestampNTZType())])
    assert lower([Filter("n", "=", None)], schema) == [IsNull(Col("n"))] and lower([Filter("n", "!=", None)], schema) == [IsNotNull(Col("n"))]
    assert lower([(Filter("n", "<", 1), Filter("n", ">", 5))], schema) == [Or(Cmp(Col("n"), "<", Lit(1)), Cmp(Col("n"), ">", Lit(5)))]
    assert describe((Filter("n", "<", 1), Filter("n", ">", 5))) == "(n < 1 OR n > 5)"
    for bad in (Filter("n", "<", None), Filter("N", "=", 1), Filter("d", "=", "soon")):
        with pytest.raises(FilterError):
            lower([bad], schema)


def test_fingerprints(tmp_path):
    # The formats of fingerprints and of file names.
    assert fnv1a64(b"") == 0xCBF29CE484222325 and fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert fingerprint({"b": "2", "a": "1"}) == "v1-e6106c491c4c4bf6"
    assert [file_stem(x) for x in ("orders.v1", "orders_v1", "a/b%c")] == ["orders%2Ev1", "orders_v1", "a%2Fb%25c"]
    store = Store(tmp_path)
    store.begin("j", {"a": "1"}, [Split(0)])
    with pytest.raises(PlanMismatch) as e:
        store.begin("j", {"a": "2"}, [Split(0)])
    assert e.value.changed == ["a"]
    with JobLock.acquire(tmp_path, "j"), pytest.raises(Exception, match="worked on"):
        JobLock.acquire(tmp_path, "j")


def test_spec_and_types():
    from quern.sources.spec import JobSpec
    from quern.sources.types import ColumnMeta, mysql_type, postgres_type

    with pytest.raises(SpecError, match="sink.*batch_size|unknown field"):
        JobSpec.parse({"job_id": "j", "table": "t", "source": {}, "sink": {}})
    with pytest.raises(SpecError, match="batch_size.*partitions"):
        JobSpec.parse({"job_id": "j", "table": "t", "source": {}, "execution": {"batch_size": 0}, "parallel_scan": {"partitions": 0}})
    assert postgres_type(ColumnMeta("n", "numeric", True, 12, 2)) == T.DecimalType(12, 2)
    assert mysql_type(ColumnMeta("n", "bigint unsigned")) == T.DecimalType(20, 0) and mysql_type(ColumnMeta("b", "tinyint(1)")) == T.BooleanType()
    with pytest.raises(UnsupportedType):
        postgres_type(ColumnMeta("n", "interval"))


def test_random_predicates_keep_their_rows(spark):
    from quern.sources.tables import SourceTable

    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2], float(i % 4)) for i in range(40)], "id bigint, status string, amount double")
    rng = random.Random(5)

    def tree(depth):
        if depth and rng.random() < 0.6:
            return rng.choice([lambda: And(tree(depth - 1), tree(depth - 1)), lambda: Or(tree(depth - 1), tree(depth - 1)), lambda: Not(tree(depth - 1))])()
        return rng.choice([Cmp(Col("id"), rng.choice(["<", ">=", "<>"]), Lit(rng.randrange(40))), Cmp(Col("status"), "=", Lit("a")), IsNull(Col("status")), Cmp(Col("amount"), "=", Lit(2.0))])

    pushed = 0
    for _ in range(24):
        node = tree(3)
        always, never = (SourceTable(spark, "t", df, Pushdown(p)).plan([node], ["id"]) for p in ("always", "never"))
        pushed += always.pushed is not None
        assert sorted(always.df().collect()) == sorted(never.df().collect())
    assert pushed >= 6


def test_runs_resume(spark, sf, tmp_path):
    from quern.engine import Connector
    from quern.jobs.run import Job
    from quern.sources.spec import JobSpec

    raw = {"job_id": "orders.v1", "table": "orders", "source": {"path": sf}, "columns": ["o_totalprice"], "filters": [{"column": "o_orderkey", "op": ">=", "value": 100}], "checkpoint": {"dir": str(tmp_path)}, "parallel_scan": {"strategy": "keyset", "partitions": 3, "partition_column": "o_orderkey"}}
    job, seen = Job(Connector(spark, JobSpec.parse(raw))), []

    def failing(split, reader):
        if split.index == 1:
            raise ValueError("no room")
        seen.append(sum(b.num_rows for b in reader))

    with pytest.raises(RunFailed, match="split-1: no room"):
        job.run_with(failing)
    outcome = job.run_with(lambda _, reader: seen.append(sum(b.num_rows for b in reader)))
    assert sorted(outcome.skipped) == ["split-0", "split-2"] and outcome.completed == ["split-1"]
    assert sum(seen) == spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey >= 100").count()
    assert [r["status"] for r in job.reports.list("orders.v1")] == ["Failed", "Succeeded"]


def test_jdbc_pushes_what_was_decided(spark, sf, tmp_path):
    from quern.plans.predicate import DERBY
    from quern.sources.tables import JdbcTable

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.read.parquet(f"{sf}/nation.parquet").write.jdbc(url, '"nation"', "overwrite", options)
    table = JdbcTable.open(spark, url, '"nation"', options, DERBY, rules=Pushdown("always"))
    plan = table.plan([Cmp(Col("n_nationkey"), ">=", Lit(5))], ["n_name"])
    assert 'WHERE ("n_nationkey" >= 5)' in table.query(plan)
    assert plan.df().count() == 20
    splits = keyset(0, 24, 3, "n_nationkey")
    assert table.read_splits(table.plan(), splits).count() == 25
    # The source finds bounds and statistics: one row of each travels. It also counts limits.
    assert table.bounds("n_nationkey") == (0, 24)
    stats = table.stats(["n_nationkey", "n_name"])
    assert stats.row_count == 25 and stats.columns["n_nationkey"].histogram == (0.0, 24.0) and stats.columns["n_name"].n_distinct == 25
    limited = table.plan([Cmp(Col("n_nationkey"), ">=", Lit(5))], ["n_name"], limit=3)
    assert table.query(limited).endswith(" FETCH FIRST 3 ROWS ONLY") and limited.df().count() == 3
    costly = replace(table, rules=Pushdown("cost_based")).plan([Cmp(Col("n_nationkey"), ">=", Lit(22))])
    assert costly.pushed is not None and costly.df().count() == 3


def test_jdbc_reads_by_splits(spark, sf, tmp_path):
    from quern.engine import Connector
    from quern.plans.predicate import DERBY
    from quern.sources.spec import JobSpec
    from quern.sources.tables import JdbcTable

    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.read.parquet(f"{sf}/nation.parquet").write.jdbc(url, '"nation"', "overwrite", options)
    raw = {"job_id": "j", "table": "nation", "source": {"path": sf}, "columns": ["n_name"], "parallel_scan": {"strategy": "keyset", "partitions": 6, "partition_column": "n_nationkey"}}
    connector = Connector(spark, JobSpec.parse(raw), JdbcTable.open(spark, url, '"nation"', options, DERBY, pool_max=3))
    assert len(connector.splits()) == 5  # ranges of five keys
    df = connector.df()
    assert df.rdd.getNumPartitions() == 3 and df.columns == ["n_name"]
    assert sorted(df.collect()) == sorted(spark.read.parquet(f"{sf}/nation.parquet").select("n_name").collect())


def test_statistics_are_shared_and_measured_on_a_part(spark, tmp_path, monkeypatch):
    from quern.sources import tables

    spark.range(10_000).selectExpr("id", "id % 4 AS few").repartition(12).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(tables, "MEASURED_FILES", 4)
    one = tables.SourceTable.parquet(spark, str(tmp_path), "t")
    stats = one.stats(["id", "few"])
    assert stats.row_count == 10_000 and stats.columns["few"].n_distinct == 4 and abs(stats.columns["id"].n_distinct - 10_000) < 500
    monkeypatch.setattr(tables, "collect", None)  # nothing is measured again
    assert tables.SourceTable.parquet(spark, str(tmp_path), "t").stats(["id"]) == stats

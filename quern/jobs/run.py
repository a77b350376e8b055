"""Running a job: every split is a Spark job of its own, complete only when its consumer drained it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..engine import Connector
from ..errors import LockLost, RunFailed, chain
from ..plans.filters import describe
from ..plans.splits import Split, restore
from .checkpoint import JobLock, Store
from .report import Reports, RunReport


@dataclass
class SplitReader:
    """A split's batches; knows whether they were read to the end."""

    split: Split
    df: DataFrame
    batch_rows: int
    rows: int = 0
    batches: int = 0
    bytes: int = 0
    drained: bool = False

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        """Partition by partition: the driver holds one partition of the split at most."""
        held: list[tuple] = []
        schema = self.df.limit(0).toArrow().schema
        for row in self.df.toLocalIterator(prefetchPartitions=False):
            held.append(tuple(row))
            if len(held) >= self.batch_rows:
                yield self._batch(held, schema)
                held = []
        if held:
            yield self._batch(held, schema)
        self.drained = True

    def _batch(self, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        self.rows, self.batches, self.bytes = self.rows + batch.num_rows, self.batches + 1, self.bytes + batch.nbytes
        return batch

    def write_parquet(self, path: str) -> None:
        """On the executors; done again, it replaces what it wrote."""
        from pyspark.sql import Observation
        from pyspark.sql import functions as F

        seen = Observation()
        self.df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        self.rows, self.drained = seen.get["rows"], True

    def count(self) -> int:
        self.rows, self.drained = self.df.count(), True
        return self.rows


Consumer = Callable[[Split, SplitReader], None]


@dataclass
class RunOutcome:
    run_id: str
    completed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    rows: int = 0
    counts: dict[str, int] = field(default_factory=dict)


class Job:
    def __init__(self, connector: Connector) -> None:
        self.connector, self.spec = connector, connector.spec
        self.store, self.reports = Store(self.spec.checkpoint.dir), Reports(self.spec.checkpoint.dir)

    def identity(self) -> dict[str, str]:
        """What a plan is, in our own words: a checkpoint outlives a change of Spark's."""
        s, p, plan = self.spec.source, self.spec.parallel_scan, self.connector.plan()
        fields = [self.connector.table.schema[c] for c in plan.columns]
        return {
            "source": s.path or s.url or f"{s.host}:{s.port}/{s.database}",
            "table": self.spec.resolved_table(),
            "schema": ", ".join(f"{f.name}: {f.dataType.simpleString()}{' null' * f.nullable}" for f in fields),
            "projection": "*" if self.spec.columns is None else ", ".join(self.spec.columns),
            "filters": " AND ".join(f"({f})" for f in self.connector.filters) or "(none)",
            "strategy": p.strategy,
            "partitions": str(p.partitions),
            "partition_column": p.partition_column,
            "execution": "standalone",
        }

    def stream(self) -> DataFrame:
        return self.connector.df()

    def collect(self) -> pa.Table:
        """All rows in the order of the splits."""
        return pa.concat_tables([self.connector.split_df(s).toArrow() for s in self.connector.splits()])

    def run(self) -> RunOutcome:
        return self.run_with(lambda _, reader: reader.count() and None)

    def run_with(self, consumer: Consumer) -> RunOutcome:
        with JobLock.acquire(self.spec.checkpoint.dir, self.spec.job_id, self.spec.checkpoint.lock_ttl_secs) as lock:
            return self._locked(consumer, lock)

    def _locked(self, consumer: Consumer, lock: JobLock) -> RunOutcome:
        spec, identity = self.spec, self.identity()
        outcome = RunOutcome(f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}")
        plan = {"table": spec.resolved_table(), "columns": spec.columns, "filters": [describe(f) for f in spec.filters], "strategy": spec.parallel_scan.strategy, "partitions": spec.parallel_scan.partitions, "partition_column": spec.parallel_scan.partition_column}
        report = RunReport(spec.job_id, outcome.run_id, plan)
        self.reports.write(report)
        error: str | None = None
        try:
            report.value["pushdown"] = [{"filter": d.filter, "pushed": d.pushed_to_source, "decision": d.text} for d in self.connector.explain_filters()]
            found = self.store.check_plan(spec.job_id, identity)
            splits = restore(found["splits"], spec.parallel_scan.partition_column) if found else self.connector.splits()
            found = self.store.begin(spec.job_id, identity, splits)
            report.value["plan"]["fingerprint"] = found["fingerprint"]
            report.value["totals"]["splits_total"] = len(splits)
            done = {s["split_id"]: s["rows_extracted"] for s in found["splits"] if s["state"] == "Completed"}
            base = self.connector.plan()
            width = min(spec.execution.concurrent_partitions or spec.source.pool_max, spec.source.pool_max)
            with ThreadPoolExecutor(max(1, width)) as pool:
                work = [pool.submit(self._split, s, base.of(s), consumer, lock) for s in splits if s.split_id not in done]
                for s in splits:
                    if s.split_id in done:
                        outcome.skipped.append(s.split_id)
                        report.value["splits"].append(self._row(s, "Skipped", done[s.split_id], 0, 0, 0, None))
                for w in work:
                    s, row = w.result()
                    report.value["splits"].append(row)
                    outcome.counts[s.split_id] = row["rows"]
                    if row["outcome"] == "Completed":
                        outcome.completed.append(s.split_id)
                        outcome.rows += row["rows"]
                    else:
                        outcome.failed[s.split_id] = row["error"]
        except Exception as e:
            error = chain(e)
            raise
        finally:
            if error is None and outcome.failed:
                error = f"{len(outcome.failed)} of {report.value['totals']['splits_total']} splits failed"
            report.finish(error)
            self.reports.write(report)
        if outcome.failed:
            raise RunFailed("; ".join(f"{k}: {v}" for k, v in outcome.failed.items()), outcome)
        return outcome

    @staticmethod
    def _row(s: Split, outcome: str, rows: int, batches: int, size: int, ms: int, error: str | None) -> dict:
        bounds = None if s.whole else {"lo": s.lo, "hi": s.hi, "predicate": s.predicate()}
        return {"split_id": s.split_id, "bounds": bounds, "outcome": outcome, "rows": rows, "batches": batches, "bytes": size, "elapsed_ms": ms, "error": error}

    def _split(self, split: Split, plan, consumer: Consumer, lock: JobLock) -> tuple[Split, dict]:
        began = time.monotonic()
        reader = SplitReader(split, plan.df(), self.spec.execution.batch_size)
        try:
            lock.ensure_held()
            self.store.mark(self.spec.job_id, split.split_id, "Running")
            consumer(split, reader)
            if not reader.drained:
                raise RuntimeError("the consumer returned before it had read every row")
            lock.ensure_held()  # whoever took the lock decides about this split now
            self.store.mark(self.spec.job_id, split.split_id, "Completed", reader.rows)
            outcome, error = "Completed", None
        except LockLost:
            raise
        except Exception as e:  # one split's failure leaves the others alone
            outcome, error = "Failed", chain(e)
            lock.ensure_held()
            self.store.mark(self.spec.job_id, split.split_id, "Failed", reader.rows, error)
        return split, self._row(split, outcome, reader.rows, reader.batches, reader.bytes, int((time.monotonic() - began) * 1000), error)

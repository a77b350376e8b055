"""The JSON job spec: unknown keys are errors, and all problems are told at once."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import FilterError, SpecError
from ..plans.filters import Entry, Filter, parse_shorthand
from ..plans.policy import POLICIES, Pushdown
from ..plans.splits import STRATEGIES


@dataclass(frozen=True)
class Source:
    """A database, or with ``path`` a folder of Parquet tables."""

    host: str = ""
    port: int = 5432
    user: str = ""
    password_env: str = ""
    database: str = ""
    pool_max: int = 8
    statement_timeout_ms: int | None = None
    application_name: str = "quern"
    schema: str = "public"
    path: str | None = None
    url: str | None = None
    dialect: str = "postgres"


@dataclass(frozen=True)
class Checkpoint:
    dir: str = "./.checkpoints"
    lock_ttl_secs: int = 30


@dataclass(frozen=True)
class ParallelScan:
    strategy: str = "none"
    partitions: int = 1
    partition_column: str = "id"


@dataclass(frozen=True)
class Execution:
    batch_size: int = 8192
    max_batch_bytes: int = 16 << 20
    concurrent_partitions: int | None = None
    use_copy: bool = True
    copy_statement_timeout_ms: int | None = None


@dataclass(frozen=True)
class Distributed:
    scheduler_url: str = ""
    workers: int = 1
    max_retries: int = 1
    executor_timeout_secs: int = 60
    job_timeout_secs: int | None = None


def check_job_id(value: object) -> str | None:
    """What is wrong with a job id."""
    if not isinstance(value, str) or not value:
        return "job_id must not be empty"
    if len(value.encode()) > 128:
        return "job_id must have at most 128 bytes"
    if value != value.strip() or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in value):
        return "job_id must be trimmed and without control characters"
    return None


@dataclass(frozen=True)
class JobSpec:
    job_id: str
    table: str
    source: Source
    columns: tuple[str, ...] | None = None
    filters: tuple[Entry, ...] = ()
    checkpoint: Checkpoint = field(default_factory=Checkpoint)
    pushdown: Pushdown = field(default_factory=Pushdown)
    parallel_scan: ParallelScan = field(default_factory=ParallelScan)
    execution: Execution = field(default_factory=Execution)
    distributed: Distributed = field(default_factory=Distributed)

    @classmethod
    def load(cls, path: str | Path) -> JobSpec:
        try:
            return cls.parse(json.loads(Path(path).read_text()))
        except (OSError, json.JSONDecodeError) as e:
            raise SpecError(f"cannot read {path}") from e

    @classmethod
    def parse(cls, raw: dict) -> JobSpec:
        bad: list[str] = []
        blocks = {"source": Source, "checkpoint": Checkpoint, "pushdown": Pushdown, "parallel_scan": ParallelScan, "execution": Execution, "distributed": Distributed}
        known = {f.name for f in dataclasses.fields(cls)}
        bad += [f"unknown field {k!r}" for k in raw if k not in known]
        bad += [f"{k} is missing" for k in ("job_id", "table", "source") if k not in raw]
        made: dict = {k: raw[k] for k in ("job_id", "table") if k in raw}
        for name, kind in blocks.items():
            own = raw.get(name, {})
            fields = {f.name for f in dataclasses.fields(kind)}
            if not isinstance(own, dict):
                bad.append(f"{name} must be an object")
                continue
            bad += [f"unknown field {name}.{k}" for k in own if k not in fields]
            made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in fields})
        if raw.get("columns") is not None:
            made["columns"] = tuple(raw["columns"])
        try:
            made["filters"] = tuple(_entry(e) for e in raw.get("filters", []))
        except FilterError as e:
            bad.append(str(e))
        if not bad:
            spec = cls(**made)
            bad = spec.problems()
        if bad:
            raise SpecError("invalid job spec: " + "; ".join(bad))
        return spec

    def problems(self) -> list[str]:
        least = [
            ("execution.batch_size", self.execution.batch_size, 1), ("execution.max_batch_bytes", self.execution.max_batch_bytes, 1),
            ("execution.concurrent_partitions", self.execution.concurrent_partitions, 1), ("parallel_scan.partitions", self.parallel_scan.partitions, 1),
            ("distributed.workers", self.distributed.workers, 1), ("distributed.executor_timeout_secs", self.distributed.executor_timeout_secs, 1),
            ("distributed.job_timeout_secs", self.distributed.job_timeout_secs, 1), ("checkpoint.lock_ttl_secs", self.checkpoint.lock_ttl_secs, 4),
            ("source.pool_max", self.source.pool_max, 1),
        ]
        bad = [f"{name} must be >= {low} (got {v})" for name, v, low in least if v is not None and v < low]
        bad += ["filters contains an empty OR-group"] * any(not isinstance(e, Filter) and not e for e in self.filters)
        bad += [p] if (p := check_job_id(self.job_id)) else []
        if self.pushdown.policy not in POLICIES:
            bad.append(f"pushdown.policy must be one of {', '.join(POLICIES)}")
        if self.parallel_scan.strategy not in STRATEGIES:
            bad.append(f"parallel_scan.strategy must be one of {', '.join(STRATEGIES)}")
        if self.parallel_scan.strategy == "keyset" and not self.parallel_scan.partition_column.strip():
            bad.append("parallel_scan.partition_column must be set for strategy 'keyset'")
        if not self.table.strip():
            bad.append("table must not be empty")
        return bad

    def resolved_table(self) -> str:
        return self.table if "." in self.table else f"{self.source.schema}.{self.table}"

    def password(self) -> str:
        try:
            return os.environ[self.source.password_env]
        except KeyError as e:
            raise SpecError(f"the environment has no {self.source.password_env!r}") from e


def _entry(raw: object) -> Entry:
    if isinstance(raw, list):
        return tuple(_entry(x) for x in raw)
    if isinstance(raw, str):
        return parse_shorthand(raw)
    if not isinstance(raw, dict) or not {"column", "op"} <= raw.keys() <= {"column", "op", "value"}:
        raise FilterError(f"a filter is {{column, op, value}}, not {raw!r}")
    return Filter(raw["column"], raw["op"], raw.get("value"))

"""python -m quern run|plan|preview|demo SPEC, checkpoint show|reset SPEC, runs list|show SPEC [RUN]"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession

from .engine import Connector, session_defaults
from .errors import QuernError, chain
from .jobs.checkpoint import Store
from .jobs.report import Reports
from .jobs.run import Job
from .plans.filters import parse_shorthand
from .sources.spec import JobSpec


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "plan", "preview", "demo"):
        c = sub.add_parser(name)
        c.add_argument("spec")
        c.add_argument("--filter", action="append", default=[], help="column<op>value, ANDed with the spec's filters")
        c.add_argument("--master", help="Spark master; a cluster's URL distributes the run")
        c.add_argument("--out", help="run: write each split as Parquet below this folder")
        c.add_argument("--limit", type=int, default=20)
    for name, actions in (("checkpoint", ("show", "reset")), ("runs", ("list", "show"))):
        c = sub.add_parser(name)
        c.add_argument("action", choices=actions)
        c.add_argument("spec")
        c.add_argument("run_id", nargs="?")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        spec = JobSpec.load(args.spec)
        if args.command == "checkpoint":
            store = Store(spec.checkpoint.dir)
            print(json.dumps(store.read(spec.job_id), indent=1) if args.action == "show" else "reset" if store.reset(spec.job_id) else "nothing to reset")
            return 0
        if args.command == "runs":
            reports = Reports(spec.checkpoint.dir)
            if args.action == "show":
                print(json.dumps(reports.read(spec.job_id, args.run_id), indent=1))
            else:
                for r in reports.list(spec.job_id):
                    print(r["run_id"], r["status"], r["started_at"], r["totals"].get("rows_delivered", 0))
            return 0
        spec = dataclasses.replace(spec, filters=(*spec.filters, *map(parse_shorthand, args.filter)))
        builder = session_defaults(SparkSession.builder)
        connector = Connector((builder.master(args.master) if args.master else builder).getOrCreate(), spec)
        if args.command == "plan":
            print(f"table {spec.resolved_table()}: {len(connector.splits())} splits")
            for d in connector.explain_filters():
                print(f"  {d.filter}: {d.text}")
        elif args.command == "preview":
            connector.preview(args.limit).show(args.limit, truncate=False)
        elif args.command == "demo":
            connector.df().groupBy(spec.columns[0] if spec.columns else connector.table.schema.names[0]).count().orderBy("count", ascending=False).show(args.limit)
        else:
            consumer = (lambda s, r: r.write_parquet(f"{args.out}/{s.split_id}")) if args.out else (lambda _, r: r.count() and None)
            outcome = Job(connector).run_with(consumer)
            print(f"run {outcome.run_id}: {outcome.rows} rows, {len(outcome.completed)} splits completed, {len(outcome.skipped)} skipped")
        return 0
    except QuernError as e:
        print(f"error: {chain(e)}", file=sys.stderr)
        return 1

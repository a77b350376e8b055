"""One JSON report an attempt."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from .checkpoint import file_stem, now, write_json

FORMAT_VERSION = 1


class RunReport:
    def __init__(self, job_id: str, run_id: str, plan: dict, kind: str = "Extract", mode: str = "Standalone") -> None:
        self.value: dict = {
            "format_version": FORMAT_VERSION, "job_id": job_id, "run_id": run_id, "status": "Running", "kind": kind, "mode": mode,
            "started_at": now(), "finished_at": None, "duration_ms": None, "plan": plan, "pushdown": [], "splits": [],
            "totals": {"splits_total": 0}, "workers": None, "error": None,
        }

    def finish(self, error: str | None = None) -> None:
        v, splits = self.value, self.value["splits"]
        v["finished_at"] = now()
        start, end = (dt.datetime.fromisoformat(v[k]) for k in ("started_at", "finished_at"))
        v["duration_ms"] = int((end - start).total_seconds() * 1000)
        by = {o: [s for s in splits if s["outcome"] == o] for o in ("Completed", "Skipped", "Failed")}
        rows = {o: sum(s["rows"] for s in x) for o, x in by.items()}
        v["totals"] = {
            "rows_delivered": rows["Completed"], "rows_extracted": rows["Completed"] + rows["Skipped"],
            "splits_completed": len(by["Completed"]) + len(by["Skipped"]), "splits_skipped": len(by["Skipped"]), "splits_failed": len(by["Failed"]),
            "splits_total": max(v["totals"]["splits_total"], len(splits)),
        }
        v["status"] = "Succeeded" if error is None and not by["Failed"] else "Failed"
        v["error"] = error


class Reports:
    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder) / "runs"

    def write(self, report: RunReport) -> Path:
        v = report.value
        path = self.folder / file_stem(v["job_id"]) / f"{v['run_id']}.json"
        write_json(path, v)
        return path

    def read(self, job_id: str, run_id: str) -> dict:
        return json.loads((self.folder / file_stem(job_id) / f"{run_id}.json").read_text())

    def list(self, job_id: str) -> list[dict]:
        folder = self.folder / file_stem(job_id)
        found = [json.loads(p.read_text()) for p in folder.glob("*.json")] if folder.is_dir() else []
        return sorted(found, key=lambda r: (r["started_at"], r["run_id"]))

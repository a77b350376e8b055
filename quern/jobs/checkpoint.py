"""What a job has done, in one JSON file a job, replaced as a whole on every change."""

from __future__ import annotations

import datetime as dt
import json
import os
import socket
import tempfile
import threading
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

from ..errors import CorruptCheckpoint, JobLocked, JobMismatch, LockLost, PlanMismatch
from ..plans.splits import Split

STATES = ("Pending", "Running", "Completed", "Failed")
#: Fixed values of FNV-1a, 64 bits, and the version that fingerprints begin with.
FNV_OFFSET, FNV_PRIME, VERSION = 0xCBF29CE484222325, 0x100000001B3, "v1"


def fnv1a64(data: bytes, h: int = FNV_OFFSET) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME % 2**64
    return h


def fingerprint(plan: dict[str, str]) -> str:
    """Of the components in the order of their names, each with its length before it."""
    h = fnv1a64(VERSION.encode())
    for item in sorted(plan.items()):
        for part in item:
            raw = part.encode()
            h = fnv1a64(raw, fnv1a64(len(raw).to_bytes(8, "little"), h))
    return f"{VERSION}-{h:016x}"


def plan_diff(a: dict[str, str], b: dict[str, str]) -> list[str]:
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def file_stem(job_id: str) -> str:
    """Letters, digits, ``-`` and ``_`` stay, other bytes are escaped; a long one is cut and gets a hash."""
    units = [chr(b) if chr(b).isascii() and (chr(b).isalnum() or b in b"-_") else f"%{b:02X}" for b in job_id.encode()]
    whole = "".join(units)
    if len(whole) <= 150:
        return whole
    head = ""
    for u in units:
        if len(head) + len(u) > 100:
            break
        head += u
    return f"{head}~{fnv1a64(job_id.encode()):016x}"


def write_json(path: Path, value: object) -> None:
    """Replaced atomically, and on disk before this returns."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w") as f:
            json.dump(value, f, indent=1)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat().replace("+00:00", "Z")


class Store:
    """Checkpoints of the jobs under one folder."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)
        self._lock = threading.Lock()

    def path(self, job_id: str) -> Path:
        return self.folder / f"{file_stem(job_id)}.json"

    def read(self, job_id: str) -> dict | None:
        try:
            found = json.loads(self.path(job_id).read_text())
        except FileNotFoundError:
            return None
        except (json.JSONDecodeError, UnicodeDecodeError) as e:
            raise CorruptCheckpoint(f"{self.path(job_id)} is no JSON") from e
        if not isinstance(found, dict) or not {"job_id", "splits"} <= found.keys() or any(s.get("state") not in STATES for s in found["splits"]):
            raise CorruptCheckpoint(f"{self.path(job_id)} is no checkpoint")
        if found["job_id"] != job_id:
            raise JobMismatch(f"{self.path(job_id)} belongs to {found['job_id']!r}")
        return found

    def check_plan(self, job_id: str, plan: dict[str, str]) -> dict | None:
        """The stored checkpoint, if it is of this plan."""
        found = self.read(job_id)
        if found and found.get("fingerprint") != fingerprint(plan):
            raise PlanMismatch(plan_diff(plan, found.get("plan", {})))
        return found

    def begin(self, job_id: str, plan: dict[str, str], splits: list[Split]) -> dict:
        """A fresh checkpoint, or the stored one with what did not complete pending again."""
        found = self.check_plan(job_id, plan)
        if found is None:
            rows = [{"split_id": s.split_id, "state": "Pending", "rows_extracted": 0, "updated_at": now(), "error": None, "bounds": None if s.whole else {"lo": s.lo, "hi": s.hi, "predicate": s.predicate()}} for s in splits]
            found = {"job_id": job_id, "fingerprint": fingerprint(plan), "plan": plan, "splits": rows}
        for s in found["splits"]:
            if s["state"] != "Completed":
                s |= {"state": "Pending", "error": None}
        self._write(found)
        return found

    def _write(self, value: dict) -> None:
        write_json(self.path(value["job_id"]), value | {"updated_at": now()})

    def mark(self, job_id: str, split_id: str, state: str, rows: int = 0, error: str | None = None) -> None:
        with self._lock:
            found = self.read(job_id)
            if found is None:
                raise CorruptCheckpoint(f"no checkpoint of {job_id!r}")
            for s in found["splits"]:
                if s["split_id"] == split_id:
                    s |= {"state": state, "rows_extracted": rows, "error": error, "updated_at": now()}
            self._write(found)

    def reset(self, job_id: str) -> bool:
        try:
            self.path(job_id).unlink()
            return True
        except FileNotFoundError:
            return False


@dataclass
class JobLock:
    """One process at a time works on a job: a file made exclusively, and touched while held.

    A lock whose holder is gone, or has not touched it for ``ttl`` seconds, is taken over.
    """

    path: Path
    ttl: float
    token: str = ""

    @classmethod
    def acquire(cls, folder: str | Path, job_id: str, ttl: float = 30) -> JobLock:
        lock = cls(Path(folder) / f"{file_stem(job_id)}.lock", ttl, uuid.uuid4().hex)
        lock.path.parent.mkdir(parents=True, exist_ok=True)
        for _ in range(3):
            try:
                fd = os.open(lock.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if not lock._stale():
                    raise JobLocked(f"{job_id!r} is being worked on: {lock.path}") from None
                lock._remove_stale()
                continue
            with os.fdopen(fd, "w") as f:
                json.dump({"token": lock.token, "pid": os.getpid(), "host": socket.gethostname()}, f)
            lock._stop = threading.Event()
            lock._thread = threading.Thread(target=lock._beat, daemon=True)
            lock._thread.start()
            return lock
        raise JobLocked(f"{job_id!r} is contended: {lock.path}")

    def _holder(self) -> dict:
        try:
            return json.loads(self.path.read_text())
        except (OSError, json.JSONDecodeError):
            return {}

    def _stale(self) -> bool:
        try:
            if time.time() - self.path.stat().st_mtime > self.ttl:
                return True
        except FileNotFoundError:
            return True
        held = self._holder()
        if held.get("host") == socket.gethostname() and held.get("pid"):
            try:
                os.kill(held["pid"], 0)
            except ProcessLookupError:
                return True
            except PermissionError:
                return False
        return False

    def _remove_stale(self) -> None:
        """By a rename that only one of several takers wins."""
        aside = self.path.with_suffix(f".{self.token}")
        try:
            os.rename(self.path, aside)
            aside.unlink()
        except FileNotFoundError:
            pass

    def _beat(self) -> None:
        while not self._stop.wait(self.ttl / 4):
            if self._holder().get("token") != self.token:
                return
            os.utime(self.path)

    def ensure_held(self) -> None:
        if self._holder().get("token") != self.token:
            raise LockLost(f"another process took {self.path}")

    def release(self) -> None:
        self._stop.set()
        self._thread.join()
        if self._holder().get("token") == self.token:
            self.path.unlink(missing_ok=True)

    def __enter__(self) -> JobLock:
        return self

    def __exit__(self, *_) -> None:
        self.release()

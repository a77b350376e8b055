"""The errors a caller can tell apart."""

from __future__ import annotations


class QuernError(Exception):
    pass


class SpecError(QuernError):
    """A job spec that cannot be used; the message lists every problem."""


class FilterError(QuernError):
    pass


class ProjectionError(QuernError):
    pass


class TableNotFound(QuernError):
    pass


class UnsupportedType(QuernError):
    pass


class UnsupportedValue(QuernError):
    """A value that the target type cannot hold; it is never rounded, cut or made null."""


class CheckpointError(QuernError):
    pass


class PlanMismatch(CheckpointError):
    """The stored plan differs from the present one in the components named."""

    def __init__(self, changed: list[str]) -> None:
        super().__init__(f"the checkpoint belongs to another plan; changed: {', '.join(changed) or 'the fingerprint'}")
        self.changed = changed


class SplitPlanMismatch(CheckpointError):
    pass


class JobMismatch(CheckpointError):
    pass


class CorruptCheckpoint(CheckpointError):
    pass


class JobLocked(CheckpointError):
    pass


class LockLost(CheckpointError):
    pass


class RunFailed(QuernError):
    """Some splits failed; ``outcome`` has the others' results."""

    def __init__(self, message: str, outcome: object) -> None:
        super().__init__(message)
        self.outcome = outcome


def chain(error: BaseException) -> str:
    """An error and its causes on one line; a cause already told is not told again."""
    parts: list[str] = []
    at: BaseException | None = error
    while at is not None:
        text = str(at) or type(at).__name__
        if not parts or text not in parts[-1]:
            parts.append(text)
        at = at.__cause__
    return ": ".join(parts)

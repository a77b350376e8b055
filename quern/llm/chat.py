"""Chat formatting with typed content parts.

A turn's content is a list of parts, each a dict with ``type`` and what belongs to it.
A visitor flattens the parts in order: text is escaped, every other part becomes a
placeholder, and its reference and expanded token count are recorded. The template is

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Control strings have the form ``<|...``; inside texts every ``<``, backslashes, ``|``
gets one more backslash, which ``unescape`` takes away again, so that any text survives.

Cases: null text, role or parts are empty; rows of one conversation are ordered by turn
(nulls first), then role, then segment, so that ties have one order; repeated rows are
repeated turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"
PATCH, AUDIO_MS_PER_TOKEN, TOKENS_PER_PAGE = 28, 40, 512

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Flattens the parts of one turn; ``text`` grows in order, ``attachments`` records the rest."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        handler = getattr(self, f"visit_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown content part type: {kind!r}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.text.append(f"<|{kind}|>")

    def visit_image(self, part: dict) -> None:
        w, h = (max(1, part.get(k) or 1) for k in ("width", "height"))
        self._attach("image", part, -(-w // PATCH) * -(-h // PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, -(-(part.get("millis") or 0) // AUDIO_MS_PER_TOKEN)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, TOKENS_PER_PAGE * max(1, part.get("pages") or 1))


def format_turn(role: str | None, parts: list[dict] | None, loss_roles: frozenset[str]) -> tuple[str, int, int, list[dict]]:
    """``(segment, loss_start, loss_end, attachments)``, the loss span in code points of the segment."""
    visitor = PartVisitor()
    for part in parts or []:
        visitor.visit(part)
    head, body = f"{START}{escape_role(role or '')}\n", "".join(visitor.text)
    at = len(head)
    return f"{head}{body}{END}\n", at, at + len(body) * ((role or "") in loss_roles), visitor.attachments


SEGMENTS = "segment string, loss_start int, loss_end int, attachments array<struct<type:string,ref:string,tokens:bigint>>, expanded_tokens bigint"


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted segment a turn: a conversation's output is its segments joined in order.

    Segments rather than whole conversations, so that no row grows with a conversation's length.
    """
    roles = frozenset(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [format_turn(r, p, roles) for r, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.int32()),
                    pa.array([x[2] for x in out], pa.int32()),
                    pa.array([x[3] for x in out], pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
                    pa.array([sum(a["tokens"] for a in x[3]) for x in out], pa.int64()),
                ],
                names=["conv", "turn", "role", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    narrow = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(parts).alias("parts"))
    return narrow.mapInArrow(run, f"conv bigint, turn bigint, role string, {SEGMENTS}")


def read_chat(formatted: DataFrame) -> DataFrame:
    """Parses formatted segments and digests each conversation, turn by turn.

    A conversation's digests are chained, so its turns are read in order by one task;
    they stream through it, sorted on disk where they must, and only the digest's state
    is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)
            done.clear()
            return batch

        for batch in batches:
            for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = _SEGMENT.fullmatch(segment)
                if found is None:
                    raise ValueError(f"conversation {conv}: a segment does not follow the template")
                state[1] += 1
                state[2].update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode())
                loss = unescape(segment[start:end])
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(segment)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    ordered = formatted.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "segment")
    return ordered.select("conv", "segment", "loss_start", "loss_end").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

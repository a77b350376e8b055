"""Repeated passages as runs of repeated lines.

A text is cut into lines, and long lines at sentence ends; every line has a hash of its
trimmed bytes. Line hashes that occur more than once in the corpus are candidates;
adjacent ones are joined, and joined lines of fewer than ``MIN_WORDS`` words are left out.
All lines of a passage that recurs are found this way, whatever stands around it.
Candidates are compared byte by byte; the occurrence with the least (doc_id, hash of the
text, place) stays, every other one goes if the lines that go together have at least
``MIN_WORDS`` words.

``spare_copies`` leaves lines that a text shares with one text that holds most of its
words, if the full shingle sets of the two are as similar as ``neardup`` asks for: such a
text is a copy, which document-level deduplication takes out.

A skeleton of each text (hashes, ends and word counts of its lines) is written once; all
searching is done on skeletons. Texts are shuffled twice: to compare the bytes of what is
to go with those of what stays, and to take it out; lines are compared as they were hashed,
without the white space around them. A hash whose occurrences differ in bytes removes
nothing.

Cases: null, empty and blank texts have no lines and stay; rows equal in id and text are
one text; a text of any length is cut whole; a text all of whose lines go becomes empty;
rows without an id are told apart by their texts, and from all that have one; an empty
table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, row_key
from .neardup import DENOMINATOR, NUMERATOR
from .shingles import mix, shingle_set

ROLL, ONE_IN = 2, 2
MIN_WORDS, COPY_SHARE = 35, 0.6

#: Line ends. Each branch begins with a literal, so that the search skips from one such character to the next.
_END = re.compile(r"\n\n*|\.[ \t]+|![ \t]+|\?[ \t]+")
_ROLLING = np.array([xxhash.xxh3_64_intdigest(f"line {i}") | 1 for i in range(ROLL)], np.uint64)
_GOLDEN = 0x9E3779B97F4A7C15


def lines_of(text: str) -> tuple[list[str], list[int]]:
    """The trimmed lines that are not blank, and where each ends in the text; blank ones belong to the line before."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    lines = [text[a:b].strip() for a, b in zip([0, *ends], ends, strict=False)]
    if "" not in lines:
        return lines, ends
    own: list[str] = []
    stops: list[int] = []
    for line, end in zip(lines, ends, strict=True):
        if line:
            own.append(line)
            stops.append(end)
        elif stops:
            stops[-1] = end
    return own, stops


def chunks_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of several texts whose lines follow one another: first line, end, and hash of each; none crosses a text's end."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.cumsum(counts)
    heads = np.zeros(n, bool)
    heads[(ends - counts)[counts > 0]] = True
    rolled = hashes * _ROLLING[0]
    for i in range(1, ROLL):
        before = np.zeros(n, np.uint64)
        before[i:] = hashes[: n - i]
        for k in range(i):  # nothing rolls over from the text before
            before[k:][heads[: n - k]] = 0
        rolled += before * _ROLLING[i]
    last = mix(rolled) % np.uint64(ONE_IN) == 0
    last[ends[counts > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop[:-1]])
    place = np.arange(n) - np.repeat(start, stop - start)
    parts = mix(hashes + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLDEN))
    return start, stop, mix(np.add.reduceat(parts, start) + (stop - start).astype(np.uint64))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, ends, words = [], [], []
        for text in batch.column(2):
            lines, at = lines_of(text.as_py() or "")
            hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)).tobytes())
            ends.append(np.array(at, np.int32).tobytes())
            words.append(np.array([x.count(" ") + 1 for x in lines], np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (hashes, ends, words))], names=["id", "th", "hashes", "ends", "words"])


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(2).to_pylist()
        counts = np.array([len(x) // 8 for x in raw], np.int64)
        row = np.repeat(np.arange(len(raw)), counts)
        index = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        at = pa.array(row)
        h = np.frombuffer(b"".join(raw), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(index), pa.array(h)], names=["id", "th", "line", "h"])


_OCCURRENCE = "h bigint, id bigint, th bigint, line int, start int, stop int, words int, total int"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated lines, without the runs of them that do not reach ``MIN_WORDS``; all texts of a batch at once."""
    names = [x.split()[0] for x in _OCCURRENCE.split(", ")]
    for batch in batches:
        raw, raw_ends, raw_words = (c.to_pylist() for c in batch.columns[2:5])
        h = np.frombuffer(b"".join(raw), np.int64)
        ends, words = (np.frombuffer(b"".join(x), np.int32) for x in (raw_ends, raw_words))
        counts = np.array([len(x) // 8 for x in raw], np.int64)
        base = np.cumsum(counts) - counts
        text = pc.list_parent_indices(batch.column(5)).to_numpy()
        line = batch.column(5).flatten().to_numpy()
        order = np.lexsort((line, text))
        text, line = text[order], line[order]
        run = np.cumsum((np.diff(text, prepend=-1) != 0) | (np.diff(line, prepend=-2) != 1)) - 1
        at = base[text] + line
        good = (np.bincount(run, words[at]) >= MIN_WORDS)[run]
        text, line, at = text[good], line[good], at[good]
        sums = np.append(0, np.cumsum(words, dtype=np.int64))
        total = (sums[base + counts] - sums[base])[text]
        start = np.where(line > 0, ends[at - 1], 0)
        own = pa.array(text)
        rest = [line, start, ends[at], words[at], total]
        yield pa.RecordBatch.from_arrays([pa.array(h[at]), batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x.astype(np.int32)) for x in rest)], names=names)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, h, start, stop) lists to a row for each spot, with its line as it was hashed."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            starts, stops = (part.column(i).flatten().to_pylist() for i in (2, 3))
            ends = np.cumsum(pc.list_value_length(part.column(1)).to_numpy()).tolist()
            body: list[str] = []
            for text, lo, hi in zip(part.column(0).to_pylist(), [0, *ends], ends, strict=False):
                body += [text[a:b].strip() for a, b in zip(starts[lo:hi], stops[lo:hi], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(1).flatten(), pa.array(body, pa.string())], names=["h", "body"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, th, kid, kth)`` of pairs whose full shingle sets reach the similarity of near-duplicates."""
    for batch in batches:
        alike = []
        for one, two in zip(batch.column(4), batch.column(5), strict=True):
            x, y = shingle_set(one.as_py()), shingle_set(two.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            alike.append(DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both) > 0)
        yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["id", "th", "kid", "kth"]).filter(pa.array(alike, pa.bool_()))


def _without_copies(gone: DataFrame, rows: DataFrame) -> DataFrame:
    """``gone`` without what near-duplicates share with the one text that holds most of their words."""
    at = F.coalesce("id", F.lit(-1)).alias("at")
    keyed = gone.select("*", at, F.coalesce("kid", F.lit(-1)).alias("kat"))
    shares = keyed.where("at <> kat or th <> kth").groupBy("at", "th", "kat", "kth").agg(F.sum("words").alias("n"), F.max("total").alias("total"))
    texts = rows.select(at, "th", "text").dropDuplicates(["at", "th"])
    pairs = shares.where(F.col("n") >= COPY_SHARE * F.col("total")).select("at", "th", "kat", "kth").join(texts, ["at", "th"])
    pairs = pairs.join(texts.toDF("kat", "kth", "other"), ["kat", "kth"]).select("at", "th", "kat", "kth", "text", "other")
    copies = cut(pairs.mapInArrow(_alike, "id bigint, th bigint, kid bigint, kth bigint"), "copies").toDF("at", "th", "kat", "kth")
    return keyed.join(copies, ["at", "th", "kat", "kth"], "left_anti").select(gone.columns)


_REMOVED = "id bigint, th bigint, removed array<struct<start:int,end:int>>, removed_words bigint, used array<struct<h:bigint,start:int,stop:int>>"


def _decide(columns: list[np.ndarray], ids: pa.Array) -> pa.RecordBatch:
    """Of whole texts' lines ``(th, line, start, stop, words, h)`` in order: the runs of enough words, as spans of each text."""
    th, line, start, stop, words, h = columns
    own = ids.fill_null(0).to_numpy()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    text = np.ones(len(th), bool)
    text[1:] = (own[1:] != own[:-1]) | (th[1:] != th[:-1]) | (null[1:] != null[:-1])
    first = text.copy()
    first[1:] |= np.diff(line) != 1
    heads = np.flatnonzero(first)
    sums = np.add.reduceat(words.astype(np.int64), heads)
    lengths = np.diff(heads, append=len(th))
    good = sums >= MIN_WORDS
    kept = np.repeat(good, lengths)
    heads, sums, tails = heads[good], sums[good], (heads + lengths - 1)[good]
    of_run, of_line = np.cumsum(text)[heads], np.cumsum(text)[kept]
    names, at = np.unique(of_run, return_index=True)
    texts = heads[at]

    def nested(parts: list[tuple[str, np.ndarray]], owner: np.ndarray) -> pa.Array:
        offsets = np.append(np.searchsorted(owner, names), len(owner)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for _, x in parts], [n for n, _ in parts]))

    removed = nested([("start", start[heads]), ("end", stop[tails])], of_run)
    used = nested([("h", h[kept]), ("start", start[kept]), ("stop", stop[kept])], of_line)
    total = np.add.reduceat(sums, at) if len(at) else sums
    return pa.RecordBatch.from_arrays([ids.take(pa.array(texts)), pa.array(th[texts]), removed, pa.array(total), used], names=["id", "th", "removed", "removed_words", "used"])


def _decided(gone: DataFrame) -> DataFrame:
    """Lines stream by, sorted by text and place; a text's lines are held until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows:
                yield _decide([rows.column(i).to_numpy() for i in range(1, 7)], rows.column(0).chunk(0))

        for batch in batches:
            if not batch.num_rows:
                continue
            id_, th = batch.column(0), batch.column(1).to_numpy()
            own, null = id_.fill_null(0).to_numpy(), id_.is_null().to_numpy(zero_copy_only=False)
            same = (th == th[-1]) & (own == own[-1]) & (null == null[-1])
            last = len(th) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                held.append(batch.slice(0, last))
                yield from close()
                held = [batch.slice(last)]
            elif held and (held[-1].column(0)[-1], held[-1].column(1)[-1]) != (id_[-1], batch.column(1)[-1]):
                yield from close()
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from close()

    ordered = gone.repartition("id", "th").sortWithinPartitions("id", "th", "line")
    return ordered.select("id", "th", "line", "start", "stop", "words", "h").mapInArrow(run, _REMOVED)


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", spare_copies: bool = False) -> DataFrame:
    """``(id, th, removed array<struct<start,end>>, removed_words)`` of every text that loses lines."""
    rows = df.select(F.col(key).cast("long").alias("id"), row_key(key, text)[1].alias("th"), F.col(text).alias("text"))
    skeletons = cut(rows.mapInArrow(_skeletons, "id bigint, th bigint, hashes binary, ends binary, words binary"), "skeletons")
    lines = skeletons.select("id", "th", "hashes").mapInArrow(_line_rows, "id bigint, th bigint, line int, h bigint")
    repeated = cut(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    at = F.coalesce("id", F.lit(-1))
    own = lines.join(repeated.hint("shuffle_hash"), "h", "left_semi").groupBy(at.alias("at"), "th").agg(F.collect_set("line").alias("own"))
    held = skeletons.withColumn("at", at).join(own.hint("shuffle_hash"), ["at", "th"]).select("id", "th", "hashes", "ends", "words", "own")
    found = held.mapInArrow(_occurrences, _OCCURRENCE)
    if not skeletons.groupBy(at, "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        found = found.distinct()  # rows that repeat are one text
    found = cut(found, "occurrences")
    drop(skeletons, repeated)
    keepers = cut(found.groupBy("h").agg(F.min(F.struct("id", "th", "line", "start", "stop")).alias("keeper"), F.count("*").alias("n")).where("n > 1").select("h", "keeper"), "keepers")
    stays = F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("th") == F.col("keeper.th")) & (F.col("line") == F.col("keeper.line"))
    gone = cut(found.join(keepers.hint("shuffle_hash"), "h").where(~stays).select(*found.columns, "keeper.id", "keeper.th").toDF(*found.columns, "kid", "kth"), "to-go")
    drop(found)
    if spare_copies:
        every, gone = gone, cut(_without_copies(gone, rows), "to-go-no-copies")
        drop(every)
    removed = cut(_decided(gone), "removed")

    # The bytes of all that goes beside those of what stays: equal hashes must mean equal bytes.
    used = removed.select("id", "th", F.explode("used").alias("u")).select("id", "th", "u.*")
    kept = keepers.join(used.select("h").distinct().hint("shuffle_hash"), "h", "left_semi").select("keeper.id", "keeper.th", "h", "keeper.start", "keeper.stop")
    spots = cut(used.unionByName(kept).groupBy(at.alias("at"), "th").agg(F.collect_set(F.struct("h", "start", "stop")).alias("spots")), "spots")
    bodies = rows.withColumn("at", at).join(spots.hint("shuffle_hash"), ["at", "th"]).select("text", "spots.h", "spots.start", "spots.stop").mapInArrow(_bodies, "h bigint, body string")
    differ = cut(bodies.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "differ")
    drop(spots, keepers)
    if not differ.isEmpty():
        unequal, removed = removed, cut(_decided(gone.join(differ, "h", "left_anti")), "removed")
        drop(unequal)
    drop(gone, differ)
    return removed.drop("used")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", spare_copies: bool = False) -> DataFrame:
    """``df`` with repeated passages taken out of ``text``, and columns ``removed`` and ``removed_words``; columns of those names are replaced."""
    gone = repeated_passages(df, key, text, spare_copies).select(F.coalesce("id", F.lit(-1)).alias("at"), "th", F.struct("removed", "removed_words").alias("found"))
    at, th = row_key(key, text)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), at.alias("at"), th.alias("th"))
    both = rows.join(gone.hint("shuffle_hash"), ["at", "th"], "left")
    body = f"row.`{text}`"
    # The pieces between the spans that go; positions count code points.
    kept = F.expr(
        f"""concat_ws('', transform(sequence(0, size(found.removed)), i -> substring({body},
            if(i = 0, 0, found.removed[greatest(i - 1, 0)].end) + 1,
            if(i = size(found.removed), length({body}), found.removed[least(i, size(found.removed) - 1)].start) - if(i = 0, 0, found.removed[greatest(i - 1, 0)].end))))"""
    )
    out = [F.when(F.col("found").isNull(), F.col(body)).otherwise(kept).alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns if c not in ("removed", "removed_words")]
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return both.select(*out, F.coalesce("found.removed", none).alias("removed"), F.coalesce("found.removed_words", F.lit(0)).cast("long").alias("removed_words"))

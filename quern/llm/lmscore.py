"""Language-model scores of whole texts.

Token counts come from every training text. The words that are most frequent are symbols
of a recurrent model (see ``gru``), grouped into classes by frequency; all other words
fall into classes by their shape, and inside a shape's class a word has its smoothed
share of the class's counts. Texts are read once more as symbols, two bytes each; training
and scoring read those. The rounds split the training texts between them by hash, so that
the weights learn from every text once. In a round every group of about ``GROUP_TOKENS``
tokens trains a copy of the model; the copies are averaged by the tokens they saw, in the
executors. Rounds and groups follow from the texts' hashes, so scores do not depend on how
the table is cut into files.

Counts of the ``KNOWN`` most frequent words at most go to every task; the others are
joined by hash with the tokens of the texts, each once a text.

Cases: null and empty texts consist of the end alone; words never seen have count 0; an
untrained table gives the smoothed shares of no counts; a text of any length is scored
whole; rows that repeat are scored each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .gru import Gru
from .shingles import split_words

END = b"\n"  # no word holds white space
WORD_CLASSES, PER_CLASS = 32, 32
KNOWN, KNOWN_BYTES = 200_000, 48
ROUNDS = 2
#: Tokens of the group that trains one copy of the model; beyond ``MAX_GROUPS`` groups a round, groups grow.
GROUP_TOKENS, MAX_GROUPS = 600_000, 1 << 14
#: Rows of weights that one task adds up.
FAN = 8
#: Tokens that a task holds at a time, or one longer text.
BLOCK_TOKENS, SCORED_TOKENS = 1_000_000, 2_000_000
#: Bytes of text that a task splits at a time, or one longer text.
SLICE_BYTES = 16 << 20
SHAPES = 24
_IS_DIGIT, _IS_HIGH, _ENDS = (np.isin(np.arange(256), list(x)) for x in (b"0123456789", range(128, 256), b".,;:!?"))


def shapes_of(words: pa.Array) -> np.ndarray:
    """For each word, none empty, a class by what it looks like: its first letter beyond ASCII, or its length and ending."""
    if not len(words):
        return np.empty(0, np.int64)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
    starts, ends, sizes = at[:-1] - at[0], at[1:] - at[0], np.diff(at)
    out = np.minimum(4, np.maximum(0, sizes - 3) // 2) * 2 + _ENDS[data[ends - 1]]
    out[np.add.reduceat(_IS_DIGIT[data].astype(np.int32), starts) > 0] = 10
    high = np.flatnonzero(_IS_HIGH[data])
    first = np.searchsorted(high, starts)
    beyond = np.flatnonzero(first < np.searchsorted(high, ends))
    place = high[first[beyond]]
    follows = np.where(place + 1 < ends[beyond], data[np.minimum(place + 1, len(data) - 1)], 0)
    out[beyond] = 11 + (data[place].astype(np.int64) * 31 + follows) % 13
    return out.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 0, SLICE_BYTES):
            words, _ = split_words(batch.column(0))
            counts = words.value_counts()
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([counts.field(0), pa.array([END], pa.binary())]), pa.concat_arrays([counts.field(1), pa.array([batch.num_rows], pa.int64())])], names=["token", "c"]
            )


def token_counts(texts: DataFrame) -> DataFrame:
    """``(token binary, c)`` over one column of texts."""
    return cut(texts.mapInArrow(_count, "token binary, c bigint").where("c > 0").groupBy("token").agg(F.sum("c").alias("c")), "counts")


class Vocabulary:
    """What every task needs of the counts: bounded by ``KNOWN`` words."""

    def __init__(self, known: list[tuple[bytes, int]], total: int, distinct: int, shapes: dict[int, tuple[int, int]]) -> None:
        self.total, self.distinct = total, distinct
        ordered = sorted(known, key=lambda x: (-x[1], x[0]))
        if END not in dict(ordered[: WORD_CLASSES * PER_CLASS]):
            ordered = [x for x in ordered if x[0] != END]
            ordered.insert(WORD_CLASSES * PER_CLASS - 1, (END, dict(known).get(END, 0)))
        known = [w for w, _ in ordered]
        self.end = known.index(END)
        counts = np.array([c for _, c in ordered], float)
        words, top = WORD_CLASSES * PER_CLASS, known[: WORD_CLASSES * PER_CLASS]
        self.word_counts = np.zeros(words)
        self.word_counts[: len(top)] = counts[:words]
        # Words of the model are no members of their shape's class.
        self.shape_counts = np.array([shapes.get(s, (0, 0)) for s in range(SHAPES)], np.float64)
        own = [(w, c) for w, c in ordered[:words] if c and w != END]
        np.subtract.at(self.shape_counts, shapes_of(pa.array([w for w, _ in own], pa.binary())), np.array([(c, 1) for _, c in own], float).reshape(-1, 2))
        self.log_base = math.log10(total + 0.5 * (distinct + 1))
        # Rows: known words, then the shapes of unknown ones, whose own counts are added later.
        kinds = np.concatenate([np.zeros(len(top), np.int64), shapes_of(pa.array(known[words:], pa.binary())), np.arange(SHAPES)])
        inside = np.arange(len(kinds)) < len(top)
        log_shape = np.log10(np.maximum(self.shape_counts[:, 0], 0) + 0.5 * (np.maximum(self.shape_counts[:, 1], 0) + 1))[kinds]
        self.symbols = np.where(inside, np.arange(len(kinds)), words + kinds).astype(np.int16)
        self.log_c = np.concatenate([np.log10(counts + 0.5), np.zeros(SHAPES)])
        self.share = np.where(inside, 0.0, self.log_c - log_shape)
        self.seen = np.concatenate([counts > 0, np.zeros(SHAPES, bool)])
        self.known = pa.array(known, pa.binary())

    def rows(self, words: pa.Array) -> np.ndarray:
        """The row of every known word; any other word has the row of its shape, which follow."""
        place = pc.index_in(words, value_set=self.known)
        unknown = pc.is_null(place)
        out = place.fill_null(0).to_numpy().copy()
        out[unknown.to_numpy(zero_copy_only=False)] = len(self.known) + shapes_of(words.filter(unknown))
        return out

    def model(self) -> Gru:
        words = WORD_CLASSES * PER_CLASS
        return Gru(words, words + SHAPES, PER_CLASS, np.concatenate([self.word_counts, np.maximum(self.shape_counts[:, 0], 0)]))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded part of the counts: totals, totals by shape, and the most frequent words."""

    def by_shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((SHAPES, 2), np.int64)
        for batch in batches:
            own = batch.filter(pc.not_equal(batch.column(0), END))
            kinds = shapes_of(own.column(0))
            sums[:, 0] += np.bincount(kinds, own.column(1).to_numpy(), SHAPES).astype(np.int64)
            sums[:, 1] += np.bincount(kinds, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["shape", "c", "v"])

    shapes = counts.mapInArrow(by_shape, "shape bigint, c bigint, v bigint").groupBy("shape").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The least count that at most KNOWN words reach, on a scale of eighths of powers of two.
    scale = F.floor(F.log2("c") * 8).cast("int")
    short = counts.where(F.length("token") <= KNOWN_BYTES)
    steps = sorted(((r["s"], r["n"]) for r in short.groupBy(scale.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    reached, least = 0, None
    for s, n in steps:
        if reached + n > KNOWN:
            break
        reached, least = reached + n, s
    known = short.where(scale >= F.lit(least)).select("token", "c").collect() if least is not None else []
    return Vocabulary([(bytes(r["token"]), r["c"]) for r in known], sums["n"], sums["v"], {r["shape"]: (r["c"], r["v"]) for r in shapes})


_CODED = "uid bigint, doc_id bigint, held_out boolean, at bigint, n_tokens bigint, known bigint, log_c double, share double, rare array<binary>, times array<int>, codes binary"


def coded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Every text read once more, as the symbols of the model and what is added to their scores; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CODED.split(", ")]
        for whole in batches:
            for batch in slices(whole, 4, SLICE_BYTES):
                words, sizes = split_words(batch.column(4))
                ends = np.cumsum(sizes + 1)
                starts = ends - sizes - 1
                place = np.full(int(ends[-1]), vocab.end, np.int32)
                inside = np.ones(len(place), bool)
                inside[ends - 1] = False  # where a text's end stands
                place[inside] = vocab.rows(words)
                symbols = vocab.symbols[place]
                # Words whose counts are not here, once a text.
                unknown = np.flatnonzero(place >= len(vocab.known))
                row = np.searchsorted(ends, unknown, side="right")
                rare = words.take(pa.array(unknown - row)).to_pylist()
                bounds = np.searchsorted(row, np.arange(len(ends) + 1)).tolist()
                own = [Counter(rare[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)]
                sums = [np.add.reduceat(x[place], starts) for x in (vocab.seen.astype(np.int64), vocab.log_c, vocab.share)]
                lists = [pa.array([list(c.keys()) for c in own], pa.list_(pa.binary())), pa.array([list(c.values()) for c in own], pa.list_(pa.int32()))]
                codes = pa.array([symbols[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes + 1), *map(pa.array, sums), *lists, codes], names=names)

    own = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", F.xxhash64("doc_id", "text").alias("at"), "text")
    return cut(own.mapInArrow(run, _CODED), "coded")


_WEIGHTS = "group bigint, seen bigint, sums binary"


def _mean(parts: DataFrame, groups: int) -> np.ndarray | None:
    """The mean of weights by symbols seen: ``FAN`` rows a task become one, level by level, in an order that is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["group"] // FAN, r["seen"], r["sums"]) for batch in batches for r in batch.to_pylist())
        for group, own in groupby(rows, key=lambda r: r[0]):
            seen, total = 0, np.zeros(1)
            for _, n, raw in own:
                seen, total = seen + n, total + np.frombuffer(raw, np.float64)
            yield pa.RecordBatch.from_pylist([{"group": group, "seen": seen, "sums": total.tobytes()}], pa.schema([("group", pa.int64()), ("seen", pa.int64()), ("sums", pa.binary())]))

    while True:
        tasks = -(-groups // FAN)
        parts = cut(parts.repartition(tasks, F.expr(f"group div {FAN}")).sortWithinPartitions("group").mapInArrow(run, _WEIGHTS), "weights")
        groups = tasks
        if groups == 1:
            row = parts.first()
            return np.frombuffer(row["sums"], np.float64) / row["seen"] if row else None


def train(texts: DataFrame, vocab: Vocabulary) -> Gru:
    """Rounds of local training on groups of ``(at, codes)``, averaged by symbols.

    A text's round and group follow from its hash alone, and a group is read in the order
    of hashes: the weights do not depend on how the table is cut into files.
    """
    model = vocab.model()
    groups = max(1, min(MAX_GROUPS, -(-vocab.total // (ROUNDS * GROUP_TOKENS))))
    first = vocab.end
    for k in range(ROUNDS):
        start = model.flat()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((g, np.frombuffer(c.as_buffer(), np.int16)) for batch in batches for g, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            for group, own in groupby(rows, key=lambda r: r[0]):
                model.load(start)  # noqa: B023
                seen = model.train(_blocks(c for _, c in own), first)
                sums = model.flat().astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([seen], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["group", "seen", "sums"])

        own = texts.where(F.pmod("at", F.lit(ROUNDS)) == k).select(F.pmod(F.shiftright("at", 8), F.lit(groups)).alias("group"), "at", "codes")
        dealt = own.repartition(groups, "group").sortWithinPartitions("group", "at", "codes").select("group", "codes")
        mean = _mean(dealt.mapInArrow(run, _WEIGHTS), groups)
        if mean is not None:
            model.load(mean)
    return model


def _blocks(texts: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in lists of ``BLOCK_TOKENS`` symbols, or one longer text."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BLOCK_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


_SCORED = "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, log_c double, model double"


def scores(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    counts = token_counts(rows.where(~F.col("held_out")).select("text"))
    vocab = vocabulary(counts)
    texts = coded(rows, vocab)
    own, first = train(texts.where(~F.col("held_out")), vocab), vocab.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCORED.split(", ")]
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [np.frombuffer(c.as_buffer(), np.int16) for batch in held for c in batch.column(7)]
            ll = own.log_likelihood(texts, first) / math.log(10)
            at = 0
            for batch in held:
                model = ll[at : at + batch.num_rows] + batch.column(6).to_numpy()
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(model, pa.float64())], names=names)
            held.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                held.append(whole.slice(at, 512))
                size += sum(held[-1].column(3).to_pylist())
                if size >= SCORED_TOKENS:
                    yield from flush()
                    size = 0
        yield from flush()

    scored = texts.select("uid", "doc_id", "held_out", "n_tokens", "known", "log_c", "share", "codes").mapInArrow(run, _SCORED)
    tokens = texts.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    joined = tokens.join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = joined.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("rare_log_c"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    total = scored.join(rare, "uid", "left").fillna(0, ["rare_log_c", "rare_known"])
    return total.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("log_c") + F.col("rare_log_c") - F.col("n_tokens") * F.lit(vocab.log_base)).alias("base_score"),
        (F.col("model") + F.col("rare_log_c")).alias("score"),
    )


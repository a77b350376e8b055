"""MinHash near-duplicates by a multi-index Hamming join.

Texts with equal shingle sets are one class. A class has a signature of ``POSITIONS``
minima of ``b`` = 16 bits, split into ``CHUNKS`` chunks. Two signatures that differ in
fewer than ``CHUNKS * (ERRORS + 1)`` positions have, by the pigeonhole principle, a
chunk with at most ``ERRORS`` errors; enumerating a chunk's allowed errors as left-out
positions gives keys of which such a pair shares one. Pairs at the similarity sought
miss every chunk with a probability of 6e-6 (0.224 ** 8 at 0.85).

A bucket's members are not paired with one another at once:

1. each class is tested against the least member of its buckets, the nearest first;
   what is confirmed makes a forest, whose trees are contracted;
2. in buckets that still hold several trees, shingles that only one of these classes
   has are counted. With ``rest`` others, a class has no link if ``rest / size`` is below
   the similarity sought, and a pair none if the lesser rest is too small for it: an exact
   and linear bound, which clears texts that only share a passage. Every class left is
   tested against its bucket's most central member, that with the greatest share of rest;
3. last, members of one bucket that are still in different components and that the bound,
   counted again, leaves linkable are compared by signature, in blocks of bounded size;
   what is near enough is paired, so that no link is lost.

Every link is confirmed on the full shingle sets.

Cases: null and empty texts have no shingles and are linked with nothing; a text of any
length goes into its class whole; equal texts are one class; rows that repeat a doc_id
are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .shingles import mix, set_digest, shingle_set

POSITIONS, CHUNKS, ERRORS = 48, 8, 1
ROWS = POSITIONS // CHUNKS
#: Candidates that differ in more positions are not tested: 0.85 means 7.2 on average, 24 is 6.8 standard deviations off.
MAX_DISTANCE = 24
#: Members of a bucket that one task compares with as many others.
BLOCK = 256
NUMERATOR, DENOMINATOR = 85, 100

_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(f"minimum {i}") | 1 for i in range(POSITIONS)], np.uint64)
#: A random odd factor for each position of a key, and one term for each (chunk, left-out position).
_FACTORS = np.array([xxhash.xxh3_64_intdigest(f"position {i}") | 1 for i in range(POSITIONS)], np.uint64)
_TERMS = np.array([xxhash.xxh3_64_intdigest(f"key {i}") for i in range(CHUNKS * ROWS)], np.uint64).reshape(CHUNKS, ROWS)


def signature(shingles: np.ndarray) -> bytes:
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 8192):
        part = shingles[at : at + 8192]
        np.minimum(least, (part[None, :] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    return (least & np.uint64(0xFFFF)).astype("<u2").tobytes()


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """(n, POSITIONS) to (n, CHUNKS * ROWS): a key for each chunk and position left out of it."""
    weighed = mix((signatures.astype(np.uint64) + np.uint64(1)) * _FACTORS[None, :]).reshape(-1, CHUNKS, ROWS)
    total = weighed.sum(axis=2, dtype=np.uint64)
    return mix(total[:, :, None] - weighed + _TERMS[None, :, :]).reshape(len(signatures), -1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, classes, signatures = [], [], []
        for text in batch.column(2):
            own = shingle_set(text.as_py())
            sizes.append(len(own))
            classes.append(int.from_bytes(set_digest(own)[:8], "little", signed=True) if len(own) else None)
            signatures.append(signature(own) if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(signatures, pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "class", "sig"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, POSITIONS)


def _bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = keys_of(_matrix(part.column(1)))
            nodes = np.repeat(part.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys.ravel().view(np.int64))], names=["class", "key"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, sig_a, sig_b) to (a, b, distance), without what is too far or too different in size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        distance = (_matrix(batch.column(4)) != _matrix(batch.column(5))).sum(axis=1)
        n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        near = (distance <= MAX_DISTANCE) & (DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(distance[near].astype(np.int32))], names=["a", "b", "distance"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingle_set(t.as_py()).astype("<u8").tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["class", "shingles"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            own = [np.frombuffer(v.as_buffer(), "<i8") for v in part.column(1)]
            nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(own))], names=["class", "h"])


def _linkable(members: DataFrame, classes: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Members ``(key, class, root)`` that can have a link to another root's in their bucket, with their size and rest."""
    held = members.select("class").distinct()
    rows = sets.join(held, "class", "left_semi").mapInArrow(_shingle_rows, "class bigint, h bigint")
    single = rows.groupBy("h").agg(F.min("class").alias("class"), F.count("*").alias("n")).where("n = 1").groupBy("class").agg(F.count("*").alias("single"))
    sizes = classes.select("class", F.col("n_shingles").alias("size")).join(held, "class", "left_semi").join(single, "class", "left")
    able = sizes.select("class", "size", (F.col("size") - F.coalesce("single", F.lit(0))).alias("rest")).where(f"{DENOMINATOR} * rest >= {NUMERATOR} * size")
    left = members.select("key", "class", "root").join(able, "class")
    mixed = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return cut(left.join(mixed, "key"), name)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of two blocks of a bucket to the pairs across roots that the bound and the signatures leave possible.

    A pair comes from the first key that its classes share, and only from there.
    """
    for batch in batches:
        keys, same = batch.column(0).to_numpy(), (batch.column(1).to_numpy() == batch.column(2).to_numpy())
        lists = batch.column(3)
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for g in range(batch.num_rows):
            own = lists[g].values
            node, root, size, rest, block = (own.field(n).to_numpy() for n in ("class", "root", "size", "rest", "block"))
            sig = _matrix(own.field("sig"))
            shared = keys_of(sig)
            for i in range(len(node) - 1):
                # Against the members after it: of the other block, or of its own where both are one.
                at = slice(i + 1, None)
                least = np.minimum(rest[i], rest[at])
                good = (root[i] != root[at]) & (DENOMINATOR * least >= NUMERATOR * (size[i] + size[at] - least))
                if not same[g]:
                    good &= block[i] != block[at]
                found = np.flatnonzero(good) + i + 1
                found = found[(sig[i] != sig[found]).sum(axis=1) <= MAX_DISTANCE]
                equal = shared[i] == shared[found]
                first = shared[i][equal.argmax(axis=1)].view(np.int64) == keys[g]
                found = found[first & equal.any(axis=1)]
                out_a.append(np.full(len(found), node[i]))
                out_b.append(node[found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def _pairs(able: DataFrame, classes: DataFrame) -> DataFrame:
    """Possible pairs within buckets; a large bucket is split into blocks, and every two blocks meet in a task of their own."""
    counts = cut(able.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "bucket-sizes")
    signed = able.join(classes.select("class", "sig"), "class").join(counts, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    spread = signed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("class", "root", "size", "rest", "block", "sig")
    met = spread.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(member).alias("members"))
    return met.mapInArrow(_block_pairs, "a bigint, b bigint")


def _measured(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    a = classes.select(F.col("class").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    b = classes.select(F.col("class").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_distances, "a bigint, b bigint, distance int")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a bigint, b bigint")


def _roots(parents: DataFrame) -> DataFrame:
    """``(node, root)`` of a forest ``(node, parent)`` whose parents are smaller, by pointer jumping."""
    now = parents.select("node", F.col("parent").alias("root"))
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = cut(now.join(up, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forest")
        now = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return now


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id, kept)`` for every row; see the module for the rule."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    described = cut(rows.mapInArrow(_describe, "doc_id bigint, text_hash bigint, n_shingles bigint, class bigint, sig binary"), "described")
    one = F.struct("doc_id", "text_hash", "n_shingles", "sig")
    classes = cut(
        described.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.min(one).alias("one")).select("class", "first", "one.*"), "classes"
    )
    keyed = classes.select("class", "sig").mapInArrow(_bucket_keys, "class bigint, key bigint")
    heads = cut(keyed.groupBy("key").agg(F.min("class").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"), "heads")
    members = cut(keyed.join(heads, "key").select("key", "class", "head"), "members")

    # The shingle sets of every class that shares a bucket, from one of its documents.
    wanted = classes.join(members.select("class").distinct(), "class", "left_semi").select(F.coalesce("doc_id", F.lit(-1)).alias("at"), "text_hash", "class")
    found = rows.withColumn("at", F.coalesce("doc_id", F.lit(-1))).join(wanted, ["at", "text_hash"]).select("class", "text")
    sets = cut(found.mapInArrow(_sets, "class bigint, shingles binary").dropDuplicates(["class"]), "shingles")

    links = cut(_measured(members.where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b")).distinct(), classes), "candidates")
    nearest = links.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("at")).select("a", "at.b")
    tree = _roots(_confirmed(nearest, sets).select(F.col("a").alias("node"), F.col("b").alias("parent")))

    def mixed(labels: DataFrame, name: str) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        named = members.join(labels.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("root", "class").alias("root"))
        keys = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        return _linkable(cut(named.join(keys, "key"), "mixed"), classes, sets, name)

    able = mixed(tree, "linkable")
    centres = able.groupBy("key").agg(F.max(F.struct(F.expr("rest / size").alias("share"), F.col("class").alias("b"), F.col("root").alias("rb"))).alias("at")).select("key", "at.b", "at.rb")
    spokes = able.join(cut(centres, "centres"), "key").where("root <> rb").select(F.col("class").alias("a"), "b").distinct()
    second = cut(_confirmed(_measured(spokes, classes).select("a", "b"), sets), "second")
    as_links = partial(lambda d: d.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = components(tree.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(as_links(second)))

    able = mixed(labels, "still-linkable")
    pairs = _pairs(able, classes)
    third = cut(_confirmed(pairs, sets), "third")
    if not third.isEmpty():
        labels = components(labels.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(as_links(third)))

    rooted = classes.join(labels.withColumnRenamed("node", "class"), "class").select("class", "root", "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = cut(rooted.join(least, "root").select("class", "component_id"), "linked")
    own = cut(classes.join(linked, "class", "left").select("class", F.coalesce("component_id", "first").alias("component_id")), "class-components")
    out = described.select("doc_id", "text_hash", "n_shingles", "class").join(own, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

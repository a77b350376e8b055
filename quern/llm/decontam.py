"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

A seed is a fixed mask over token places; the places it leaves out may differ.
Hashes of the places it keeps, at every position of every text and of every benchmark
item, are joined; each hit names a text, an item and the distance between their
positions. Around a hit the two are laid side by side along that distance, and the text
is contaminated where ``WINDOW`` tokens in a row (or the whole of a shorter item) agree
but for as many substitutions as the item's tier allows.

A tier's masks reach every placement of its substitutions in every window of its lengths;
``tests/llm`` enumerates them. A text is searched with the masks of those tiers alone that
the benchmark has items of.

The benchmark is broadcast only while its seeds number ``BROADCAST_ROWS`` at most, which
bounds its tokens too, at 8 bytes each; beyond that the joins are dealt out by hash.

Cases: null and empty texts and items have no tokens; items of fewer tokens than the least
tier are no evidence and match nothing; items that repeat are found under each id; rows
equal in id and text get one answer, and rows without an id are told apart by their texts
and from all that have one; a benchmark without rows leaves everything clean; an empty
table gives an empty result; other columns are kept, but for those named like the results,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key

WINDOW = 13
#: Least tokens of an item, substitutions allowed, fixed masks (1 for a place that counts).
TIERS = (
    (WINDOW, 2, ("11101011", "110100111")),
    (9, 2, ("10111", "1100101")),
    (5, 0, ("11111",)),
)
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def seeds(own: Column, mask: str, number: int) -> Column:
    """The masked hash and position at every place of a token array that the mask fits."""
    places = [i for i, c in enumerate(mask) if c == "1"]
    last = F.size(own) - len(mask)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(number), *(F.get(own, i + p) for p in places)).alias("seed"), i.alias("pos")))


def positions(df: DataFrame, keep: list[str], tier: int) -> DataFrame:
    """``keep``, the seed's hash and its position, one row a seed of ``tokens`` under the tier's masks."""
    every = F.concat(*(seeds(F.col("tokens"), mask, 100 * tier + i) for i, mask in enumerate(TIERS[tier][2])))
    return df.select(*keep, F.explode(every).alias("at")).select(*keep, "at.seed", "at.pos")


def tier_of(size: Column) -> Column:
    """The tier of an item of ``size`` tokens; null below the least."""
    out = F.lit(None).cast("int")
    for number in reversed(range(len(TIERS))):
        out = F.when(size >= TIERS[number][0], number).otherwise(out)
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, th, items array<bigint>, overlap int)`` of the texts that hold a passage of an item."""
    owned = benchmark.select(F.col(item).cast("long").alias("item"), tokens(F.col(item_text)).alias("item_tokens"))
    items = cut(owned.withColumn("tier", tier_of(F.size("item_tokens"))).where("tier is not null").distinct(), "items")
    used = sorted(r["tier"] for r in items.select("tier").distinct().collect())
    if not used:
        nothing = "id long, th long, items array<bigint>, overlap int"
        return documents.sparkSession.createDataFrame([], nothing)
    own = items.withColumnRenamed("item_tokens", "tokens").withColumn("length", F.size("tokens"))
    parts = [positions(own.where(F.col("tier") == t), ["item", "length"], t) for t in used]
    known = parts[0]
    for part in parts[1:]:
        known = known.unionByName(part)
    known = cut(known.withColumnRenamed("pos", "item_pos").distinct(), "seeds")
    small = known.count() <= BROADCAST_ROWS and items.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda d: d)

    at, th = row_key(key, text)
    rows = documents.select(F.col(key).cast("long").alias("id"), at.alias("at"), th.alias("th"), F.col(text).alias("text"))
    split = rows.select("id", "at", "th", tokens(F.col("text")).alias("tokens"))
    every = F.concat(*(seeds(F.col("tokens"), mask, 100 * t + i) for t in used for i, mask in enumerate(TIERS[t][2])))
    searched = split.select("id", "at", "th", F.explode(every).alias("s")).select("id", "at", "th", "s.seed", "s.pos")
    hits = searched.join(hint(known), "seed").select("at", "th", "item", "length", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    per_text = cut(hits.groupBy("at", "th").agg(F.collect_set(F.struct("item", "length", "shift")).alias("hits")), "hits")

    held = per_text.join(rows, ["at", "th"]).select("id", "th", tokens(F.col("text")).alias("tokens"), F.explode("hits").alias("hit")).select("id", "th", "tokens", "hit.*")
    # Of the text only what lies beside the item goes on.
    beside = F.slice("tokens", F.greatest("shift", F.lit(0)) + 1, F.greatest(F.col("length") + F.least("shift", F.lit(0)), F.lit(0)))
    laid = held.select("id", "th", "item", F.least("shift", F.lit(0)).alias("lead"), beside.alias("beside")).join(hint(items), "item")
    same = F.transform(F.col("item_tokens"), lambda t, j: F.coalesce((F.try_element_at("beside", F.when(F.col("lead") + j >= 0, F.col("lead") + j + 1)) == t).cast("int"), F.lit(0)))
    width = F.least(F.lit(WINDOW), F.size("item_tokens"))
    allowed = F.element_at(F.array(*(F.lit(t[1]) for t in TIERS)), F.col("tier") + 1)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("same") - width), lambda s: F.aggregate(F.slice("same", s + 1, width), F.lit(0), lambda a, b: a + b)))
    judged = laid.withColumn("same", same).where(best >= width - allowed)
    overlap = F.aggregate("same", F.lit(0), lambda a, b: a + b)
    return cut(judged.groupBy("id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(overlap).alias("overlap")), "contaminated")


RESULTS = ("contaminated", "items", "overlap")


def with_contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``contaminated``, ``items`` and ``overlap``."""
    found = contaminated(documents, benchmark, key, text).select(F.coalesce("id", F.lit(-1)).alias("at"), "th", F.struct("items", "overlap").alias("found"))
    at, th = row_key(key, text)
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), at.alias("at"), th.alias("th"))
    out = rows.join(found, ["at", "th"], "left")
    return out.select(
        *(F.col(f"row.`{c}`") for c in documents.columns if c not in RESULTS),
        F.col("found").isNotNull().alias("contaminated"),
        F.coalesce("found.items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("found.overlap", F.lit(0)).alias("overlap"),
    )

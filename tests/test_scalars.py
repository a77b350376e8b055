"""Scalars and joins at the ends of their ranges, against Python."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from quern import functions as q
from quern.operators import range_join


def test_whole_numbers_stay_whole(spark):
    pairs = [(2**53 + 1, 1), (2**63 - 2, 2**63 - 1), (-7, 2), (7, 0), (0, 0), (12, 18), (None, 3)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a bigint, b bigint")
    small = F.col("i") != 1  # the least common multiple of the second pair has no place in 64 bits
    got = rows.select("i", F.when(small, q.lcm(F.col("a"), F.col("b"))).alias("l"), q.int_div(F.col("a"), F.col("b")).alias("d")).collect()
    for i, least, whole in got:
        a, b = pairs[i]
        known = a is not None
        assert whole == ((abs(a) // abs(b)) * (1 if a * b >= 0 else -1) if known and b else None), i
        assert i == 1 or least == (math.lcm(a, b) if known else None), i


def test_ranges_with_fractional_ends(spark):
    rng = random.Random(1)
    points = [round(rng.uniform(-50, 50), 2) for _ in range(200)] + [16.2, 16.0, 32.0]
    ranges = [(a, a + round(rng.uniform(-1, 40), 2)) for a in (round(rng.uniform(-50, 50), 1) for _ in range(40))] + [(15.5, 16.5), (16.0, 32.0)]
    found = range_join(spark.createDataFrame([(p,) for p in points], "p double"), spark.createDataFrame(ranges, "lo double, hi double"), "p", "lo", "hi", 16)
    assert sorted(map(tuple, found.select("p", "lo", "hi").collect())) == sorted((p, a, b) for p in points for a, b in ranges if a <= p < b)

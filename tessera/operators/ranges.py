"""Classification of keys into ordered, inclusive intervals.

Ranges are rows (range_id, lo, hi); range_id counts from 1 in the order of declaration, and 0 stands for "no range".
Of several ranges that hold a key the one declared first wins.

While the ranges fit the driver (MAX_LOCAL rows, checked), overlaps are resolved once into disjoint segments, each with
the winning range.  A key then lies in one segment at most, so the lookup is one broadcast hash join on key div width
with the containment as residual, without a shuffle or an aggregation of the keys.  More ranges than that are dealt by
their length: a range lies in two buckets at most of the power of two that reaches its length, so a wide one isn't cut
into many.  Distinct keys are joined on (power, bucket), the smallest range_id per key is an aggregation, and the rows
take it by their key; both paths give the same rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.storage import written

RANGES = "range_id int, lo bigint, hi bigint"
MAX_LOCAL = 100_000


def within(key, lo, hi):
    return (lo <= key) & (key <= hi)


def strictly_in(key, lo, hi):
    return (lo < key) & (key < hi)


def admit(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(range_id, lo, hi) of the pairs that are accepted, in order.

    A pair is rejected only if one of its ends lies strictly inside an accepted range; so repeats of a range and
    ranges around an accepted one are accepted.  Each decision depends on those before it.
    The accepted ranges' insides are kept as disjoint open intervals in order, so a decision is two binary searches.
    """
    accepted: list[tuple[int, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []

    def inside(x: int) -> bool:
        i = bisect_left(starts, x) - 1  # the last interval that starts before x
        return i >= 0 and x < ends[i]

    for lo, hi in pairs:
        if inside(lo) or inside(hi):
            continue
        accepted.append((len(accepted) + 1, lo, hi))
        if lo < hi:  # no interval reaches over an end, so those from lo on that start before hi lie in the new one
            a, b = bisect_left(starts, lo), bisect_left(starts, hi)
            starts[a:b], ends[a:b] = [lo], [hi]
    return accepted


def ranges_frame(spark: SparkSession, rows: Iterable[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(list(rows), RANGES)


def count_with_dummy(ranges: DataFrame) -> int:
    """How many ranges there are, counting the one that stands for none."""
    return ranges.count() + 1


def segments(rows: Iterable[tuple[int, int, int]], strict: bool = False) -> list[tuple[int, int, int]]:
    """Disjoint (range_id, lo, hi) that give each key its winning range: a sweep over the ends."""
    step = 1 if strict else 0
    rows = [(r, lo + step, hi - step) for r, lo, hi in rows if lo + step <= hi - step]
    starts = sorted(rows, key=lambda r: r[1])
    points = sorted({p for _, lo, hi in rows for p in (lo, hi + 1)})
    active: list[tuple[int, int]] = []  # (range_id, hi)
    out: list[tuple[int, int, int]] = []
    i = 0
    for at, after in zip(points, points[1:], strict=False):
        while i < len(starts) and starts[i][1] <= at:
            heapq.heappush(active, (starts[i][0], starts[i][2]))
            i += 1
        while active and active[0][1] < at:
            heapq.heappop(active)
        if active:
            if out and out[-1][0] == active[0][0] and out[-1][2] == at - 1:
                out[-1] = (out[-1][0], out[-1][1], after - 1)
            else:
                out.append((active[0][0], at, after - 1))
    return out


def _bucketed(ranges: DataFrame, width: int) -> DataFrame:
    return ranges.select("range_id", "lo", "hi", F.explode(F.sequence(_bucket(F.col("lo"), width), _bucket(F.col("hi"), width))).alias("bucket"))


def _bucket(key, width: int):
    """floor(key / width) in integers, negative keys too."""
    return F.call_function("div", key - F.pmod(key, F.lit(width)), F.lit(width))


def classify(keys: DataFrame, ranges: DataFrame, strict: bool = False, max_local: int = MAX_LOCAL) -> DataFrame:
    """pos, key, range_id (0: no range, also for null keys) of keys (pos, key)."""
    spark = keys.sparkSession
    keys = keys.select("pos", "key")
    local = ranges.select("range_id", "lo", "hi").limit(max_local + 1).collect()
    if len(local) <= max_local:
        parts = segments([tuple(r) for r in local], strict)
        if not parts:
            return keys.withColumn("range_id", F.lit(0))
        width = max(1, (parts[-1][2] - parts[0][1] + 1) // (2 * len(parts)))  # at most 3 bucket rows a segment on average
        lookup = F.broadcast(_bucketed(spark.createDataFrame(parts, RANGES), width))
        return _matched(keys, lookup, width)
    if strict:
        ranges = ranges.select("range_id", (F.col("lo") + 1).alias("lo"), (F.col("hi") - 1).alias("hi"))
    # two buckets of 2^power cover a range of that length at most; a wrapped length belongs to the widest power
    length = F.col("hi") - F.col("lo")
    power = F.when((length < 0) | (length >= 1 << 61), 62).otherwise(F.ceil(F.log2(length.cast("double") + 1)) + 1).cast("int")
    leveled = written(ranges.where("lo <= hi").select("range_id", "lo", "hi", F.least(power, F.lit(62)).alias("power")), "ranges")
    shift = lambda x: F.expr(f"shiftright({x}, power)")
    ends = leveled.select("power", "range_id", "lo", "hi", F.explode(F.sequence(shift("lo"), shift("hi"))).alias("bucket"))
    powers = [r["power"] for r in leveled.select("power").distinct().collect()]  # 62 at most
    asked = keys.select("key").where("key IS NOT NULL").distinct().withColumn("power", F.explode(F.array(*map(F.lit, powers)) if powers else F.array().cast("array<int>")))
    found = asked.withColumn("bucket", shift("key")).join(ends, ["power", "bucket"]).where(within(F.col("key"), F.col("lo"), F.col("hi")))
    found = found.groupBy("key").agg(F.min("range_id").alias("range_id"))
    return keys.join(found, "key", "left").select("pos", "key", F.coalesce("range_id", F.lit(0)).alias("range_id"))


def _matched(keys: DataFrame, lookup: DataFrame, width: int) -> DataFrame:
    b = lookup.withColumnRenamed("bucket", "of")
    joined = keys.withColumn("bucket", _bucket(F.col("key"), width)).join(b, (F.col("bucket") == F.col("of")) & within(F.col("key"), F.col("lo"), F.col("hi")), "left")
    return joined.select("pos", "key", F.coalesce("range_id", F.lit(0)).alias("range_id"))


def reset(classified: DataFrame) -> DataFrame:
    """The keys as they were before classification: range_id 0."""
    return classified.withColumn("range_id", F.lit(0))


def histogram(classified: DataFrame, n_ranges: int) -> DataFrame:
    """range_id 0..n_ranges, cnt; empty ranges count 0."""
    every = classified.sparkSession.range(n_ranges + 1).select(F.col("id").cast("int").alias("range_id"))
    counts = classified.groupBy("range_id").agg(F.count("*").alias("cnt"))
    return every.join(counts, "range_id", "left").select("range_id", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def offsets(histogram: DataFrame) -> DataFrame:
    """range_id, cnt, start_offset, end_offset: inclusive prefix sums (one row a range, so one window over few rows)."""
    upto = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("end_offset", F.sum("cnt").over(upto)).select("range_id", "cnt", (F.col("end_offset") - F.col("cnt")).alias("start_offset"), "end_offset")


def partition_sort(classified: DataFrame) -> DataFrame:
    """slot, pos, key, range_id: the rows grouped by range, in the order of pos within each; slots are 0..N-1.

    Rows are dealt by ranges of (range_id, pos) and sorted, so a range with a third of all rows is spread; each
    partition's rows are numbered where they are, and the partitions' counts (one row each) give the rest.
    """
    dealt = classified.select("pos", "key", "range_id").repartitionByRange("range_id", "pos").sortWithinPartitions("range_id", "pos")
    numbered = written(dealt.withColumns({"part": F.spark_partition_id(), "local": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return numbered.join(F.broadcast(starts), "part").select((F.col("start") + F.col("local")).alias("slot"), "pos", "key", "range_id")

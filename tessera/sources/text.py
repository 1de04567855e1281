"""Text inputs and outputs: ranges, keys, timing tables, truss flags, components, influencers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ranges
from tessera.operators.graph import symmetric


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """pos, key: the whitespace-separated numbers of a file, pos rising in file order."""
    tokens = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "t")).where("t <> ''")
    return tokens.select("line", "at", F.col("t").cast("bigint").alias("key"))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """range_id, lo, hi of the pairs ``lo hi`` that are admitted, in file order.

    Admission is sequential: the driver reads the pairs one partition at a time and holds those it accepts.
    """
    numbers = (r["key"] for r in _numbers(spark, path).orderBy("line", "at").toLocalIterator())
    return ranges.ranges_frame(spark, ranges.admit(zip(numbers, numbers, strict=False)))


def read_keys(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """pos, key of at most ``most`` keys; pos rises in file order."""
    keys = _numbers(spark, path)
    keys = keys if most is None else keys.orderBy("line", "at").limit(most)
    return keys.select((F.col("line") * (1 << 16) + F.col("at")).alias("pos"), "key")


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """Timing table with processes, threads and time: adds speed-up, efficiency, serial fraction and overhead (p times seconds, less the time of 1 x 1)."""
    table = spark.read.csv(path, header=True, schema="processes int, threads int, seconds double")
    one = table.where("processes = 1 AND threads = 1").agg(F.min("seconds").alias("one"))
    p = F.col("processes") * F.col("threads")
    out = table.crossJoin(F.broadcast(one)).withColumn("speedup", F.try_divide("one", "seconds"))
    return out.select("processes", "threads", "seconds", "speedup", (F.col("speedup") / p).alias("efficiency"), F.try_divide(1 / F.col("speedup") - 1 / p, 1 - 1 / p).alias("serial_fraction"), (p * F.col("seconds") - F.col("one")).alias("overhead"))


def flag_lines(flags: DataFrame, joined: bool = True) -> DataFrame:
    """value: the flags of a truss sweep by k, on one line or one a line."""
    if not joined:
        return flags.orderBy("k").select(F.col("found").cast("string").alias("value"))
    return flags.agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("k", "found"))), lambda x: x["found"].cast("string"))).alias("value"))


def component_lines(members: DataFrame) -> DataFrame:
    """value: how many components, then each one's ids on a line, by smallest id."""
    lines = members.select(F.col("component").alias("o"), F.concat_ws(" ", F.col("members").cast("array<string>")).alias("value"))
    return members.agg(F.lit(-1).cast("bigint").alias("o"), F.count("*").cast("string").alias("value")).unionByName(lines).orderBy("o").select("value")


def influencer_lines(found: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """value: how many, then the ids on one line; with ``reach`` each id and its members on lines of their own."""
    count = found.agg(F.lit(-1).cast("bigint").alias("o"), F.lit(0).alias("i"), F.count("*").cast("string").alias("value"))
    if reach is None:
        ids = found.agg(F.lit(0).cast("bigint").alias("o"), F.lit(0).alias("i"), F.concat_ws(" ", F.sort_array(F.collect_list("id")).cast("array<string>")).alias("value"))
        return count.unionByName(ids.where("value <> ''")).orderBy("o").select("value")
    each = reach.groupBy("id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("member")).cast("array<string>")).alias("m"))
    lines = each.select(F.col("id").alias("o"), F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("id").cast("string").alias("value")), F.struct(F.lit(1).alias("i"), F.col("m").alias("value")))).alias("l")).select("o", "l.i", "l.value")
    return count.unionByName(lines).orderBy("o", "i").select("value")


def range_inspection(found: DataFrame) -> DataFrame:
    """value: id, lower and upper end of each range, by id."""
    return found.orderBy("range_id").select(F.format_string("%d: %d, %d", "range_id", "lo", "hi").alias("value"))


def key_inspection(keys: DataFrame) -> DataFrame:
    """value: place, key and range id (-1 where there is none yet) of each key, by place."""
    value = F.coalesce("range_id", F.lit(-1)) if "range_id" in keys.columns else F.lit(-1)
    return keys.orderBy("pos").select(F.format_string("%d: %d -- %d", "pos", "key", value).alias("value"))


def count_inspection(histogram: DataFrame) -> DataFrame:
    """value: range id and count, by id."""
    return histogram.orderBy("range_id").select(F.format_string("%d:%d", "range_id", "cnt").alias("value"))


def block_inspection(blocks: DataFrame) -> DataFrame:
    """value: place and elements of each block, by place."""
    data = F.concat_ws(" ", F.col("data").cast("array<string>"))
    return blocks.orderBy("brow", "bcol").select(F.concat(F.format_string("row %d, col %d: ", "brow", "bcol"), data).alias("value"))


def graph_inspection(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """value: id, degree and (ascending) neighbours of each vertex, by id; those without neighbours too."""
    near = symmetric(edges).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("near"))
    every = vertices.select("id").join(near, F.col("id") == F.col("src"), "left").select("id", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    return every.orderBy("id").select(F.concat(F.format_string("vertex %d, degree %d: ", "id", F.size("near")), F.concat_ws(" ", F.col("near").cast("array<string>"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes ordered lines as text, in order, in as many files as there are partitions."""
    lines.write.mode("overwrite").text(path)

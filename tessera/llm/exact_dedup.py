"""Exact dedup: group by a 128-bit content hash, keep one row, and compare bytes inside groups.

Plan.  One narrow shuffle (hash, length, id; pre-aggregated on the map side) finds the groups with more than one row
and the row that each keeps.  A second pass takes only the rows of those groups and compares their bytes: the smallest
and the largest normalised text of a group are kept by partial aggregation, so a group holding a third of all rows is
reduced on the map side before anything moves.  Groups whose smallest and largest text differ are hash collisions;
their rows are grouped again by the text itself.  The last join is a left outer equi-join on the hash, whose large
partitions adaptive execution splits.

Defined results: null text counts as empty; a null doc_id sorts after all others; rows that repeat a doc_id are one
document stated more than once (each counts in group_size, and ``kept`` is true for each if their doc_id is kept).
Very long texts are hashed whole, in time proportional to their length.  Extra columns, whatever their names, are ignored
by ``exact_dedup`` and carried by ``keep_one``.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, load, whole_rows, written

OUT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _best() -> Column:
    return F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
        normalised(F.col(text)).alias("norm"),
    )
    hashed = rows.withColumn("h", F.unhex(F.md5(F.col("norm"))))
    groups = written(
        hashed.groupBy("h").agg(F.count("*").alias("size"), _best().alias("best")).where("size > 1").select("h", "size", F.col("best.doc_id").alias("keep_id")),
        "dedup-groups",
        few=True,
    )
    collided = written(
        hashed.select("h", "norm")
        .join(groups.select("h"), "h", "left_semi")
        .groupBy("h")
        .agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
        .where(F.col("a") != F.col("b"))
        .select("h"),
        "dedup-collisions",
        few=True,
    )
    out = hashed.select("doc_id", "h", F.sha2(F.col("norm"), 256).alias("text_sha256"))
    if collided.isEmpty():
        dropped(collided)
        return _labelled(out.join(groups, "h", "left"))
    clear = _labelled(out.join(groups, "h", "left").join(collided, "h", "left_anti"))
    again = hashed.join(collided, "h", "left_semi")
    by_text = again.groupBy("norm").agg(F.count("*").alias("size"), _best().alias("best")).select("norm", "size", F.col("best.doc_id").alias("keep_id"))
    mixed = again.withColumn("text_sha256", F.sha2(F.col("norm"), 256)).join(by_text, "norm")
    return clear.unionByName(_labelled(mixed))


def _labelled(rows: DataFrame) -> DataFrame:
    single = F.col("size").isNull()
    return rows.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("size"), F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns as they were; a document stated more than once stays once.

    A document is a doc_id with a normalised text: different texts that share a doc_id (or have none) are told apart.
    Of the rows of one document that with the longest text stays (then the largest text and other columns).
    """
    rows = whole_rows(docs).select("row", F.col("row.doc_id").alias("id"), F.sha2(normalised(F.col("row.text")), 256).alias("sha"))
    flags = exact_dedup(docs).where("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).agg(F.count("*").alias("times"))
    flags = written(flags, "dedup-kept", few=True)
    # null-safe on the digest too: a plain equality would have every text hashed again to see that it isn't null
    same = F.col("id").eqNullSafe(F.col("kept_id")) & F.col("sha").eqNullSafe(F.col("kept_sha"))
    once = rows.join(flags.where("times = 1"), same).select("row.*")
    stated_again = flags.where("times > 1")
    if stated_again.isEmpty():
        return once
    order = F.struct(F.char_length(F.coalesce(F.col("row.text"), F.lit(""))), F.col("row.text"), F.to_json("row"))
    more = rows.join(stated_again, same).groupBy("id", "sha").agg(F.max_by("row", order).alias("row")).select("row.*")
    return once.unionByName(more)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS n, first(doc_id ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, cast(g.n AS BIGINT) AS group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

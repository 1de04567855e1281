"""Undirected graphs as edges (u, v) with u < v, each once: degree, core, orientation, triangles, support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import dropped, written


def normalise(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Each undirected edge once, the smaller end first; self-loops go."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """src, dst in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("e.*")


def degree(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, degree; vertices (id) without edges have degree 0."""
    found = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return found if vertices is None else vertices.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def core(edges: DataFrame, min_degree: int, slight: float = 0.0) -> DataFrame:
    """The edges left when vertices under min_degree are deleted until there are none.

    Rounds work on what is left; each is written, and ends when no vertex was deleted.  slight: rounds end as well after one
    that deleted no more than this share of the edges, for callers that need not have all vertices deleted.
    """
    now = written(edges.select("u", "v"), "core")
    while True:
        weak = written(degree(now).where(F.col("degree") < min_degree).select("id"), "weak")
        if weak.isEmpty():
            return now
        after = written(now.join(weak, F.col("u") == F.col("id"), "left_anti").join(weak, F.col("v") == F.col("id"), "left_anti"), "core")
        before = now.count() if slight else 0
        dropped(now)
        dropped(weak)
        now = after
        if slight and before - now.count() <= slight * before:
            return now


def orient(edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """u, v with (degree, id) of u below that of v: bounds the wedges at a vertex by the root of the number of edges."""
    degrees = degree(edges) if degrees is None else degrees
    both = edges.join(degrees.select(F.col("id").alias("u"), F.col("degree").alias("du")), "u").join(degrees.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    return both.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("v"))


def wedges_by_id(edges: DataFrame) -> int:
    """How many pairs of edges meet at the smaller id of both."""
    return edges.groupBy("u").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0


def triangles(edges: DataFrame, by_id: bool = False) -> DataFrame:
    """a, b, c with a < b < c, each triangle once: wedges at the lowest vertex in degree order, closed by an edge.

    by_id: the order is that of the ids, which needs no degrees, but bounds the wedges by nothing.
    """
    o = edges if by_id else orient(edges)
    wedges = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedges.join(edges.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"], "left_semi")
    three = F.sort_array(F.array("u", "x", "y"))
    return closed.select(three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def triangle_edges(found: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("a", "c"), ("b", "c"))])
    return found.select(F.explode(sides).alias("e")).select("e.*")


def support(edges: DataFrame, found: DataFrame) -> DataFrame:
    """u, v, support: in how many triangles each edge lies, 0 too."""
    counts = triangle_edges(found).groupBy("u", "v").agg(F.count("*").alias("support"))
    return edges.join(counts, ["u", "v"], "left").select("u", "v", F.coalesce("support", F.lit(0)).cast("bigint").alias("support"))


#: The test graph of ten vertices with two groups of four.
SMALL_GRAPH = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (3, 4), (2, 5), (2, 9), (8, 9), (7, 8), (0, 2), (1, 3), (4, 6), (5, 7))


def small_graph(spark: SparkSession, more: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    return normalise(spark.createDataFrame([*SMALL_GRAPH, *more], "u bigint, v bigint"))

"""Connected components by alternating large-star and small-star.

Each step is a minimum per vertex (pre-aggregated on the map side) joined back to the edges.  The minima are tables, so
that both sides of the join are exchanges and adaptive execution can split a vertex with a third of all edges.  Each
round is written to the shared folder, which cuts lineage, in files that go by the number of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.storage import dropped, written


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component of all links (u, v) of a task: roots are hooked to the least root they are linked with, until none is."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    links = pa.Table.from_batches(got)
    ids, ends = np.unique(np.concatenate([links["u"].to_numpy(), links["v"].to_numpy()]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != (up := root[root])).any():
            root = up
    table = pa.table({"id": pa.array(ids, links["u"].type), "component": pa.array(ids[root], links["u"].type)})
    yield from table.to_batches(1 << 16)


def components(links: DataFrame, at_once: int = 0) -> DataFrame:
    """id, component (smallest id reachable) for every id in links (a, b); self-links and repeats do no harm.

    at_once: up to so many different links are solved in one task, which takes some 150 bytes a link; beyond, rounds are.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", few=True)
    if at_once and edges.count() <= at_once:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_at_once, f"id {kind}, component {kind}")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", few=True)
        large = written(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", few=True)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low", few=True)
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges", few=True)
        for x in (edges, least, large, low):
            dropped(x)
        edges = after
        # a star forest no longer changes: the same number of edges with the same sum of hashes
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def component_members(labels: DataFrame) -> DataFrame:
    """component, size, members (ascending ids) of id, component rows."""
    return labels.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("members"))

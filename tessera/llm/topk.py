"""Exact top-k search by inner product as a Voronoi kNN join.

1. A bounded sample gives the pivots.  Every vector (queries included) is assigned to its nearest pivot's cell, with
   its Euclidean distance r to the pivot.  For any vector x of the cell of pivot c, q.c - |q| r <= q.x <= q.c + |q| r.
2. One aggregation gives a summary row per cell: how many vectors, the largest r, and its k + 1 smallest r.
   The number of cells is a parameter, so the summary is small whatever the input.
3. For each query the (k + m)-th largest of the lower bounds over all cells' summaries is a score that its k-th
   neighbour reaches (m, the number of rows with its vec_id, are left for its own rows).  A cell is needed only if its
   upper bound reaches that score.
4. Queries are grouped by their own cell, in groups of bounded size, so that the queries of a group need much the same
   cells.  Cells are cut into blocks of bounded size by a hash of the vector (a cell that holds a third of all rows
   becomes many blocks).  A query goes to the blocks of the cells it needs, and a cell's vectors only to the groups
   with a query that needs the cell.  Each (block, group) is solved locally by matrix products; its k best per query
   go on to the final ranking, k rows for each query and block.

Scores are exact: products are computed in float64 while every sum stays below 2^53, else with Python integers.

Defined results: null vectors and vectors holding null or non-finite components take no part; scaled components and scores beyond a long
are the nearest long; ties go to the smaller
vec_id; a query with fewer than k candidates returns all; rows that share a query's vec_id are its own; vectors of
unequal length are compared with those of their own length only; null vec_ids take no part; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import load, written

PIVOTS, SAMPLE, BLOCK_BYTES, MOST_ROWS = 64, 4096, 16 << 20, 32768  # a block or group: that many bytes of vectors, and rows
_EXACT, _LONG = float(1 << 53), (1 << 63) - 1


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as long; null if the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length."""
    flat = vectors.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(vectors), -1)


def block_rows(dim: int) -> int:
    """Vectors of a block, and queries of a group."""
    return max(1, min(MOST_ROWS, BLOCK_BYTES // (8 * dim)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int64 rows."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(x).max() * np.abs(y).max() * a.shape[1] < _EXACT:
        return (x @ y.T).astype(np.int64)
    return np.array([[sum(p * q for p, q in zip(u, v, strict=True)) for v in b.tolist()] for u in a.tolist()], object)


def _pivots(vectors: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """Pivots by vector length, spread over a bounded sample by repeatedly taking the farthest vector."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    found = {}
    for n in sorted({len(r["v"]) for r in rows}):
        m = np.array([r["v"] for r in rows if len(r["v"]) == n], np.float64).reshape(-1, n)
        chosen, far = [0], ((m - m[0]) ** 2).sum(1)
        # random-like members (hash order) give balanced cells; the farthest ones would be outliers
        for i in range(1, len(m)):
            if len(chosen) >= pivots:
                break
            if far[i] > 0:
                chosen.append(i)
                far = np.minimum(far, ((m - m[i]) ** 2).sum(1))
        found[n] = m[chosen]
    return found


def top_k(vectors: DataFrame, queries: Column, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, v: array of long) for which ``queries`` holds."""
    spark = vectors.sparkSession
    vectors = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    centres = _pivots(vectors, pivots, sample)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["v"].map(len)
            for n, part in b.groupby(size):
                c = shared.value.get(n)
                c = np.zeros((1, n)) if c is None else c
                x = np.array(part["v"].tolist(), np.float64).reshape(-1, n)
                d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]
                cell = d.argmin(1)
                r = np.sqrt(((x - c[cell]) ** 2).sum(1)) * (1 + 1e-9) + 1e-6
                yield part.assign(dim=n, cell=cell, r=r)

    cells = written(
        vectors.select("vec_id", "v", F.coalesce(queries, F.lit(False)).alias("is_query")).mapInPandas(assign, "vec_id long, v array<long>, is_query boolean, dim int, cell int, r double"),
        "topk-cells",
    )
    near = Window.partitionBy("dim", "cell", "part").orderBy("r")
    parts = cells.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    least = parts.withColumn("i", F.row_number().over(near)).where(F.col("i") <= k + 1).groupBy("dim", "cell").agg(F.sort_array(F.collect_list("r")).alias("least"))
    summary = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("is_query").alias("asked"), F.max("r").alias("most")).join(least, ["dim", "cell"])
    summary = {(s["dim"], s["cell"]): (s["n"], s["most"], s["least"][: k + 1], s["asked"]) for s in summary.collect()}
    blocks = {key: -(-s[0] // block_rows(key[0])) for key, s in summary.items()}
    groups = {key: max(1, -(-s[3] // block_rows(key[0]))) for key, s in summary.items()}
    known = spark.sparkContext.broadcast((summary, blocks))

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, cut = known.value
        for b in batches:
            for n, part in b.groupby("dim"):
                own = [c for d, c in table if d == n]
                x = np.array(part["v"].tolist(), np.float64).reshape(-1, n)
                c = shared.value.get(n)
                c = (np.zeros((1, n)) if c is None else c)[own]
                dot, norm = x @ c.T, np.sqrt((x**2).sum(1))[:, None] * (1 + 1e-9)
                low = np.concatenate([dot[:, [j]] - norm * np.array(table[n, i][2])[None, :] for j, i in enumerate(own)], 1)
                least, rows = np.full(len(x), -np.inf), part["own"].to_numpy()
                for m in np.unique(rows[rows <= low.shape[1] - k]).tolist():
                    at = np.flatnonzero(rows == m)
                    least[at] = np.partition(low[at], -(k + m), 1)[:, -(k + m)]
                high = dot + norm * np.array([table[n, i][1] for i in own])[None, :]
                q, j = np.nonzero(high >= (least - 1e-3 - 1e-9 * np.abs(least))[:, None])
                cell = np.array(own)[j]
                times = np.array([cut[n, i] for i in cell], int)
                at = np.repeat(np.arange(len(q)), times)
                block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                mine = part["part"].to_numpy()
                vec = part["vec_id"].to_numpy()[q[at]]
                for lo in range(0, len(at), 4096):
                    s = slice(lo, lo + 4096)
                    yield pd.DataFrame({"dim": n, "cell": cell[at[s]], "block": block[s], "part": mine[q[at[s]]], "query_id": vec[s], "q": [part["v"].iloc[i] for i in q[at[s]]]})

    def numbers(of: dict[tuple[int, int], int]) -> Column:
        """Of the row's cell: there are at most PIVOTS for each vector length."""
        found = F.create_map(*[F.lit(x) for (d, c), n in of.items() for x in (d * 65536 + c, n)]) if of else F.create_map(F.lit(0), F.lit(1))
        return F.coalesce(found[F.col("dim") * 65536 + F.col("cell")], F.lit(1))

    first = dict(zip(groups, np.cumsum([0, *groups.values()])[:-1].tolist(), strict=True))
    group = (numbers(first) + F.pmod(F.xxhash64("vec_id", F.lit(1)), numbers(groups))).cast("int").alias("part")
    repeated = cells.groupBy("dim", "vec_id").agg(F.count("*").alias("own")).where("own > 1")
    asked = cells.where("is_query").join(repeated, ["dim", "vec_id"], "left").select("vec_id", "v", "dim", F.coalesce("own", F.lit(1)).alias("own"), group)
    asked = written(asked.mapInPandas(needed, "dim int, cell int, block int, part int, query_id long, q array<long>"), "topk-asked")
    wanted = written(asked.select("dim", "cell", "part").distinct().groupBy("dim", "cell").agg(F.collect_list("part").alias("parts")), "topk-wanted")
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), numbers(blocks)).cast("int").alias("block")
    data = cells.select("dim", "cell", block, "vec_id", "v").join(wanted, ["dim", "cell"]).withColumn("part", F.explode("parts")).drop("parts")

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        out = ([], [], [])
        if q.num_rows and x.num_rows:
            a, b = _matrix(q["q"]), _matrix(x["v"])
            ids, own = x["vec_id"].to_numpy(), q["query_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            b, ids = b[order], ids[order]
            for lo in range(0, len(a), 256):
                score = products(a[lo : lo + 256], b)
                for s, me in zip(score, own[lo : lo + 256], strict=True):
                    keep = k + int((ids == me).sum())
                    best = np.argpartition(-s, keep - 1)[:keep] if keep < len(s) and s.dtype != object else np.arange(len(s))
                    if keep < len(s):
                        best = np.flatnonzero(s >= min(s[best])) if s.dtype != object else best
                    best = [i for i in sorted(best.tolist(), key=lambda i: (-s[i], i)) if ids[i] != me][:k]
                    for o, more in zip(out, ([me] * len(best), ids[best], s[best]), strict=True):
                        o.extend(max(-_LONG - 1, min(_LONG, int(x))) for x in more)
        return pa.table([pa.array(o, pa.int64()) for o in out], ["query_id", "vec_id", "score"])

    keys = ["dim", "cell", "block", "part"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = load(spark, sf_dir, "embeddings")
    vectors = src.select(F.col("vec_id").cast(T.LongType()).alias("vec_id"), scaled(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, cast(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, cast(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""

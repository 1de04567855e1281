"""Block-sparse matrices as coordinate rows (i, k, x) or blocks (brow, bcol, data: m*m values by row).

Products of sparse matrices are an equi-join on the inner index and an aggregation with partial sums; the optimizer
picks the join, and adaptive execution splits an inner index that holds many rows.  Products of matrices whose blocks
are well filled send blocks to the tiles of the result that need them, and multiply and sum them there as arrays.  Values are widened to
bigint and clipped, never wrapped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.semiring import KERNELS, SEMIRINGS, Semiring
from tessera.functions.storage import written

U16, U32 = 65_535, 4_294_967_295
CHUNK = 65_536  # rows of blocks numbered together
BATCH = 1 << 20  # elements of the blocks sent on together
SIDE = 2_048  # rows and columns of a tile of a product of blocks
DEPTH = 1_024  # inner indices of a tile that one task sums
BLOCKS = "brow int, bcol int, data array<bigint>"


def _div(a, m: int):
    return F.call_function("div", a, F.lit(m))


def to_coo(blocks: DataFrame, m: int) -> DataFrame:
    """i, j, v of the non-zero elements."""
    p = blocks.select("brow", "bcol", F.posexplode("data").alias("p", "v")).where("v <> 0")
    return p.select((F.col("brow").cast("bigint") * m + _div(F.col("p"), m)).alias("i"), (F.col("bcol").cast("bigint") * m + F.col("p") % m).alias("j"), F.col("v").cast("bigint").alias("v"))


def to_blocks(coo: DataFrame, m: int) -> DataFrame:
    """The blocks with a non-zero element; absent elements are zero."""
    p = ((F.col("i") % m) * m + F.col("j") % m).cast("int")
    cells = coo.where("v <> 0").select(_div(F.col("i"), m).cast("int").alias("brow"), _div(F.col("j"), m).cast("int").alias("bcol"), F.struct(p.alias("p"), F.col("v").cast("bigint").alias("v")).alias("cell"))
    held = cells.groupBy("brow", "bcol").agg(F.map_from_entries(F.collect_list("cell")).alias("cells"))
    data = F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0)))
    return held.select("brow", "bcol", data.cast("array<bigint>").alias("data"))


def mirror(coo: DataFrame) -> DataFrame:
    """Adds the transposed element of each one off the diagonal."""
    return coo.unionByName(coo.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def transpose_blocks(blocks: DataFrame, m: int) -> DataFrame:
    """The transposed matrix."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), lambda p: F.get("data", (p % m) * m + F.call_function("div", p, F.lit(m)).cast("int")))
    return blocks.select(F.col("bcol").alias("brow"), F.col("brow").alias("bcol"), turned.alias("data"))


def mirror_blocks(blocks: DataFrame, m: int) -> DataFrame:
    """Adds the transposed block of each one off the diagonal."""
    return blocks.unionByName(transpose_blocks(blocks.where("brow <> bcol"), m))


def duplicates(blocks: DataFrame) -> DataFrame:
    """Unordered (row, col) that occur more than once: a symmetric input must have none."""
    return blocks.groupBy(F.least("brow", "bcol").alias("a"), F.greatest("brow", "bcol").alias("b")).count().where("count > 1")


def _product(pairs: DataFrame, semiring: Semiring, cap: int | None) -> DataFrame:
    v = semiring.outer(semiring.inner(F.col("x"), F.col("y")))
    return pairs.groupBy("i", "j").agg((F.least(v, F.lit(cap)) if cap is not None else v).cast("bigint").alias("v"))


def multiply(a: DataFrame, b: DataFrame, semiring: str = "plus_times", cap: int | None = U32) -> DataFrame:
    """i, j, v of a (i, k, x) times b (k, j, y), clipped to cap."""
    pairs = a.select("i", "k", F.col("x").cast("bigint").alias("x")).join(b.select("k", "j", F.col("y").cast("bigint").alias("y")), "k")
    return _product(pairs, SEMIRINGS[semiring], cap)


def multiply_blocks(a: DataFrame, b: DataFrame, m: int, semiring: str = "plus_times", cap: int | None = U32, upper: bool = False) -> DataFrame:
    """brow, bcol, data of the product of two matrices of full m x m blocks; ``upper``: the blocks with brow <= bcol.

    Every element of a block takes part, zeros too; absent blocks don't.  The result is cut into tiles of SIDE x SIDE elements.
    Blocks go to each tile that they have a partner in, not the products: these are summed where the tile is and never move.
    Only a tile with more than DEPTH inner indices is summed in several tasks, whose sums are folded by place.
    """
    inner, outer = KERNELS[semiring]
    side = max(1, SIDE // m)

    def top(x: np.ndarray) -> int:
        return max(-int(x.min()), int(x.max()))

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if semiring == "plus_times":
            exact = top(x) * top(y) * m < 1 << 53  # then every sum is an integer that doubles hold
            return (x.astype(np.float64) @ y.astype(np.float64)).astype(np.int64) if exact else x @ y
        out = inner(x[:, :1], y[:1])
        for k in range(1, m):
            out = outer(out, inner(x[:, k : k + 1], y[k : k + 1]))
        return out

    def clip(x: np.ndarray) -> np.ndarray:
        return x if cap is None else np.minimum(x, cap)

    def batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        i, j, data = zip(*rows, strict=True)
        flat = pa.array(np.concatenate([d.ravel() for d in data]), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * m * m, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), lists], ["brow", "bcol", "data"])

    def blocks_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, m, m)

    def tiled(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Rows come by tile, part and inner index; ``last``: a tile has one part, so its sums are whole."""

        def add(sums: dict[tuple[int, int], np.ndarray], rows: list[tuple[int, np.ndarray]], cols: list[tuple[int, np.ndarray]]) -> None:
            if not rows or not cols:
                return
            wide = np.concatenate([y for _, y in cols], axis=1)
            for i, x in rows:
                found = product(x, wide).reshape(m, len(cols), m)
                for q, (j, _) in enumerate(cols):
                    if not upper or i <= j:
                        old = sums.get((i, j))
                        sums[i, j] = found[:, q].copy() if old is None else outer(old, found[:, q])

        def out(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = [(*k, clip(v) if last else v) for k, v in sums.items()]
            step = max(1, BATCH // (m * m))
            for at in range(0, len(rows), step):
                yield batch(rows[at : at + step])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile, k, sums = None, None, {}
            found: tuple[list, list] = ([], [])
            for b in batches:
                keys = zip(*(b.column(c).to_pylist() for c in range(6)), strict=True)
                for (ti, tj, part, kk, right, at), x in zip(keys, blocks_of(b.column(6)), strict=True):
                    if ((ti, tj, part), kk) != (tile, k):
                        add(sums, *found)
                        found = ([], [])
                        if (ti, tj, part) != tile:
                            yield from out(sums)
                            sums = {}
                        tile, k = (ti, tj, part), kk
                    found[right].append((at, x))
            add(sums, *found)
            yield from out(sums)

        return run

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, acc, out = None, None, []
        for b in batches:
            for i, j, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), blocks_of(b.column(2)), strict=True):
                if (i, j) == last:
                    acc = outer(acc, x)
                    continue
                if last is not None:
                    out.append((*last, clip(acc)))
                last, acc = (i, j), x
                if len(out) * m * m >= BATCH:
                    yield batch(out)
                    out = []
        if last is not None:
            yield batch([*out, (*last, clip(acc))])

    left = a.select(_div(F.col("brow"), side).cast("int").alias("ti"), F.col("bcol").alias("k"), F.lit(0).alias("right"), F.col("brow").alias("at"), F.col("data").cast("array<bigint>").alias("x"))
    right = b.select(_div(F.col("bcol"), side).cast("int").alias("tj"), F.col("brow").alias("k"), F.lit(1).alias("right"), F.col("bcol").alias("at"), F.col("data").cast("array<bigint>").alias("x"))
    both = left.select("k", "ti").distinct().join(right.select("k", "tj").distinct(), "k")
    both = both.where("ti <= tj") if upper else both
    # the inner indices of each tile, in as many parts as they fill
    parts = both.groupBy("ti", "tj").agg(F.ceil(F.count("*") / DEPTH).cast("int").alias("parts"))
    places = written(both.join(parts, ["ti", "tj"]).withColumn("part", F.pmod(F.hash("k"), "parts")), "places")

    def sums(of: DataFrame, last: bool) -> DataFrame:
        names = ["ti", "tj", "part", "k", "right", "at", "x"]
        rows = left.join(of, ["k", "ti"]).select(names).unionByName(right.join(of, ["k", "tj"]).select(names))
        return rows.repartition("ti", "tj", "part").sortWithinPartitions("ti", "tj", "part", "k").mapInArrow(tiled(last), BLOCKS)

    whole = sums(places.where("parts = 1"), True)
    if places.where("parts > 1").isEmpty():
        return whole
    several = sums(places.where("parts > 1"), False).repartition("brow", "bcol").sortWithinPartitions("brow", "bcol")
    return whole.unionByName(several.mapInArrow(folded, BLOCKS))


def multiply_python(a: DataFrame, b: DataFrame, inner: Callable[[int, int], int], outer: Callable[[int, int], int], start: int = 0) -> DataFrame:
    """i, j, v with any scalar functions, folded by ascending k from ``start``; row by row in Python, hence slow."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        acc = start
        for x, y in rows.sort_values("k")[["x", "y"]].itertuples(index=False):
            acc = outer(inner(int(x), int(y)), acc)
        return pd.DataFrame({"i": rows["i"].iloc[:1], "j": rows["j"].iloc[:1], "v": [acc]})

    return a.join(b, "k").groupBy("i", "j").applyInPandas(fold, "i bigint, j bigint, v bigint")


def square_upper(s: DataFrame, m: int, semiring: str = "plus_times", cap: int | None = U16) -> DataFrame:
    """i, j, v of the square of a symmetric matrix s (i, k, x), for the blocks on and above the diagonal.

    The triangle is one of blocks, so blocks on the diagonal are complete; the test is part of the join.
    """
    left = s.select("i", "k", F.col("x").cast("bigint").alias("x"))
    right = s.select(F.col("i").alias("j"), F.col("k").alias("kk"), F.col("x").cast("bigint").alias("y"))
    pairs = left.join(right, (F.col("k") == F.col("kk")) & (_div(F.col("i"), m) <= _div(F.col("j"), m)))
    return _product(pairs, SEMIRINGS[semiring], cap).where("v <> 0")


def nonzero_blocks(coo: DataFrame, m: int) -> DataFrame:
    """brow, bcol of the blocks with a non-zero element."""
    return coo.where("v <> 0").select(_div(F.col("i"), m).cast("int").alias("brow"), _div(F.col("j"), m).cast("int").alias("bcol")).distinct()


def csr_index(blocks: DataFrame, n_rows: int) -> DataFrame:
    """brow 0..n_rows, ptr: how many blocks lie in the rows before; empty rows too."""
    every = blocks.sparkSession.range(n_rows + 1).select(F.col("id").cast("int").alias("brow"))
    counts = every.join(blocks.groupBy("brow").agg(F.count("*").alias("n")), "brow", "left").select("brow", F.coalesce("n", F.lit(0)).alias("n"), _div(F.col("brow"), CHUNK).alias("chunk"))
    # sums of chunks are few; rows are numbered inside their chunk
    upto = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("chunk").agg(F.sum("n").alias("of")).select("chunk", F.coalesce(F.sum("of").over(upto), F.lit(0)).alias("start"))
    before = Window.partitionBy("chunk").orderBy("brow").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return inside.join(starts, "chunk").select("brow", (F.col("start") + F.col("inside")).cast("bigint").alias("ptr"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, left_v, right_v where two matrices (i, j, v) differ; an absent element is null."""
    left, right = a.select("i", "j", F.col("v").alias("left_v")), b.select("i", "j", F.col("v").alias("right_v"))
    return left.join(right, ["i", "j"], "full").where("NOT (left_v <=> right_v)")


def equal(a: DataFrame, b: DataFrame) -> bool:
    return diff(a, b).isEmpty()


def score(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """score: the share of expected blocks (brow, bcol, data) that are right; 0.8 of it if there are blocks too many."""
    both = expected.select("brow", "bcol", F.col("data").alias("e")).join(actual.select("brow", "bcol", F.col("data").alias("a")), ["brow", "bcol"], "full")
    sums = both.agg(F.count("e").alias("n"), F.count(F.when(F.col("e") == F.col("a"), 1)).alias("right"), F.count(F.when(F.col("e").isNull(), 1)).alias("extra"))
    share = F.coalesce(F.try_divide(F.col("right"), F.col("n")), F.lit(0.0))
    return sums.select(F.when(F.col("extra") > 0, share * 0.8).otherwise(share).alias("score"))


def random_blocks(spark: SparkSession, n: int, m: int, count: int, top: int, seed: int = 0) -> DataFrame:
    """count distinct random block places of an n x n matrix with uniform values 0..top-1 (a test source)."""
    side = n // m
    if count > side * side:
        raise ValueError("more blocks than places")
    places = spark.range(side * side).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count)
    data = F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), lambda p: F.pmod(F.xxhash64(F.col("id"), p, F.lit(seed + 1)), F.lit(top)))
    return places.select(_div(F.col("id"), side).cast("int").alias("brow"), (F.col("id") % side).cast("int").alias("bcol"), data.alias("data"))

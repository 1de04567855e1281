"""Command line: python -m tessera classify|inspect|multiply|square|truss|influencers ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import written
from tessera.operators import blocks, influence, ranges
from tessera.operators.components import component_members, components
from tessera.operators.truss import truss, truss_sweep
from tessera.sources import adjacency, blockmatrix, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="task", required=True)
    p = sub.add_parser("classify", help="range id and slot of each key")
    p.add_argument("ranges")
    p.add_argument("keys")
    p.add_argument("out")
    p.add_argument("--most", type=int)
    p.add_argument("--strict", action="store_true")
    p = sub.add_parser("multiply", help="product of two block matrices")
    p.add_argument("left")
    p.add_argument("right")
    p.add_argument("out")
    p = sub.add_parser("square", help="upper triangle of the square of a symmetric block matrix")
    p.add_argument("matrix")
    p.add_argument("out")
    p.add_argument("--semiring", default="plus_times")
    for p in (sub.choices["multiply"], sub.choices["square"]):
        p.add_argument("--parts", action="store_true", help="write a folder of parts instead of one file")
    p = sub.add_parser("inspect", help="print what a file holds")
    p.add_argument("kind", choices=("ranges", "keys", "blocks", "graph"))
    p.add_argument("path")
    p.add_argument("--offsets")
    p.add_argument("--width", type=int, default=2)
    p.add_argument("--most", type=int, default=20, help="how many lines")
    for name in ("truss", "influencers"):
        p = sub.add_parser(name)
        p.add_argument("--graph", required=True)
        p.add_argument("--offsets", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--startk", type=int, required=True)
        p.add_argument("--endk", type=int, required=True)
        p.add_argument("--verbose", type=int, default=0)
        p.add_argument("--p", type=int, default=-1)
    return top


def inspected(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """value: a line for each range, key, block or vertex of a file, in order."""
    if a.kind == "ranges":
        return text.range_inspection(text.read_ranges(spark, a.path))
    if a.kind == "keys":
        return text.key_inspection(text.read_keys(spark, a.path, a.most))
    if a.kind == "blocks":
        return text.block_inspection(blockmatrix.read_blocks(spark, a.path, a.width))
    return text.graph_inspection(*adjacency.read_adjacency(spark, a.path, a.offsets))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.task == "classify":
        found = ranges.classify(text.read_keys(spark, a.keys, a.most), text.read_ranges(spark, a.ranges), a.strict)
        ranges.partition_sort(found).write.mode("overwrite").parquet(a.out)
    elif a.task == "inspect":
        for r in inspected(spark, a).limit(a.most).collect():
            print(r["value"])
    elif a.task == "multiply":
        n, m, _ = blockmatrix.header(a.left)
        x, y = (blockmatrix.read_blocks(spark, p, 2) for p in (a.left, a.right))
        product = blocks.multiply_blocks(x, y, m).where(F.exists("data", lambda v: v != 0))
        blockmatrix.write_blocks(product, a.out, n, m, 4, single=not a.parts)
    elif a.task == "square":
        n, m, _ = blockmatrix.header(a.matrix)
        half = blockmatrix.read_blocks(spark, a.matrix, 1)
        if not blocks.duplicates(half).isEmpty():
            raise ValueError("a block is given twice")
        whole = written(blocks.mirror_blocks(half, m), "mirrored")
        if a.semiring == "plus_times":
            # rows times rows: blocks on the diagonal needn't be symmetric
            square = blocks.multiply_blocks(whole, blocks.transpose_blocks(whole, m), m, cap=blocks.U16, upper=True).where(F.exists("data", lambda v: v != 0))
        else:  # absent elements take no part in the other semirings
            square = blocks.to_blocks(blocks.square_upper(blocks.to_coo(whole, m).toDF("i", "k", "x"), m, a.semiring), m)
        blockmatrix.write_blocks(square, a.out, n, m, 2, single=not a.parts)
    else:
        edges, vertices = adjacency.read_adjacency(spark, a.graph, a.offsets)
        if a.task == "truss":
            flags = truss_sweep(edges, a.startk, a.endk)
            text.write_lines(text.flag_lines(flags, joined=not a.verbose), a.out)
            for r in flags.where("found = 1").orderBy("k").collect() if a.verbose else ():
                labels = components(truss(edges, r["k"]).toDF("a", "b"))
                text.write_lines(text.component_lines(component_members(labels)), f"{a.out}-k{r['k']}")
        else:
            found = influence.influencers(edges, vertices, a.endk, a.p)
            reach = influence.influencer_reach(edges, vertices, a.endk, a.p) if a.verbose else None
            text.write_lines(text.influencer_lines(found, reach), a.out)


if __name__ == "__main__":
    main()

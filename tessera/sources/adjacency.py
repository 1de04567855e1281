"""Data source ``adjacency``: a graph file (n, m, then per vertex id, degree, neighbours; int32) and its offsets file.

Options: path; offsets, the file of n byte offsets, whose entries are the points at which reading splits; vertices, the
vertices of a partition.  Rows are (src, dst), both directions as stored.  ``isolated`` vertices give (src, null).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.operators.graph import normalise
from tessera.sources import files

SCHEMA = "src bigint, dst bigint"


@dataclass
class _Part(InputPartition):
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.offsets = options["path"], options["offsets"]
        self.vertices = int(options.get("vertices", 65536))
        self.isolated = options.get("isolated", "false").lower() == "true"

    def partitions(self) -> list[_Part]:
        n = int(np.frombuffer(files.read(self.path, 0, 4), "<i4")[0])
        starts = [int(np.frombuffer(files.read(self.offsets, 4 * v, 4), "<i4")[0]) for v in range(0, n, self.vertices)]
        return [_Part(a, b) for a, b in zip(starts, [*starts[1:], files.size(self.path)], strict=True)] or [_Part(8, 8)]

    def read(self, part: _Part) -> Iterator[tuple]:
        data, at = np.frombuffer(files.read(self.path, part.begin, part.end - part.begin), "<i4"), 0
        while at < len(data):
            vertex, degree = int(data[at]), int(data[at + 1])
            if not degree and self.isolated:
                yield vertex, None
            for other in data[at + 2 : at + 2 + degree].tolist():
                yield vertex, other
            at += 2 + degree


class AdjacencySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "adjacency"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_adjacency(spark: SparkSession, path: str, offsets: str, vertices: int = 65536) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) and vertices (id)."""
    spark.dataSource.register(AdjacencySource)
    rows = spark.read.format("adjacency").options(path=path, offsets=offsets, vertices=vertices, isolated="true").load()
    return normalise(rows.where("dst IS NOT NULL"), "src", "dst"), rows.selectExpr("src AS id").distinct()


def read_adjacency_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """edges and vertices of the text form: ``n m``, then lines ``id degree neighbours``."""
    from pyspark.sql import functions as F

    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").cast("array<bigint>").alias("p"), F.monotonically_increasing_id().alias("line"))
    head = parts.agg(F.min("line")).first()[0]
    body = parts.where((F.col("line") > (head if head is not None else -1)) & (F.size("p") >= 2))
    edges = body.select(F.col("p")[0].alias("src"), F.explode(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(1)))).alias("dst"))
    return normalise(edges, "src", "dst"), body.select(F.col("p")[0].alias("id")).distinct()


def write_adjacency(edges: DataFrame, n: int, path: str, offsets: str) -> None:
    """Writes the two binary files of a graph that fits the driver (a test source)."""
    near: list[list[int]] = [[] for _ in range(n)]
    count = 0
    for u, v in edges.select("u", "v").toLocalIterator():
        near[u].append(v)
        near[v].append(u)
        count += 1
    at, starts = 8, []
    with files.create(path) as f:
        f.write(np.array([n, count], "<i4").tobytes())
        for v, others in enumerate(near):
            starts.append(at)
            record = np.array([v, len(others), *sorted(others)], "<i4").tobytes()
            f.write(record)
            at += len(record)
    with files.create(offsets) as f:
        f.write(np.array(starts, "<i4").tobytes())

"""Data source ``blockmatrix``: a file with n, m, k (int32) and k blocks (row, col int32; m*m little-endian elements).

Options: path; width, the bytes of an element (1, 2 or 4); records, the most blocks of a partition when reading
(whatever fits PART_BYTES if unset); n, m and single when writing.  Records have a fixed size, so reading splits the file
by seeking and a task holds READ_BYTES at a time.  Elements are clipped to their width.

Tasks write parts.  ``single``: the commit joins them behind the header, whose number of blocks is known only then, so one
process copies all bytes.  Otherwise the path is a folder of parts, blocks without a header, and the commit writes only
their list and the header: ``_blocks`` holds n, m, k and then the number of blocks and the name of each part.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tessera.sources import files

SCHEMA = "brow int, bcol int, data array<bigint>"
HEADER = 12
PART_BYTES, READ_BYTES = 128 << 20, 16 << 20
LIST = "_blocks"
_KINDS = {1: "<u1", 2: "<u2", 4: "<u4"}


def header(path: str) -> tuple[int, int, int]:
    """n, m and k."""
    if files.exists(f"{path}/{LIST}"):
        n, m, k = _listed(path)[0]
        return n, m, k
    return struct.unpack("<3i", files.read(path, 0, HEADER))


def _listed(path: str) -> list[list]:
    """n, m, k; then the number of blocks and the name of each part of a folder."""
    name = f"{path}/{LIST}"
    return json.loads(files.read(name, 0, files.size(name)))


def file_bytes(m: int, k: int, width: int) -> int:
    return HEADER + k * (8 + width * m * m)


@dataclass
class _Part(InputPartition):
    path: str
    begin: int
    count: int
    m: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.width = options["path"], int(options.get("width", 2))
        self.records = int(options.get("records", 0))

    def partitions(self) -> list[_Part]:
        _, m, k = header(self.path)
        one = 8 + self.width * m * m
        if files.exists(f"{self.path}/{LIST}"):
            held = [(f"{self.path}/{name}", 0, count) for count, name in _listed(self.path)[1:]]
        else:
            held = [(self.path, HEADER, k)]
        most = self.records or max(1, PART_BYTES // one)
        parts = []
        for path, begin, count in held:
            if files.size(path) != begin + count * one:
                raise ValueError(f"{path} has another size than its header says")
            parts += [_Part(path, begin + a * one, min(most, count - a), m) for a in range(0, count, most)]
        return parts or [_Part(self.path, 0, 0, m)]

    def read(self, part: _Part) -> Iterator[tuple]:
        m = part.m
        one = 8 + self.width * m * m
        step = max(1, READ_BYTES // one)
        for first in range(0, part.count, step):
            data = files.read(part.path, part.begin + first * one, min(step, part.count - first) * one)
            for at in range(0, len(data), one):
                row, col = struct.unpack_from("<2i", data, at)
                yield row, col, np.frombuffer(data, _KINDS[self.width], m * m, at + 8).tolist()


@dataclass
class _Written(WriterCommitMessage):
    path: str
    count: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.width = options["path"], int(options.get("width", 4))
        self.n, self.m, self.single = int(options["n"]), int(options["m"]), options.get("single", "true") == "true"

    def write(self, rows: Iterator[Row]) -> _Written:
        name, top, count = uuid.uuid4().hex, (1 << 8 * self.width) - 1, 0
        if not self.single:
            files.make_folder(self.path)
        part = f"{self.path}.{name}.part" if self.single else f"{self.path}/{name}"
        with files.create(part) as f:
            for r in rows:
                f.write(struct.pack("<2i", r.brow, r.bcol) + np.clip(np.array(r.data, np.int64), 0, top).astype(_KINDS[self.width]).tobytes())
                count += 1
        return _Written(part, count)

    def commit(self, messages: list[_Written | None]) -> None:
        done = [x for x in messages if x]
        if not self.single:
            files.make_folder(self.path)
            rows = [[self.n, self.m, sum(x.count for x in done)], *([x.count, x.path.rsplit("/", 1)[1]] for x in done)]
            with files.create(f"{self.path}/{LIST}") as f:
                f.write(json.dumps(rows).encode())
            return
        with files.create(self.path) as f:
            f.write(struct.pack("<3i", self.n, self.m, sum(x.count for x in done)))
            for x in done:
                left, at = files.size(x.path), 0
                while at < left:
                    f.write(files.read(x.path, at, min(1 << 24, left - at)))
                    at += 1 << 24
        self.abort(done)

    def abort(self, messages: list[_Written | None]) -> None:
        for x in messages:
            if x:
                files.delete(x.path)


class BlockMatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockmatrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def read_blocks(spark: SparkSession, path: str, width: int = 2, records: int = 0) -> DataFrame:
    spark.dataSource.register(BlockMatrixSource)
    return spark.read.format("blockmatrix").options(path=path, width=width, records=records).load()


def write_blocks(blocks: DataFrame, path: str, n: int, m: int, width: int = 4, single: bool = True) -> None:
    """Blocks in the order of (brow, bcol), in one file or in a folder of parts (for large matrices)."""
    blocks.sparkSession.dataSource.register(BlockMatrixSource)
    ordered = blocks.select("brow", "bcol", "data").orderBy("brow", "bcol")
    ordered.write.format("blockmatrix").options(path=path, n=n, m=m, width=width, single=str(single).lower()).mode("append").save()

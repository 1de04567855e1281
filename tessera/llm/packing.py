"""Packing of documents into sequences of a fixed capacity with minimum bin slack.

Each partition packs its own rows while it reads them, so nothing is shuffled.  A document longer than the capacity
gives full sequences and a remainder.  Remainders wait in a pool of bounded size.  For each sequence the largest
remainder is fixed, and a subset-sum dynamic program on bitsets over the distinct remaining lengths, each with its
count, finds the multiset that comes closest to the capacity; walking the stored bitsets back gives the counts.  Where
even the best multiset leaves slack, one more document is cut to fill it.  What is left at the end of a partition is
laid end to end; its last part is cut into sequences whose lengths are powers of two, which need no padding.

Sequence ids are the partition's number times 2^33 plus a running number: unique, and the same when a lost partition
is computed again, if a partition is always the same rows in the same order: so it is for files, which the query and the
pipeline read; other inputs should be written first.

Defined results: null text counts as empty and an empty document is its closing id alone; repeated rows are packed as
often as they occur; very long texts give many full sequences; a null doc_id is carried along; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe_automaton import automaton, default_path
from tessera.llm.common import load

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CAPACITY, CLOSING_ID, POOL = 2048, 1, 1024


def best_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum comes closest to room without passing it.

    Bitset subset-sum: bit s of ``reach`` says that the sum s can be had from the lengths seen so far.
    """
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        layers.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            reach |= (reach << length) & mask
        if reach >> room & 1:
            break
    target, take = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> target & 1:
            target -= length
            n += 1
        if n:
            take[length] = n
    return take


class Packer:
    """Packs (doc_id, ids) documents; full sequences' pieces gather in ``rows``."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, deque] = defaultdict(deque)  # by length
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        while n - start >= self.capacity:
            self._close([(doc_id, ids, start, self.capacity, n)])
            start += self.capacity
        if start < n:
            self._wait((doc_id, ids[4 * start :], start, n - start, n))
        while self.waiting > POOL:
            self._fill()

    def _wait(self, piece: tuple) -> None:
        self.pool[piece[3]].append(piece)
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        line = self.pool[length]
        piece = line.popleft()
        if not line:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, ids, start, length, n in pieces:
            skip = start if len(ids) == 4 * n else 0  # full documents carry all their ids
            self.rows.append((doc_id, start, length, crc32(ids[4 * skip : 4 * (skip + length)]), n, self.sequence, at))
            at += length
        self.sequence += 1

    def _cut(self, piece: tuple, length: int) -> tuple[tuple, tuple]:
        doc_id, ids, start, n, whole = piece
        return (doc_id, ids[: 4 * length], start, length, whole), (doc_id, ids[4 * length :], start + length, n - length, whole)

    def _fill(self) -> None:
        pieces = [self._take(max(self.pool))]
        room = self.capacity - pieces[0][3]
        for length, n in best_multiset({k: len(v) for k, v in self.pool.items()}, room).items():
            pieces += [self._take(length) for _ in range(n)]
            room -= n * length
        if room and self.pool:
            head, tail = self._cut(self._take(max(self.pool)), room)
            pieces.append(head)
            self._wait(tail)
        self._close(pieces)

    def finish(self) -> None:
        while self.waiting and sum(k * len(v) for k, v in self.pool.items()) >= self.capacity:
            self._fill()
        line = deque(self._take(max(self.pool)) for _ in range(self.waiting))
        rest = sum(p[3] for p in line)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            pieces = []
            while size:
                piece = line.popleft()
                if piece[3] > size:
                    piece, tail = self._cut(piece, size)
                    line.appendleft(tail)
                size -= piece[3]
                pieces.append(piece)
            self._close(pieces)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    capacity must be a power of two.
    """
    closing = closing_id.to_bytes(4, "little")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = automaton(vocabulary or default_path())
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), bpe.encode_all(t.as_py() for t in b.column(1)), strict=True):
                packer.add(doc_id, ids + closing)
            if packer.rows:
                yield batch(packer.rows)
                packer.rows = []
        packer.finish()
        if packer.rows:
            yield batch(packer.rows)

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return src.mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))

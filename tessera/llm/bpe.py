"""BPE encoding and decoding of whole texts with the tokenization automaton.

A map-only plan: each batch of texts is encoded and decoded where it was read; nothing is shuffled or broadcast, and
each Python worker compiles the automaton once.

Defined results: null and empty texts have no ids, and decode to the empty text; very long words cost time in
proportion to their length; repeated rows each give a row; a null doc_id is carried along; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe_automaton import automaton, default_path
from tessera.llm.common import load


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int): the general interface."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = automaton(vocabulary or default_path())
        for b in batches:
            ids = [memoryview(bpe.encode(t)).cast("I").tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text: decodes what encode() returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = automaton(vocabulary or default_path())
        for b in batches:
            texts = [" ".join([bpe.label[i] for i in ids or ()]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = automaton(vocabulary or default_path())
        for b in batches:
            n, a, z = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids) // 4)
                a.append(sha256(ids).hexdigest())
                z.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))

"""Suffix-array dedup by a depth-limited radix sort.

Only the order of suffixes down to the threshold (``window`` tokens) matters: windows that are equal to that depth are
exactly the repeated ones.  Sorting every suffix would move many times the corpus, so the sort goes by digits, most
significant first, and each pass goes on only with groups that can still hold equal windows:

* digit 1, the minimiser.  A window belongs to the ``digit`` tokens inside it with the smallest hash (the leftmost of
  equals).  That depends on the window's tokens alone, so equal windows belong to equal minimisers at equal distances.
  The windows of one minimiser occurrence are one range, held in one row; rows whose minimiser is unique are done.
* digit 2, the range's tokens.  Rows of a group with equal tokens have all their windows repeated and are settled; one
  of them stands for all from here on.  If a group has several kinds of rows, one row of each kind goes on.
* digit 3, blocks of ``block`` distances: the tokens that all windows of a block share are the digit; rows of a group
  with equal tokens are settled as before, and one of each kind goes on where there are several kinds.
* digit 4, single windows, by a 128-bit hash.

Each pass is an aggregation with partial sums on the map side (groups of copies collapse before they move) and an
equi-join of rows with settled or open kinds, whose large partitions adaptive execution splits; passes 3 and 4 and the
result fetch the texts of the documents concerned by an equi-join.  No group is gathered in one task.

Tokens are UTF-8 bytes (BYTES: 400 of them repeat) or words (WORDS: 50 of them; white space between words doesn't
matter, a word is its 64-bit hash).  Defined results: null counts as empty; texts under a window lose nothing;
overlapping repeats count; long texts are read in overlapping buffers and cost time and memory in proportion to their
length; rows that repeat a doc_id are documents of their own (they are told apart by their text; equal rows are
repeats of each other); a null doc_id is carried along; extra columns are ignored by ``repeats`` and kept by ``strip``,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest, xxh3_64_intdigest, xxh3_128_digest

from tessera.functions.storage import Step
from tessera.llm.common import claim, dropped, fewer, load, whole_rows, written

_BUFFER, _BITS = 1 << 19, 21  # tokens hashed at a time; bits that hold a place in them
_PLACE = np.uint64((1 << _BITS) - 1)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Tokens:
    """What windows are made of.  window, digit and block count tokens; digit is a power of two."""

    window: int
    digit: int
    block: int
    words: bool = False

    @property
    def width(self) -> int:
        """Bytes of a token in a stream."""
        return 8 if self.words else 1

    @property
    def least(self) -> int:
        """Bytes of the shortest text that holds a window."""
        return 2 * self.window - 1 if self.words else self.window

    def stream(self, text: bytes | None) -> bytes:
        return b"".join(map(xxh3_64_digest, (text or b"").split())) if self.words else text or b""

    def hashes(self, stream: bytes) -> np.ndarray:
        return np.frombuffer(stream, np.uint64).copy() if self.words else _TABLE[np.frombuffer(stream, np.uint8)]

    def cut(self, text: bytes | None, ranges: list[dict] | None) -> tuple[bytes, int]:
        """The text without the tokens of the ranges' windows, and the number of maximal runs removed."""
        text, spans = text or b"", _spans(ranges, self.window)
        if self.words and spans:  # white space goes with the word before it
            at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
            places = [(at[a], at[b]) for a, b in spans]
        else:
            places = spans
        done, kept = 0, []
        for a, b in places:
            kept.append(text[done:a])
            done = b
        kept.append(text[done:])
        return b"".join(kept), len(spans)


BYTES, WORDS = Tokens(400, 128, 16), Tokens(50, 16, 8, True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ranges(buf: bytes, spans: list[tuple[int, int]], tokens: Tokens = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows inside each span of the stream: place of the minimiser, first and last window that belong to it."""
    window, digit = tokens.window, tokens.digit
    n = len(buf) // tokens.width - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = tokens.hashes(buf)
    step = 1
    while step < digit:  # digit is a power of two
        h = h[:-step] * _MIX + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    h = (h * _MIX) & ~_PLACE | np.arange(len(h), dtype=np.uint64)
    width, step = window - digit + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if width > step:
        h = np.minimum(h[: n], h[width - step : width - step + n])
    place = (h[:n] & _PLACE).astype(np.int64)
    valid, edge = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    for a, b in spans:
        if b - a >= window:
            valid[a : b - window + 1] = True
            edge[a] = edge[b - window + 1] = True
    edge[0] = True
    edge[1:n] |= place[1:] != place[:-1]
    first = np.flatnonzero(edge[:n])
    last = np.append(first[1:], n) - 1
    keep = valid[first]
    return place[first[keep]], first[keep], last[keep]


def _segments(streams: list[bytes], tokens: Tokens = BYTES) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of about _BUFFER tokens, with (begin, end, document, place in the document); long texts overlap by a window."""
    parts: list[bytes] = []
    spans: list[tuple[int, int, int, int]] = []
    size, w = 0, tokens.width
    for i, t in enumerate(streams):
        for at in range(0, max(1, len(t) // w - tokens.window + 1), _BUFFER):
            part = t[at * w : (at + _BUFFER + tokens.window - 1) * w]
            n = len(part) // w
            if n < tokens.window:
                continue
            spans.append((size, size + n, i, at))
            parts.append(part)
            size += n
            if size >= _BUFFER:
                yield b"".join(parts), spans
                parts, spans, size = [], [], 0
    if parts:
        yield b"".join(parts), spans


def _first(tokens: Tokens) -> Step:
    w, window, digit = tokens.width, tokens.window, tokens.digit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none", lambda: None)
        for b in batches:
            streams = [tokens.stream(x.as_py()) for x in b.column(2)]
            for buf, spans in _segments(streams, tokens):
                place, lo, hi = ranges(buf, [s[:2] for s in spans], tokens)
                which = np.searchsorted([s[0] for s in spans], lo, "right") - 1
                base = np.array([s[3] - s[0] for s in spans], np.int64)[which]
                doc = np.array([s[2] for s in spans], np.int64)[which]
                pairs = list(zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True))
                key = [_signed(xxh3_64_intdigest(buf[p * w : (p + digit) * w])) for p, _, _ in pairs]
                sub = [xxh3_128_digest(buf[a * w : (z + window) * w] + (p - a).to_bytes(4, "little")) for p, a, z in pairs]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(key, pa.int64()), pa.array(sub, pa.binary()), *[pa.array(x + base, pa.int32()) for x in (place, lo, hi)]], _NAMES
                )

    return run


def _blocks(tokens: Tokens) -> Step:
    w, window, block = tokens.width, tokens.window, tokens.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t, out = tokens.stream(b.column(2)[i].as_py()), []
                for r in b.column(3)[i].as_py():
                    p, lo, hi = r["p"], r["lo"], r["hi"]
                    for d in range((p - hi) // block * block, p - lo + 1, block):
                        near, far = max(d, p - hi), min(d + block - 1, p - lo)
                        shared = t[(p - d) * w : (p - d - block + 1 + window) * w] + d.to_bytes(4, "little")
                        every = t[(p - far) * w : (p - near + window) * w] + bytes((near - d, far - d))
                        out.append((_signed(xxh3_64_intdigest(shared)), xxh3_128_digest(every), p, p - far, p - near))
                if out:
                    yield _made(b, i, out)

    return run


def _windows(tokens: Tokens) -> Step:
    w, window = tokens.width, tokens.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t, out = tokens.stream(b.column(2)[i].as_py()), []
                for r in b.column(3)[i].as_py():
                    for at in range(r["lo"], r["hi"] + 1):
                        h = xxh3_128_digest(t[at * w : (at + window) * w])
                        out.append((_signed(int.from_bytes(h[:8], "little")), h, r["p"], at, at))
                if out:
                    yield _made(b, i, out)

    return run


_NAMES = ["did", "th", "k", "sub", "p", "lo", "hi"]
_SCHEMA = "did long, th long, k long, sub binary, p int, lo int, hi int"


def _made(b: pa.RecordBatch, i: int, out: list[tuple]) -> pa.RecordBatch:
    k, sub, p, lo, hi = zip(*out, strict=True)
    n = len(out)
    return pa.RecordBatch.from_arrays(
        [pa.array([b.column(0)[i].as_py()] * n, pa.int64()), pa.array([b.column(1)[i].as_py()] * n, pa.int64()), pa.array(k, pa.int64()), pa.array(sub, pa.binary()), *[pa.array(x, pa.int32()) for x in (p, lo, hi)]], _NAMES
    )


def _table(df: DataFrame, name: str, step: Step | None = None) -> DataFrame:
    return written(df, name, few=True, workers=True, step=step, schema=_SCHEMA if step else None)


def _pass(texts: DataFrame, step: Step, name: str) -> tuple[DataFrame, DataFrame]:
    """Settled ranges (did, th, lo, hi), and one range of each kind of the groups that have several kinds (with p)."""
    rows = _table(texts, f"{name}-rows", step)
    # tables, so that both sides of the joins are exchanges and a hot key's rows can be split
    many = _table(rows.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k"), f"{name}-many")
    held = _table(rows.join(many, "k"), f"{name}-held")
    dropped(rows)
    dropped(many)
    kinds = _table(held.groupBy("k", "sub").agg(F.count("*").alias("m"), F.min(F.struct("did", "th", "p", "lo", "hi")).alias("one")), f"{name}-kinds")
    settled = _table(held.join(kinds.where("m > 1").select("k", "sub"), ["k", "sub"]).select("did", "th", "lo", "hi"), f"{name}-settled")
    dropped(held)
    several = _table(kinds.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k"), f"{name}-several")
    return settled, kinds.join(several, "k").select("one.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """did, th, text: doc_id (null as the smallest long) and a hash of the text tell documents apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def _with_ranges(texts: DataFrame, ranges: DataFrame, fields: tuple[str, ...], how: str = "inner") -> DataFrame:
    each = ranges.groupBy("did", "th").agg(F.collect_set(F.struct(*fields)).alias("ranges"))
    return texts.join(each, ["did", "th"], how)


def repeated(docs: DataFrame, tokens: Tokens = BYTES) -> DataFrame:
    """Ranges of repeated windows: did, th, lo, hi (places of the first token of the first and last window)."""
    texts = _keyed(docs)
    long = texts.where(F.octet_length("text") >= tokens.least)
    done, open_ = _pass(long.select("did", "th", "text"), _first(tokens), "digit1")
    for name, split in (("digit3", _blocks), ("digit4", _windows)):
        # the kinds that go on are distinct rows, so a document's list is bounded by its length
        settled, open_ = _pass(_with_ranges(long, open_, ("p", "lo", "hi")).select("did", "th", "text", "ranges"), split(tokens), name)
        done = done.unionByName(settled)
    return done


def _spans(ranges: list[dict] | None, window: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + window)
        else:
            out.append([lo, hi + window])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left), one row per input row.

    n_bytes counts the bytes of the input text; characters cut in two are not in the column text, only in the digest.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ranges in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py() or b""
                rest, spans = BYTES.cut(text, ranges.as_py())
                out.append((len(text), len(text) - len(rest), spans, sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            n, gone, spans, sha, left = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, spans)], pa.array(sha, pa.string()), pa.array(left, pa.string())], names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = _keyed(docs).withColumn("none", F.col("did") == -(1 << 63))
    doc_id = F.when(~F.col("none"), F.col("did")).alias("doc_id")
    return fewer(_with_ranges(texts, repeated(docs), ("lo", "hi"), "left").select(doc_id, "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"))


def strip(docs: DataFrame, tokens: Tokens = WORDS) -> DataFrame:
    """docs without the repeated tokens; characters cut in two go too, and n_chars (if there) counts what is left."""
    schema, names = docs.schema, docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.column(0).flatten()
            texts = [None if t is None else tokens.cut(t.encode(), r.as_py())[0].decode("utf-8", "ignore") for t, r in zip(cols[at].to_pylist(), b.column(1), strict=True)]
            cols[at] = pa.array(texts, pa.string())
            if chars >= 0:
                cols[chars] = pa.array([len(t or "") for t in texts], pa.int64()).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    keyed = whole_rows(docs).select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64("row.text").alias("th"))
    return _with_ranges(keyed, repeated(docs.select("doc_id", "text"), tokens), ("lo", "hi"), "left").select("row", "ranges").mapInArrow(run, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(load(spark, sf_dir, "documents"))

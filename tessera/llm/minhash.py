"""MinHash near-dedup: universal hash minima, banding, signature verification, exact check, connected components.

1. Each text gives its set of distinct word shingles (64-bit hashes) and HASHES minima of universal hash functions,
   of which 16 bits are kept.  Texts with equal sets (128-bit hash) are one class; only one document of a class, that
   with the smallest id, goes on.  Copies, however many, are collapsed by partial aggregation.
2. The minima are cut into BANDS bands of ROWS; classes that share a band are in one bucket.  At similarity 0.8 a pair
   shares none of 40 bands of 5 with probability (1 - 0.8^5)^40 = 1.2e-7.
   A set of fewer than 4 shingles can only be linked to an equal one, so it isn't banded at all.
3. Round one compares the members of each bucket with two centres, its smallest and largest id: as many pairs as
   members.  Pairs pass the size bound, the share of equal minima (0.8 less five standard errors), then the exact
   check on the full sets; the links found give components.
4. Round two looks at buckets whose members are in several components and compares members of different components:
   inside the bucket, block by block, or, where a large component is one side, with that component's members, block
   by block.  A link between two of one component is no news, so no link between different components is lost.
5. Components by alternating large-star and small-star over all links.

No bucket is gathered in one task: all steps are comparisons of bounded blocks, aggregations with partial sums, or
equi-joins whose large partitions adaptive execution splits.  Texts travel only for members of buckets with several members.

Defined results: null texts and texts without words have an empty set and are linked with nothing; rows that share a
doc_id are one document; rows with a null doc_id are linked with nothing and their component_id is null; very long
texts are read whole, with memory in proportion to their words; extra columns, whatever their names, are ignored by
``near_duplicates`` and kept by ``keep_representatives``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from tessera.llm.common import claim, dropped, load, whole_rows, written
from tessera.operators.components import components

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
LARGE, X_BLOCK, Y_BLOCK, BLOCK = 32, 512, 256, 1024  # classes from which a component counts as large; block sizes
SALTS = 64  # parts of a component in joins on it
MARGIN = 5 * (0.8 * 0.2 / HASHES) ** 0.5
_draw = np.random.default_rng(7919)
_A = _draw.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, HASHES, np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORDS: dict[bytes, int] = {}


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; A-Z lower-cased, words split at white space."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    claim("words", _WORDS.clear)
    get, put = _WORDS.get, _WORDS.setdefault
    h = np.array([get(w) or put(w, xxh3_64_intdigest(w)) for w in words], np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for i in range(min(size, len(h))):
        out = out * _M1 + h[i : i + n]
        out ^= out >> np.uint64(32)
        out *= _M2
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of each universal hash function."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _A + _B).min(0))
    return (least >> np.uint64(48) ^ least >> np.uint64(20)).astype(np.uint16)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, class (128-bit hash of the set; null if it is empty), minima (null if n < 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sig = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                key.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minima(s).tobytes() if len(s) >= 4 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "class", "minima"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, n long, class binary, minima binary")


def _similar(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sizes and minima allow a similarity of threshold percent."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("minima").alias(f"m{x}"))
    least = threshold / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
                yield b.filter(pa.array((x == y).mean(1) >= least)).select(["a", "b"])

    fits = F.greatest("na", "nb") * threshold <= F.least("na", "nb") * 100
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
    return joined.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for b in batches:
            keep = []
            ids = b.column(0).to_pylist()
            for i, a in enumerate(ids):
                if a != last:
                    last, own = a, shingles(b.column(2)[i].as_py(), size)
                other = shingles(b.column(3)[i].as_py(), size)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= threshold * (len(own) + len(other) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _alike(some: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (a, b) of one bucket and different components whose minima allow the similarity.

    some: k, id, c, m (members of the bucket).  Buckets are compared in blocks of BLOCK members: the pairs of blocks i
    and j in group (i, j), so that a task holds two blocks at most and pairs that aren't alike never become rows.
    """
    least = threshold / 100 - MARGIN
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int")
    dealt = some.select("k", "id", "c", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "c").join(classes.select("id", "n", "minima"), "id")

    def pairs(rows: list[dict]) -> list[tuple[int, int]]:
        i, j = rows[0]["i"], rows[0]["j"]
        xs = [r for r in rows if r["own"] == i]
        ys = xs if i == j else [r for r in rows if r["own"] == j]
        if len(rows) < 2 or not ys:
            return []
        table = lambda rs: np.frombuffer(b"".join(r["minima"] for r in rs), np.uint16).reshape(-1, HASHES)
        my, cy, ny, out = table(ys), np.array([r["c"] for r in ys]), np.array([r["n"] for r in ys]), []
        for at, (x, mine) in enumerate(zip(xs, table(xs), strict=True)):
            first = at + 1 if i == j else 0
            fits = (cy[first:] != x["c"]) & (np.minimum(ny[first:], x["n"]) * 100 >= np.maximum(ny[first:], x["n"]) * threshold)
            near = np.flatnonzero(fits)
            near = near[(my[first:][near] == mine).mean(1) >= least] if len(near) else near
            out += [(min(x["id"], y), max(x["id"], y)) for y in (ys[first + k]["id"] for k in near.tolist()) if x["id"] != y]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, seen = None, [], set()

        def flush(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            fresh = [p for p in dict.fromkeys(found) if p not in seen]
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(fresh)
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*fresh, strict=True)], ["a", "b"])

        for b in batches:
            for r in b.to_pylist():
                key = (r["k"], r["i"], r["j"])
                if key != last and rows:
                    yield from flush(pairs(rows))
                    rows = []
                last = key
                rows.append(r)
        if rows:
            yield from flush(pairs(rows))

    together = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "id")
    return together.select("k", "i", "j", "own", "id", "c", "n", "minima").mapInArrow(run, "a long, b long").distinct()


def _with_components(asked: DataFrame, found: DataFrame, sizes: DataFrame, classes: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links (a, b) of documents x with members of components c, for the rows (x, c) of asked.

    Members and documents of a component are dealt into blocks of bounded size and each pair of blocks is compared in
    one task, so a component's pairs never become rows.  A document that is linked with a block needs no more of it.
    """
    least = threshold / 100 - MARGIN
    cuts = asked.groupBy("c").agg(F.ceil(F.count("*") / X_BLOCK).cast("int").alias("xs")).join(sizes.where(F.col("size") > LARGE).withColumnRenamed("component", "c"), "c")
    # salted: whichever side adaptive execution streams, a giant component's rows lie in many keys
    cuts = cuts.select("c", "xs", F.ceil(F.col("size") / Y_BLOCK).cast("int").alias("ys"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cuts = written(cuts, "cuts", few=True)
    salted = lambda rows, by: rows.withColumn("salt", F.pmod(F.xxhash64(by, F.lit(5)), F.lit(SALTS)).cast("int")).join(cuts, ["c", "salt"])
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    full = classes.select("id", "n", "minima").join(texts, "id")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    xs = salted(asked, "x").select("c", F.col("x").alias("id"), F.pmod(F.xxhash64("x"), F.col("xs")).cast("int").alias("xb"), upto("ys").alias("yb")).join(full, "id").select("c", "xb", "yb", "id", "minima", "text")
    ys = salted(found.withColumnRenamed("component", "c"), "id").select("c", "id", upto("xs").alias("xb"), dealt("ys").alias("yb")).join(full, "id").select(*[F.col(n).alias(n) for n in ("c", "xb", "yb", "id", "minima", "text")])

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = [], []
        if x.num_rows and y.num_rows:
            mx, my = (np.frombuffer(b"".join(t["minima"].to_pylist()), np.uint16).reshape(-1, HASHES) for t in (x, y))
            ids, sets = y["id"].to_pylist(), [shingles(t, size) for t in y["text"].to_pylist()]
            for i, (own, text) in enumerate(zip(x["id"].to_pylist(), x["text"].to_pylist(), strict=True)):
                alike = (my == mx[i]).mean(1)
                mine = None
                for j in np.argsort(-alike, kind="stable").tolist():
                    if alike[j] < least:
                        break
                    mine = shingles(text, size) if mine is None else mine
                    both = len(np.intersect1d(mine, sets[j], assume_unique=True))
                    if 100 * both >= threshold * (len(mine) + len(sets[j]) - both):
                        a.append(own)
                        b.append(ids[j])
                        break
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = ["c", "xb", "yb"]
    return xs.groupBy(*keys).cogroup(ys.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def _ordered(x: str, y: str, pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per input row.  threshold: per cent of Jaccard similarity."""
    if not 75 < threshold <= 100:
        raise ValueError("the banding is made for a similarity of 0.8 and more")
    each = written(sketches(docs, size), "sketches")
    classes = written(
        each.where("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("minima").alias("minima")), "classes", few=True
    )
    banded = classes.where("minima IS NOT NULL")
    bands = banded.select("id", F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("minima", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])).alias("k"))
    shared = bands.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members = written(bands.join(shared, "k"), "buckets", few=True)
    texts = written(
        docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).join(members.select("id").distinct(), "id"), "texts", few=True
    )

    stars = members.select("id", F.explode(F.array("low", "high")).alias("centre"))
    tried = written(_ordered("id", "centre", stars), "pairs", few=True)
    links = written(_linked(written(_similar(tried, banded, threshold), "similar"), texts, size, threshold), "links")
    found = written(components(links), "found", few=True)

    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    inside = members.select("k", "id").join(found, "id", "left").select("k", "id", F.coalesce("component", "id").alias("c"))
    inside = written(inside.join(sizes, F.col("c") == F.col("component"), "left").select("k", "id", "c", (F.coalesce("size", F.lit(1)) > LARGE).alias("large")), "inside", few=True)
    kinds = inside.groupBy("k", "c", "large").agg(F.count("*").alias("m"))
    mixed = kinds.groupBy("k").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("large"), 0).otherwise(F.col("m"))).alias("m")).where("kinds > 1").select("k", "m")
    some = written(inside.join(mixed, "k"), "mixed", few=True)
    more = written(_alike(some.where("NOT large"), banded, threshold).join(tried, ["a", "b"], "left_anti"), "pairs")
    again = written(_linked(more, texts, size, threshold), "links")
    large = some.where("large").select("k", F.col("c").alias("cy")).distinct()
    to_large = some.join(large, "k").where("c <> cy AND (NOT large OR c < cy)").select(F.col("id").alias("x"), F.col("cy").alias("c"))
    to_large = written(to_large.distinct(), "to-large", few=True)
    if not to_large.isEmpty():
        again = again.unionByName(written(_with_components(to_large, found, sizes, banded, texts, size, threshold), "links"))
    for x in (members, inside, some, texts, tried, more):
        dropped(x)
    if not again.isEmpty():
        found = written(components(links.unionByName(again)), "found", few=True)

    label = classes.select("class", "id").join(found, "id", "left").select("class", F.coalesce("component", "id").alias("component_id"))
    out = each.select("doc_id", "n", "class").join(label, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_representatives(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, all columns as they were."""
    kept = near_duplicates(docs, size, threshold).where("kept").select(F.col("doc_id").alias("id")).distinct()
    return whole_rows(docs).join(kept, F.col("row.doc_id").eqNullSafe(F.col("id"))).select("row.*")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), size=2)
